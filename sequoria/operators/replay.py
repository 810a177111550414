"""A replay of updates day by day: what each variant of an update would have ranked, on the same cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sequoria.functions import arrays as a


def variant_pairs(base: DataFrame, daily: DataFrame) -> DataFrame:
    """(variant, day, a, b, n): the pairs that a variant has added by the end of a day; the base's are of day -1.

    ``today`` adds none, ``all`` adds every pair of the updates, ``new`` those with an item
    that the base does not know. ``base``: a, b, n; ``daily``: day, a, b, n.
    """
    known = base.select(F.col("a").alias("item")).unionByName(base.select(F.col("b").alias("item"))).distinct().withColumn("_known", F.lit(True))
    side = lambda c: known.select(F.col("item").alias(c), F.col("_known").alias(f"_{c}"))
    marked = daily.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumn("_new", F.col("_a").isNull() | F.col("_b").isNull())
    variants = F.when(F.col("_new"), F.array(F.lit("all"), F.lit("new"))).otherwise(F.array(F.lit("all")))
    added = marked.select(F.explode(variants).alias("variant"), "day", "a", "b", "n")
    kept = base.select(F.explode(F.array(*map(F.lit, ("today", "all", "new")))).alias("variant"), F.lit(-1).cast(daily.schema["day"].dataType).alias("day"), "a", "b", "n")
    return kept.unionByName(added)


def replayed_ranks(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """(variant, day, case, rank): of each case's target among what followed its last item on earlier days, by count, then item.

    ``pairs`` as from ``variant_pairs``; ``cases``: day, case, last, target. A target that
    never followed has no rank. Only items that are asked for meet their pairs: a row for
    each (variant, day, last) and item after it.
    """
    asked = cases.select(F.col("day").alias("on"), F.col("last").alias("a")).distinct()
    counts = asked.join(pairs, "a").filter("day < on").groupBy("variant", "on", "a", "b").agg(F.sum("n").alias("n"))
    placed = counts.withColumn("rank", F.row_number().over(Window.partitionBy("variant", "on", "a").orderBy(F.desc("n"), "b")))
    variants = pairs.select("variant").distinct()
    wanted = cases.crossJoin(F.broadcast(variants))  # three variants
    found = placed.select("variant", F.col("on").alias("day"), F.col("a").alias("last"), F.col("b").alias("target"), "rank")
    return wanted.join(found, ["variant", "day", "last", "target"], "left").select("variant", "day", "case", "rank")


def replay_report(ranks: DataFrame, against: str = "today") -> DataFrame:
    """(variant, day, n, ndcg_10, difference, se): by day, and the paired difference to ``against`` with its standard error."""
    gains = ranks.select("variant", "day", "case", F.coalesce(a.gain(F.col("rank"), 10), F.lit(0.0)).alias("gain"))
    other = gains.filter(F.col("variant") == against).select("day", "case", F.col("gain").alias("_other"))
    paired = gains.join(other, ["day", "case"])
    d = F.col("gain") - F.col("_other")
    return paired.groupBy("variant", "day").agg(F.count("*").alias("n"), F.avg("gain").alias("ndcg_10"), F.avg(d).alias("difference"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se"))
