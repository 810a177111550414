"""Exact quantiles by selection: counts of value ranges narrow to the wanted ranks, so values are never gathered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sequoria.sources.tables import dropped, written

#: Parts that a range is cut into in a round, and rows of a range that are sorted at last.
BUCKETS, SORTED_ROWS = 1024, 100_000


def exact_quantiles(rows: DataFrame, value: str, points: Sequence[float], group: str | None = None, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """(point, value), by ``group`` if given: interpolated between the two values around each point; nulls do not count.

    Values are finite numbers. Each round is one pass that counts the values of the ranges
    that still hold a wanted rank, by part; a part's own least and greatest value are the
    next range. Ranges of one value, or of few rows, end it: those rows are sorted, each
    range on its own. A value that most rows have is a range of its own at once.
    """
    key = F.lit(0) if group is None else F.col(group)
    base = rows.filter(F.col(value).isNotNull()).select(key.alias("_g"), F.col(value).cast("double").alias("_x"))
    bounds = base.groupBy("_g").agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    place = F.col("point") * (F.col("_n") - 1)
    pointed = bounds.withColumn("point", F.explode(F.array(*(F.lit(float(p)) for p in points)))).withColumns({"_low": F.floor(place), "_high": F.ceil(place), "_part": place - F.floor(place)})
    asked = written(pointed)
    ranks = asked.select("_g", "_lo", "_hi", F.col("_n").alias("_size"), F.explode(F.array("_low", "_high")).alias("_rank")).distinct().withColumn("_below", F.lit(0).cast("long"))
    now = written(ranks)
    while now.filter(_open(sorted_rows)).limit(1).count():
        done, last = now.filter(~_open(sorted_rows)), now
        now = written(done.unionByName(_narrowed(base, now.filter(_open(sorted_rows)))))
        dropped(last)
    found = now.filter("_lo = _hi").select("_g", "_rank", F.col("_lo").alias("_value"))
    few = now.filter("_lo < _hi")
    w = Window.partitionBy("_g", "_from", "_to").orderBy("_x")
    placed = _in_ranges(base, few).withColumn("_at", F.row_number().over(w) - 1)
    rest = placed.join(few.select("_g", F.col("_lo").alias("_from"), F.col("_hi").alias("_to"), "_rank", (F.col("_rank") - F.col("_below")).alias("_at")), ["_g", "_from", "_to", "_at"])
    values = found.unionByName(rest.select("_g", "_rank", F.col("_x").alias("_value")))
    at = lambda rank, name: values.select("_g", F.col("_rank").alias(rank), F.col("_value").alias(name))
    joined = asked.join(at("_low", "_a"), ["_g", "_low"]).join(at("_high", "_b"), ["_g", "_high"])
    out = joined.select("_g", "point", F.when(F.col("_part") == 0, F.col("_a")).otherwise((1 - F.col("_part")) * F.col("_a") + F.col("_part") * F.col("_b")).alias("value"))
    return out.drop("_g") if group is None else out.withColumnRenamed("_g", group)


def _open(sorted_rows: int) -> Column:
    return (F.col("_lo") < F.col("_hi")) & (F.col("_size") > sorted_rows)


def _in_ranges(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``base`` in a range (_from, _to) of their group's; ranges of a group are disjoint, two for each point at most."""
    ranges = wanted.select("_g", "_lo", "_hi").distinct().groupBy("_g").agg(F.collect_list(F.struct("_lo", "_hi")).alias("_ranges"))
    held = F.get(F.filter("_ranges", lambda r: (r["_lo"] <= F.col("_x")) & (F.col("_x") <= r["_hi"])), F.lit(0))
    return base.join(ranges, "_g").select("_g", "_x", held.alias("_r")).filter("_r IS NOT NULL").select("_g", "_x", F.col("_r._lo").alias("_from"), F.col("_r._hi").alias("_to"))


def _narrowed(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with the part of its range that holds its rank."""
    # the least value is in the first part and the greatest in the last, so every part is smaller than its range
    part = F.least(F.floor((F.col("_x") - F.col("_from")) / (F.col("_to") - F.col("_from")) * BUCKETS), F.lit(BUCKETS - 1))
    counts = _in_ranges(base, wanted).groupBy("_g", "_from", "_to", part.alias("_bucket")).agg(F.count("*").alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    upto = F.sum("_c").over(Window.partitionBy("_g", "_from", "_to").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    parts = counts.withColumn("_upto", upto)
    met = wanted.join(parts, (wanted["_g"] == parts["_g"]) & (wanted["_lo"] == parts["_from"]) & (wanted["_hi"] == parts["_to"]) & (F.col("_rank") < F.col("_below") + F.col("_upto")) & (F.col("_rank") >= F.col("_below") + F.col("_upto") - F.col("_c")))
    return met.select(wanted["_g"], F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), F.col("_c").alias("_size"), "_rank", (F.col("_below") + F.col("_upto") - F.col("_c")).alias("_below"))
