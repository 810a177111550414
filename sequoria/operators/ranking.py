"""Ranked lists: diversified top k, targets' ranks, and metrics over cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sequoria.functions import arrays as a
from sequoria.operators.ids import with_dense_id

#: The rank of a target that is not in the list at all.
MISSED = 1_000_000_000
RECALLS = (100, 500, 1000, 2000, 5000)


def popularity_ranks(rows: DataFrame) -> DataFrame:
    """(item, n, rank) by count, then id."""
    counts = rows.filter("item IS NOT NULL").groupBy("item").agg(F.count("*").alias("n"))
    return with_dense_id(counts, -F.col("n"), "item", name="rank", start=1).select("item", "n", "rank")


def top_per_group(rows: DataFrame, keys: list[str], k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``; partial limits before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def most_played(items: DataFrame, limit: int) -> DataFrame:
    return items.orderBy(F.desc("n"), "id").limit(limit)


def reranked(candidates: DataFrame) -> DataFrame:
    """``candidates`` (case, item, score, rank) ranked by score; equal scores keep their order."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy(F.desc("score"), "rank")))


def without_inputs(ranked: DataFrame, inputs: DataFrame, k: int) -> DataFrame:
    """The best ``k`` items that are not inputs; if fewer others exist, inputs fill the tail in their order. Ranked (case, item, rank)."""
    flagged = ranked.join(inputs.select("case", "item").distinct().withColumn("_in", F.lit(1)), ["case", "item"], "left").fillna(0, ["_in"])
    placed = flagged.withColumn("_place", F.row_number().over(Window.partitionBy("case").orderBy("_in", "rank"))).filter(F.col("_place") <= k)
    return placed.drop("_in", "rank").withColumnRenamed("_place", "rank")


def diversified(ranked: DataFrame, k: int, per_artist: int) -> DataFrame:
    """The top ``k`` of (case, item, artist, rank) with ``per_artist`` items of an artist at most (0: no limit).

    Too few artists: the best skipped items fill the rest; the result stands in rank order.
    """
    if not per_artist:
        return ranked.filter(F.col("rank") <= k)
    own = F.row_number().over(Window.partitionBy("case", "artist").orderBy("rank"))
    chosen = ranked.withColumn("_over", (own > per_artist).cast("int"))
    placed = chosen.withColumn("_place", F.row_number().over(Window.partitionBy("case").orderBy("_over", "rank"))).filter(F.col("_place") <= k)
    return placed.drop("_over", "_place")


def target_ranks(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """(case, item, rank): 1 + the number of scores strictly above the target's. ``scores``: case, item, score."""
    own = targets.join(scores, ["case", "item"]).select("case", "item", F.col("score").alias("_own"))
    above = own.join(scores.select("case", "score"), "case").groupBy("case", "item").agg(F.sum((F.col("score") > F.col("_own")).cast("long")).alias("_above"))
    return above.select("case", "item", (F.col("_above") + 1).alias("rank"))


def final_ranks(targets: DataFrame, ranked: DataFrame, missed: int = MISSED) -> DataFrame:
    """(case, item, rank) of targets in a list; MISSED where they are not in it."""
    return targets.select("case", "item").join(ranked.select("case", "item", "rank"), ["case", "item"], "left").withColumn("rank", F.coalesce(F.col("rank").cast("long"), F.lit(missed).cast("long")))


def score_summary(ranks: DataFrame, *keys: str) -> DataFrame:
    """n, ndcg@10, hits and recalls over (case, rank), by ``keys``."""
    share = lambda k: F.avg((F.col("rank") <= k).cast("double"))
    return ranks.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(a.gain(F.col("rank"), 10)).alias("ndcg_10"), *(share(k).alias(f"hits_{k}") for k in (1, 5, 10)), *(share(k).alias(f"recall_{k}") for k in RECALLS))


def length_group(n: Column) -> Column:
    """1 .. 10, then 11-25, 26-50, 51-100, 101-250 and so on."""
    out = n.cast("string")
    for low, high in ((11, 25), (26, 50), (51, 100), (101, 250)):
        out = F.when((n >= low) & (n <= high), f"{low}-{high}").otherwise(out)
    return F.when(n > 250, "251+").otherwise(out)


def by_length(ranks: DataFrame) -> DataFrame:
    """``score_summary`` by groups of ``n_inputs``."""
    return score_summary(ranks.withColumn("length_group", length_group(F.col("n_inputs"))), "length_group")


def artist_variety(top: DataFrame, last_artist: DataFrame) -> DataFrame:
    """(case, artists, last_share): different artists of a list, and the share by the last input's artist. ``top``: case, artist."""
    joined = top.join(last_artist.select("case", F.col("artist").alias("_last")), "case")
    return joined.groupBy("case").agg(F.count_distinct("artist").alias("artists"), F.avg((F.col("artist") == F.col("_last")).cast("double")).alias("last_share"))


def answered_summary(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Gains of two-sided comparisons: a case without an answer is a miss. ``answers``: case, rank."""
    joined = cases.select("case").join(answers, "case", "left")
    return joined.agg(F.count("*").alias("n"), F.avg(F.col("rank").isNotNull().cast("double")).alias("answered"), F.avg(F.coalesce(a.gain(F.col("rank"), 10), F.lit(0.0))).alias("ndcg_10"))


def paired_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mean and standard error of the per-case difference of ``gain``."""
    d = left.select("case", F.col("gain").alias("_l")).join(right.select("case", F.col("gain").alias("_r")), "case").select((F.col("_r") - F.col("_l")).alias("d"))
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("se"))


def bootstrap_interval(cases: DataFrame, value: str, cluster: str, resamples: int = 1000, seed: int = 0) -> DataFrame:
    """(mean, low, high): percentiles 2.5 and 97.5 of the mean over resampled clusters.

    Poisson(1) weights by a hash of (resample, cluster); clusters are summed first and each
    meets the stated number of resamples, so the work is linear.
    """
    sums = cases.groupBy(cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "b", cluster), F.lit(1 << 30)) + 0.5) / (1 << 30)
    cuts, total, term = [], 0.0, 0.36787944117144233
    for i in range(1, 12):
        total += term
        cuts.append(total)
        term /= i
    weight = sum((F.when(u > c, 1).otherwise(0) for c in cuts), F.lit(0))
    drawn = sums.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("_w", weight)
    means = drawn.groupBy("b").agg((F.sum(F.col("_w") * F.col("_s")) / F.sum(F.col("_w") * F.col("_n"))).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def best_setting(results: DataFrame, score: str, order: str) -> DataFrame:
    """The row of the largest score; of equal ones the first by ``order``."""
    return results.orderBy(F.desc(score), order).limit(1)


def seeds_table(results: DataFrame) -> DataFrame:
    """(setting, mean, low, high, change): by setting over seeds, and the change from the setting before."""
    by = results.groupBy("place", "setting").agg(F.avg("score").alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"))
    return by.withColumn("change", F.col("mean") - F.lag("mean").over(Window.orderBy("place")))
