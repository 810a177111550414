"""One listener's taste: affinity, skips, taste vector, and lists adjusted by them. ``plays``: user, sec, item, artist, listened, skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sequoria.functions import arrays as a
from sequoria.operators import vectors as v

HALF_LIFE_DAYS = 30.0
LISTENED_MS = 30_000
LEAST_PLAYS = 3


def listened(ms_played: Column) -> Column:
    return ms_played >= LISTENED_MS


def artist_affinity(plays: DataFrame, until: int, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """(user, artist, affinity): logarithm of recency-weighted listens, 1 for the user's largest."""
    weights = plays.filter((F.col("sec") < until) & F.col("listened")).groupBy("user", "artist").agg(F.log1p(F.sum(a.recency_weight(F.col("sec"), F.lit(until), half_life))).alias("_w"))
    return weights.select("user", "artist", (F.col("_w") / F.greatest(F.max("_w").over(Window.partitionBy("user")), F.lit(1e-9))).alias("affinity"))


def skip_rates(plays: DataFrame, until: int, least: int = LEAST_PLAYS) -> DataFrame:
    """(user, item, plays, skip_rate): share of plays that were skipped or not listened to; 0 for fewer than ``least``."""
    skipped = (F.col("skipped") | ~F.col("listened")).cast("long")
    return plays.filter(F.col("sec") < until).groupBy("user", "item").agg(F.count("*").alias("plays"), F.when(F.count("*") >= least, F.sum(skipped) / F.count("*")).otherwise(0.0).alias("skip_rate"))


def taste_vectors(positions: DataFrame, until: int, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """(user, vector): recency-weighted mean of the query vectors at every place, as long as a typical query. ``positions``: user, sec, vector."""
    early = positions.filter(F.col("sec") < until)
    return v.average_vectors(early, ["user"], a.recency_weight(F.col("sec"), F.lit(until), half_life), lengthened=True)


def adjusted(ranked: DataFrame, affinity: DataFrame, skips: DataFrame, alpha: float, beta: float) -> DataFrame:
    """``ranked`` (user, item, artist, score, rank) by score + alpha affinity - beta skip rate; equal scores keep their order."""
    both = ranked.join(affinity, ["user", "artist"], "left").join(skips.select("user", "item", "skip_rate"), ["user", "item"], "left")
    score = F.col("score") + alpha * F.coalesce("affinity", F.lit(0.0)) - beta * F.coalesce("skip_rate", F.lit(0.0))
    order = Window.partitionBy("user").orderBy(F.desc("score"), "rank")
    return both.withColumn("score", score).withColumn("rank", F.row_number().over(order)).drop("affinity", "skip_rate")


def time_split(plays: DataFrame, tune: float = 0.1, test: float = 0.1) -> DataFrame:
    """``plays`` with ``part`` by when its session began: shares of the time span at the end are for tuning and tests. Needs ``session``."""
    span = plays.groupBy("user").agg(F.min("sec").alias("_lo"), F.max("sec").alias("_hi"))
    begun = plays.withColumn("_begin", F.min("sec").over(Window.partitionBy("user", "session"))).join(span, "user")
    at = (F.col("_begin") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))
    return begun.withColumn("part", F.when(at >= 1 - test, "test").when(at >= 1 - test - tune, "tune").otherwise("before")).drop("_lo", "_hi", "_begin")


def finds(top: DataFrame, liked: DataFrame, known: DataFrame) -> DataFrame:
    """(user, new_share, finds_per_100): recommended items that the user did not know, and those of them that they came to like."""
    mark = lambda t, name: t.select("user", "item").distinct().withColumn(name, F.lit(1))
    both = top.join(mark(known, "_k"), ["user", "item"], "left").join(mark(liked, "_l"), ["user", "item"], "left")
    new = F.col("_k").isNull()
    return both.groupBy("user").agg(F.avg(new.cast("double")).alias("new_share"), (100 * F.avg((new & F.col("_l").isNotNull()).cast("double"))).alias("finds_per_100"))
