"""Listens in time order: noise, sessions, repeats, recency. One window sort by user serves most of it.

A listen is a row with ``user``, ``sec`` (seconds) and ``item``; ``tie`` columns make an
order of equal seconds. Other columns stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

GAP = 1800
MIN_LENGTH = 4


def in_time(ties: Sequence[str] = ("item",), descending: bool = False) -> WindowSpec:
    order = [F.col(c).desc() if descending else F.col(c) for c in ("sec", *ties)]
    return Window.partitionBy("user").orderBy(*order)


def noise_flag(max_day: int = 1000, skip: int = 30, ties: Sequence[str] = ("item",)) -> Column:
    """True for all of a user's day with more than ``max_day`` listens, the later of two at one second, and the earlier of two less than ``skip`` seconds apart. Needs ``day``."""
    w = in_time(ties)
    busy = F.count("*").over(Window.partitionBy("user", "day")) > max_day
    same = F.col("sec") == F.lag("sec").over(w)
    gap = F.lead("sec").over(w) - F.col("sec")
    return F.coalesce(busy | F.coalesce(same, F.lit(False)) | F.coalesce((gap > 0) & (gap < skip), F.lit(False)), F.lit(False))


def without_noise(listens: DataFrame, start: int | Column, max_day: int = 1000, skip: int = 30, ties: Sequence[str] = ("item",)) -> DataFrame:
    """Listens that the noise rules keep; days count from ``start``."""
    start = F.lit(start) if isinstance(start, int) else start
    dated = listens.withColumn("day", F.floor((F.col("sec") - start) / 86400).cast("int"))
    return dated.withColumn("_noise", noise_flag(max_day, skip, ties)).filter("NOT _noise").drop("_noise")


def with_sessions(listens: DataFrame, gap: int = GAP, ties: Sequence[str] = ("item",)) -> DataFrame:
    """Adds ``starts`` (first of a session: more than ``gap`` after the listen before), ``session`` (number within the user) and ``repeat`` (same item as the listen before it in the session)."""
    w = in_time(ties)
    starts = F.coalesce(F.col("sec") - F.lag("sec").over(w) > gap, F.lit(True))
    flagged = listens.withColumn("starts", starts).withColumn("repeat", F.coalesce(F.lag("item").over(w) == F.col("item"), F.lit(False)) & ~F.col("starts"))
    return flagged.withColumn("session", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def kept_listens(sessioned: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Listens that are no repeat, of sessions with ``min_length`` of them."""
    size = F.sum((~F.col("repeat")).cast("int")).over(Window.partitionBy("user", "session"))
    return sessioned.withColumn("_n", size).filter(~F.col("repeat") & (F.col("_n") >= min_length)).drop("_n")


def session_windows(listens: DataFrame, gap: int = GAP) -> DataFrame:
    """(user, begin, end, n) of every session by Spark's session windows; also right for streams. Needs ``ts``."""
    return listens.groupBy("user", F.session_window("ts", f"{gap} seconds").alias("w")).agg(F.min("sec").alias("begin"), F.max("sec").alias("end"), F.count("*").alias("n")).drop("w")


def with_rank_from_end(listens: DataFrame, ties: Sequence[str] = ("item",)) -> DataFrame:
    """Adds ``from_end``: 0 for a user's most recent listen."""
    return listens.withColumn("from_end", F.row_number().over(in_time(ties, descending=True)) - 1)


def most_recent(listens: DataFrame, k: int, ties: Sequence[str] = ("item",)) -> DataFrame:
    return with_rank_from_end(listens, ties).filter(F.col("from_end") < k).drop("from_end")


def users_per_item(listens: DataFrame) -> DataFrame:
    """(item, users): distinct listeners; two aggregations, so a very common item is spread."""
    return listens.select("item", "user").distinct().groupBy("item").agg(F.count("*").alias("users"))


def session_items(kept: DataFrame, ties: Sequence[str] = ("item",)) -> DataFrame:
    """Kept listens as sequences: (seq, pos, item), seq = user and session number."""
    w = Window.partitionBy("user", "session").orderBy("sec", *ties)
    return kept.select(F.struct("user", "session").alias("seq"), (F.row_number().over(w) - 1).alias("pos"), "item")
