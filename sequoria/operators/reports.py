"""Profiles of listens: gaps, activity, concentration, caps, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sequoria.operators import sessions as s
from sequoria.operators.ids import with_dense_id
from sequoria.operators.quantiles import exact_quantiles


def user_activity(listens: DataFrame, short: int = 30, ties: Sequence[str] = ("item",)) -> DataFrame:
    """(user, listens, gaps, short_gaps, zero_gaps, busiest_day): one window by user, aggregated by day and then by user. Needs ``day``."""
    gap = F.col("sec") - F.lag("sec").over(s.in_time(ties))
    gaps = listens.withColumn("_gap", gap)
    days = gaps.groupBy("user", "day").agg(F.count("*").alias("_n"), F.count("_gap").alias("_g"), F.sum((F.col("_gap") < short).cast("long")).alias("_s"), F.sum((F.col("_gap") == 0).cast("long")).alias("_z"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    return days.groupBy("user").agg(F.sum("_n").alias("listens"), F.sum("_g").alias("gaps"), total("_s").alias("short_gaps"), total("_z").alias("zero_gaps"), F.max("_n").alias("busiest_day"))


def bot_flags(activity: DataFrame) -> DataFrame:
    """Adds ``busy``, ``rapid`` and ``same_second``: more listens, or a larger share of short gaps, than people have."""
    share = lambda c: F.when(F.col("gaps") > 0, F.col(c) / F.col("gaps")).otherwise(0.0)
    return activity.withColumns({"busy": F.col("busiest_day") > 1000, "rapid": (F.col("listens") >= 1000) & (share("short_gaps") > 0.5), "same_second": (F.col("listens") >= 100) & (share("zero_gaps") > 0.5)})


def top_user_share(activity: DataFrame, part: int = 100) -> DataFrame:
    """Share of listens by the most active one in ``part`` of users (one at least)."""
    placed = with_dense_id(activity.select("user", "listens"), -F.col("listens"), "user", name="_place")
    n = activity.agg(F.count("*").alias("_n"))
    top = F.when(F.col("_place") < F.greatest(F.lit(1), F.floor(F.col("_n") / part)), F.col("listens")).otherwise(0)
    return placed.crossJoin(F.broadcast(n)).agg((F.sum(top) / F.sum("listens")).alias("top_share"))


def cap_table(activity: DataFrame, caps: Sequence[int]) -> DataFrame:
    """(cap, listens) left if each user kept ``cap`` at most; one pass."""
    wide = activity.agg(*(F.sum(F.least("listens", F.lit(k))).alias(f"c{k}") for k in caps))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("cap"), F.col(f"c{k}").alias("listens")) for k in caps))).alias("r")).select("r.*")


def percentiles(rows: DataFrame, value: str, points: Sequence[float]) -> DataFrame:
    """(point, value): exact, interpolated percentiles cut to whole numbers."""
    return exact_quantiles(rows, value, points).select("point", F.col("value").cast("long").alias("value"))


def quantile_cuts(rows: DataFrame, value: str, n: int) -> DataFrame:
    """One row with ``cuts``: ``n`` - 1 interpolated quantiles of the known (not 0) values."""
    found = exact_quantiles(rows.filter(F.col(value) > 0), value, [i / n for i in range(1, n)])
    return found.agg(F.transform(F.sort_array(F.collect_list(F.struct("point", "value"))), lambda x: x["value"]).alias("cuts"))


def share_by_bucket(rows: DataFrame, bucket: Column, weight: Column) -> DataFrame:
    """(bucket, n, share) of the summed weight."""
    counted = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(weight).alias("_w"))
    return counted.select("bucket", "n", (F.col("_w") / F.sum("_w").over(Window.partitionBy())).alias("share"))


def latency_summary(calls: DataFrame, slow: float = 0.99) -> DataFrame:
    """(group, n, p50, p99, slow_n): percentiles of ``ms`` by group, and calls beyond the overall ``slow`` percentile."""
    limit = exact_quantiles(calls, "ms", [slow]).select(F.col("value").alias("_limit"))
    by_group = exact_quantiles(calls, "ms", [0.5, 0.99], "group")
    at = lambda p: F.max(F.when(F.col("point") == p, F.col("value")))
    wide = by_group.groupBy("group").agg(at(0.5).alias("p50"), at(0.99).alias("p99"))
    counted = calls.crossJoin(F.broadcast(limit)).groupBy("group").agg(F.count("*").alias("n"), F.sum((F.col("ms") > F.col("_limit")).cast("long")).alias("slow_n"))
    return counted.join(wide, "group").select("group", "n", "p50", "p99", "slow_n")


def interpolated(points: DataFrame, samples: DataFrame) -> DataFrame:
    """``points`` (series, t) with ``value`` between the samples (series, t, value) around it; beyond the ends the nearest sample."""
    both = points.select("series", "t", F.lit(None).cast("double").alias("value"), F.lit(True).alias("_asked")).unionByName(samples.select("series", "t", F.col("value").cast("double"), F.lit(False).alias("_asked")))
    w = Window.partitionBy("series").orderBy("t", "_asked")
    known = F.when(~F.col("_asked"), F.struct("t", "value"))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    framed = both.withColumns({"_b": before, "_a": after}).filter("_asked")
    line = F.col("_b.value") + (F.col("_a.value") - F.col("_b.value")) * (F.col("t") - F.col("_b.t")) / F.nullif(F.col("_a.t") - F.col("_b.t"), F.lit(0))
    return framed.select("series", "t", F.coalesce(line, "_b.value", "_a.value").alias("value"))


def dump_report(listens: DataFrame) -> DataFrame:
    """One row: listens, users, sessions, items, share of the most played item. Needs ``session``."""
    per_item = listens.groupBy("item").agg(F.count("*").alias("n"))
    top = per_item.agg(F.max("n").alias("_top"), F.count("*").alias("items"), F.sum("n").alias("listens"))
    per_user = listens.groupBy("user").agg(F.max("session").alias("_s"))
    users = per_user.agg(F.count("*").alias("users"), F.sum("_s").alias("sessions"))
    return top.crossJoin(users).select("listens", "users", "sessions", "items", (F.col("_top") / F.col("listens")).alias("top_item_share"))


def sane_rates(rates: DataFrame, low: float = 0.3, high: float = 3.0, days: int = 14) -> DataFrame:
    """(day, rate, sane): a rate within ``low`` to ``high`` times the median of the last ``days`` rates before it."""
    earlier = F.collect_list("rate").over(Window.orderBy("day").rowsBetween(-days, -1))
    ordered = F.sort_array(F.col("_earlier"))
    n = F.size("_earlier")
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    return rates.withColumn("_earlier", earlier).select("day", "rate", F.when(n == 0, True).otherwise(F.col("rate").between(low * middle, high * middle)).alias("sane"))
