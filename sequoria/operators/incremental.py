"""Dumps that follow each other: which to use, what they add, and whether an update kept what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sequoria.operators import pairs as p

DAY = 86400
FRESH_DAYS = NEW_DAYS = 30
TOLERANCE = 1.0


def chained(windows: DataFrame, after: float | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``windows`` (name, start, end) with ``status`` used or skipped and ``gap_from``: the uncovered time before a used one.

    In order of start a dump is used if it begins at the end of the last used one or
    later. The fold runs over the ledger's rows, one for each dump, gathered in one array.
    """
    rows = windows.agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "name"))).alias("d"))
    none = F.lit(None).cast("double")
    state = F.struct((F.lit(float(after)) if after is not None else none).alias("upto"), F.array().cast("array<struct<name:string,start:double,end:double,status:string,gap_from:double>>").alias("out"))

    def step(acc, d):
        skip = F.coalesce(d["start"] < acc["upto"] - tolerance, F.lit(False))
        gap = F.when(~skip & (d["start"] > acc["upto"] + tolerance), acc["upto"])
        row = F.struct(d["name"].alias("name"), d["start"].alias("start"), d["end"].alias("end"), F.when(skip, "skipped").otherwise("used").alias("status"), gap.alias("gap_from"))
        return F.struct(F.when(skip, acc["upto"]).otherwise(d["end"]).alias("upto"), F.concat(acc["out"], F.array(row)).alias("out"))

    return rows.select(F.explode(F.aggregate("d", state, step, lambda acc: acc["out"])).alias("r")).select("r.*")


def fresh(listens: DataFrame, end: int, days: int = FRESH_DAYS, ahead: int = 3600) -> DataFrame:
    """Listens played within ``days`` before a dump's end, up to ``ahead`` seconds after it."""
    return listens.filter((F.col("sec") >= end - days * DAY) & (F.col("sec") < end + ahead))


def listeners_within(seen: DataFrame, now: int, days: int = NEW_DAYS) -> DataFrame:
    """(key, listeners): different users in dumps that ended within ``days`` before ``now``. ``seen``: end, key, user."""
    recent = seen.filter(F.col("end") > now - days * DAY).select("key", "user").distinct()
    return recent.groupBy("key").agg(F.count("*").alias("listeners"))


def rolling_listeners(listens: DataFrame, days: int = NEW_DAYS) -> DataFrame:
    """(day, key, listeners): different users within ``days`` up to each day, for every day on which a key is played.

    A user counts from a play until ``days`` later or the next play's end: each (key, user)
    becomes disjoint intervals, and intervals are summed by their ends, so no day holds the
    rows of all days before it. ``listens``: day, key, user.
    """
    once = listens.select("key", "user", "day").distinct()
    w = Window.partitionBy("key", "user").orderBy("day")
    until = F.least(F.col("day") + days, F.coalesce(F.lead("day").over(w), F.lit(2**31 - 1)))
    ended = once.withColumn("until", until)
    steps = ended.select("key", F.explode(F.array(F.struct(F.col("day").alias("day"), F.lit(1).alias("d")), F.struct(F.col("until").alias("day"), F.lit(-1).alias("d")))).alias("e")).select("key", "e.*")
    daily = steps.groupBy("key", "day").agg(F.sum("d").alias("d"))
    summed = daily.withColumn("listeners", F.sum("d").over(Window.partitionBy("key").orderBy("day")))
    return summed.join(once.select("key", "day").distinct(), ["key", "day"], "left_semi").select("day", "key", "listeners")


def updated_pairs(base: DataFrame, *deltas: DataFrame) -> DataFrame:
    """The pair table at a version: the base and its updates."""
    return p.merged(base, *deltas)


def lost_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``before`` that ``after`` no longer has; empty if an update kept them."""
    return before.exceptAll(after.select(before.columns))


def lowered_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs whose count an update lowered; empty if it is sound."""
    return before.join(after.select("a", "b", F.col("n").alias("_after")), ["a", "b"], "left").filter(F.coalesce("_after", F.lit(0)) < F.col("n")).drop("_after")


def lineage(versions: DataFrame, version: str) -> DataFrame:
    """(version, parent, depth) from a version down to its base, by a recursive query. ``versions``: version, parent."""
    view = "versions_of_lineage"
    versions.createOrReplaceTempView(view)
    return versions.sparkSession.sql(
        f"""WITH RECURSIVE up(version, parent, depth) AS (
          SELECT version, parent, 0 FROM {view} WHERE version = :version
          UNION ALL SELECT v.version, v.parent, up.depth + 1 FROM {view} v JOIN up ON v.version = up.parent)
        SELECT version, parent, depth FROM up""",
        args={"version": version},
    )


def standby_check(current: DataFrame, standby: DataFrame, new_from: int, most_drop: float = 0.003, most_new: float = 0.01) -> DataFrame:
    """One row: whether the standby's answers (case, gain, items, failed) may go live."""
    one = lambda t, n: t.agg(F.avg("gain").alias(f"{n}_gain"), F.sum(F.col("failed").cast("long")).alias(f"{n}_failed"), F.count("*").alias(f"{n}_cases"))
    new = standby.select("case", F.explode(F.array_distinct("items")).alias("item")).filter(F.col("item") >= new_from).groupBy("item").agg(F.count("*").alias("lists")).agg(F.coalesce(F.max("lists"), F.lit(0)).alias("top_new"))
    row = one(current, "current").crossJoin(one(standby, "standby")).crossJoin(new)
    return row.withColumn("passed", (F.col("standby_failed") == 0) & (F.col("current_gain") - F.col("standby_gain") <= most_drop) & (F.col("top_new") <= most_new * F.col("standby_cases")))
