"""Listens as a stream: sessions, running counts, listeners within a month, and dumps as micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sequoria.operators import pairs as p
from sequoria.operators import sessions as s


def stream_of(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def live_sessions(listens: DataFrame, gap: int, late: str = "1 hour") -> DataFrame:
    """(user, begin, end, n) of sessions that the watermark has closed. ``listens``: user, ts (timestamp), sec."""
    return s.session_windows(listens.withWatermark("ts", late), gap)


def live_counts(listens: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(begin, item, n) by window of event time; later rows than ``late`` are dropped."""
    return listens.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "item").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), "item", "n")


def live_listeners(listens: DataFrame, days: int = 30, late: str = "1 day") -> DataFrame:
    """(key, user, day, days) of each micro-batch: the days (since 1970) on which a user played. See ``listeners_step``.

    ``listens``: key, user, ts (timestamp). No row is too late, ``late`` only marks its time for what may follow.
    """
    return listens.withWatermark("ts", late).select("key", "user", F.unix_date(F.to_date("ts")).cast("long").alias("day"), F.lit(days).cast("long").alias("days"))


def _turns(plays: DataFrame, sign: int) -> DataFrame:
    """(key, day, delta): where users begin and end to count, from a play until ``days`` after the last one. ``plays``: key, user, day, days, no row twice."""
    w = Window.partitionBy("key", "user").orderBy("day")
    placed = plays.withColumns({"_before": F.lag("day").over(w), "_after": F.lead("day").over(w)})
    before, after = F.col("_before"), F.col("_after")
    begins = F.when(before.isNull() | (F.col("day") >= before + F.col("days")), F.struct("day", F.lit(sign).alias("delta")))
    ends = F.when(after.isNull() | (after >= F.col("day") + F.col("days")), F.struct((F.col("day") + F.col("days")).alias("day"), F.lit(-sign).alias("delta")))
    return placed.select("key", F.explode(F.array_compact(F.array(begins, ends))).alias("t")).select("key", "t.*")


def listeners_step(path: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: a batch's plays and the changes they make, by key and day, under its batch id.

    A change is what the plays of earlier batches and these give beyond the earlier ones.
    Only plays within ``days`` of the batch's own can meet them, so a batch costs as much as
    its rows and those days, whatever the order of batches. A batch that is run again
    overwrites its own.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, f"{path}/plays/batch={batch_id}"
        batch.distinct().sortWithinPartitions("day").write.mode("overwrite").parquet(own)
        new = spark.read.schema(batch.schema).parquet(own)
        turned = _turns(new, 1)
        if batch_id:
            least, most, days = new.agg(F.min("day"), F.max("day"), F.max("days")).first()
            old = spark.read.parquet(f"{path}/plays").filter(F.col("batch") < batch_id)
            near = old.filter(F.col("day").between((least or 0) - (days or 0), (most or 0) + (days or 0))).select(*new.columns)
            met = near.distinct().join(new.select("key", "user").distinct(), ["key", "user"], "left_semi")
            turned = _turns(met.unionByName(new).distinct(), 1).unionByName(_turns(met, -1))
        played = new.select("key", "day", F.lit(0).alias("delta"), F.lit(True).alias("played"))
        changes = turned.withColumn("played", F.lit(False)).unionByName(played)
        changes.groupBy("key", "day").agg(F.sum("delta").alias("delta"), F.max("played").alias("played")).write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")

    return step


def listeners_of(spark: SparkSession, path: str) -> DataFrame:
    """(day, key, listeners): different users within ``days`` up to each day on which a key was played, from all batches so far."""
    daily = spark.read.parquet(f"{path}/changes").groupBy("key", "day").agg(F.sum("delta").alias("delta"), F.max("played").alias("played"))
    return daily.withColumn("listeners", F.sum("delta").over(Window.partitionBy("key").orderBy("day"))).filter("played").select("day", "key", "listeners")


def dump_step(path: str, gap: int, min_length: int, window: int = p.WINDOW) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: the pair counts of a dump's sessions, written under its batch id.

    A batch that is run again overwrites its own folder, so counts are never added twice.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        kept = s.kept_listens(s.with_sessions(batch, gap), min_length)
        p.pair_counts(s.session_items(kept), window).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return step


def pairs_so_far(spark: SparkSession, path: str) -> DataFrame:
    """The pair table of all batches."""
    return spark.read.parquet(path).groupBy("a", "b").agg(F.sum("n").alias("n"))


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """What has arrived, in micro-batches; the checkpoint is the ledger of what is done."""
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


