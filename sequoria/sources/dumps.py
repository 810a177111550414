"""Listen dumps: compressed archives of JSON lines, or the lines unpacked; months, reasons, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sequoria.functions import listen_json as j
from sequoria.functions import text as t
from sequoria.sources import archives



def month_of(name: Column) -> tuple[Column, Column]:
    """(year, month) of a file of the dump, null for others."""
    part = lambda i: F.nullif(F.regexp_extract(name, archives.MONTH_NAME, i), F.lit("")).cast("int")
    return part(1), part(2)


def month_overlaps(year: Column, month: Column, start: int, end: int) -> Column:
    """Whether a month has seconds of [start, end): for partitions that need not be read."""
    first = F.make_date(year, month, F.lit(1))
    second = lambda d: F.unix_date(d).cast("long") * 86_400
    return (second(first) < end) & (second(F.add_months(first, 1)) > start)


def archive_lines(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, verify: bool = False) -> DataFrame:
    """(archive, started, ended, year, month, line) of the ``.tar.zst`` archives at ``path``, a task each.

    Months outside [start, end) are passed over, and so are those that filters on year and
    month exclude. ``started`` and ``ended`` are the archive's window of submission times,
    null without one. With ``verify`` an archive must have the SHA-256 of the ``.sha256``
    file beside it, if there is one. An archive is one stream; unpack it (``write_lines``)
    for anything that is read twice.
    """
    return _archives(spark, path, start=start, end=end, verify=str(verify).lower())


def _archives(spark: SparkSession, path: str, **options) -> DataFrame:
    archives.register(spark)
    return spark.read.format(archives.ArchiveSource.name()).options(**{k: v for k, v in options.items() if v is not None}).load(path)


def write_archives(lines: DataFrame, path: str, started: str | None = None, ended: str | None = None) -> None:
    """Writes ``lines`` (year, month, line) as archives, one for each partition, months in order; with the window of submission times."""
    archives.register(lines.sparkSession)
    writer = lines.select("year", "month", "line").sortWithinPartitions("year", "month").write.format(archives.ArchiveSource.name()).mode("append")
    writer.options(**{k: v for k, v in (("started", started), ("ended", ended)) if v is not None}).save(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """By month, so that a later read with a filter on year and month opens those folders only."""
    lines.write.partitionBy("year", "month").parquet(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of unpacked files; Spark splits them at line ends."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def parsed(lines: DataFrame, start: int, end: int) -> DataFrame:
    """Listens of ``lines`` with ``reason``: kept, unreadable, outside the window, or no artist or title."""
    rows = lines.select(*j.parsed_listen(F.col("line")))
    blank = lambda c: F.trim(F.col(c)) == ""
    reason = (
        F.when(F.col("user_id").isNull() | F.col("ts").isNull(), "unreadable")
        .when((F.col("ts") < start) | (F.col("ts") >= end), "outside the window")
        .when(blank("first_artist") | blank("title"), "no artist or title")
        .otherwise("kept")
    )
    return rows.withColumn("reason", reason)


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def keyed(rows: DataFrame) -> DataFrame:
    """Kept listens with ``song_key``; names of which nothing is left are dropped."""
    return t.with_song_keys(rows.filter("reason = 'kept'").drop("reason"), "first_artist", "title").filter("song_key NOT LIKE '|%' AND song_key NOT LIKE '%|'")


def checksums(spark: SparkSession, path: str, ending: str = "") -> DataFrame:
    """(path, archive, sha256, expected) of the files at ``path`` with that ending; ``expected`` is from a ``.sha256`` file beside it, else null."""
    return _archives(spark, path, what="checksums", ending=ending).filter("NOT endswith(archive, '.sha256')")


def dump_windows(spark: SparkSession, path: str) -> DataFrame:
    """(archive, started, ended, named) of the archives at ``path``: windows from their first members, of which only
    those bytes are read, and the time in their names (...-20250131-000003-...); null where there is none."""
    stamp = F.nullif(F.regexp_extract("archive", r"(\d{8}-\d{6})", 1), F.lit(""))
    return _archives(spark, path, what="windows").withColumn("named", F.try_to_timestamp(stamp, F.lit("yyyyMMdd-HHmmss")))
