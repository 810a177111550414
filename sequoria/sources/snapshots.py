"""Versioned snapshots: tables in one folder, a manifest whose hash is the version, updates on top, and the live pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(files: DataFrame) -> DataFrame:
    """One row: ``version``, the first 12 hex digits of the hash of all "name sha256" lines in order of names. ``files``: name, sha256."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "sha256"))), lambda f: F.concat(f["name"], F.lit(" "), f["sha256"], F.lit("\n"))), "")
    return files.agg(F.substring(F.sha2(lines, 256), 1, 12).alias("version"), F.count("*").alias("files"))


def table_digest(table: DataFrame) -> DataFrame:
    """(sha256) of a table's rows in any order: row hashes are summed in parts, so nothing is sorted or gathered."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(table.columns)]
    row = F.xxhash64(*columns)
    other = F.xxhash64(F.lit(1), *columns)
    return table.agg(F.sha2(F.concat_ws(" ", F.count("*").cast("string"), F.sum(row.cast("decimal(38,0)")).cast("string"), F.sum(other.cast("decimal(38,0)")).cast("string")), 256).alias("sha256"))


def write_snapshot(tables: dict[str, DataFrame], path: str, parent: str | None = None) -> str:
    """Writes the tables, then the manifest; returns the version. A snapshot without manifest is unfinished."""
    spark = next(iter(tables.values())).sparkSession
    digests = None
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
        one = table_digest(spark.read.parquet(f"{path}/{name}")).select(F.lit(name).alias("name"), "sha256")
        digests = one if digests is None else digests.unionByName(one)
    row = manifest(digests).withColumn("parent", F.lit(parent).cast("string"))
    row.coalesce(1).write.parquet(f"{path}/manifest")
    return version_of(spark, path)


def version_of(spark: SparkSession, path: str) -> str:
    return spark.read.parquet(f"{path}/manifest").first()["version"]


def snapshot_table(spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    """A table at a version: the base's rows and those of its updates."""
    out = spark.read.parquet(f"{paths[0]}/{name}")
    for p in paths[1:]:
        out = out.unionByName(spark.read.parquet(f"{p}/{name}"), allowMissingColumns=True)
    return out


def write_sharded(table: DataFrame, path: str, shards: int, key: str = "id") -> None:
    """By the id's remainder, so that a lookup of ids reads their folders only."""
    table.withColumn("shard", F.pmod(F.col(key), F.lit(shards))).write.partitionBy("shard").parquet(path)


def sharded_rows(spark: SparkSession, path: str, wanted: DataFrame, shards: int, key: str = "id") -> DataFrame:
    """Rows of the wanted ids."""
    keys = wanted.select(key).distinct().withColumn("shard", F.pmod(F.col(key), F.lit(shards)))
    return spark.read.parquet(path).join(keys, ["shard", key], "left_semi").drop("shard")


def live_view(spark: SparkSession, paths: list[str], name: str, view: str) -> None:
    """Points ``view`` at a version; queries that began keep the one they read."""
    snapshot_table(spark, paths, name).createOrReplaceTempView(view)
