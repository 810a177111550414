"""Tables that cut a plan, and connected components; for jobs in several steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequoria.sources.tables import dropped, shared_folder, written

__all__ = ["components", "dropped", "in_common", "shared_folder", "written"]


def in_common(rows: DataFrame, key: str, who: str) -> DataFrame:
    """The rows of ``rows`` whose ``key`` different ``who`` have; they are made and dealt out once."""
    dealt = rows.repartition(key)
    several = dealt.groupBy(key).agg(F.min(who).alias("low"), F.max(who).alias("high")).filter("low < high").select(key)
    return dealt.join(several.hint("shuffle_hash"), key, "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id of ``edges`` (a, b): root is the smallest id that links reach.

    Alternating large-star and small-star rounds, each a few shuffles of the edges, until
    none changes; the rounds grow as the logarithm of the longest chain. No group meets in
    one row.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every edge now goes down; the smallest neighbour takes the others
        smallest = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = smallest.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        last, now = now, written(small)
        dropped(last)
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
