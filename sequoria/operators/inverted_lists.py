"""Nearest items by inverted lists: items packed by cluster, queries multiplied with the lists they probe.

A list is the items of one cluster; it is written in slices of a bounded number of items,
so a large cluster is many rows and many tasks. A slice is one row: ids, and the vectors
as one run of 32-bit numbers, which a task takes as a matrix without copying.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sequoria.operators import vectors as v
from sequoria.sources.tables import written

#: Items in a slice.
SLICE_ITEMS = 4096


@dataclass(frozen=True)
class Lists:
    """``slices`` (cluster, slice, ids, data), written in order of clusters, and the ``centres`` (cluster, centre)."""

    slices: DataFrame
    centres: DataFrame
    width: int
    copies: int = 1


def build_lists(items: DataFrame, centres: DataFrame, width: int, copies: int = 1, slice_items: int = SLICE_ITEMS) -> Lists:
    """Every row of ``items`` (id, vector) in the lists of its ``copies`` nearest centres; vectors have ``width`` numbers.

    Several copies make the index larger and spare probes, as an item near the edge of a list is in the next one too.

    A list's number of slices follows its count, so that hot lists are split; one shuffle.
    """

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, data = pa.array([group.column("id").to_pylist()], pa.list_(pa.int64())), group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), ids, pa.array([data], pa.binary())], ["cluster", "slice", "ids", "data"])

    placed = written(v.with_clusters(items.select(F.col("id").cast("long").alias("id"), "vector"), centres, copies))
    sizes = placed.groupBy("cluster").agg(F.ceil(F.count("*") / slice_items).alias("_slices"))  # as many rows as centres
    dealt = placed.join(F.broadcast(sizes), "cluster").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("_slices"))).drop("_slices")
    slices = dealt.groupBy("cluster", "slice").applyInArrow(pack, "cluster int, slice long, ids array<long>, data binary")
    return Lists(written(slices.sortWithinPartitions("cluster")), centres, width, copies)


def list_top_k(lists: Lists, queries: DataFrame, k: int, probes: int, block: int = v.QUERY_BLOCK) -> DataFrame:
    """(query, item, score, rank) of the ``k`` best items of each query's ``probes`` lists; equal scores by id.

    Blocks of at most ``block`` queries are broadcast with the lists they probe; only slices
    of those lists are read. A task multiplies a slice with the queries that probe its list
    and keeps its own best of each query, a bounded number of scores at a time. Scores are
    rounded to 9 decimals.
    """
    spark = lists.slices.sparkSession
    parts = []
    width, most = lists.width, k * lists.copies  # an item may be met as often as it has copies
    for ids, rows, probing in v.probing_blocks(queries, lists.centres, probes, block):
        shared = spark.sparkContext.broadcast((ids, rows, probing))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q, by = shared.value
            best = v._Probed(by, q, most)
            for batch in batches:
                for cluster, own, data in zip(batch.column("cluster").to_pylist(), batch.column("ids"), batch.column("data")):
                    best.add(cluster, own.values.to_numpy(), np.frombuffer(data.as_buffer(), "<f4").reshape(-1, width).astype(np.float64))
            yield from best.rows(q_ids)

        wanted = lists.slices.filter(F.col("cluster").isin(sorted(probing)))
        parts.append(wanted.mapInArrow(run, f"query {queries.schema['id'].dataType.simpleString()}, item long, score double"))
    if not parts:
        return spark.createDataFrame([], "query long, item long, score double, rank int")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    return found.dropDuplicates(["query", "item"]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
