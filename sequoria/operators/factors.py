"""Item vectors made from sequences: a factorisation of the pair table, and what to expect of its next items.

Counts of "b after a" are factorised as implicit feedback: each item gets a vector as the
item that comes next, and one as the context that it comes after. A sequence's query is
the decayed mean of its last items' context vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sequoria.operators import ranking as r
from sequoria.operators import vectors as v
from sequoria.sources.tables import shared_folder


#: Pairs in a block of ids on average, so that blocks do not grow with the table; there are BLOCKS of them at least. Each half round sends
#: a block all factors that it needs, so more blocks than memory asks for write them more often.
BLOCK_PAIRS, BLOCKS = 8_000_000, 10


@dataclass(frozen=True)
class Factors:
    """``items`` and ``contexts``: (id, vector)."""

    items: DataFrame
    contexts: DataFrame


def fitted_factors(pairs: DataFrame, rank: int = 32, rounds: int = 8, confidence: float = 1.0, penalty: float = 0.05, seed: int = 0) -> Factors:
    """Alternating least squares over all of ``pairs`` (a, b, n); ids are whole numbers below 2^31.

    Counts weigh in by their logarithm, as a few pairs have most of the counts. Factors are
    dealt in blocks of ids, so no side is held in one place; lineage is cut by a checkpoint of
    each round in the shared folder, which lets the round's shuffle files go.
    """
    from pyspark.ml.recommendation import ALS

    shared_folder(pairs.sparkSession)
    rated = pairs.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.log1p(F.col("n").cast("double")).cast("float").alias("rating"))
    blocks = max(BLOCKS, -(-pairs.count() // BLOCK_PAIRS))
    als = ALS(numUserBlocks=blocks, numItemBlocks=blocks, rank=rank, maxIter=rounds, implicitPrefs=True, alpha=confidence, regParam=penalty, seed=seed, userCol="a", itemCol="b", ratingCol="rating", coldStartStrategy="drop", checkpointInterval=1)
    model = als.fit(rated)
    side = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("features").alias("vector"))
    return Factors(side(model.itemFactors), side(model.userFactors))


def next_item_queries(inputs: DataFrame, contexts: DataFrame, mix: float = 0.8, length: int = 10) -> DataFrame:
    """(id, vector) of each case with a known input: the decayed mean of its last ``length`` items' context vectors. ``inputs``: case, place, item."""
    back = F.row_number().over(Window.partitionBy("case").orderBy(F.desc("place"))) - 1
    last = inputs.withColumn("back", back).filter(F.col("back") < length)
    located = last.join(contexts.select(F.col("id").alias("item"), "vector"), "item").select(F.col("case").alias("seq"), "back", "vector")
    return v.mixed_queries(located, mix).withColumnRenamed("seq", "id")


def expected_next(inputs: DataFrame, factors: Factors, k: int, mix: float = 0.8, length: int = 10) -> DataFrame:
    """(case, item, score, rank): the ``k`` items that the factors expect next. Cases are the stated query set."""
    found = v.exact_top_k(factors.items, next_item_queries(inputs, factors.contexts, mix, length), k)
    return found.select(F.col("query").alias("case"), "item", "score", "rank")


def popular_next(cases: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(case, item, score, rank): the same ``k`` most frequent items for every case, the baseline. ``counts``: item, n."""
    top = r.most_played(counts.select(F.col("item").alias("id"), "n"), k)
    ranked = top.select(F.col("id").alias("item"), F.col("n").cast("double").alias("score"), F.row_number().over(Window.orderBy(F.desc("n"), "id")).alias("rank"))
    return cases.select("case").crossJoin(F.broadcast(ranked))  # k rows


def next_item_summary(targets: DataFrame, ranked: DataFrame) -> DataFrame:
    """n, ndcg_10, hits and recalls of held-out ``targets`` (case, item) in ``ranked``; a case that got no list is missed."""
    return r.score_summary(r.final_ranks(targets, ranked))
