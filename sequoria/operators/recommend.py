"""A batch of recommendation requests as one plan: names to ids, nearest items, inputs out, features, diversity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sequoria.operators import pairs as p
from sequoria.operators import ranking as r
from sequoria.operators import vectors as v


def last_inputs(inputs: DataFrame, length: int) -> DataFrame:
    """The last ``length`` known items of each request, each at its last place: (case, place, n_items, item)."""
    once = inputs.filter("item IS NOT NULL").groupBy("case", "item").agg(F.max("place").alias("place"))
    w = Window.partitionBy("case")
    kept = once.withColumn("_back", F.row_number().over(w.orderBy(F.desc("place")))).filter(F.col("_back") <= length)
    return kept.withColumn("n_items", F.count("*").over(w).cast("int")).select("case", (F.col("n_items") - F.col("_back")).alias("place"), "n_items", "item")


def recommended(inputs: DataFrame, items: DataFrame, artists: DataFrame, pairs: DataFrame, k: int = 10, shortlist: int = 100, mix: float = 0.7, pair_weight: float = 0.1, per_artist: int = 3, length: int = 10) -> DataFrame:
    """(case, item, artist, score, rank). ``inputs``: case, place, item; ``items``: id, vector; ``artists``: item, artist; ``pairs``: a, b, n.

    A query is the decayed mean of its inputs' vectors; the shortlist is scored again with
    what usually follows the inputs. Requests are the stated query set.
    """
    context = last_inputs(inputs, length)
    located = context.join(items.select(F.col("id").alias("item"), "vector"), "item").select(F.col("case").alias("seq"), (F.col("n_items") - 1 - F.col("place")).alias("back"), "vector")
    queries = v.mixed_queries(located, mix).withColumnRenamed("seq", "id")
    short = v.exact_top_k(items, queries, shortlist + length).select(F.col("query").alias("case"), "item", "score", "rank")
    fresh = r.without_inputs(short, context, shortlist)
    counted = p.after_counts(context, fresh, pairs)
    scored = fresh.join(counted.select("case", "item", "after_sum"), ["case", "item"], "left").withColumn("score", F.round(F.col("score") + pair_weight * F.log1p(F.coalesce("after_sum", F.lit(0)).cast("double")), 9)).drop("after_sum")
    named = r.reranked(scored).join(artists.select("item", "artist"), "item")
    chosen = r.diversified(named, k, per_artist)
    return chosen.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy("rank"))).select("case", "item", "artist", "score", "rank")
