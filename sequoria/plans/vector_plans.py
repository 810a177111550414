"""Queries over vectors: nearest items, lists made of them, averages, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequoria.functions import arrays as a
from sequoria.operators import features, pairs, personal, ranking, recommend
from sequoria.operators import vectors as v
from sequoria.plans import inputs as i


def _top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    items = i.vectors(spark, sf_dir)
    found = v.exact_top_k(items, i.vector_queries(spark, sf_dir), k)
    labels = items.select(F.col("id").alias("item"), F.col("label").alias("artist"))
    return found.withColumnRenamed("query", "case").join(labels, "item")


def exact_top_k(spark, sf_dir):
    """The ten nearest of all vectors for the stated query set."""
    return _top(spark, sf_dir, 10).select(F.col("case").alias("query"), "item", F.round("score", 6).alias("score"), "rank")


def clustered_top_k(spark, sf_dir):
    """The ten nearest by clusters: every vector indexed, a query meets its best clusters' vectors."""
    items = i.vectors(spark, sf_dir)
    centres = v.fitted_centres(items, 16)
    return v.clustered_top_k(v.with_clusters(items, centres), i.vector_queries(spark, sf_dir), centres, 10, 8)


def clustered_recall(spark, sf_dir):
    return v.recall(clustered_top_k(spark, sf_dir), v.exact_top_k(i.vectors(spark, sf_dir), i.vector_queries(spark, sf_dir), 10))


def diversified_top_k(spark, sf_dir):
    """Ten of the nearest fifty, two of a label at most."""
    return ranking.diversified(_top(spark, sf_dir, 50), 10, 2).select("case", "item", "artist", "rank")


def without_inputs(spark, sf_dir):
    """The nearest twenty without those whose id 3 divides, ten of them, filled up with these."""
    top = _top(spark, sf_dir, 20).select("case", "item", "rank")
    return ranking.without_inputs(top, top.filter("item % 3 = 0"), 10)


def target_ranks(spark, sf_dir):
    """The rank of the next id among all scores."""
    items = i.vectors(spark, sf_dir)
    targets = i.vector_queries(spark, sf_dir).select(F.col("id").alias("case"), (F.col("id") + 1).alias("item"))
    return v.ranks_among(items, i.vector_queries(spark, sf_dir), targets)


def final_ranks(spark, sf_dir):
    queries = i.vector_queries(spark, sf_dir)
    targets = queries.select(F.col("id").alias("case"), F.explode(F.array(F.col("id"), F.col("id") + 1, F.col("id") + 2)).alias("item"))
    return ranking.final_ranks(targets, _top(spark, sf_dir, 100))


def artist_variety(spark, sf_dir):
    last = i.vector_queries(spark, sf_dir).select(F.col("id").alias("case"), F.col("label").alias("artist"))
    return ranking.artist_variety(_top(spark, sf_dir, 10), last).withColumn("last_share", F.round("last_share", 9))


def score_features(spark, sf_dir):
    out = features.score_features(_top(spark, sf_dir, 20), 1000)
    return out.select("case", "item", F.round("score_gap", 6).alias("score_gap"), F.round("log_rank", 9).alias("log_rank"))


def neighbour_features(spark, sf_dir):
    """Share of the fifty nearest vectors that have a label, for every label."""
    near = _top(spark, sf_dir, 50).select("case", F.col("item").alias("seq"), "rank")
    members = i.vectors(spark, sf_dir).select(F.col("id").alias("seq"), F.col("label").alias("item"))
    candidates = near.select("case").distinct().crossJoin(F.broadcast(members.select("item").distinct()))
    out = features.neighbour_features(candidates, near, members)
    return out.select("case", "item", F.round("neighbours", 9).alias("neighbours"), F.round("near_neighbours", 9).alias("near_neighbours"))


def _numbers(vectors: DataFrame, key: str) -> DataFrame:
    """(key, place, x) of every number of every vector."""
    return vectors.select(key, F.posexplode("vector").alias("place", "x")).withColumn("x", F.round("x", 6))


def average_vectors(spark, sf_dir):
    """Each label's mean vector weighted by id + 1, as long as a typical one; all of its numbers."""
    return _numbers(v.average_vectors(i.vectors(spark, sf_dir), ["label"], F.col("id") + 1, lengthened=True), "label")


def unfit_vectors(spark, sf_dir):
    """Vectors longer than any of the first labels'."""
    items = i.vectors(spark, sf_dir)
    return v.unfit_vectors(items, items.filter("label < 3"), 1.0).select("id")


def stand_in_vectors(spark, sf_dir):
    """Stand-ins for the stated queries from their label's vectors and their nearest ones."""
    items = i.vectors(spark, sf_dir)
    new = i.vector_queries(spark, sf_dir).select(F.col("id").alias("new"), F.col("label").alias("artist"))
    own = items.select(F.col("label").alias("artist"), F.col("id").alias("item"), (F.col("id") % 9).alias("listens"))
    near = v.exact_top_k(items, i.vector_queries(spark, sf_dir), 5).select(F.col("query").alias("new"), "item", (F.lit(6) - F.col("rank")).alias("n"))
    weights = v.stand_in_weights(new, own, near)
    return _numbers(v.stand_ins(weights, items), "new")


def quantised_overlap(spark, sf_dir):
    """How many of each query's ten nearest stay when vectors have 16 steps for each number."""
    items, queries = i.vectors(spark, sf_dir), i.vector_queries(spark, sf_dir)
    near, rough = v.exact_top_k(items, queries, 10), v.exact_top_k(v.quantised(items, 15), queries, 10)
    return near.join(rough.select("query", "item", F.lit(1).alias("_kept")), ["query", "item"], "left").groupBy("query").agg(F.count("_kept").alias("kept"))


def taste_vectors(spark, sf_dir):
    """Each user's recency-weighted mean of the vectors of what they played before a day; all numbers of it."""
    plays = i.listens(spark, sf_dir).join(i.vectors(spark, sf_dir).select(F.col("id").alias("item"), "vector"), "item")
    return _numbers(personal.taste_vectors(plays.select("user", "sec", "vector"), i.START + 24 * 86_400), "user")


def recommended(spark, sf_dir):
    """Requests of the ten vectors before each stated query, answered with diversity."""
    items = i.vectors(spark, sf_dir)
    inputs = i.vector_queries(spark, sf_dir).select(F.col("id").alias("case"), F.posexplode(F.sequence(F.col("id"), F.col("id") + 9)).alias("place", "item"))
    walks = items.select((F.floor(F.col("id") / 20)).alias("seq"), (F.col("id") % 20).alias("pos"), F.col("id").alias("item"))
    artists = items.select(F.col("id").alias("item"), F.col("label").alias("artist"))
    return recommend.recommended(inputs, items, artists, pairs.pair_counts(walks))


def fitted_ranker(spark, sf_dir):
    """A linear correction of scores and ranks that tells items of the query's own label; its mean by label equality."""
    top = _top(spark, sf_dir, 50)
    own = i.vector_queries(spark, sf_dir).select(F.col("id").alias("case"), F.col("label").alias("own"))
    rows = features.score_features(top, 1000).join(top.select("case", "item", "artist"), ["case", "item"]).join(own, "case").withColumn("label", (F.col("artist") == F.col("own")).cast("double"))
    from pyspark.ml.functions import vector_to_array

    scored = features.fitted_correction(rows, ["score_gap", "log_rank"]).transform(rows)
    return scored.withColumn("p", F.get(vector_to_array("probability"), F.lit(1))).groupBy("label").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"))


QUERIES = {f.__name__: f for f in (exact_top_k, clustered_top_k, clustered_recall, diversified_top_k, without_inputs, target_ranks, final_ranks, artist_variety, score_features, neighbour_features, average_vectors, unfit_vectors, stand_in_vectors, taste_vectors, quantised_overlap, recommended, fitted_ranker)}

_NORMS = "nv AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)"

SQL = {
    "exact_top_k": f"WITH {i.SCORES} SELECT query, item, round(score, 6) AS score, rank FROM t WHERE rank <= 10",
    "diversified_top_k": f'WITH {i.SCORES}, x AS (SELECT *, (row_number() OVER (PARTITION BY query, label ORDER BY rank) > 2)::INT AS o FROM t WHERE rank <= 50) SELECT query AS "case", item, label AS artist, rank FROM x QUALIFY row_number() OVER (PARTITION BY query ORDER BY o, rank) <= 10',
    "without_inputs": f'WITH {i.SCORES} SELECT query AS "case", item, row_number() OVER (PARTITION BY query ORDER BY (item % 3 = 0)::INT, rank) AS rank FROM t WHERE rank <= 20 QUALIFY row_number() OVER (PARTITION BY query ORDER BY (item % 3 = 0)::INT, rank) <= 10',
    "target_ranks": f'WITH {i.SCORES} SELECT x.query AS "case", x.item, 1 + count(*) FILTER (y.score > x.score) AS rank FROM s x JOIN s y ON x.query = y.query WHERE x.item = x.query + 1 GROUP BY ALL',
    "final_ranks": f"WITH {i.SCORES}, g AS (SELECT vec_id AS \"case\", unnest([vec_id, vec_id + 1, vec_id + 2]) AS item FROM embeddings WHERE vec_id % 100 = 0) SELECT \"case\", g.item, coalesce(CASE WHEN rank <= 100 THEN rank END, {ranking.MISSED})::BIGINT AS rank FROM g LEFT JOIN t ON t.query = \"case\" AND t.item = g.item",
    "artist_variety": f'WITH {i.SCORES} SELECT query AS "case", count(DISTINCT label) AS artists, round(avg((label = q_label)::INT), 9) AS last_share FROM t WHERE rank <= 10 GROUP BY ALL',
    "score_features": f'WITH {i.SCORES} SELECT query AS "case", item, round(score - max(score) OVER (PARTITION BY query), 6) AS score_gap, round(ln(rank), 9) AS log_rank FROM t WHERE rank <= 20',
    "neighbour_features": f'WITH {i.SCORES}, n AS (SELECT query, label, count(*) AS n, count(*) FILTER (rank <= 10) AS m FROM t WHERE rank <= 50 GROUP BY ALL) SELECT q.query AS "case", l.label AS item, round(coalesce(n, 0) / 50, 9) AS neighbours, round(coalesce(m, 0) / 10, 9) AS near_neighbours FROM (SELECT DISTINCT query FROM t) q CROSS JOIN (SELECT DISTINCT label FROM embeddings) l LEFT JOIN n ON n.query = q.query AND n.label = l.label',
    "average_vectors": f"""WITH {_NORMS}, x AS (SELECT label, vec_id + 1 AS w, norm, unnest(e) AS x, unnest(range(64)) AS i FROM nv), m AS (SELECT label, i, sum(w * x) / sum(w) AS x, sum(w * norm) / sum(w) AS typical FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY label)
        SELECT label, i::INTEGER AS place, round(x * typical / norm, 6) AS x FROM m JOIN n USING (label)""",
    "stand_in_vectors": f"""WITH {i.SCORES}, {_NORMS}, ne AS (SELECT query AS new, item, (6 - rank) / sum(6 - rank) OVER (PARTITION BY query) AS share FROM t WHERE rank <= 5),
        ow AS (SELECT q.vec_id AS new, e.vec_id AS item, (e.vec_id % 9 + 1) / sum(e.vec_id % 9 + 1) OVER (PARTITION BY q.vec_id) AS share, count(*) OVER (PARTITION BY q.vec_id) AS n FROM nv q JOIN nv e ON e.label = q.label WHERE q.vec_id % 100 = 0),
        ok AS (SELECT new, item, share FROM ow WHERE n >= 3), wt AS (SELECT new, item, sum(w) AS w FROM (SELECT new, item, share / 2 AS w FROM ok UNION ALL SELECT new, item, CASE WHEN new IN (SELECT new FROM ok) THEN share / 2 ELSE share END FROM ne) GROUP BY ALL),
        x AS (SELECT new, w, norm, unnest(e) AS x, unnest(range(64)) AS i FROM wt JOIN nv ON vec_id = item), m AS (SELECT new, i, sum(w * x) / sum(w) AS x, sum(w * norm) / sum(w) AS typical FROM x GROUP BY ALL), n AS (SELECT new, sqrt(sum(x * x)) AS norm FROM m GROUP BY new)
        SELECT new, i::INTEGER AS place, round(x * typical / norm, 6) AS x FROM m JOIN n USING (new)""",
    "quantised_overlap": f"""WITH {i.SCORES}, n AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), m AS (SELECT i, min(x) AS lo, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / 15 ELSE 1.0 END AS step FROM n GROUP BY i),
        r AS (SELECT vec_id, list(round_even((x - lo) / step, 0) * step + lo ORDER BY i) AS e FROM n JOIN m USING (i) GROUP BY vec_id), rt AS (SELECT query, item FROM (SELECT q.vec_id AS query, r.vec_id AS item, round(list_dot_product(q.embedding::DOUBLE[], r.e), 9) AS score FROM embeddings q, r WHERE q.vec_id % 100 = 0) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, item) <= 10)
        SELECT t.query, count(rt.item) AS kept FROM t LEFT JOIN rt ON rt.query = t.query AND rt.item = t.item WHERE t.rank <= 10 GROUP BY t.query""",
    "taste_vectors": f"""WITH {i.LISTENS}, {_NORMS}, x AS (SELECT "user", 0.5 ** (({i.START + 24 * 86_400} - sec) / 86400.0 / 30) AS w, norm, unnest(e) AS x, unnest(range(64)) AS i FROM l JOIN nv ON vec_id = item WHERE sec < {i.START + 24 * 86_400}),
        m AS (SELECT "user", i, sum(w * x) / sum(w) AS x, sum(w * norm) / sum(w) AS typical FROM x GROUP BY ALL), n AS (SELECT "user", sqrt(sum(x * x)) AS norm FROM m GROUP BY ALL) SELECT "user", i::INTEGER AS place, round(x * typical / norm, 6) AS x FROM m JOIN n USING ("user")""",
    "recommended": f"""WITH {_NORMS}, ct AS (SELECT vec_id AS "case", unnest(range(10)) AS place, vec_id + unnest(range(10)) AS item FROM embeddings WHERE vec_id % 100 = 0),
        qx AS (SELECT "case", 0.7 ** (9 - place) AS w, unnest(e) AS x, unnest(range(64)) AS i FROM ct JOIN nv ON vec_id = item), qi AS (SELECT "case", i, sum(w * x) / sum(w) AS x FROM qx GROUP BY ALL), qv AS (SELECT "case", list(x ORDER BY i) AS q FROM qi GROUP BY "case"),
        sc AS (SELECT "case", vec_id AS item, label AS artist, round(list_dot_product(e, q), 9) AS score FROM qv, nv), sh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY score DESC, item) AS rank FROM sc) WHERE rank <= 110),
        fl AS (SELECT sh.*, (ct.item IS NOT NULL)::INT AS isin FROM sh LEFT JOIN ct ON ct."case" = sh."case" AND ct.item = sh.item), fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY isin, rank) AS place FROM fl) WHERE place <= 100),
        wk AS (SELECT vec_id // 20 AS seq, vec_id % 20 AS pos, vec_id AS item FROM embeddings), pc AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM wk x JOIN wk y ON x.seq = y.seq AND y.pos BETWEEN x.pos + 1 AND x.pos + 5 GROUP BY ALL),
        af AS (SELECT fr."case", fr.item, sum(coalesce(n, 0)) AS s FROM fr JOIN ct ON ct."case" = fr."case" LEFT JOIN pc ON pc.a = ct.item AND pc.b = fr.item GROUP BY ALL),
        rs AS (SELECT "case", item, artist, round(score + 0.1 * ln(1 + s), 9) AS score, place FROM fr JOIN af USING ("case", item)), rr AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY score DESC, place) AS rank FROM rs),
        dv AS (SELECT *, (row_number() OVER (PARTITION BY "case", artist ORDER BY rank) > 3)::INT AS o FROM rr), ch AS (SELECT * FROM dv QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY o, rank) <= 10)
        SELECT "case", item, artist, score, (row_number() OVER (PARTITION BY "case" ORDER BY rank))::INTEGER AS rank FROM ch""",
    "unfit_vectors": f"WITH {_NORMS} SELECT vec_id AS id FROM nv WHERE norm > (SELECT max(norm) FROM nv WHERE label < 3)",
}
