"""The driver tables as listens, playlists, items and vectors, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sequoria.operators import sequences as q

#: Kinds of events in order; an item is a number of the payload and a kind.
KINDS = ("click", "error", "purchase", "signup", "view")
TIES = ("event_id",)
#: Rules that suit sparse events: sessions end after a day, a day of more than 20 events is noise, as are two within 10 minutes.
GAP, MIN_LENGTH, MAX_DAY, SKIP = 86_400, 4, 20, 600
#: The first second of the events' month.
START = 1_704_067_200
MIN_COUNT = 30


#: Rows of a table for each part that it is dealt out to, so that a task's rows do not grow with the table.
ROWS_A_PART = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Parts of ROWS_A_PART rows of a table (its files' footers tell how many there are), one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // ROWS_A_PART))


def listens(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")) - 1
    sec = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("user"), sec.cast("long").alias("sec"), (F.get_json_object("props", "$.k").cast("long") * 5 + kind).alias("item"), "event_type", "value", "ts")


LISTENS = f"l AS (SELECT event_id, user_id AS \"user\", floor(epoch(ts))::BIGINT AS sec, json_extract(props, '$.k')::BIGINT * 5 + list_position({list(KINDS)}, event_type) - 1 AS item, event_type, value, ts FROM events)"


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, pos, item) of orders, dealt out by seq; what goes on by seq needs no other shuffle."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_partkey").alias("item"), "l_linenumber", "l_suppkey")
    w = Window.partitionBy("seq").orderBy("l_linenumber", "item", "l_suppkey")
    return rows.repartition(parts(spark, sf_dir, "lineitem"), "seq").select("seq", (F.row_number().over(w) - 1).alias("pos"), "item")


PLAYLISTS = "p AS (SELECT l_orderkey AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_partkey AS item FROM lineitem)"


def known_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlists with items of fewer than MIN_COUNT places outside the vocabulary."""
    rows = playlists(spark, sf_dir)
    return q.in_vocabulary(rows, q.frequent_items(rows, MIN_COUNT).select("item", F.col("item").alias("id"))).select("seq", "pos", "item")


KNOWN = f"{PLAYLISTS}, v AS (SELECT item FROM p GROUP BY item HAVING count(*) >= {MIN_COUNT}), k AS (SELECT seq, pos, CASE WHEN item IN (SELECT item FROM v) THEN item END AS item FROM p)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: ids that 100 divides."""
    return vectors(spark, sf_dir).filter(F.col("id") % 100 == 0)


SCORES = "s AS (SELECT q.vec_id AS query, e.vec_id AS item, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score, e.label, q.label AS q_label FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s)"


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, artist, album, genres, length_ms) of parts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"), F.split("p_name", " ").alias("genres"), (F.col("p_size") * 10_000).alias("length_ms"))


def contexts_and_candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cases are orders: all places but the last are the context, the last item and the two most frequent ones the candidates."""
    rows = playlists(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("seq"))
    sized = rows.withColumn("n", n).filter("n > 1")
    contexts = sized.filter("pos < n - 1").select(F.col("seq").alias("case"), F.col("pos").alias("place"), (F.col("n") - 1).alias("n_items"), "item")
    frequent = rows.groupBy("item").agg(F.count("*").alias("_c")).orderBy(F.desc("_c"), "item").limit(2).agg(F.collect_list("item").alias("_frequent"))
    last = sized.filter("pos = n - 1").select(F.col("seq").alias("case"), "item").crossJoin(F.broadcast(frequent))
    return contexts, last.select("case", F.explode(F.array_distinct(F.concat(F.array("item"), "_frequent"))).alias("item"))


CONTEXTS = f"""{PLAYLISTS}, z AS (SELECT *, count(*) OVER (PARTITION BY seq) AS n FROM p),
c AS (SELECT seq AS "case", pos AS place, n - 1 AS n_items, item FROM z WHERE n > 1 AND pos < n - 1),
f AS (SELECT item FROM p GROUP BY item ORDER BY count(*) DESC, item LIMIT 2),
d AS (SELECT seq AS "case", item FROM z WHERE n > 1 AND pos = n - 1 UNION SELECT seq, f.item FROM z, f WHERE n > 1 AND pos = n - 1)"""

PAIRS = "pc AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM p x JOIN p y ON x.seq = y.seq AND y.pos BETWEEN x.pos + 1 AND x.pos + 5 GROUP BY ALL)"
POPULAR = "pop AS (SELECT item, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, item) AS rank FROM p GROUP BY item)"
