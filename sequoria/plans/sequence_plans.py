"""Queries over playlists: catalogs, windows, targets, pairs, features, metrics, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequoria.functions import arrays as a
from sequoria.functions import text as t
from sequoria.operators import catalog as c
from sequoria.operators import features, ids, incremental, pairs, ranking, reports, search
from sequoria.operators import sequences as q
from sequoria.plans import inputs as i

LENGTH = 4


def _listed(rows: DataFrame, *columns: str) -> DataFrame:
    """Arrays as comma-joined text, which any comparison of results can read."""
    return rows.withColumns({c: F.concat_ws(",", F.col(c).cast("array<string>")) for c in columns})


def mode_per_item(spark, sf_dir):
    return c.mode_per_item(i.table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "item"), "l_suppkey")


def median_per_item(spark, sf_dir):
    rows = i.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_quantity").cast("long").alias("quantity"))
    return c.median_per_item(rows, "quantity")


def item_columns(spark, sf_dir):
    rows = i.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("track"), F.col("l_linenumber").alias("release"), (F.col("l_quantity") * 1000).cast("long").alias("duration_ms"))
    return c.item_columns(rows)


def record_conflicts(spark, sf_dir):
    return c.conflicts(i.table(spark, sf_dir, "lineitem").withColumn("line", F.col("l_orderkey") * 100 + F.col("l_linenumber")), "line", "l_partkey", "l_suppkey")


def first_appearance_ids(spark, sf_dir):
    rows = i.playlists(spark, sf_dir).withColumn("place", F.col("seq") * 100 + F.col("pos"))
    return ids.first_appearance_ids(rows, "item", "place")


def appended_ids(spark, sf_dir):
    """Ids of the parts of the first suppliers' lines, and the other parts behind them."""
    rows = i.table(spark, sf_dir, "lineitem")
    known = ids.with_dense_id(rows.filter("l_linenumber = 1").select(F.col("l_partkey").alias("item")).distinct(), F.col("item")).select("item", "id")
    new = rows.groupBy(F.col("l_partkey").alias("item")).agg(F.count("*").alias("n"))
    return ids.appended_ids(known, new, "item", "n")


def frequent_items(spark, sf_dir):
    return q.frequent_items(i.playlists(spark, sf_dir), i.MIN_COUNT)


def fixed_windows(spark, sf_dir):
    return _listed(q.fixed_windows(i.known_playlists(spark, sf_dir), 2), "inputs")


def chunk_runs(spark, sf_dir):
    return _listed(q.chunks(i.known_playlists(spark, sf_dir), 3), "inputs", "targets")


def any_length_cases(spark, sf_dir):
    return _listed(q.any_length_cases(i.known_playlists(spark, sf_dir), LENGTH), "inputs")


def prefix_windows(spark, sf_dir):
    return _listed(q.prefix_windows(i.playlists(spark, sf_dir), LENGTH), "inputs")


def history_matrix(spark, sf_dir):
    return _listed(q.histories(i.known_playlists(spark, sf_dir), 6), "history")


def next_targets(spark, sf_dir):
    rows = q.next_targets(i.known_playlists(spark, sf_dir), 5)
    return _listed(rows.withColumn("targets", F.transform("targets", lambda x: F.coalesce(x, F.lit(-1).cast("long")))), "targets")


def case_targets(spark, sf_dir):
    rows = i.known_playlists(spark, sf_dir)
    out = q.case_targets(q.any_length_cases(rows, LENGTH), rows, 3)
    return _listed(out.select("seq", "pos", F.transform("targets", lambda x: F.coalesce(x, F.lit(-1).cast("long"))).alias("targets")), "targets")


def last_positions(spark, sf_dir):
    return q.last_positions(i.known_playlists(spark, sf_dir))


def augmented_cases(spark, sf_dir):
    return q.augmented(q.any_length_cases(i.playlists(spark, sf_dir), 10), 0.5)


def pair_counts(spark, sf_dir):
    return pairs.pair_counts(i.known_playlists(spark, sf_dir))


def pair_merge(spark, sf_dir):
    """The pair tables of even and odd playlists added up, with those of items from id 100 on apart."""
    rows, parts = i.playlists(spark, sf_dir), i.parts(spark, sf_dir, "lineitem")
    both = incremental.updated_pairs(*(pairs.pair_counts(rows.filter(f"seq % 2 = {k}"), parts=parts) for k in range(2)))
    return pairs.involving_new(both, 100)


def popularity_ranks(spark, sf_dir):
    return ranking.popularity_ranks(i.playlists(spark, sf_dir))


def _case_ranks(spark, sf_dir) -> DataFrame:
    rows = i.playlists(spark, sf_dir)
    cases = q.any_length_cases(rows, 10).select("seq", "pos", F.size("inputs").alias("n_inputs"), F.col("target").alias("item"))
    return cases.join(ranking.popularity_ranks(rows), "item")


def popularity_baseline(spark, sf_dir):
    """Metrics of ranking by popularity, over every case, by length of input."""
    out = ranking.by_length(_case_ranks(spark, sf_dir))
    return out.select("length_group", "n", *(F.round(x, 9).alias(x) for x in out.columns if x not in ("length_group", "n")))


def multi_target_gains(spark, sf_dir):
    """NDCG of the next five items by popularity, weights falling by 0.8."""
    rows = i.playlists(spark, sf_dir)
    ranked = rows.join(ranking.popularity_ranks(rows).select("item", "rank"), "item", "left").select("seq", "pos", F.struct("item", "rank").alias("item"))
    targets = q.next_targets(pairs.dealt(ranked, i.parts(spark, sf_dir, "lineitem"), "seq"), 5)
    ranks = F.transform("targets", lambda x: F.coalesce(x["rank"], F.lit(0)))
    weights = F.array(*(F.lit(0.8**d) for d in range(5)))
    return targets.select("seq", "pos", F.round(a.multi_target_gain(ranks, weights, 1000), 9).alias("gain"))


def later_in_playlist(spark, sf_dir):
    """Share of the ten most popular items that a playlist goes on to hold, for every case."""
    rows = i.playlists(spark, sf_dir)
    top = ranking.popularity_ranks(rows).filter("rank <= 10").select("item")
    cases = q.any_length_cases(rows, 10).select(F.struct("seq", "pos").alias("case"), "seq", "pos")
    later = q.later_in_sequence(cases.crossJoin(F.broadcast(top)), q.last_positions(rows))
    return later.select("case.seq", "case.pos", F.round("later", 9).alias("later"))


def cooccurrence_features(spark, sf_dir):
    contexts, candidates = i.contexts_and_candidates(spark, sf_dir)
    parts = i.parts(spark, sf_dir, "lineitem")
    out = features.cooccurrence_features(candidates, contexts, pairs.pair_counts(i.playlists(spark, sf_dir), parts=parts), parts)
    return _rounded(out)


def overlap_features(spark, sf_dir):
    contexts, candidates = i.contexts_and_candidates(spark, sf_dir)
    return _rounded(features.overlap_features(candidates, contexts, i.attributes(spark, sf_dir), i.parts(spark, sf_dir, "lineitem")))


def length_features(spark, sf_dir):
    contexts, candidates = i.contexts_and_candidates(spark, sf_dir)
    return _rounded(features.length_features(candidates, contexts, i.attributes(spark, sf_dir)))


def popularity_features(spark, sf_dir):
    _, candidates = i.contexts_and_candidates(spark, sf_dir)
    return _rounded(features.popularity_features(candidates, ranking.popularity_ranks(i.playlists(spark, sf_dir))))


def sequence_length_feature(spark, sf_dir):
    contexts, _ = i.contexts_and_candidates(spark, sf_dir)
    return contexts.transform(features.sequence_length_feature).withColumn("sequence_length", F.round("sequence_length", 9))


def history_features(spark, sf_dir):
    """Overlap and co-occurrence over whole histories."""
    contexts, candidates = i.contexts_and_candidates(spark, sf_dir)
    parts = i.parts(spark, sf_dir, "lineitem")
    return _rounded(features.history_features(candidates, contexts, i.attributes(spark, sf_dir), pairs.pair_counts(i.playlists(spark, sf_dir), parts=parts), parts))


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("case", "item", *(F.round(x, 9).alias(x) for x in rows.columns if x not in ("case", "item")))


def quantile_buckets(spark, sf_dir):
    """Parts by quantile of size; sizes below 3 count as unknown."""
    parts = i.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") < 3, 0).otherwise(F.col("p_size")).alias("size"))
    cuts = reports.quantile_cuts(parts, "size", 8)
    return parts.crossJoin(F.broadcast(cuts)).select("p_partkey", a.quantile_bucket(F.col("size"), F.col("cuts")).alias("bucket"))


def share_by_bucket(spark, sf_dir):
    rows = i.table(spark, sf_dir, "part")
    return reports.share_by_bucket(rows, F.floor(F.col("p_size") / 10), F.col("p_size")).withColumn("share", F.round("share", 9))


def matched_plays(spark, sf_dir):
    """Lines matched by part where they have a key, else by name."""
    parts = i.table(spark, sf_dir, "part")
    plays = i.table(spark, sf_dir, "lineitem").join(parts.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_suppkey", F.when(F.col("l_linenumber") % 2 == 1, F.col("l_partkey")).alias("uri"), t.ascii_clean_text(F.col("p_name")).alias("song_key"))
    by_uri = parts.filter("p_size > 10").select(F.col("p_partkey").alias("uri"), F.col("p_partkey").alias("id"))
    by_key = c.lowest_id_lookup(parts.filter("p_size > 25").select(t.ascii_clean_text(F.col("p_name")).alias("song_key"), F.col("p_partkey").alias("id")))
    return c.matched(plays, by_uri, by_key).fillna(-1, ["uri", "id"])


def best_version(spark, sf_dir):
    counts = i.playlists(spark, sf_dir).groupBy("item").agg(F.count("*").alias("n"))
    named = i.table(spark, sf_dir, "part").join(counts, F.col("item") == F.col("p_partkey")).select(t.ascii_name_key(F.col("p_name")).alias("song_key"), F.col("p_partkey").alias("id"), "n")
    return c.best_version_lookup(named)


def resolved_genres(spark, sf_dir):
    """Nations' genres from segments of rich customers, else of all customers of the region, else none."""
    customers = i.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_acctbal", F.col("c_mktsegment").alias("genre"))
    nations = i.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    one = c.merged_votes(customers.filter("c_acctbal > 9500").select(F.col("nation").alias("artist"), "genre", F.lit(1).alias("votes"))).withColumnRenamed("artist", "nation")
    two = c.merged_votes(customers.filter("c_acctbal < 0").select(F.col("nation").alias("artist"), "genre", F.lit(1).alias("votes"))).withColumnRenamed("artist", "nation")
    return c.resolved_genres(nations, "nation", one, two).select("nation", F.array_join("genres", ",").alias("genres"))


def genre_vocab(spark, sf_dir):
    return c.genre_vocab(i.attributes(spark, sf_dir).select(F.col("item").alias("artist"), "genres"))


def word_vocab(spark, sf_dir):
    """Words by how many parts' names have them."""
    words = i.table(spark, sf_dir, "part").select(F.explode(F.array_distinct(t.name_words(F.col("p_name")))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("names"))


def joining_items(spark, sf_dir):
    counts = i.table(spark, sf_dir, "lineitem").join(i.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("item"), F.col("o_custkey").alias("user")).distinct().groupBy("item").agg(F.count("*").alias("users"))
    parts = i.table(spark, sf_dir, "part")
    outside = counts.join(parts, F.col("item") == F.col("p_partkey")).select(F.col("item").alias("key"), F.col("p_brand").alias("artist"), (F.col("p_partkey") % 700).alias("track"), "users")
    return c.joining_items(outside, parts.filter("p_size > 45").select(F.col("p_brand").alias("artist")), parts.filter("p_size = 1").select((F.col("p_partkey") % 700).alias("track")), 3, 500)


def unique_assignment(spark, sf_dir):
    """Each part takes a supplier slot that is its own: two choices, the most sold first."""
    sold = i.playlists(spark, sf_dir).groupBy("item").agg(F.count("*").alias("listens"))
    option = lambda k: F.concat(F.lit("slot:"), F.pmod(F.col("item") * k, F.lit(1511)).cast("string"))
    return c.uniquely_assigned(sold.select("item", "listens", option(7).alias("option1"), option(31).alias("option2"))).select("item", "uri")


def _named_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = i.playlists(spark, sf_dir).groupBy("item").agg(F.count("*").alias("n"))
    return i.table(spark, sf_dir, "part").join(counts, F.col("item") == F.col("p_partkey")).select(F.col("p_partkey").alias("id"), t.ascii_name_key(F.col("p_name")).alias("track"), t.ascii_name_key(F.col("p_brand")).alias("artist"), "n")


_TYPED = ("small ring", "blue bolt - brand#4", "red wid", "hot ge", "brand#1", "smal ringg", "nothing like it", "a - b - c")


def _typed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _TYPED], "query string").withColumn("key", t.ascii_name_key(F.col("query")))


def resolved_names(spark, sf_dir):
    return search.resolved(_typed(spark), _named_items(spark, sf_dir))


def names_starting(spark, sf_dir):
    """The ten most played items for each typed beginning (a menu)."""
    return search.starting_with(_typed(spark), _named_items(spark, sf_dir), 10)


def typed_names(spark, sf_dir):
    """The ten best items for each typed text, errors allowed (a menu)."""
    return search.typed(_typed(spark), _named_items(spark, sf_dir), 10)


def interpolated_counters(spark, sf_dir):
    """Order totals of a customer as a counter over time, read at the dates of the next customer's orders."""
    orders = i.table(spark, sf_dir, "orders").select(F.col("o_custkey"), F.expr("timestampdiff(DAY, TIMESTAMP_NTZ '1990-01-01 00:00:00', o_orderdate)").cast("double").alias("t"), "o_totalprice")
    samples = orders.groupBy(F.col("o_custkey").alias("series"), "t").agg(F.max("o_totalprice").alias("value"))
    points = orders.select((F.col("o_custkey") - 1).alias("series"), "t").distinct()
    return reports.interpolated(points, samples).filter("value IS NOT NULL")


QUERIES = {
    f.__name__: f
    for f in (mode_per_item, median_per_item, item_columns, record_conflicts, first_appearance_ids, appended_ids, frequent_items, fixed_windows, chunk_runs, any_length_cases, prefix_windows, history_matrix, next_targets, case_targets, last_positions, augmented_cases, pair_counts, pair_merge, popularity_ranks, popularity_baseline, multi_target_gains, later_in_playlist, cooccurrence_features, overlap_features, length_features, popularity_features, sequence_length_feature, history_features, quantile_buckets, share_by_bucket, matched_plays, best_version, resolved_genres, genre_vocab, word_vocab, joining_items, unique_assignment, resolved_names, names_starting, typed_names, interpolated_counters)
}

_LEADS = ", ".join(f"lead(item, {d}) OVER w" for d in range(1, 5))
_RUNS = "u AS (SELECT *, sum((item IS NULL)::INT) OVER (PARTITION BY seq ORDER BY pos) AS run FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY seq, run ORDER BY pos) - 1 AS kk FROM u WHERE item IS NOT NULL)"
_CASES = f"ca AS (SELECT * FROM (SELECT seq, pos, array_agg(item) OVER (PARTITION BY seq, run ORDER BY pos ROWS BETWEEN {LENGTH} PRECEDING AND 1 PRECEDING) AS inputs, item AS target FROM r) WHERE inputs IS NOT NULL)"
_NEXT = "nt AS (SELECT seq, pos, list_transform(xs, lambda x, j: CASE WHEN x IS NOT NULL AND list_position(xs, x) = j THEN x END) AS targets FROM (SELECT seq, pos, [item, {leads}] AS xs FROM {rows} WINDOW w AS (PARTITION BY seq ORDER BY pos)))"
_ALL_CASES = "ac AS (SELECT seq, pos, item, least(pos, 10) AS n_inputs FROM p WHERE pos > 0)"
_GROUP = "CASE WHEN n_inputs BETWEEN 11 AND 25 THEN '11-25' ELSE n_inputs::VARCHAR END"
_SHARE = "avg((rank <= {k})::INT)"
_SPLIT = "q AS (SELECT unnest(" + str(list(_TYPED)) + ") AS query), n AS (SELECT p_partkey AS id, p_name AS track, lower(p_brand) AS artist, n FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey), sp AS (SELECT query, array_to_string(parts[1:j], ' - ') AS track, array_to_string(parts[j + 1:], ' - ') AS artist FROM (SELECT query, string_split(query, ' - ') AS parts, unnest(range(1, len(string_split(query, ' - ')))) AS j FROM q))"

SQL = {
    "mode_per_item": "SELECT l_partkey AS item, l_suppkey AS mode FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) = 1",
    "median_per_item": "SELECT l_partkey AS item, quantile_disc(l_quantity::BIGINT, 0.5) AS median FROM lineitem GROUP BY l_partkey",
    "item_columns": """WITH x AS (SELECT l_partkey AS item, l_suppkey AS track, l_linenumber AS release, (l_quantity * 1000)::BIGINT AS ms FROM lineitem),
        t AS (SELECT item, track FROM (SELECT item, track, count(*) AS n FROM x GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY item ORDER BY n DESC, track) = 1),
        r AS (SELECT item, release FROM (SELECT item, release, count(*) AS n FROM x GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY item ORDER BY n DESC, release) = 1)
        SELECT item, count(*) AS listens, any_value(t.track) AS track, any_value(r.release) AS release, coalesce(quantile_disc(ms, 0.5) FILTER (ms BETWEEN 20000 AND 1800000), 0) AS length_ms FROM x JOIN t USING (item) JOIN r USING (item) GROUP BY item""",
    "record_conflicts": "SELECT l_orderkey * 100 + l_linenumber AS line, count(DISTINCT (l_partkey, l_suppkey)) AS variants FROM lineitem GROUP BY ALL HAVING variants > 1",
    "first_appearance_ids": f"WITH {i.PLAYLISTS} SELECT item, row_number() OVER (ORDER BY min(seq * 100 + pos), item) - 1 AS id FROM p GROUP BY item",
    "appended_ids": "WITH k AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS id FROM (SELECT DISTINCT l_partkey AS item FROM lineitem WHERE l_linenumber = 1)), n AS (SELECT l_partkey AS item, count(*) AS n FROM lineitem GROUP BY 1) SELECT * FROM k UNION ALL SELECT item, (SELECT count(*) FROM k) + row_number() OVER (ORDER BY n, item) - 1 FROM n WHERE item NOT IN (SELECT item FROM k)",
    "frequent_items": f"SELECT l_partkey AS item, count(*) AS n FROM lineitem GROUP BY 1 HAVING n >= {i.MIN_COUNT}",
    "fixed_windows": f"WITH {i.KNOWN}, x AS (SELECT seq, pos, [lag(item, 2) OVER w, lag(item, 1) OVER w] AS inputs, item AS target FROM k WINDOW w AS (PARTITION BY seq ORDER BY pos)) SELECT seq, pos, array_to_string(inputs, ',') AS inputs, target FROM x WHERE target IS NOT NULL AND inputs[1] IS NOT NULL AND inputs[2] IS NOT NULL",
    "chunk_runs": f"""WITH {i.KNOWN}, {_RUNS}, n AS (SELECT *, lead(item) OVER (PARTITION BY seq, run ORDER BY pos) AS nx FROM r), c AS (SELECT seq, run::BIGINT AS run, kk // 3 AS chunk, array_agg(item ORDER BY kk) AS a, array_agg(nx ORDER BY kk) AS b FROM n WHERE nx IS NOT NULL GROUP BY ALL)
        SELECT seq, run, chunk, array_to_string(list_resize(a, 3, 0::BIGINT), ',') AS inputs, array_to_string(list_resize(b, 3, -100::BIGINT), ',') AS targets FROM c""",
    "any_length_cases": f"WITH {i.KNOWN}, {_RUNS}, {_CASES} SELECT seq, pos, array_to_string(inputs, ',') AS inputs, target FROM ca",
    "prefix_windows": f"WITH {i.PLAYLISTS} SELECT seq, pos, array_to_string(array_agg(item) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW), ',') AS inputs FROM p",
    "history_matrix": f"WITH {i.KNOWN} SELECT seq, pos, array_to_string([{', '.join(f'coalesce(lag(item, {d}) OVER w, -1)' if d else 'coalesce(item, -1)' for d in range(5, -1, -1))}], ',') AS history FROM k WINDOW w AS (PARTITION BY seq ORDER BY pos)",
    "next_targets": f"WITH {i.KNOWN}, {_NEXT.format(leads=_LEADS, rows='k')} SELECT seq, pos, array_to_string(list_transform(targets, lambda x: coalesce(x, -1)), ',') AS targets FROM nt",
    "case_targets": f"WITH {i.KNOWN}, {_RUNS}, {_CASES}, {_NEXT.format(leads='lead(item, 1) OVER w, lead(item, 2) OVER w', rows='k')} SELECT seq, pos, array_to_string(list_transform(targets, lambda x, j: CASE WHEN j > 1 AND list_contains(inputs, x) THEN -1 ELSE coalesce(x, -1) END), ',') AS targets FROM ca JOIN nt USING (seq, pos)",
    "last_positions": f"WITH {i.KNOWN} SELECT seq, item, max(pos) AS last FROM k WHERE item IS NOT NULL GROUP BY ALL",
    "pair_counts": f"WITH {i.KNOWN} SELECT x.item AS a, y.item AS b, count(*) AS n FROM k x JOIN k y ON x.seq = y.seq AND y.pos BETWEEN x.pos + 1 AND x.pos + 5 WHERE x.item IS NOT NULL AND y.item IS NOT NULL GROUP BY ALL",
    "pair_merge": f"WITH {i.PLAYLISTS}, {i.PAIRS} SELECT * FROM pc WHERE a >= 100 OR b >= 100",
    "popularity_ranks": f"WITH {i.PLAYLISTS}, {i.POPULAR} SELECT item, n, rank FROM pop",
    "popularity_baseline": f"WITH {i.PLAYLISTS}, {i.POPULAR}, {_ALL_CASES} SELECT {_GROUP} AS length_group, count(*) AS n, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(1 + rank) ELSE 0 END), 9) AS ndcg_10, {', '.join(f'round({_SHARE.format(k=k)}, 9) AS hits_{k}' for k in (1, 5, 10))}, {', '.join(f'round({_SHARE.format(k=k)}, 9) AS recall_{k}' for k in ranking.RECALLS)} FROM ac JOIN pop USING (item) GROUP BY ALL",
    "multi_target_gains": f"""WITH {i.PLAYLISTS}, {i.POPULAR}, {_NEXT.format(leads=_LEADS, rows='p')}, e AS (SELECT seq, pos, unnest(range(5)) AS d, unnest(targets) AS item FROM nt), w AS (SELECT seq, pos, pow(0.8, d) AS w, rank FROM e JOIN pop USING (item)),
        b AS (SELECT *, row_number() OVER (PARTITION BY seq, pos ORDER BY w DESC) AS j FROM w) SELECT seq, pos, round(sum(CASE WHEN rank <= 1000 THEN w / log2(1 + rank) ELSE 0 END) / sum(w / log2(1 + j)), 9) AS gain FROM b GROUP BY seq, pos""",
    "later_in_playlist": f"WITH {i.PLAYLISTS}, {i.POPULAR}, {_ALL_CASES} SELECT ac.seq, ac.pos, round((SELECT 0) + count(DISTINCT t.item) / 10, 9) AS later FROM ac LEFT JOIN (SELECT seq, pos, item FROM p WHERE item IN (SELECT item FROM pop WHERE rank <= 10)) t ON t.seq = ac.seq AND t.pos >= ac.pos GROUP BY ac.seq, ac.pos",
    "cooccurrence_features": f'WITH {i.CONTEXTS}, {i.PAIRS}, j AS (SELECT d."case", d.item, place, n_items, coalesce(pc.n, 0) AS n FROM d JOIN c ON c."case" = d."case" LEFT JOIN pc ON pc.a = c.item AND pc.b = d.item) SELECT "case", item, round(ln(1 + coalesce(sum(n) FILTER (place = n_items - 1), 0)), 9) AS log_after_last, round(ln(1 + sum(n)), 9) AS log_after_context, round(avg((n > 0)::INT), 9) AS context_with_pair FROM j GROUP BY ALL',
    "overlap_features": f"""WITH {i.CONTEXTS}, att AS (SELECT p_partkey AS item, p_brand AS artist, p_type AS album, string_split(p_name, ' ') AS genres FROM part),
        j AS (SELECT d."case", d.item, place, n_items, x.artist = y.artist AS ar, x.album = y.album AS al, list_transform(x.genres, lambda g: list_contains(y.genres, g)::INT) AS ge FROM d JOIN c ON c."case" = d."case" JOIN att x ON x.item = d.item JOIN att y ON y.item = c.item)
        SELECT "case", item, round(avg(ar::INT), 9) AS same_artist, round(avg(al::INT), 9) AS same_album, max(ar::INT) FILTER (place = n_items - 1)::DOUBLE AS last_same_artist, round(avg(list_avg(ge)), 9) AS genre_match FROM j GROUP BY ALL""",
    "length_features": f"""WITH {i.CONTEXTS}, att AS (SELECT p_partkey AS item, ln(greatest(p_size * 10000, 1000)) AS ll FROM part), ty AS (SELECT "case", avg(ll) AS ty FROM c JOIN att USING (item) GROUP BY ALL) SELECT "case", item, round(abs(ll - ty), 9) AS length_gap FROM d JOIN att USING (item) JOIN ty USING ("case")""",
    "popularity_features": f'WITH {i.CONTEXTS}, {i.POPULAR} SELECT "case", item, round(ln(1 + n), 9) AS log_popularity FROM d JOIN pop USING (item)',
    "sequence_length_feature": f'WITH {i.CONTEXTS} SELECT "case", round(ln(1 + max(n_items)), 9) AS sequence_length FROM c GROUP BY ALL',
    "quantile_buckets": "WITH s AS (SELECT p_partkey, CASE WHEN p_size < 3 THEN 0 ELSE p_size END AS size FROM part), c AS (SELECT quantile_cont(size, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS cuts FROM s WHERE size > 0) SELECT p_partkey, CASE WHEN size = 0 THEN 8 ELSE len(list_filter(cuts, lambda x: x <= size)) END::INT AS bucket FROM s, c",
    "share_by_bucket": "SELECT p_size // 10 AS bucket, count(*) AS n, round(sum(p_size) / (SELECT sum(p_size) FROM part), 9) AS share FROM part GROUP BY ALL",
    "matched_plays": """WITH k AS (SELECT p_name AS song_key, min(p_partkey) AS id FROM part WHERE p_size > 25 GROUP BY ALL), pl AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber % 2 = 1 THEN l_partkey END AS uri, p_name AS song_key FROM lineitem JOIN part ON p_partkey = l_partkey)
        SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(uri, -1) AS uri, pl.song_key, coalesce(p_partkey, k.id, -1) AS id, CASE WHEN p_partkey IS NOT NULL THEN 1 WHEN k.id IS NOT NULL THEN 2 ELSE 0 END AS how FROM pl LEFT JOIN part ON p_partkey = uri AND p_size > 10 LEFT JOIN k ON k.song_key = pl.song_key""",
    "best_version": "SELECT p_name AS song_key, p_partkey AS id FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY n DESC, p_partkey) = 1",
    "resolved_genres": """WITH v AS (SELECT c_nationkey AS nation, c_mktsegment AS genre, c_acctbal > 9500 AS rich, count(*) AS n FROM customer WHERE c_acctbal > 9500 OR c_acctbal < 0 GROUP BY ALL), g AS (SELECT nation, rich, string_agg(genre, ',' ORDER BY n DESC, genre) AS genres FROM v GROUP BY ALL)
        SELECT n_nationkey AS nation, coalesce((SELECT genres FROM g WHERE g.nation = n_nationkey AND rich), (SELECT genres FROM g WHERE g.nation = n_nationkey AND NOT rich), '') AS genres FROM nation""",
    "genre_vocab": "SELECT genre, count(*) AS artists, row_number() OVER (ORDER BY count(*) DESC, genre)::INT AS id FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS genre FROM part) GROUP BY genre HAVING count(*) >= 5",
    "word_vocab": "SELECT word, count(*) AS names FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word",
    "joining_items": """WITH u AS (SELECT l_partkey AS key, count(DISTINCT o_custkey) AS users FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1), o AS (SELECT key, p_brand AS artist, key % 700 AS track, users FROM u JOIN part ON p_partkey = key WHERE users >= 3 AND p_brand IN (SELECT p_brand FROM part WHERE p_size > 45) AND key % 700 NOT IN (SELECT p_partkey % 700 FROM part WHERE p_size = 1)),
        t AS (SELECT * FROM o ORDER BY users DESC, key LIMIT 500) SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY track ORDER BY users DESC, key) = 1""",
    "resolved_names": f"WITH {_SPLIT}, m AS (SELECT query, id, n, 0 AS how FROM sp JOIN n USING (track, artist) UNION ALL SELECT query, id, n, 1 FROM q JOIN n ON n.track = query) SELECT query, id FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY how, n DESC, id) = 1",
    "names_starting": f"WITH {_SPLIT}, m AS (SELECT query, id, n FROM q JOIN n ON starts_with(track, query) OR starts_with(artist, query) UNION SELECT query, id, n FROM sp JOIN n ON starts_with(n.track, sp.track) AND starts_with(n.artist, sp.artist)) SELECT query, id, n, row_number() OVER (PARTITION BY query ORDER BY n DESC, id) AS rank FROM m QUALIFY rank <= 10",
    "history_features": f"""WITH {i.CONTEXTS}, {i.PAIRS}, att AS (SELECT p_partkey AS item, p_brand AS artist, p_type AS album, string_split(p_name, ' ') AS genres FROM part),
        o AS (SELECT d."case", d.item, x.artist = y.artist AS ar, x.album = y.album AS al, list_transform(x.genres, lambda g: list_contains(y.genres, g)::INT) AS ge FROM d JOIN c ON c."case" = d."case" JOIN att x ON x.item = d.item JOIN att y ON y.item = c.item),
        ov AS (SELECT "case", item, avg(ar::INT) AS ar, avg(al::INT) AS al, avg(list_avg(ge)) AS ge FROM o GROUP BY ALL), j AS (SELECT d."case", d.item, coalesce(pc.n, 0) AS n FROM d JOIN c ON c."case" = d."case" LEFT JOIN pc ON pc.a = c.item AND pc.b = d.item), ca AS (SELECT "case", item, ln(1 + sum(n)) AS la, avg((n > 0)::INT) AS wp FROM j GROUP BY ALL), sz AS (SELECT "case", max(n_items) AS n FROM c GROUP BY ALL)
        SELECT "case", item, round(ar, 9) AS history_same_artist, round(al, 9) AS history_same_album, round(ge, 9) AS history_genre_match, round(la, 9) AS history_log_after, round(wp, 9) AS history_with_pair, round(ln(1 + n), 9) AS history_log_length FROM ov JOIN ca USING ("case", item) JOIN sz USING ("case")""",
    "unique_assignment": f"""WITH RECURSIVE {i.PLAYLISTS}, x AS (SELECT item, 'slot:' || (item * 7) % 1511 AS o1, 'slot:' || (item * 31) % 1511 AS o2, row_number() OVER (ORDER BY count(*) DESC, item) AS rn FROM p GROUP BY item),
        u AS (SELECT 0::BIGINT AS rn, -1::BIGINT AS item, NULL::VARCHAR AS uri, []::VARCHAR[] AS taken UNION ALL SELECT x.rn, x.item, c.uri, CASE WHEN c.uri IS NULL THEN taken ELSE list_append(taken, c.uri) END FROM u JOIN x ON x.rn = u.rn + 1, LATERAL (SELECT CASE WHEN NOT list_contains(taken, o1) THEN o1 WHEN NOT list_contains(taken, o2) THEN o2 END AS uri) c)
        SELECT item, uri FROM u WHERE rn > 0""",
    "typed_names": f"""WITH q AS (SELECT unnest({list(_TYPED)}) AS query), n AS (SELECT p_partkey AS id, lower(p_name) AS track, lower(p_brand) AS artist, n FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
        w AS (SELECT query, unnest(ws) AS word, unnest(range(len(ws))) AS place, len(ws) - 1 AS last FROM (SELECT query, regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM q)),
        f AS (SELECT id, n, unnest(regexp_extract_all(track, '[\\p{{L}}\\p{{N}}_]+')) AS found, 0 AS field FROM n UNION ALL SELECT id, n, unnest(regexp_extract_all(artist, '[\\p{{L}}\\p{{N}}_]+')), 1 FROM n),
        e AS (SELECT query, place, word, found, CASE WHEN place = last AND starts_with(found, word) THEN 0 ELSE levenshtein(word, found) END AS errors FROM w, (SELECT DISTINCT found FROM f)),
        h AS (SELECT query, id, place, min(errors * 10 + field) AS best, max(n) AS n FROM e JOIN f USING (found) WHERE errors <= CASE WHEN length(word) >= 8 THEN 2 WHEN length(word) >= 4 THEN 1 ELSE 0 END GROUP BY ALL),
        s AS (SELECT query, id, count(*) AS words, sum(best // 10) AS errors, sum(best % 10) AS fields, max(n) AS n FROM h GROUP BY ALL)
        SELECT query, id, (row_number() OVER (PARTITION BY query ORDER BY words DESC, errors, fields, n DESC, id))::INTEGER AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY words DESC, errors, fields, n DESC, id) <= 10""",
    "interpolated_counters": """WITH s AS (SELECT o_custkey AS series, date_diff('day', TIMESTAMP '1990-01-01', o_orderdate::TIMESTAMP)::DOUBLE AS t, max(o_totalprice) AS value FROM orders GROUP BY ALL), p AS (SELECT DISTINCT series - 1 AS series, t FROM s),
        b AS (SELECT p.series, p.t, s.t AS bt, s.value AS bv FROM p ASOF LEFT JOIN s ON p.series = s.series AND p.t >= s.t), x AS (SELECT b.*, s.t AS a_t, s.value AS av FROM b ASOF LEFT JOIN s ON b.series = s.series AND b.t <= s.t)
        SELECT series, t, coalesce(bv + (av - bv) * (t - bt) / nullif(a_t - bt, 0), bv, av) AS value FROM x WHERE bv IS NOT NULL OR av IS NOT NULL""",
}
