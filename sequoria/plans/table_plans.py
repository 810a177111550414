"""Queries over written files and tables: sources and sinks are written from the driver tables and read back whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequoria.functions import arrays as a
from sequoria.functions import text as t
from sequoria.operators import catalog as c
from sequoria.operators import features, ids, incremental, pairs, personal, ranking, search
from sequoria.operators import sequences as q
from sequoria.plans import inputs as i
from sequoria.sources import dumps, playlists, snapshots
from sequoria.sources.tables import shared_folder

#: Seconds of 1995-03-10 and 1996-07-02, the window of months; orders, plays and shards of a file each.
WINDOW = (794_793_600, 836_265_600)
ORDERS_A_SLICE, PLAYS_AN_EXPORT, SHARDS = 1000, 5000, 4
UNTIL = i.START + 24 * 86_400


def written_files(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"


def _one_row_files(values: DataFrame, path: str) -> None:
    """A compressed text file for each row of ``values``."""
    values.write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def dump_months(spark, sf_dir):
    """Files of a dump by name, and whether their month has seconds of the window."""
    names = i.table(spark, sf_dir, "orders").select(F.concat(F.lit("dump/listens/"), F.year("o_orderdate"), F.lit("/"), F.month("o_orderdate"), F.when(F.col("o_orderkey") % 2 == 0, ".listens").otherwise(".txt")).alias("name")).distinct()
    year, month = dumps.month_of(F.col("name"))
    return names.select("name", year.alias("year"), month.alias("month")).withColumn("wanted", F.coalesce(dumps.month_overlaps(F.col("year"), F.col("month"), *WINDOW), F.lit(False)))


def lines_of_months(spark, sf_dir):
    """Lines written by month; a filter on year and month opens those folders only."""
    rows = i.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.concat_ws(",", "o_orderkey", "o_orderstatus").alias("line"))
    path = written_files(spark)
    dumps.write_lines(rows.repartition("year", "month"), path)
    return spark.read.parquet(path).filter("year = 1995 AND month <= 6").select("year", "month", "line")


def unpacked_lines(spark, sf_dir):
    path = written_files(spark)
    i.table(spark, sf_dir, "customer").select(F.concat_ws("|", "c_custkey", "c_name")).write.text(path)
    part = F.split("line", r"\|")
    return dumps.text_lines(spark, path).select(part[0].cast("long").alias("key"), part[1].alias("name"))


def file_checksums(spark, sf_dir):
    """SHA-256 of files, one for each nation."""
    path = written_files(spark)
    i.table(spark, sf_dir, "nation").select(F.concat_ws(",", "n_nationkey", "n_name").alias("value"), F.col("n_nationkey").alias("nation")).write.partitionBy("nation").text(path)
    return dumps.checksums(spark, path, ".txt").select(F.regexp_extract("path", r"nation=(\d+)", 1).cast("int").alias("nation"), "sha256")


def keyed_listens(spark, sf_dir):
    """Kept listens with their song's key; names of which nothing is left are dropped."""
    l = i.listens(spark, sf_dir)
    rows = l.select("event_id", F.when(F.col("event_id") % 7 == 0, "!!").otherwise(F.initcap("event_type")).alias("first_artist"), F.concat(F.lit("Item  "), "item").alias("title"), F.when(F.col("event_id") % 5 == 0, "unreadable").otherwise("kept").alias("reason"))
    return dumps.keyed(rows).select("event_id", "song_key")


def store_entries(spark, sf_dir):
    """Playlist slices in JSON, a store made of them, and its sequences of three entries or more, by name."""
    rows = i.playlists(spark, sf_dir).join(i.attributes(spark, sf_dir).drop("genres"), "item").withColumn("slice", F.floor(F.col("seq") / ORDERS_A_SLICE))
    text = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))

    def track(t):
        item, artist, album = t["item"], t["artist"], t["album"]
        return F.struct(
            t["pos"].cast("int").alias("pos"), text("Track ", item).alias("track_name"), text("track:", item).alias("track_uri"), artist.alias("artist_name"), text("artist:", artist).alias("artist_uri"),
            album.alias("album_name"), text("album:", album).alias("album_uri"), t["length_ms"].cast("long").alias("duration_ms"),
        )

    # dealt out by slice once; names are made behind it
    dealt = pairs.dealt(rows, i.parts(spark, sf_dir, "lineitem"), "slice")
    lists = dealt.groupBy("slice", "seq").agg(F.sort_array(F.collect_list(F.struct("pos", "item", "artist", "album", "length_ms"))).alias("tracks"))
    slices = lists.groupBy("slice").agg(F.collect_list(F.struct("seq", "tracks")).alias("lists"))
    playlist = lambda p: F.struct(text("List ", p["seq"]).alias("name"), p["seq"].alias("pid"), F.transform(p["tracks"], track).alias("tracks"))
    slices = slices.select(F.to_json(F.struct(F.transform("lists", playlist).alias("playlists"))).alias("value"))
    files, store = written_files(spark), written_files(spark)
    _one_row_files(slices, files)
    playlists.write_store(playlists.playlist_entries(spark, files), store)
    part = lambda name: playlists.store_table(spark, store, name)
    entries = playlists.store_sequences(spark, store, 3).join(part("playlists").select("seq", F.col("name").alias("list")), "seq")
    tracks = part("tracks").select(F.col("track").alias("item"), "track_uri", "track_name", "artist_uri", "duration_ms", "conflicts").join(part("artists").select("artist_uri", F.col("name").alias("artist")), "artist_uri")
    return entries.join(tracks, "item").select("list", "pos", "track_uri", "track_name", "artist", "duration_ms", "conflicts")


def artist_genre_lines(spark, sf_dir):
    path = written_files(spark)
    genre = lambda name, n: F.struct(name.alias("name"), F.lit(n).alias("count"))
    i.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("artist"), F.col("s_suppkey").cast("string").alias("mbid"), F.array(genre(F.concat(F.lit("z"), "s_nationkey"), 9), genre(F.concat(F.lit("a"), F.col("s_suppkey") % 5), 2)).alias("genres")).write.json(path)
    return playlists.artist_genres(spark, path).select("artist", "mbid", F.array_join("genres", ",").alias("genres"))


def merged_genre_sources(spark, sf_dir):
    """Of each artist the genres of the first source that has it."""
    one = i.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("artist"))
    source = lambda k, name: one.filter(F.col("s_suppkey") % k == 0).select("artist", F.array(F.lit(name), F.col("s_suppkey").cast("string")).alias("genres"))
    return c.merged_genre_sources(source(2, "second"), source(3, "third"), source(1, "every")).select("artist", F.array_join("genres", ",").alias("genres"))


def voted_genres(spark, sf_dir):
    votes = i.table(spark, sf_dir, "lineitem").join(i.attributes(spark, sf_dir), F.col("l_partkey") == F.col("item")).select("artist", F.col("album").alias("genre"), F.col("l_quantity").cast("long").alias("votes"))
    return c.merged_votes(votes).select("artist", F.array_join("genres", ",").alias("genres"))


def linked_artists(spark, sf_dir):
    """Artists of a dump with links, of those that are wanted."""
    path = written_files(spark)
    link = lambda host: F.struct(F.struct(F.concat(F.lit(f"https://{host}/"), "s_suppkey").alias("resource")).alias("url"))
    i.table(spark, sf_dir, "supplier").select(F.concat(F.lit("m"), "s_suppkey").alias("id"), F.array(F.struct(F.concat(F.lit("g"), "s_nationkey").alias("name"), F.lit(1).alias("count"))).alias("genres"), F.array(link("one.test"), link("two.test")).alias("relations")).write.json(path)
    wanted = i.table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(F.concat(F.lit("https://two.test/"), "s_suppkey").alias("link"))
    return playlists.artists_in_dump(spark, path, wanted).select("mbid", "link", F.array_join(F.transform("genres", lambda g: g["name"]), ",").alias("genres"))


def exported_plays(spark, sf_dir):
    """Listeners' exports, JSON arrays over several lines; rows without a track are left out."""
    path = written_files(spark)
    row = F.struct(
        a.iso(F.col("sec")).alias("ts"), (F.col("item") * 100).alias("ms_played"), F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 4 == 1).alias("skipped"),
        F.when(F.col("event_id") % 9 > 0, F.concat(F.lit("track:"), "item")).alias("spotify_track_uri"), F.concat(F.lit("Item "), "item").alias("master_metadata_track_name"), F.col("event_type").alias("master_metadata_album_artist_name"),
    )
    _one_row_files(i.listens(spark, sf_dir).groupBy(F.floor(F.col("event_id") / PLAYS_AN_EXPORT).alias("export")).agg(F.to_json(F.collect_list(row)).alias("value")).select("value"), path)
    return playlists.listener_export(spark, path)


def snapshot_rows(spark, sf_dir):
    """A table of a base and its update."""
    rows = i.attributes(spark, sf_dir).select("item", "artist", "length_ms")
    base, update = written_files(spark), written_files(spark)
    version = snapshots.write_snapshot({"items": rows.filter("item % 3 > 0")}, base)
    snapshots.write_snapshot({"items": rows.filter("item % 3 = 0")}, update, version)
    return snapshots.snapshot_table(spark, [base, update], "items")


def manifest_version(spark, sf_dir):
    return snapshots.manifest(i.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.sha2(F.col("n_nationkey").cast("string"), 256).alias("sha256")))


def equal_digests(spark, sf_dir):
    """Whether tables have the same rows, in any order: the same one dealt out anew, and one with a row less."""
    rows = i.table(spark, sf_dir, "part")
    digest = lambda df, name: snapshots.table_digest(df).select(F.col("sha256").alias(name))
    both = digest(rows, "x").crossJoin(digest(rows.repartition(5), "y")).crossJoin(digest(rows.filter("p_partkey > 0"), "z"))
    return both.select((F.col("x") == F.col("y")).alias("dealt_anew"), (F.col("x") == F.col("z")).alias("a_row_less"))


def rows_of_shards(spark, sf_dir):
    path = written_files(spark)
    rows = i.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    snapshots.write_sharded(rows, path, SHARDS)
    return snapshots.sharded_rows(spark, path, rows.filter("id % 7 = 0"), SHARDS)


def live_rows(spark, sf_dir):
    """The view after a switch to an update."""
    rows = i.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    base, update = written_files(spark), written_files(spark)
    version = snapshots.write_snapshot({"suppliers": rows.filter("s_suppkey % 2 = 0")}, base)
    snapshots.write_snapshot({"suppliers": rows.filter("s_suppkey % 4 = 1")}, update, version)
    view = f"live_{uuid.uuid4().hex}"
    snapshots.live_view(spark, [base], "suppliers", view)
    snapshots.live_view(spark, [base, update], "suppliers", view)
    return spark.table(view)


def version_lineage(spark, sf_dir):
    """Versions down to the base; every version's parent is the one of half its number."""
    n = F.col("n_nationkey")
    versions = i.table(spark, sf_dir, "nation").select(n.cast("string").alias("version"), F.when(n > 0, F.floor(n / 2).cast("string")).alias("parent"))
    return incremental.lineage(versions, "21")


def _with_documents(spark, sf_dir) -> DataFrame:
    counts = i.playlists(spark, sf_dir).groupBy("item").agg(F.count("*").alias("n"))
    return i.attributes(spark, sf_dir).join(counts, "item").select(F.col("item").alias("id"), F.concat(F.lit("Track "), "item").alias("track"), "artist", "album", "n")


def search_documents(spark, sf_dir):
    return search.search_documents(_with_documents(spark, sf_dir))


def upserted_documents(spark, sf_dir):
    documents = search.search_documents(_with_documents(spark, sf_dir))
    return search.upserted(documents.filter("id % 5 > 0"), documents.filter("id % 3 = 0").withColumn("name", F.concat(F.lit("New "), "name")))


def name_order(spark, sf_dir):
    """Items in the index of names, numbered as they stand under each name."""
    rows = search.name_index(_with_documents(spark, sf_dir).withColumn("track", F.concat_ws(" ", "artist", "album")))
    w = ranking.Window.partitionBy("track").orderBy(F.desc("n"), "id")
    return rows.select("track", "id", F.row_number().over(w).alias("place"))


def name_keys(spark, sf_dir):
    """Accents, marks, case and spaces of names."""
    name = F.concat(F.lit("  Él  Ñandú ÅB "), "p_name")
    return i.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), t.strip_accents(name).alias("plain"), t.name_key(name).alias("key"))


def iso_times(spark, sf_dir):
    return i.listens(spark, sf_dir).select("event_id", a.iso(F.col("sec")).alias("time"))


def known_genres(spark, sf_dir):
    """The first two genres of an item that the vocabulary has."""
    rows = i.attributes(spark, sf_dir)
    vocab = c.genre_vocab(rows.select("artist", "genres"), 5).agg(F.sort_array(F.collect_list("genre")).alias("known"))
    return rows.crossJoin(F.broadcast(vocab)).select("item", F.array_join(a.capped_known(F.col("genres"), F.col("known"), 2), ",").alias("genres"))


def long_playlists(spark, sf_dir):
    return q.long_sequences(i.playlists(spark, sf_dir), 4)


def padded_inputs(spark, sf_dir):
    out = q.padded_inputs(q.prefix_windows(i.playlists(spark, sf_dir), 3), 5)
    return out.withColumn("inputs", F.array_join("inputs", ","))


def sequence_starts(spark, sf_dir):
    out = q.sequence_starts(q.fixed_windows(i.playlists(spark, sf_dir), 2), 2)
    return out.withColumn("inputs", F.array_join("inputs", ","))


def fresh_listens(spark, sf_dir):
    return incremental.fresh(i.listens(spark, sf_dir), UNTIL, 7).select("event_id", "user", "sec")


def standby_report(spark, sf_dir):
    """The current model's answers to orders, and a standby's."""
    rows = i.table(spark, sf_dir, "orders")
    answers = lambda gain, failed: rows.select(F.col("o_orderkey").alias("case"), gain.alias("gain"), F.array(F.col("o_custkey"), F.col("o_custkey") + 1, F.col("o_custkey")).alias("items"), failed.alias("failed"))
    key = F.col("o_orderkey")
    out = incremental.standby_check(answers((key % 10) / 10, key % 97 == 0), answers((key % 11) / 10, key < 0), 100)
    return out.select(*(F.round(f"{k}_gain", 9).alias(f"{k}_gain") if c == "gain" else f"{k}_{c}" for k in ("current", "standby") for c in ("gain", "failed", "cases")), "top_new", "passed")


def lost_rows(spark, sf_dir):
    rows = i.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return incremental.lost_rows(rows, rows.filter("p_partkey % 13 > 0"))


def lowered_counts(spark, sf_dir):
    rows = i.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    base = pairs.dealt(rows, i.parts(spark, sf_dir, "lineitem"), "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return incremental.lowered_counts(base, base.withColumn("n", F.when(F.col("a") % 10 == 0, F.col("n") - 1).otherwise(F.col("n") + 1))).select("a", "b")


def genres_or_default(spark, sf_dir):
    table = i.attributes(spark, sf_dir).filter("item % 4 > 0").select("item", "album")
    return c.lookup_or(i.playlists(spark, sf_dir), table, "item", "album", F.lit("none")).select("seq", "pos", "item", "album")


def feature_scale(spark, sf_dir):
    rows = i.table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", F.lit(0.25).alias("constant"))
    return features.feature_scale(rows, "l_quantity", "l_discount", "constant").select("feature", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


def _results(spark, sf_dir) -> DataFrame:
    return i.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("place"), F.concat(F.lit("setting "), "l_linenumber").alias("setting"), (F.col("l_quantity") / 50).alias("score"))


def seeds_summary(spark, sf_dir):
    out = ranking.seeds_table(_results(spark, sf_dir))
    return out.select("place", "setting", "low", "high", *(F.round(x, 9).alias(x) for x in ("mean", "change")))


def best_setting(spark, sf_dir):
    """The setting of the largest mean score, the first of equal ones."""
    return ranking.best_setting(_results(spark, sf_dir).groupBy("place").agg(F.max("score").alias("score")), "score", "place")


def model_difference(spark, sf_dir):
    side = lambda k: i.table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % (k + 1) > 0).select(F.col("o_orderkey").alias("case"), ((F.col("o_orderkey") % k) / k).alias("gain"))
    out = ranking.paired_difference(side(7), side(9))
    return out.select("n", F.round("mean", 9).alias("mean"), F.round("se", 9).alias("se"))


def new_finds(spark, sf_dir):
    """Of users' most frequent items in the first half of the month, those that were new and those that they came back to."""
    l = i.listens(spark, sf_dir)
    half = i.START + 15 * 86_400
    out = personal.finds(l.filter(F.col("sec") < half).select("user", "item").distinct(), l.filter(F.col("sec") >= half), l.filter(F.col("event_id") % 3 == 0))
    return out.select("user", F.round("new_share", 9).alias("new_share"), F.round("finds_per_100", 9).alias("finds_per_100"))


def most_played(spark, sf_dir):
    """The feature is a top 50."""
    counts = i.playlists(spark, sf_dir).groupBy(F.col("item").alias("id")).agg(F.count("*").alias("n"))
    return ranking.most_played(counts, 50)


def reranked_lists(spark, sf_dir):
    """Orders ranked by a score with many ties, which keep their order."""
    rows = i.playlists(spark, sf_dir).select(F.col("seq").alias("case"), "item", (F.col("item") % 3).alias("score"), (F.col("pos") + 1).alias("rank"))
    return ranking.reranked(rows)


def disjoint_samples(spark, sf_dir):
    """Sizes of two fixed samples of one seed, and the rows that both have."""
    rows = i.table(spark, sf_dir, "part").select("p_partkey")
    one, two = ids.fixed_sample(rows, "p_partkey", 50), ids.fixed_sample(rows, "p_partkey", 70, skip=50)
    size = lambda df, name: df.agg(F.count("*").alias(name))
    return size(one, "one").crossJoin(size(two, "two")).crossJoin(size(one.intersect(two), "common"))


QUERIES = {
    f.__name__: f
    for f in (
        dump_months, lines_of_months, unpacked_lines, file_checksums, keyed_listens, store_entries, artist_genre_lines, merged_genre_sources, voted_genres, linked_artists, exported_plays, snapshot_rows, manifest_version, equal_digests,
        rows_of_shards, live_rows, version_lineage, search_documents, upserted_documents, name_order, name_keys, iso_times, known_genres, long_playlists, padded_inputs, sequence_starts, fresh_listens, standby_report, lost_rows,
        lowered_counts, genres_or_default, feature_scale, seeds_summary, best_setting, model_difference, new_finds, most_played, reranked_lists, disjoint_samples,
    )
}

_ITEMS = "it AS (SELECT p_partkey AS item, p_brand AS artist, p_type AS album, string_split(p_name, ' ') AS genres, p_size * 10000 AS length_ms FROM part)"
_DOCS = f"{i.PLAYLISTS}, {_ITEMS}, n AS (SELECT item, count(*) AS n FROM p GROUP BY item), dx AS (SELECT item AS id, 'Track ' || item AS track, artist, album, n FROM it JOIN n USING (item)), d AS (SELECT id, track || ' ' || artist AS name, album, n AS popularity FROM dx)"
_RESULTS = "r AS (SELECT l_linenumber AS place, 'setting ' || l_linenumber AS setting, l_quantity / 50 AS score FROM lineitem)"
_MONTH = "EXTRACT(year FROM o_orderdate)::INT AS y, EXTRACT(month FROM o_orderdate)::INT AS m"

SQL = {
    "dump_months": f"""WITH x AS (SELECT DISTINCT {_MONTH}, o_orderkey % 2 = 0 AS listens FROM orders)
        SELECT 'dump/listens/' || y || '/' || m || CASE WHEN listens THEN '.listens' ELSE '.txt' END AS name, CASE WHEN listens THEN y END AS year, CASE WHEN listens THEN m END AS month,
        listens AND epoch(make_date(y, m, 1)) < {WINDOW[1]} AND epoch(make_date(y, m, 1) + INTERVAL 1 MONTH) > {WINDOW[0]} AS wanted FROM x""",
    "lines_of_months": f"SELECT y AS year, m AS month, line FROM (SELECT {_MONTH}, o_orderkey || ',' || o_orderstatus AS line FROM orders) WHERE y = 1995 AND m <= 6",
    "unpacked_lines": "SELECT c_custkey AS key, c_name AS name FROM customer",
    "file_checksums": "SELECT n_nationkey::INT AS nation, sha256(n_nationkey || ',' || n_name || chr(10)) AS sha256 FROM nation",
    "keyed_listens": f"WITH {i.LISTENS} SELECT event_id, event_type || '|item ' || item AS song_key FROM l WHERE event_id % 7 > 0 AND event_id % 5 > 0",
    "store_entries": f"WITH {i.PLAYLISTS}, {_ITEMS} SELECT 'List ' || seq AS list, pos, 'track:' || item AS track_uri, 'Track ' || item AS track_name, artist, length_ms AS duration_ms, 0 AS conflicts FROM (SELECT *, count(*) OVER (PARTITION BY seq) AS k FROM p) JOIN it USING (item) WHERE k >= 3",
    "artist_genre_lines": "SELECT s_name AS artist, s_suppkey::VARCHAR AS mbid, 'z' || s_nationkey || ',a' || (s_suppkey % 5) AS genres FROM supplier",
    "merged_genre_sources": "SELECT s_name AS artist, CASE WHEN s_suppkey % 2 = 0 THEN 'second' WHEN s_suppkey % 3 = 0 THEN 'third' ELSE 'every' END || ',' || s_suppkey AS genres FROM supplier",
    "voted_genres": f"WITH {_ITEMS} SELECT artist, string_agg(album, ',' ORDER BY v DESC, album) AS genres FROM (SELECT artist, album, sum(l_quantity::BIGINT) AS v FROM lineitem JOIN it ON item = l_partkey GROUP BY ALL) GROUP BY artist",
    "linked_artists": "SELECT 'm' || s_suppkey AS mbid, 'https://two.test/' || s_suppkey AS link, 'g' || s_nationkey AS genres FROM supplier WHERE s_suppkey % 3 = 0",
    "exported_plays": f"WITH {i.LISTENS} SELECT sec, item * 100 AS ms_played, event_id % 4 = 1 AS skipped, 'track:' || item AS uri, 'Item ' || item AS title, event_type AS artist FROM l WHERE event_id % 9 > 0",
    "snapshot_rows": f"WITH {_ITEMS} SELECT item, artist, length_ms FROM it",
    "manifest_version": "SELECT substr(sha256(string_agg(n_name || ' ' || sha256(n_nationkey::VARCHAR) || chr(10), '' ORDER BY n_name)), 1, 12) AS version, count(*) AS files FROM nation",
    "equal_digests": "SELECT count(DISTINCT p_partkey) = count(*) AS dealt_anew, count(*) FILTER (p_partkey > 0) = count(*) AS a_row_less FROM part",
    "rows_of_shards": "SELECT p_partkey AS id, p_name FROM part WHERE p_partkey % 7 = 0",
    "live_rows": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 4 = 1",
    "version_lineage": "WITH RECURSIVE u AS (SELECT 21 AS v, 0 AS depth UNION ALL SELECT v // 2, depth + 1 FROM u WHERE v > 0) SELECT v::VARCHAR AS version, CASE WHEN v > 0 THEN (v // 2)::VARCHAR END AS parent, depth FROM u",
    "search_documents": f"WITH {_DOCS} SELECT * FROM d",
    "upserted_documents": f"WITH {_DOCS} SELECT id, CASE WHEN id % 3 = 0 THEN 'New ' || name ELSE name END AS name, album, popularity FROM d WHERE id % 5 > 0 OR id % 3 = 0",
    "name_order": f"WITH {_DOCS} SELECT artist || ' ' || album AS track, id, row_number() OVER (PARTITION BY artist, album ORDER BY n DESC, id) AS place FROM dx",
    "name_keys": "SELECT p_partkey AS id, '  El  Nandu AB ' || p_name AS plain, 'el nandu ab ' || p_name AS key FROM part",
    "iso_times": f"WITH {i.LISTENS} SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time FROM l",
    "known_genres": f"""WITH {_ITEMS}, g AS (SELECT DISTINCT artist, unnest(genres) AS genre FROM it), v AS (SELECT list(genre) AS known FROM (SELECT genre FROM g GROUP BY genre HAVING count(*) >= 5))
        SELECT item, array_to_string(list_filter(genres, lambda x: list_contains(known, x))[1:2], ',') AS genres FROM it, v""",
    "long_playlists": f"WITH {i.PLAYLISTS} SELECT seq, pos, item FROM (SELECT *, count(*) OVER (PARTITION BY seq) AS n FROM p) WHERE n >= 4",
    "padded_inputs": f"WITH {i.PLAYLISTS}, x AS (SELECT seq, pos, array_agg(item) OVER (PARTITION BY seq ORDER BY pos ROWS 2 PRECEDING) AS xs FROM p) SELECT seq, pos, len(xs) AS n_inputs, array_to_string(list_resize(xs, 5, 0::BIGINT), ',') AS inputs FROM x",
    "sequence_starts": f"WITH {i.PLAYLISTS} SELECT x.seq, z.pos, x.item || ',' || y.item AS inputs, z.item AS target FROM p x JOIN p y ON y.seq = x.seq AND y.pos = 1 JOIN p z ON z.seq = x.seq AND z.pos = 2 WHERE x.pos = 0",
    "fresh_listens": f"WITH {i.LISTENS} SELECT event_id, \"user\", sec FROM l WHERE sec >= {UNTIL - 7 * 86_400} AND sec < {UNTIL + 3600}",
    "standby_report": """WITH x AS (SELECT (o_orderkey % 10) / 10 AS a, o_orderkey % 97 = 0 AS f, (o_orderkey % 11) / 10 AS b, [o_custkey, o_custkey + 1] AS items FROM orders),
        n AS (SELECT max(k) AS top_new FROM (SELECT count(*) AS k FROM (SELECT unnest(items) AS item FROM x) WHERE item >= 100 GROUP BY item)), s AS (SELECT avg(a) AS a, count(*) FILTER (f) AS f, avg(b) AS b, count(*) AS n FROM x)
        SELECT round(a, 9) AS current_gain, f AS current_failed, s.n AS current_cases, round(b, 9) AS standby_gain, 0 AS standby_failed, s.n AS standby_cases, coalesce(top_new, 0) AS top_new, a - b <= 0.003 AND coalesce(top_new, 0) <= 0.01 * s.n AS passed FROM s, n""",
    "lost_rows": "SELECT p_partkey, p_name FROM part WHERE p_partkey % 13 = 0",
    "lowered_counts": "SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey % 10 = 0",
    "genres_or_default": f"WITH {i.PLAYLISTS}, {_ITEMS} SELECT seq, pos, item, CASE WHEN item % 4 > 0 THEN coalesce(album, 'none') ELSE 'none' END AS album FROM p LEFT JOIN it USING (item)",
    "feature_scale": "SELECT 'l_quantity' AS feature, round(avg(l_quantity), 9) AS mean, round(stddev_samp(l_quantity), 9) AS std FROM lineitem UNION ALL SELECT 'l_discount', round(avg(l_discount), 9), round(stddev_samp(l_discount), 9) FROM lineitem UNION ALL SELECT 'constant', 0.25, 1.0",
    "seeds_summary": f"WITH {_RESULTS}, x AS (SELECT place, setting, avg(score) AS mean, min(score) AS low, max(score) AS high FROM r GROUP BY ALL) SELECT place, setting, low, high, round(mean, 9) AS mean, round(mean - lag(mean) OVER (ORDER BY place), 9) AS change FROM x",
    "best_setting": f"WITH {_RESULTS} SELECT place, max(score) AS score FROM r GROUP BY place ORDER BY score DESC, place LIMIT 1",
    "model_difference": "WITH x AS (SELECT (o_orderkey % 9) / 9 - (o_orderkey % 7) / 7 AS d FROM orders WHERE o_orderkey % 8 > 0 AND o_orderkey % 10 > 0) SELECT count(*) AS n, round(avg(d), 9) AS mean, round(stddev_samp(d) / sqrt(count(*)), 9) AS se FROM x",
    "new_finds": f"""WITH {i.LISTENS}, x AS (SELECT DISTINCT "user", item FROM l WHERE sec < {i.START + 15 * 86_400}), h AS (SELECT DISTINCT "user", item FROM l WHERE sec >= {i.START + 15 * 86_400}), k AS (SELECT DISTINCT "user", item FROM l WHERE event_id % 3 = 0)
        SELECT x."user", round(avg((k.item IS NULL)::INT), 9) AS new_share, round(100 * avg((k.item IS NULL AND h.item IS NOT NULL)::INT), 9) AS finds_per_100 FROM x LEFT JOIN h USING ("user", item) LEFT JOIN k USING ("user", item) GROUP BY x."user\"""",
    "most_played": f"WITH {i.PLAYLISTS} SELECT item AS id, count(*) AS n FROM p GROUP BY item ORDER BY n DESC, id LIMIT 50",
    "disjoint_samples": "SELECT least(50, count(*)) AS one, least(70, greatest(count(*) - 50, 0)) AS two, count(*) - count(DISTINCT p_partkey) AS common FROM part",
    "reranked_lists": f'WITH {i.PLAYLISTS} SELECT seq AS "case", item, item % 3 AS score, row_number() OVER (PARTITION BY seq ORDER BY item % 3 DESC, pos) AS rank FROM p',
}
