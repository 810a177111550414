"""Small cases by hand and against plain Python."""

import json
import random
import tarfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from sequoria.functions import arrays as a
from sequoria.functions import text as t
from sequoria.operators import catalog as c
from sequoria.operators import features, ids, incremental, pairs, personal, ranking, search
from sequoria.operators import sequences as q
from sequoria.operators import sessions as s
from sequoria.operators import vectors as v
from sequoria.plans import inputs, registry
from sequoria.sources import dumps, playlists, snapshots
from sequoria.streaming import live


def listens(spark, rows):
    return spark.createDataFrame(rows, "user long, sec long, item long")


TWO_USERS = [(0, x, y) for x, y in zip((0, 60, 120, 180, 240, 5000, 5060, 5120), (1, 2, 2, 3, 4, 5, 6, 7))] + [(1, x, y) for x, y in zip((5130, 5190, 5250, 5310), (1, 2, 3, 4))]


def test_sessions(spark):
    kept = s.kept_listens(s.with_sessions(listens(spark, TWO_USERS)))
    assert sorted((r.user, r.sec, r.session) for r in kept.collect()) == [(0, 0, 1), (0, 60, 1), (0, 180, 1), (0, 240, 1), (1, 5130, 1), (1, 5190, 1), (1, 5250, 1), (1, 5310, 1)]


def test_short_after_repeats(spark):
    rows = [(0, 60 * k, item) for k, item in enumerate((1, 1, 2, 2, 3))]
    assert s.kept_listens(s.with_sessions(listens(spark, rows))).count() == 0


def test_gap_is_strict_and_a_repeat_never_splits_a_session(spark):
    rows = [(0, sec, item) for sec, item in zip((0, 1000, 2500, 3000, 3500), (0, 1, 1, 2, 3))]
    kept = s.kept_listens(s.with_sessions(listens(spark, rows)))
    assert sorted(r.item for r in kept.collect()) == [0, 1, 2, 3] and {r.session for r in kept.collect()} == {1}
    edge = s.with_sessions(listens(spark, [(0, 0, 1), (0, 1800, 2), (0, 3601, 3)])).collect()
    assert [r.session for r in sorted(edge, key=lambda r: r.sec)] == [1, 1, 2]


def test_noise(spark):
    rows = [(0, k, k) for k in (0, 100, 110, 200, 200)] + [(1, 10 * k, k) for k in range(0)] + [(2, 100 * k, k) for k in range(7)]
    kept = s.without_noise(listens(spark, rows), 0, max_day=6)
    assert sorted((r.user, r.sec, r.item) for r in kept.collect()) == [(0, 0, 0), (0, 110, 110), (0, 200, 200)]


def test_recent_and_users(spark):
    rows = [(0, k, 5) for k in range(4)] + [(1, 0, 5), (1, 1, 1), (2, 0, 0)]
    assert s.most_recent(listens(spark, rows), 2).count() == 5
    assert {(r.item, r.users) for r in s.users_per_item(listens(spark, rows)).collect()} == {(5, 2), (1, 1), (0, 1)}


def test_mode_and_median(spark):
    rows = spark.createDataFrame([(i, x) for i, x in zip((0, 0, 0, 2, 2, 2, 2), (7, 5, 7, 9, 1, 1, 9))], "item long, v long")
    assert {(r.item, r.mode) for r in c.mode_per_item(rows, "v").collect()} == {(0, 7), (2, 1)}
    rows = spark.createDataFrame([(i, x) for i, x in zip((0, 0, 0, 2, 2, 2, 2), (10, 30, 20, 4, 1, 3, 2))], "item long, v long")
    assert {(r.item, r.median) for r in c.median_per_item(rows, "v").collect()} == {(0, 20), (2, 2)}


def test_smallest_cap(spark):
    rnd = random.Random(1)
    rows = spark.createDataFrame([(u, 60 * k, rnd.randrange(6), u < 2) for u in range(3) for k in range(8)], "user long, sec long, item long, training boolean").cache()
    count = lambda k: c.capped_catalog(rows, k, 2, min_length=2).count()
    target = count(8) - 2
    assert c.choose_cap(rows, 2, target, first=2, min_length=2) == min(k for k in range(1, 9) if count(k) >= target)
    assert c.choose_cap(rows, 2, 1000, first=2, min_length=2) is None


def test_unique_assignment_equals_the_one_by_one_rule(spark):
    rnd = random.Random(2)
    items = [(i, rnd.randrange(5), rnd.choice([None, *"abcdef"]), rnd.choice([None, *"abcdef"])) for i in range(12)]
    taken, want = set(), {}
    for i, _, one, two in sorted(items, key=lambda x: (-x[1], x[0])):
        want[i] = next((o for o in (one, two) if o and o not in taken), None)
        taken.add(want[i])
    got = c.uniquely_assigned(spark.createDataFrame(items, "item long, listens long, option1 string, option2 string"))
    assert {r.item: r.uri for r in got.collect()} == want


def test_pair_counts_keep_the_place_of_unknown_items(spark):
    rows = [(0, k, x) for k, x in enumerate((0, 1, 2))] + [(1, k, x) for k, x in enumerate((2, None, 0))]
    got = pairs.pair_counts(spark.createDataFrame(rows, "seq long, pos long, item long"), 2)
    assert {(r.a, r.b, r.n) for r in got.collect()} == {(0, 1, 1), (0, 2, 1), (1, 2, 1), (2, 0, 1)}


def test_history(spark):
    rows = [(0, k, x) for k, x in enumerate((5, 6, None, 8))]
    got = q.histories(spark.createDataFrame(rows, "seq long, pos long, item long"), 6).filter("pos = 3").first().history
    assert got == [-1, -1, 5, 6, -1, 8]


def test_text(spark):
    names = {"  Beyoncé & JAY-Z!! ": "beyonce and jay z", "Sigur Rós": "sigur ros", "Dumb &amp; Poetic": "dumb and poetic", "ジブリ": "ジブリ", "Ａｄｅｌｅ": "adele"}
    got = spark.createDataFrame([(x,) for x in names], "x string").select("x", t.clean_text(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == names
    titles = {
        "Let It Be - Remastered 2009": "let it be", "Wonderwall (Remastered)": "wonderwall", "Can't Hold Us (feat. Ray Dalton)": "can t hold us", "Mask Off [with Kendrick Lamar]": "mask off", "Song feat. Someone": "song",
        "Song (feat. X) - Single Version": "song", "Return To Me (Ritorna-Me) - 1997 - Remastered": "return to me ritorna me", "Stand By Me - Single/LP Version": "stand by me", "Wonderwall - Live": "wonderwall live", "Song (Remix)": "song remix", "Stereo Hearts": "stereo hearts",
    }
    got = spark.createDataFrame([(x,) for x in titles], "x string").select("x", t.clean_title(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == titles
    keyed = t.with_song_keys(spark.createDataFrame([("Drake feat. Rihanna", "Song - Mono"), ("Drake feat. Rihanna", "Song - Mono"), (None, "x")], "artist string, title string"))
    assert sorted(r.song_key for r in keyed.collect()) == ["drake|song", "drake|song", "|x"]
    assert spark.range(1).select(t.name_splits(F.lit("a - b - c")).alias("s")).first().s == [("a", "b - c"), ("a - b", "c")]


def test_array_functions(spark):
    row = spark.range(1).select(
        a.without_repeats(F.array(*map(F.lit, (1, 2, 1)))).alias("r"), a.without_inputs(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (1, 3)))).alias("i"), a.gain(F.lit(1)).alias("g"), a.gain(F.lit(11)).alias("h"),
        a.multi_target_gain(F.array(*map(F.lit, (1, 0, 2))), F.array(*map(F.lit, (1.0, 0.5, 0.25)))).alias("m"), a.decayed_weights(2, 0.5).alias("w"), a.capped_known(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "cb")), 1).alias("c"),
    ).first()
    assert row.r == [1, 2, None] and row.i == [1, 2, None] and (row.g, row.h) == (1.0, 0.0) and row.m == pytest.approx(1.0) and row.w == pytest.approx([1 / 3, 2 / 3]) and row.c == ["b"]


def test_diversified_refills(spark):
    rows = spark.createDataFrame([(0, i, art, i + 1) for i, art in enumerate("aaaab")], "case long, item long, artist string, rank long")
    assert sorted(r.item for r in ranking.diversified(rows, 3, 1).collect()) == [0, 1, 4]
    assert sorted(r.item for r in ranking.diversified(rows, 2, 0).collect()) == [0, 1]


def test_chain(spark):
    rows = [("a", 0.0, 10.0), ("b", 10.5, 20.0), ("again", 10.0, 20.0), ("tail", 20.0, 19.5), ("c", 30.0, 40.0)]
    got = incremental.chained(spark.createDataFrame(rows, "name string, start double, end double")).collect()
    assert {r.name: r.status for r in got} == {"a": "used", "again": "used", "b": "skipped", "tail": "used", "c": "used"}
    assert {r.name: r.gap_from for r in got}["c"] == 19.5


def test_rolling_listeners(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(40), rnd.choice("xy"), rnd.randrange(5)) for _ in range(60)]
    got = incremental.rolling_listeners(spark.createDataFrame(rows, "day int, key string, user long"), 7).collect()
    assert {(r.day, r.key): r.listeners for r in got} == {(d, k): len({u for e, l, u in rows if l == k and d - 7 < e <= d}) for d, k, _ in rows}


def test_update_checks(spark):
    old = spark.createDataFrame([(1, 2, 5)], "a long, b long, n long")
    new = incremental.updated_pairs(old, spark.createDataFrame([(1, 2, 1), (3, 1, 1)], "a long, b long, n long"))
    assert incremental.lowered_counts(old, new).isEmpty() and not incremental.lowered_counts(new, old).isEmpty()
    versions = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None)], "version string, parent string")
    assert [r.version for r in incremental.lineage(versions, "c").orderBy("depth").collect()] == ["c", "b", "a"]


def test_splits_and_samples(spark):
    users = spark.range(1000).withColumnRenamed("id", "user")
    got = ids.with_split(users, "user", (("a", 0.64), ("b", 0.16), ("c", 0.1), ("d", 0.1))).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"a": 640, "b": 160, "c": 100, "d": 100}
    one, two = (ids.fixed_sample(users, "user", 50, skip=k) for k in (0, 50))
    assert one.count() == two.count() == 50 and one.join(two, "user").isEmpty()
    weights = spark.createDataFrame([(0, 1.0), (1, 3.0)], "item long, p double")
    drawn = ids.weighted_draws(weights, spark.range(4000).withColumnRenamed("id", "draw"))
    share = drawn.agg(F.avg("item")).first()[0]
    assert drawn.count() == 4000 and abs(share - 0.75) < 0.03


def test_vectors(spark):
    items = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 4.0])], "id long, vector array<double>")
    top = v.exact_top_k(items, items.filter("id < 2"), 2, block=1)
    assert {(r.query, r.item, r["rank"]) for r in top.collect()} == {(0, 2, 1), (0, 0, 2), (1, 2, 1), (1, 1, 2)}
    assert v.average_vectors(items.filter("id < 2").withColumn("k", F.lit(0)), ["k"], lengthened=True).first().vector == pytest.approx([0.5**0.5, 0.5**0.5])
    assert [r.id for r in v.unfit_vectors(items, items.filter("id < 2")).collect()] == [2]


def test_clusters_reach_recall(spark):
    rnd = random.Random(4)
    items = spark.createDataFrame([(i, [rnd.gauss(i % 5 * 4, 1), rnd.gauss(i % 3 * 4, 1), rnd.random()]) for i in range(400)], "id long, vector array<double>")
    centres = v.fitted_centres(items, 8)
    queries = items.filter("id % 100 = 0")
    found = v.clustered_top_k(v.with_clusters(items, centres), queries, centres, 5, 3)
    assert v.recall(found, v.exact_top_k(items, queries, 5)).first().recall >= 0.9


def test_typed_names(spark):
    items = spark.createDataFrame([(0, "let it be", "the beatles", 5), (1, "yesterday", "the beatles", 9), (2, "let me", "other", 1)], "id long, track string, artist string, n long")
    queries = spark.createDataFrame([("beatles yesterdya", "beatles yesterdya"), ("let it b", "let it b")], "query string, key string")
    assert {(r.query, r.id) for r in search.typed(queries, items, 1).collect()} == {("beatles yesterdya", 1), ("let it b", 0)}


def test_adjusted(spark):
    ranked = spark.createDataFrame([(0, 1, "a", 1.0, 1), (0, 2, "b", 0.9, 2)], "user long, item long, artist string, score double, rank int")
    affinity = spark.createDataFrame([(0, "b", 1.0)], "user long, artist string, affinity double")
    skips = spark.createDataFrame([(0, 2, 3, 0.1)], "user long, item long, plays long, skip_rate double")
    assert [r.item for r in personal.adjusted(ranked, affinity, skips, 0.5, 0.5).orderBy("rank").collect()] == [2, 1]


def test_archive(spark, tmp_path):
    import zstandard

    line = {"user_id": 7, "timestamp": 1_704_100_000, "track_metadata": {"artist_name": "Drake feat. X", "track_name": "Song - Mono", "additional_info": {"duration": "200", "artist_mbids": ["A" * 8 + "-0000-0000-0000-" + "b" * 12]}}}
    raw = BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as archive:
        for name, data in (("x/listens/2024/1.listens", json.dumps(line) + "\nnot json\n"), ("x/listens/2020/1.listens", json.dumps(line) + "\n"), ("x/other", "")):
            info = tarfile.TarInfo(name)
            info.size = len(data.encode())
            archive.addfile(info, BytesIO(data.encode()))
    (tmp_path / "dump.tar.zst").write_bytes(zstandard.ZstdCompressor().compress(raw.getvalue()))
    lines = dumps.archive_lines(spark, str(tmp_path), 1_704_000_000, 1_705_000_000)
    rows = dumps.parsed(lines.select("line"), 1_704_000_000, 1_705_000_000)
    assert {r.reason: r.n for r in dumps.reason_counts(rows).collect()} == {"kept": 1, "unreadable": 1}
    row = dumps.keyed(rows).first()
    assert (row.song_key, row.duration_ms, row.artist_mbid) == ("drake|song", 200_000, "aaaaaaaa-0000-0000-0000-bbbbbbbbbbbb")
    dumps.write_lines(lines, str(tmp_path / "lines"))
    assert spark.read.parquet(str(tmp_path / "lines")).filter("year = 2024").count() == 2


def test_playlist_store(spark, tmp_path):
    track = lambda k, name: {"pos": 0, "track_name": name, "track_uri": f"t{k}", "artist_name": "A", "artist_uri": "a", "album_name": "B", "album_uri": "b", "duration_ms": 1}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.json").write_text(json.dumps({"playlists": [{"name": "two", "pid": 1, "tracks": [track(1, "x"), track(3, "y")]}]}))
    (tmp_path / "in" / "a.json").write_text(json.dumps({"playlists": [{"name": "one", "pid": 0, "tracks": [track(2, "z"), track(1, "w")]}]}))
    playlists.write_store(playlists.playlist_entries(spark, str(tmp_path / "in")), str(tmp_path / "store"))
    tracks = {r.track_uri: (r.track, r.track_name, r.conflicts) for r in playlists.store_table(spark, str(tmp_path / "store"), "tracks").collect()}
    assert tracks == {"t2": (0, "z", 0), "t1": (1, "w", 1), "t3": (2, "y", 0)}
    assert sorted((r.seq, r.pos, r.item) for r in playlists.store_sequences(spark, str(tmp_path / "store"), 2).collect()) == [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 2)]


def test_snapshots(spark, tmp_path):
    one, two = spark.range(5), spark.range(5, 8)
    first = snapshots.write_snapshot({"items": one}, str(tmp_path / "1"))
    assert first == snapshots.write_snapshot({"items": one.repartition(3)}, str(tmp_path / "same")) and len(first) == 12
    assert first != snapshots.write_snapshot({"items": two}, str(tmp_path / "2"), first)
    assert snapshots.snapshot_table(spark, [str(tmp_path / "1"), str(tmp_path / "2")], "items").count() == 8
    snapshots.write_sharded(one, str(tmp_path / "shards"), 2)
    assert [r.id for r in snapshots.sharded_rows(spark, str(tmp_path / "shards"), spark.range(3, 4), 2).collect()] == [3]


def test_stream_sessions_equal_batch_sessions(spark, tmp_path):
    rows = listens(spark, [*TWO_USERS, (9, 10**6, 1)]).withColumn("ts", F.timestamp_seconds("sec"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.stream_of(spark, str(tmp_path / "in"), "user long, sec long, item long, ts timestamp")
    query = live.live_sessions(stream, 1800).writeStream.format("memory").queryName("live_sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    want = {tuple(r) for r in s.session_windows(rows.filter("user < 9"), 1800).collect()}
    assert {tuple(r) for r in spark.table("live_sessions").collect()} == want


def test_stream_listeners_by_changes(spark, tmp_path):
    """Days of three batches; a user who plays on, one who lapses and comes back, and a late play."""
    from datetime import UTC, datetime, timedelta

    at = lambda day: datetime(2024, 1, 1, 12, tzinfo=UTC) + timedelta(days=day)
    days = [[(0, "x", 1), (1, "x", 2), (1, "x", 2)], [(5, "x", 1), (4, "x", 1), (3, "z", 9)], [(9, "x", 3), (9, "y", 1), (6, "x", 2), (2, "z", 9)], [(30, "x", 1)], [(31, "x", 1)]]
    for k, rows in enumerate(days):
        spark.createDataFrame([(key, user, at(d)) for d, key, user in rows], "key string, user long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"d={k}"))
    stream = live.stream_of(spark, str(tmp_path / "in" / "*"), "key string, user long, ts timestamp")
    live.run_available(live.live_listeners(stream, 5, "30 days"), live.listeners_step(str(tmp_path / "out")), str(tmp_path / "c"))
    first = 19723
    got = {(r.key, r.day - first): r.listeners for r in live.listeners_of(spark, str(tmp_path / "out")).collect()}
    batch = spark.createDataFrame([(d, key, user) for rows in days for d, key, user in rows], "day long, key string, user long")
    assert got == {(r.key, r.day): r.listeners for r in incremental.rolling_listeners(batch, 5).collect()}


def test_stacked_notes_and_written_durations(spark):
    from sequoria.functions import listen_json
    from sequoria.functions import text as names

    notes = "".join(f" - {1990 + k} Remaster" for k in range(7))
    titles = spark.createDataFrame([(f"Song{notes}",), ("Song (Mono) [Remastered 2011] feat. Someone",), ("Song",), ("",), (None,), ("--((",)], "t string")
    assert [r.t for r in titles.select(names.clean_title(F.col("t")).alias("t")).collect()] == ["song", "song", "song", "", None, ""]
    values = [('"351000.7"', 0), ('"3e5"', 0), ('"351000"', 351000), ("351000.7", 351000), ("3e5", 300000), ("-1", 0), ("null", 0), ("true", 0)]
    lines = spark.createDataFrame([(k, f'{{"track_metadata": {{"additional_info": {{"x": 1, "duration_ms": {v}}}}}}}') for k, (v, _) in enumerate(values)], "k int, line string")
    got = dict(lines.select("k", listen_json.duration_ms(F.col("line")).alias("ms")).collect())
    assert [got[k] for k in range(len(values))] == [ms for _, ms in values]


def test_stream_listeners_in_any_order(spark, tmp_path):
    """Batches whose days come last first, a week and more behind: no play is dropped, no day counts twice."""
    from datetime import UTC, datetime, timedelta

    at = lambda day: datetime(2024, 1, 1, 12, tzinfo=UTC) + timedelta(days=day)
    days = [[(28, "x", 1), (24, "x", 2)], [(12, "x", 1), (25, "x", 2), (20, "y", 3)], [(0, "x", 1), (10, "x", 1), (14, "y", 3), (28, "x", 1)], [(3, "x", 1), (11, "x", 4)]]
    step = live.listeners_step(str(tmp_path / "out"))
    for k, rows in enumerate([*days, days[-1]]):  # the last batch is run twice
        batch = spark.createDataFrame([(key, user, at(d)) for d, key, user in rows], "key string, user long, ts timestamp")
        step(live.live_listeners(batch, 7), min(k, len(days) - 1))
    got = {(r.key, r.day - 19723): r.listeners for r in live.listeners_of(spark, str(tmp_path / "out")).collect()}
    whole = spark.createDataFrame([(d, key, user) for rows in days for d, key, user in rows], "day long, key string, user long")
    assert got == {(r.key, r.day): r.listeners for r in incremental.rolling_listeners(whole, 7).collect()}


def test_nearest_hold_few_scores(monkeypatch):
    """Many queries and items in bounded memory; ties by item, batches and parts of any size."""
    import tracemalloc

    import numpy as np

    rnd = np.random.default_rng(5)
    items, queries, names = rnd.integers(-3, 4, (6000, 4)).astype(float), rnd.integers(-3, 4, (2000, 4)).astype(float), rnd.permutation(6000)
    tracemalloc.start()
    best = v._Nearest(len(queries), 30)
    for at in range(0, 6000, 2500):
        best.add(queries, names[at : at + 2500], items[at : at + 2500])
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 10 * 8 * v.HELD_SCORES  # all scores of a batch and their copies took several times that
    for row in (0, 1, 1999):
        scores = items @ queries[row]
        order = np.lexsort((names, -scores))[:30]
        assert best.names[row].tolist() == names[order].tolist() and (-best.costs[row]).tolist() == scores[order].tolist()
    monkeypatch.setattr(v, "HELD_SCORES", 7)
    small = v._Nearest(3, 30)
    for at in range(0, 6000, 10):
        small.add(queries[:3], names[at : at + 10], items[at : at + 10])
    assert (small.names == best.names[:3]).all() and (small.costs == best.costs[:3]).all()


def test_ranks_among_all_items(spark):
    rnd = random.Random(6)
    rows = [(k, [float(rnd.randrange(-2, 3)) for _ in range(3)]) for k in range(90)]
    items = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    targets = [(k, k + 1) for k in range(0, 80, 10)]
    got = v.ranks_among(items, items.filter("id % 10 = 0"), spark.createDataFrame(targets, "case long, item long"), block=3)
    score = lambda x, y: sum(p * q for p, q in zip(rows[x][1], rows[y][1]))
    assert {(r.case, r.item, r["rank"]) for r in got.collect()} == {(c, t, 1 + sum(score(c, o) > score(c, t) for o in range(90))) for c, t in targets}


def test_probed_lists_hold_few_scores():
    """A slice of a list and all queries that probe it, in bounded memory; a query's lists are ranked together."""
    import tracemalloc

    import numpy as np

    rnd = np.random.default_rng(7)
    queries, items = rnd.normal(size=(3000, 4)), rnd.normal(size=(8192, 4))
    probing = {0: np.arange(3000), 3: np.arange(0, 3000, 2)}
    tracemalloc.start()
    best = v._Probed(probing, queries, 5)
    for cluster, at in ((0, 0), (3, 4096), (4, 0)):
        best.add(cluster, np.arange(at, at + 4096), items[at : at + 4096])
    assert tracemalloc.get_traced_memory()[1] < 10 * 8 * v.HELD_SCORES
    tracemalloc.stop()
    (got,) = best.rows(np.arange(3000) + 100)
    found = got.to_pandas().groupby("query")["item"].apply(list)
    for q, most in ((0, 8192), (1, 4096), (2998, 8192)):
        assert found[q + 100] == np.argsort(-np.round(items[:most] @ queries[q], 9), kind="stable")[:5].tolist()


def _order_features(spark, sf_dir, make):
    contexts, candidates = inputs.contexts_and_candidates(spark, sf_dir)
    return make(candidates, contexts, inputs.attributes(spark, sf_dir)).rdd.getNumPartitions()


def test_overlap_is_dealt_out_by_case_as_the_table_grows(spark, sf_dir, monkeypatch):
    few = inputs.parts(spark, sf_dir, "lineitem")
    monkeypatch.setattr(inputs, "ROWS_A_PART", 500)
    many = inputs.parts(spark, sf_dir, "lineitem")
    assert few == spark.sparkContext.defaultParallelism < many == -(-inputs.table(spark, sf_dir, "lineitem").count() // 500)
    assert _order_features(spark, sf_dir, lambda *x: features.overlap_features(*x, many)) == many


def test_overlap_without_attributes_and_of_a_case_without_context(spark):
    contexts = spark.createDataFrame([(1, 0, 2, 10), (1, 1, 2, 11), (None, 0, 1, 10)], "case long, place int, n_items int, item long")
    candidates = spark.createDataFrame([(1, 10), (1, 12), (1, 99), (2, 10)], "case long, item long")
    known = spark.createDataFrame([(10, "A", "x", ["u", "v"]), (11, "B", "y", ["v"]), (12, "B", "x", ["v", "w"])], "item long, artist string, album string, genres array<string>")
    out = {(r.case, r.item): tuple(r)[2:] for r in features.overlap_features(candidates, contexts, known, 3).collect()}
    assert out == {(1, 10): (0.5, 0.5, 0.0, 0.75), (1, 12): (0.5, 0.5, 1.0, 0.5), (1, 99): (0.0, 0.0, 0.0, 0.0), (2, 10): (0.0, 0.0, 0.0, 0.0)}


def test_counts_after_a_history_are_dealt_out_by_case(spark, sf_dir):
    contexts, candidates = inputs.contexts_and_candidates(spark, sf_dir)
    counts = pairs.pair_counts(inputs.playlists(spark, sf_dir), parts=5)
    assert pairs.after_counts(contexts, candidates, counts, 7).rdd.getNumPartitions() == 7


def test_merged_pair_tables_are_dealt_out_once(spark, sf_dir):
    rows = inputs.playlists(spark, sf_dir)
    halves = [pairs.pair_counts(rows.filter(f"seq % 2 = {k}"), parts=9) for k in range(2)]
    assert pairs.merged(*halves).rdd.getNumPartitions() == 9


def test_gains_of_targets_make_no_row_for_each_target(spark, sf_dir):
    plan = registry.queries()["multi_target_gains"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_counts_that_are_compared_are_dealt_out_as_the_table_grows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(inputs, "ROWS_A_PART", 500)
    assert registry.queries()["lowered_counts"](spark, sf_dir).rdd.getNumPartitions() == inputs.parts(spark, sf_dir, "lineitem")


def test_slices_are_compressed_files_of_a_row(spark, tmp_path):
    from sequoria.plans import table_plans

    table_plans._one_row_files(spark.createDataFrame([("x" * 10_000,)], "value string"), str(tmp_path / "slices"))
    files = [f for f in (tmp_path / "slices").iterdir() if f.name.startswith("part-")]
    assert {f.suffix for f in files} == {".gz"} and sum(f.stat().st_size for f in files) < 1000
    assert sorted(len(r.value) for r in spark.read.text(str(tmp_path / "slices"), wholetext=True).collect())[-1] == 10_001  # with its line end


def test_features_of_a_history_that_is_the_context_are_made_once(spark):
    contexts = spark.createDataFrame([(1, 0, 2, 10), (1, 1, 2, 11), (3, 0, 1, 12)], "case long, place int, n_items int, item long")
    candidates = spark.createDataFrame([(1, 10, 2.0, 1), (1, 12, 1.0, 2), (2, 10, 1.0, 1), (3, 11, 1.0, 1)], "case long, item long, score double, rank int")
    attributes = spark.createDataFrame([(10, "A", "x", ["u", "v"], 5000), (11, "B", "y", ["v"], 7000), (12, "B", "x", ["v", "w"], 9000)], "item long, artist string, album string, genres array<string>, length_ms long")
    counts = spark.createDataFrame([(10, 5), (11, 3)], "item long, n long")
    after = spark.createDataFrame([(10, 12, 4), (11, 12, 1), (12, 11, 2)], "a long, b long, n long")
    near = spark.createDataFrame([(1, 7, 1)], "case long, seq long, rank int")
    known = features.Statistics(counts, after, attributes, near, spark.createDataFrame([(7, 12)], "seq long, item long"))
    once = features.ranking_features(candidates, contexts, contexts, known, parts=3)
    twice = features.ranking_features(candidates, contexts, contexts.select("*"), known)
    assert sorted(once.collect()) == sorted(twice.collect())
    windows = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    assert 0 < windows(once) < windows(twice)
