"""Factorised vectors, the ranker's table, inverted lists, sampled candidates, versions and replays."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sequoria.operators import factors, features, ids, inverted_lists, pairs, ranking, replay
from sequoria.operators import vectors as v
from sequoria.plans import model_plans
from sequoria.sources.versions import SwitchError, Versions


def test_factors_find_what_follows(spark):
    """Two worlds of items that never mix: what follows an item is of its world."""
    rnd = random.Random(0)
    rows = [(s, p, (s % 2) * 20 + rnd.randrange(20)) for s in range(120) for p in range(12)]
    counted = pairs.pair_counts(spark.createDataFrame(rows, "seq long, pos int, item long"))
    learned = factors.fitted_factors(counted, rank=4, rounds=5)
    inputs = spark.createDataFrame([(0, 0, 3), (0, 1, 5), (1, 0, 30), (2, 0, 999)], "case long, place int, item long")
    found = factors.expected_next(inputs, learned, 10).collect()
    assert {r.case for r in found} == {0, 1}  # item 999 is not known
    assert all((r.item >= 20) == (r.case == 1) for r in found) and sorted(r.rank for r in found if r.case == 0) == list(range(1, 11))
    counts = spark.createDataFrame([(1, 5), (2, 9), (3, 5)], "item long, n long")
    popular = factors.popular_next(spark.createDataFrame([(7,), (8,)], "case long"), counts, 2).collect()
    assert sorted((r.case, r.item, r.rank) for r in popular) == [(7, 1, 2), (7, 2, 1), (8, 1, 2), (8, 2, 1)]


def test_blocks_of_factors_grow_in_number_with_the_pairs(spark, monkeypatch):
    known = spark.range(3000).select((F.col("id") % 60).alias("a"), F.floor(F.col("id") / 60).alias("b"), F.lit(1).alias("n"))
    monkeypatch.setattr(factors, "BLOCK_PAIRS", 150)
    learned = factors.fitted_factors(known, rank=2, rounds=1)
    assert learned.items.rdd.getNumPartitions() == learned.contexts.rdd.getNumPartitions() == 20
    assert learned.items.count() == 50 and learned.contexts.count() == 60


def test_rounds_of_factors_leave_few_files(spark, monkeypatch):
    """Each round is a checkpoint, which drops its shuffle files, and 30 million pairs do not need more blocks than few ones."""
    from pyspark.ml.recommendation import ALS

    fit, seen = ALS.fit, []
    monkeypatch.setattr(ALS, "fit", lambda self, rows: seen.append(self) or fit(self, rows))
    known = spark.range(100).select((F.col("id") % 10).alias("a"), F.floor(F.col("id") / 10).alias("b"), F.lit(1).alias("n"))
    monkeypatch.setattr(type(known), "count", lambda self: 30_000_000)
    factors.fitted_factors(known, rank=2, rounds=1)
    assert [(als.getCheckpointInterval(), als.getNumUserBlocks(), als.getNumItemBlocks()) for als in seen] == [(1, 10, 10)]


def test_learned_vectors_and_ranker_beat_their_baselines(spark, sf_dir):
    """Held-out next words: vectors against the most frequent words, trees against the order of retrieval.

    On the middle tables: the smallest ones have 40 cases to fit trees on and 40 to judge them.
    """
    sf_dir = str(Path(sf_dir).parent / "sf0.01")
    recall = {r.model: r for r in model_plans.learned_recall(spark, sf_dir).collect()}
    assert recall["factors"].recall_50 > recall["popularity"].recall_50 and recall["factors"].n == recall["popularity"].n > 150
    lists = {r.list: r for r in model_plans.learned_ranker(spark, sf_dir).collect()}
    assert lists["ranked"].n == lists["retrieved"].n and lists["ranked"].ndcg_10 > lists["retrieved"].ndcg_10


def test_repeated_items_of_a_context_are_looked_up_once(spark):
    contexts = spark.createDataFrame([(1, 0, 4, 10), (1, 1, 4, 11), (1, 2, 4, 10), (1, 3, 4, 10)], "case long, place int, n_items int, item long")
    candidates = spark.createDataFrame([(1, 20), (1, 21)], "case long, item long")
    counts = spark.createDataFrame([(10, 20, 5), (11, 20, 2), (11, 21, 3)], "a long, b long, n long")
    once = pairs.after_counts(contexts, candidates, counts)
    want = {(1, 20, 5, 17, 1.0), (1, 21, 0, 3, 0.25)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in pairs.after_counts(contexts, candidates, counts, 3).collect()}
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.rindex("Aggregate [")  # below the look-up


def test_features_in_steps_are_those_of_one_step(spark, monkeypatch):
    contexts = spark.range(60).select(F.floor(F.col("id") / 3).alias("case"), (F.col("id") % 3).cast("int").alias("place"), F.lit(3).alias("n_items"), (F.col("id") * 7 % 11).alias("item"))
    candidates = spark.range(40).select(F.floor(F.col("id") / 2).alias("case"), (F.col("id") * 5 % 11).alias("item"), (F.col("id") % 2).cast("double").alias("score"), (F.col("id") % 2 + 1).cast("int").alias("rank"))
    attributes = spark.range(11).select(F.col("id").alias("item"), (F.col("id") % 3).cast("string").alias("artist"), (F.col("id") % 4).cast("string").alias("album"), F.array((F.col("id") % 2).cast("string")).alias("genres"), (F.col("id") * 1000).alias("length_ms"))
    after = spark.range(50).select((F.col("id") % 7).alias("a"), F.floor(F.col("id") / 7).alias("b"), F.col("id").alias("n"))
    members = spark.range(90).select((F.col("id") % 30).alias("seq"), (F.col("id") * 3 % 11).alias("item"))
    known = features.Statistics(spark.range(11).select(F.col("id").alias("item"), F.col("id").alias("n")), after, attributes, None, members)
    make = lambda: sorted(model_plans._features_in_steps(candidates, contexts, contexts.select("*"), known, contexts.select("case").distinct()).collect())
    kept = model_plans.written
    made = []
    monkeypatch.setattr(model_plans, "written", lambda df: made.append(1) or kept(df))
    whole = make()
    monkeypatch.setattr(model_plans, "STEP_CASES", 6)
    assert make() == whole and len(whole) == 40 and len(made) == 1 + 4


def test_assembled_features_in_steps_of_orders(spark, sf_dir, monkeypatch):
    whole = sorted(model_plans.assembled_features(spark, sf_dir).collect())
    monkeypatch.setattr(model_plans, "STEP_ORDERS", 700)
    stepped = model_plans.assembled_features(spark, sf_dir)
    assert stepped._jdf.queryExecution().analyzed().toString().count("Relation") > 1 and sorted(stepped.collect()) == whole


def test_features_of_unknown_items_are_nothing(spark):
    candidates = spark.createDataFrame([(1, 10, 0.5, 1), (1, 99, 0.25, 2)], "case long, item long, score double, rank int")
    contexts = spark.createDataFrame([(1, 0, 2, 10), (1, 1, 2, 11)], "case long, place int, n_items int, item long")
    attributes = spark.createDataFrame([(10, "a", "x", ["g", "h"], 2000), (11, "a", "y", ["g"], 4000)], "item long, artist string, album string, genres array<string>, length_ms long")
    empty = lambda schema: spark.createDataFrame([], schema)
    known = features.Statistics(empty("item long, n long"), empty("a long, b long, n long"), attributes, empty("case long, seq long, rank int"), empty("seq long, item long"))
    rows = {r.item: r.asDict() for r in features.ranking_features(candidates, contexts, contexts, known).collect()}
    assert set(rows) == {10, 99} and set(rows[10]) == {"case", "item", *features.FEATURES}
    assert (rows[10]["same_artist"], rows[10]["same_album"], rows[10]["last_same_artist"], rows[10]["genre_match"]) == (1.0, 0.5, 1.0, 0.75)
    assert rows[99]["same_artist"] == rows[99]["genre_match"] == rows[99]["length_gap"] == 0 and rows[99]["log_rank"] == pytest.approx(math.log(2))
    near = features.alike_sequences(contexts, spark.createDataFrame([(5, 10), (5, 11), (6, 10), (7, 3)], "seq long, item long"))
    assert [(r.seq, r["rank"]) for r in near.orderBy("rank").collect()] == [(5, 1), (6, 2)]


def test_sampled_cases_are_whole(spark):
    rows = spark.range(3000).select((F.col("id") % 300).alias("case"), F.col("id").alias("item"))
    kept = features.sampled_cases(rows, 900)
    assert {r["count"] for r in kept.groupBy("case").count().collect()} == {10} and 500 < kept.count() < 1300
    assert features.sampled_cases(rows, 10**6).count() == 3000


def test_trees_are_fitted_on_all_rows(spark):
    """What only cases beyond the first half of the hash order show, in more than 200,000 rows, is learned too."""
    late = F.pmod(F.xxhash64("case"), F.lit(1 << 30)) >= 1 << 29
    rows = spark.range(420_000).select((F.col("id") % 42_000).alias("case"), F.col("id").alias("item")).withColumns({"seen": late.cast("double"), "noise": (F.col("item") % 97).cast("double"), "label": F.when(late, 1.0).otherwise((F.col("item") % 2).cast("double"))})
    model = features.fitted_trees(rows, ["seen", "noise"], trees=2, depth=2)
    got = model.transform(spark.createDataFrame([(0.0, 5.0), (1.0, 5.0)], "seen double, noise double")).orderBy("seen").collect()
    assert got[1].probability[1] > got[0].probability[1] + 0.1


def test_edges_of_trees_are_exact(spark):
    """Quantiles of all rows; a value that most rows have is a bin of its own."""
    rows = spark.range(1, 3201).select(F.col("id").cast("double").alias("even"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).cast("double").alias("heavy"))
    even, heavy = features.tree_edges(rows, ["even", "heavy"])
    assert len(even) == 33 and [round(e, 3) for e in even[1:3]] == [round(1 + 3199 * k / 32, 3) for k in (1, 2)]
    assert heavy[1] == 7 and 7 < heavy[2] < 7.001 and len(heavy) < 33


@pytest.mark.parametrize("slice_items,copies,block", [(4096, 1, 4096), (7, 1, 4096), (7, 3, 4)])
def test_inverted_lists(spark, slice_items, copies, block):
    """All lists probed is the exact answer; fewer lists find what numpy finds in them; lists are split in slices."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[150:170] = x[150]  # ties
    items = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<float>")
    queries = items.filter("id % 30 = 0")
    centres = v.fitted_centres(items, 6)
    lists = inverted_lists.build_lists(items, centres, 8, copies, slice_items)
    packed = lists.slices.collect()
    assert sorted(i for r in packed for i in r.ids) == sorted(list(range(300)) * copies)
    if slice_items < 100:
        assert max(len(r.ids) for r in packed) < 40 and len(packed) > 30
    scores = np.round((x @ x[::30].T).T.astype(np.float64), 6)
    centre = {r.cluster: np.array(r.centre) for r in centres.collect()}
    held = {c: {i for r in packed if r.cluster == c for i in r.ids} for c in centre}
    for probes in (6, 2):
        got = {}
        for r in inverted_lists.list_top_k(lists, queries, 5, probes, block).collect():
            got.setdefault(r.query, []).append((r["rank"], r.item))
        for row, q in enumerate(range(0, 300, 30)):
            near = sorted(centre, key=lambda c: (-float(x[q].astype(np.float64) @ centre[c]), c))[:probes]
            met = set().union(*(held[c] for c in near))
            want = sorted(met, key=lambda i: (-scores[row, i], i))[:5]
            assert sorted(got[q]) == list(enumerate(want, 1))
    assert inverted_lists.list_top_k(lists, queries.limit(0), 5, 2).count() == 0


def test_candidates_and_expected_counts(spark):
    targets = spark.createDataFrame([(0, 4), (1, None), (2, 4)], "place long, item long")
    draws = spark.createDataFrame([(0, 9), (1, 4)], "place long, item long")
    got = [(r.place, r.candidate, r.item, r.real) for r in ids.candidate_counts(targets, draws).orderBy("place").collect()]
    assert got == [(0, "target", 4, True), (1, "target", 0, False), (2, "target", 4, True), (3, "draw", 9, True), (4, "draw", 4, True)]
    counts = spark.createDataFrame([(1, 1), (2, 3), (3, 0)], "item long, n long")
    uniform = {r.item: (r.target_share, r.draw_share) for r in ids.draw_shares(counts, 0.0).collect()}
    assert uniform == {1: (0.25, pytest.approx(1 / 3)), 2: (0.75, pytest.approx(1 / 3)), 3: (0.0, pytest.approx(1 / 3))}
    q = {r.item: r.log_q for r in ids.log_q(ids.draw_shares(counts, 1.0), 4, 8).collect()}
    assert q == {1: pytest.approx(math.log(3)), 2: pytest.approx(math.log(9)), 3: pytest.approx(math.log(1e-12))}


def test_draws_follow_the_weights(spark):
    weights = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0), (4, 6.0)], "item long, p double")
    drawn = ids.weighted_draws(weights, spark.range(20_000).withColumnRenamed("id", "draw"))
    n = {r.item: r["count"] for r in drawn.groupBy("item").count().collect()}
    assert sum(n.values()) == 20_000 and 3 not in n
    assert n[1] / 20_000 == pytest.approx(0.1, abs=0.01) and n[4] / 20_000 == pytest.approx(0.6, abs=0.015)


def test_versions_switch_undo_and_prune(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    rows = lambda a, b: {"t": spark.range(a, b)}
    with pytest.raises(SwitchError, match="nothing is live"):
        versions.table("t")
    versions.publish("base", rows(0, 3))
    with pytest.raises(SwitchError, match="no standby"):
        versions.flip()
    with pytest.raises(SwitchError, match="not published"):
        versions.prepare("other")
    versions.prepare("base")
    versions.flip()
    versions.finish()
    versions.publish("one", rows(3, 5), "base")
    versions.publish("side", rows(90, 95), "base")
    versions.prepare("one")
    with pytest.raises(SwitchError, match="another standby"):
        versions.prepare("side")
    reading = versions.table("t")
    versions.flip()
    assert reading.count() == 3 and versions.table("t").count() == 5  # a query that has begun keeps its version
    with pytest.raises(SwitchError, match="live already"):
        versions.prepare("one")
    versions.finish()
    with pytest.raises(SwitchError, match="was built on base"):
        versions.prepare("side")
    versions.publish("two", rows(5, 9), "one")
    versions.prepare("two")
    versions.flip()
    assert sorted(r.id for r in versions.table("t").collect()) == list(range(9)) and versions.lineage("two") == ["base", "one", "two"]
    versions.undo()
    assert (versions.state().live, versions.state().standby) == ("one", "two") and versions.table("t").count() == 5
    assert versions.prune(keep=0) == ["side"] and versions.published() == ["base", "one", "two"]
    versions.finish()
    (tmp_path / "v" / "unfinished").mkdir()
    assert versions.prune(keep=0) == ["two", "unfinished"] and versions.table("t").count() == 5
    assert [r.action for r in versions.history().orderBy("number").collect()] == ["publish", "prepare", "flip", "finish", "publish", "publish", "prepare", "flip", "finish", "publish", "prepare", "flip", "undo", "prune", "finish", "prune"]
    with pytest.raises(SwitchError, match="nothing to go back"):
        versions.undo() or versions.undo()


def test_of_two_writers_one_wins(spark, tmp_path):
    one, two = Versions(spark, str(tmp_path / "v")), Versions(spark, str(tmp_path / "v"))
    one.publish("base", {"t": spark.range(1)})
    seen = two.state()
    one.prepare("base")
    with pytest.raises(SwitchError, match="another writer"):
        two._put(seen, "prepare", "base", None, "base")
    assert one.state().standby == "base" and not [p for p in (tmp_path / "v" / "_pointers").iterdir() if p.name.startswith("_")]


def test_replay_of_updates(spark):
    base = spark.createDataFrame([(1, 2, 5), (1, 3, 1)], "a long, b long, n long")
    daily = spark.createDataFrame([(0, 1, 3, 9), (0, 1, 7, 2), (1, 8, 1, 1)], "day int, a long, b long, n long")
    got = {}
    for r in replay.variant_pairs(base, daily).collect():
        got.setdefault(r.variant, set()).add((r.day, r.a, r.b, r.n))
    first = {(-1, 1, 2, 5), (-1, 1, 3, 1)}
    assert got == {"today": first, "all": first | {(0, 1, 3, 9), (0, 1, 7, 2), (1, 8, 1, 1)}, "new": first | {(0, 1, 7, 2), (1, 8, 1, 1)}}
    cases = spark.createDataFrame([(0, 1, 1, 3), (1, 2, 1, 3), (1, 3, 1, 7), (1, 4, 8, 1)], "day int, case long, last long, target long")
    ranks = {(r.variant, r.case): r["rank"] for r in replay.replayed_ranks(replay.variant_pairs(base, daily), cases).collect()}
    assert ranks == {("today", 1): 2, ("today", 2): 2, ("today", 3): None, ("today", 4): None, ("all", 1): 2, ("all", 2): 1, ("all", 3): 3, ("all", 4): None, ("new", 1): 2, ("new", 2): 3, ("new", 3): 2, ("new", 4): None}
    report = {(r.variant, r.day): r for r in replay.replay_report(replay.replayed_ranks(replay.variant_pairs(base, daily), cases)).collect()}
    gain = lambda k: 1 / math.log2(k + 1)
    d = [gain(1) - gain(2), gain(3), 0]
    assert report["all", 1].n == 3 and report["all", 1].difference == pytest.approx(sum(d) / 3) and report["all", 1].se == pytest.approx(np.std(d, ddof=1) / 3**0.5)
    assert report["today", 1].difference == 0


def test_metrics_of_ranked_lists(spark):
    targets = spark.createDataFrame([(1, 5), (2, 6)], "case long, item long")
    ranked = spark.createDataFrame([(1, 5, 2), (1, 6, 1)], "case long, item long, rank int")
    row = factors.next_item_summary(targets, ranked).first()
    assert (row.n, row.hits_1, row.hits_5) == (2, 0.0, 0.5) and row.ndcg_10 == pytest.approx(0.5 / math.log2(3))
    assert ranking.MISSED > 10
