"""Rules, decontamination, joins, line and substring dedup against brute force, with awkward rows."""

import hashlib
import random
import re
import tempfile
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sequoria.llm import contamination, fuzzy_lines, induced, jaccard_join, recompression, repetition, suffix_dedup

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, symbol string, root long, n long, line string"


def texts(seed=0, n=60):
    """Copies, near copies, shared passages, runs, unicode, short and empty texts."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["é", "😀", "a"]
    passage = [rnd.choice(words) for _ in range(70)]
    out = [None, "", " \n ", "one two", "a " * 400, "x" * 300, "x" * 200]
    while len(out) < n:
        base = [rnd.choice(words) for _ in range(rnd.randrange(1, 160))]
        kind = rnd.randrange(5)
        if kind == 0:
            base[len(base) // 2 : len(base) // 2] = passage[rnd.randrange(10) : 70 - rnd.randrange(10)]
        elif kind == 1 and len(out) > 8 and out[-1]:
            base = out[-1].split()
            base[rnd.randrange(len(base)) :][:1] = ["edit"]
        elif kind == 2 and len(out) > 8:
            base = (out[rnd.randrange(7, len(out))] or "").split()
        out.append((rnd.choice((" ", "\n", "  "))).join(base))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", 1, 2, "l") for i, t in enumerate(texts())]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, empty):
    rows, df = docs
    got = {r.doc_id: r for r in repetition.repetition_report(df).collect()}
    for key, text, *_ in rows:
        words = re.findall(WORD, text or "")
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        hit = {i + k for i, x in enumerate(grams) if grams.count(x) > 1 for k in range(8)}
        lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
        r = got[key]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(hit), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 20 or 100 * len(hit) > 30 * len(words)) and not (r.base_failed and r.kept)
    assert sorted(r.doc_id for r in repetition.keep_clean(df).collect()) == sorted(k for k, r in got.items() if r.kept)
    assert repetition.repetition_report(empty).count() == repetition.keep_clean(empty).count() == 0


def test_contamination_in_one_and_in_several_parts(spark, docs, empty):
    rows, df = docs
    items = [("i1", " ".join((rows[20][1] or "").split()[:30])), ("i2", "one TWO"), ("i3", None), ("i4", "!!"), (None, "a a"), ("i1", "one two")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = [(i, tuple(w[k : k + 13])) for i, t in items if (w := norm(t)) for k in range(max(1, len(w) - 12))]
    want = {}
    for key, text, *_ in rows:
        words = norm(text)
        found = [(i, k, len(w)) for i, w in windows for k in range(len(words) - len(w) + 1) if tuple(words[k : k + len(w)]) == w]
        hit, ids = {k + d for _, k, n in found for d in range(n)}, sorted({i for i, _, _ in found if i})
        places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        spans = ",".join(f"{places[k][0]}:{places[next(e for e in range(k, len(words)) if e + 1 not in hit)][1]}" for k in sorted(hit) if k - 1 not in hit)
        want[key] = (len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words), spans)
    for most in (contamination.MAX_PATTERN_CHARS, 60):
        assert {r[0]: tuple(r[1:]) for r in contamination.contamination_report(df, bench, most).collect()} == want
        assert sorted(r.doc_id for r in contamination.drop_contaminated(df, bench, most).collect()) == sorted(k for k, w in want.items() if not w[4])
    assert contamination.contamination_report(empty, bench).count() == 0
    assert contamination.contamination_report(df, bench.limit(0)).filter("contaminated").count() == 0


def shingles(text, size):
    words = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def components(n, links):
    root = list(range(n))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("size,least", [(3, 90), (5, 80)])
def test_jaccard(docs, empty, size, least):
    rows, df = docs
    sets = [shingles(t, size) for _, t, *_ in rows]
    links = [(i, k) for i in range(len(sets)) for k in range(i) if sets[i] and sets[k] and 100 * len(sets[i] & sets[k]) >= least * len(sets[i] | sets[k])]
    want = components(len(sets), links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(df, size, least).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, want))}
    assert len(set(want)) < len(want)
    assert jaccard_join.similar_groups(empty, size, least).count() == 0


def test_one_of_each_group_stays(spark, docs):
    rows, df = docs
    more = df.unionByName(spark.createDataFrame([(None, "a b c d e f", "", 0, 0, ""), (None, None, "", 0, 0, "")], SCHEMA))
    kept = jaccard_join.keep_one(more)
    assert kept.columns == df.columns and kept.filter("doc_id IS NULL").count() == 2
    groups = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(df).collect()}
    assert {r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()} == set(groups.values())


def removed(units, size):
    """Units covered by windows that start in a smaller document too."""
    first, out = {}, []
    for x in units:
        for k in range(len(x) - size + 1):
            first.setdefault(tuple(x[k : k + size]), len(out))
        gone = set()
        for k in range(len(x) - size + 1):
            if first[tuple(x[k : k + size])] < len(out):
                gone |= set(range(k, k + size))
        out.append(gone)
    return out


def test_repeated_passages_of_words(docs, empty):
    rows, df = docs
    units = [re.findall(WORD, t or "") for _, t, *_ in rows]
    want = {i: (len(u), len(g), hashlib.sha256(" ".join(w for k, w in enumerate(u) if k not in g).encode()).hexdigest()) for i, (u, g) in enumerate(zip(units, removed(units, 50)))}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompression.repeat_report(df).collect()} == want
    assert any(w[1] for w in want.values())
    assert recompression.repeat_report(empty).count() == 0


@pytest.mark.parametrize("symbol_bytes", [suffix_dedup.SYMBOL_BYTES, 200])
def test_repeated_passages_of_bytes(docs, empty, symbol_bytes, monkeypatch):
    rows, df = docs
    monkeypatch.setattr(suffix_dedup, "SYMBOL_BYTES", symbol_bytes)
    units = [(t or "").encode() for _, t, *_ in rows]
    gone = removed(units, 50)
    spans = [sum(k - 1 not in g for k in g) for g in gone]
    want = {i: (len(u), len(g), s, hashlib.sha256(bytes(b for k, b in enumerate(u) if k not in g)).hexdigest()) for i, (u, g, s) in enumerate(zip(units, gone, spans))}
    assert {r.doc_id: tuple(r[1:]) for r in suffix_dedup.substring_report(df).collect()} == want
    assert any(w[1] for w in want.values())
    assert suffix_dedup.substring_report(empty).count() == 0


@pytest.mark.parametrize("rows,base", [(1 << 22, 1 << 22), (5, 2)])
def test_external_induction(rows, base):
    rng = np.random.default_rng(rows)
    for _ in range(30):
        parts = [rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 30))) for _ in range(int(rng.integers(1, 9)))]
        parts += [parts[int(rng.integers(len(parts)))] for _ in range(2)]
        text = np.concatenate([np.append(p, 0) for p in parts])
        need = int(rng.integers(1, 60))
        blocks = list(induced.suffixes(text, int(text.max()) + 1, need, induced.Room(tempfile.gettempdir(), rows, base)))
        place, common = (np.concatenate(x) for x in zip(*blocks))
        assert sorted(place.tolist()) == list(range(len(text)))
        for a, b, c in zip(place.tolist(), place[1:].tolist(), common[1:].tolist()):
            x, y = text[a:].tolist(), text[b:].tolist()
            lcp = next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
            assert x[:need] >= y[:need] and min(lcp, need) == min(c, need)


def test_queues_wait_on_disk_at_shipped_settings(monkeypatch):
    rng, spills = np.random.default_rng(3), []
    parts = [rng.integers(1, 30, 90) for _ in range(12000)]
    text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.uint16)
    spill = induced.Queue.spill
    monkeypatch.setattr(induced.Queue, "spill", lambda self: (spills.append(self.rows), spill(self))[1])
    room = induced.Room(tempfile.gettempdir())
    place = np.concatenate([p for p, _ in induced.suffixes(text, 30, suffix_dedup.WINDOW, room)])[::-1]
    assert len(text) < suffix_dedup.SHARD_BYTES and spills and max(spills) <= 2 * room.rows
    sample = place[:: len(place) // 500]
    keys = [text[a : a + suffix_dedup.WINDOW].tolist() for a in sample.tolist()]
    assert len(place) == len(text) == len(set(place.tolist())) and keys == sorted(keys, reverse=keys[0] > keys[-1])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for k, y in enumerate(b):
            row.append(min(row[k] + 1, last[k + 1] + 1, last[k] + (x != y)))
    return row[-1]


def test_fuzzy_lines(spark, empty):
    rnd = random.Random(5)
    words = [f"word{i}" for i in range(60)]
    base = [" ".join(rnd.choice(words) for _ in range(30)) for _ in range(6)]
    rows = [(None, base[0]), (90, None), (91, ""), (92, "short line\nshort line")]
    for i in range(25):
        lines = []
        for _ in range(rnd.randrange(1, 5)):
            line = rnd.choice(base).split()
            if rnd.random() < 0.5:
                line[rnd.randrange(len(line))] += "s"
            lines.append(rnd.choice((str, str.upper))(" ".join(line)) + rnd.choice(("", "!")))
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # brute force: the edit similarity of all pairs of lines, whatever their SimHashes and keys
    norm = {(key, k): " ".join(re.findall(r"\w+", line.lower())) for key, text in rows[1:] for k, line in enumerate((text or "").split("\n"))}
    keys = sorted(k for k, line in norm.items() if line)
    links = [(i, k) for i in range(len(keys)) for k in range(i) if distance(norm[keys[i]], norm[keys[k]]) <= int(max(len(norm[keys[i]]), len(norm[keys[k]])) * 0.2 + 1e-9)]
    root = components(len(keys), links)
    want = {keys[i] for i in range(len(keys)) if root[i] != i}
    assert {(r.doc_id, r.line_no) for r in fuzzy_lines.dropped_lines(df).collect()} == want and want
    out = {r.doc_id: r.text for r in fuzzy_lines.dedup_lines(df).collect()}
    assert out[None] == base[0] and out[90] is None and out[91] == "" and out[92] == "short line"
    for key, text in rows[4:]:
        assert out[key] == "\n".join(x for k, x in enumerate(text.split("\n")) if (key, k) not in want)
    assert fuzzy_lines.line_report(empty).count() == 0


def test_recall_of_fuzzy_lines_by_length(spark):
    """Against edit similarity of all pairs of original and copy, with one word in ten (one at least) replaced, left out or put in."""
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 9))) for _ in range(3000)]
    rows, lengths = [], ((5, 9), (10, 19), (20, 49), (50, 150))
    for k, (low, high) in enumerate(lengths):
        while len(rows) < 100 * (k + 1):
            line = [rnd.choice(words) for _ in range(rnd.randrange(low, high + 1))]
            copy = list(line)
            for i in rnd.sample(range(len(line)), max(1, len(line) // 10)):
                copy[i] = rnd.choice((rnd.choice(words), "", f"{line[i]} {rnd.choice(words)}"))
            line, copy = " ".join(line), " ".join(" ".join(copy).split())
            if len(copy.split()) >= 5 and line != copy and distance(line, copy) <= int(max(len(line), len(copy)) * 0.2 + 1e-9):
                rows += [(len(rows), line), (len(rows) + 1, copy)]
    found = [r.doc_id for r in fuzzy_lines.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    recall = {f"{low}-{high}": sum(x // 100 == k for x in found) / 50 for k, (low, high) in enumerate(lengths)}
    print("recall by words of a line:", recall)
    assert min(recall.values()) >= 0.97 and all(x % 2 for x in found)


def test_lines_that_share_a_common_passage(spark):
    """More lines than a key compares in full share half of their words; only those that are alike beside it meet, and all of these do."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 9)))
    passage = [word() for _ in range(30)]
    tails = [[word() for _ in range(30)] for _ in range(fuzzy_lines.FULL + 60)]
    rows = [(i, " ".join(passage + tail)) for i, tail in enumerate(tails)]
    rows += [(1000 + i, " ".join(passage + [word()] + tails[i][1:])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in fuzzy_lines.dropped_lines(df).collect()} == {1000 + i for i in range(40)}
    lines = fuzzy_lines.written(fuzzy_lines.line_table(df).selectExpr("line", "struct(doc_id, line_no) AS first", "n", "size", "sim", "shingles"))
    pairs = fuzzy_lines._rest_pairs(df, lines, fuzzy_lines._buckets(lines), spark.createDataFrame([], "id long, root long"))
    assert pairs.count() < len(rows)
    told = {r.common for r in fuzzy_lines._rare_shingles(df, lines, lines.select("line")).collect()}
    assert told == {False}


@pytest.mark.parametrize("others", [100, 400])
def test_changed_letters_beside_a_common_passage(spark, others):
    """Pairs of lines with 30 words of a common passage and 24 of their own, every third of which is changed by a letter:
    the second one goes whether few or many other lines have the passage."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(4, 9)))
    passage = [word() for _ in range(30)]
    rows = [(k, " ".join(passage + [word() for _ in range(24)])) for k in range(others)]
    changed = lambda w, at: w[:at] + chr(97 + (ord(w[at]) - 96) % 26) + w[at + 1 :]
    for k in range(20):
        own = [word() for _ in range(24)]
        rows += [(10_000 + 2 * k, " ".join(passage + own)), (10_001 + 2 * k, " ".join(passage + [changed(w, len(w) // 2) if i % 3 == 0 else w for i, w in enumerate(own)]))]
    found = {r.doc_id for r in fuzzy_lines.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {10_001 + 2 * k for k in range(20)}


def test_links_do_not_depend_on_the_size_of_a_key(spark):
    """Pairs that share a common passage alone, as every own word is changed by a letter: what is found stays, however many other lines have the passage."""
    rnd = random.Random(17)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    passage, pairs = [word() for _ in range(30)], []
    for k in range(20):
        own = [word() for _ in range(24)]
        pairs += [(10_000 + 2 * k, " ".join(passage + own)), (10_001 + 2 * k, " ".join(passage + [w[:2] + chr(97 + (ord(w[2]) - 96) % 26) + w[3:] for w in own]))]
    others = [(k, " ".join(passage + [word() for _ in range(24)])) for k in range(fuzzy_lines.FULL + 100)]
    alone, beside = ({r.doc_id for r in fuzzy_lines.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} for rows in (pairs, others + pairs))
    assert beside == alone and len(alone) >= 15 and all(x % 2 for x in alone)


def test_tables_of_keys_do_not_stay_on_disk(spark, monkeypatch):
    """What only serves to find links is gone when the result is made."""
    made, written = [], fuzzy_lines.written
    monkeypatch.setattr(fuzzy_lines, "written", lambda df: made.append(written(df)) or made[-1])
    texts = ["one two three four five six\nseven eight nine ten eleven", "one two three four five sixx\nseven eight nine ten eleve", "one two three four fives six"]
    found = {r.doc_id: r.n_dropped for r in fuzzy_lines.line_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {0: 0, 1: 2, 2: 1}
    left = [t.columns for t in made if Path(t._written_to.removeprefix("file:")).exists()]
    assert left and not [c for c in left if {"shingles", "key", "keys", "bits", "norm"} & set(c)]


def test_texts_of_candidates_do_not_stay_on_disk(spark, monkeypatch):
    made, written = [], jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df: made.append(written(df)) or made[-1])
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(k, " ".join([*words[: 50 + k], f"x{k}"])) for k in range(4)], "doc_id long, text string")
    assert {r.component_id for r in jaccard_join.similar_groups(docs, 3, 80).collect()} == {0}
    left = [t.columns for t in made if Path(t._written_to.removeprefix("file:")).exists()]
    assert left and not [c for c in left if {"text", "prefix", "key"} & set(c)]


def test_rows_of_a_stage_go_when_the_next_ones_are_written(spark, sf_dir, monkeypatch):
    import corpus_pipeline

    made, written = [], corpus_pipeline.written
    monkeypatch.setattr(corpus_pipeline, "written", lambda df: made.append(written(df)) or made[-1])
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(k), lambda spark, docs, sf_dir: docs.filter("doc_id % 2 = 0")) for k in range(4)])
    n = corpus_pipeline.run(spark, sf_dir).count()
    assert n > 0 and [Path(t._written_to.removeprefix("file:")).exists() for t in made] == [False, False, True]


def test_large_keys_meet_in_rounds(spark, monkeypatch):
    """A line of a key of many parts is in many cells: rounds hold a few rows for each line, and their links are those of one round."""
    monkeypatch.setattr(fuzzy_lines, "PART", 4)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    passage, own = [word() for _ in range(8)], [[word() for _ in range(12)] for _ in range(30)]
    texts = [" ".join([*passage, *(word() if i == k // 30 else w for i, w in enumerate(own[k % 30]))]) for k in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, cells = fuzzy_lines.written, []
    monkeypatch.setattr(fuzzy_lines, "written", lambda df: cells.append(df.columns) or made(df))
    found, rounds = [], []
    for copies, pairs in ((4, 1), (1000, 4_000_000)):
        monkeypatch.setattr(fuzzy_lines, "COPIES", copies)
        monkeypatch.setattr(fuzzy_lines, "STEP_PAIRS", pairs)
        cells.clear()
        found.append(sorted(tuple(r) for r in fuzzy_lines.dropped_lines(docs).collect()))
        rounds.append(cells.count(["a", "b"]))
    assert found[0] == found[1] and len(found[0]) == 60 and rounds[0] > rounds[1]


@pytest.mark.parametrize("part", [7, 1024])
def test_parts_of_a_key_meet_in_full(spark, monkeypatch, part):
    """Against all pairs of lines, with keys in one part and in many: each pair that may be similar comes once."""
    monkeypatch.setattr(fuzzy_lines, "PART", part)
    monkeypatch.setattr(fuzzy_lines, "FULL", 20)
    rnd = random.Random(23)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 14))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = fuzzy_lines.written(fuzzy_lines.line_table(docs).select("line", F.struct("doc_id", "line_no").alias("first"), *fuzzy_lines.FEATURES[1:]).dropDuplicates(["line"]))
    rest = lines.select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), F.col("n").cast("long") + 10)).alias("key"), *fuzzy_lines.FEATURES, F.col("line").alias("root")).withColumn("lines", F.count("*").over(Window.partitionBy("key")))
    norms = fuzzy_lines.written(fuzzy_lines._texts(docs, lines.select("line", "first")))
    found = [tuple(r) for r in fuzzy_lines._met_in_parts(rest, norms).collect()]
    rows, norm = lines.collect(), {r.line: r.norm.split() for r in norms.collect()}
    near = lambda a, b: abs(a["size"] - b["size"]) <= int(max(a["size"], b["size"]) * 0.2 + 1e-9) and (min(a.n, b.n) < 8 or (a.sim ^ b.sim).bit_count() <= fuzzy_lines.MOST_BITS)
    share = lambda x, y: min(len(x), len(y)) < 8 or len(set(x) & set(y)) >= 0.4 * min(len(set(x)), len(set(y)))
    close = {(a.line, b.line) for a in rows for b in rows if a.line < b.line and near(a, b)}
    want = {p for p in close if share(norm[p[0]], norm[p[1]])}
    assert len(found) == len(set(found)) and want <= set(found) <= close and want


def test_short_lines_and_lines_without_spaces(spark):
    rows = [(0, "版权所有保留一切权利未经许可不得转载\nPrivacy policy"), (1, "版权所有保留一切权利未经许可不得转截\nPRIVACY policy!"), (2, "今天天气很好我们去公园散步吧\nshort line"), (3, "สงวนลิขสิทธิ์ตามกฎหมาย\nshort line"), (4, "สงวนลิขสิทธิ์ตามกฎหมาย\nPrivacy")]
    found = {(r.doc_id, r.line_no) for r in fuzzy_lines.dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, 0), (1, 1), (3, 1), (4, 0)}


def test_all_words_of_lines_of_any_length_count(spark):
    """The SimHash against its definition: the majority of each bit over all different pairs of neighbouring words."""
    mixed = lambda h, seed: xxhash.xxh64(h.to_bytes(8, "little"), seed).intdigest()
    rows = [(k, " ".join(f"h{i % 3000 * (k + 1)}" for i in range(n))) for k, n in enumerate((1, 2, 5, 63, 64, 200, 255, 256, 700, 33000, 73000))]
    sims = {r.doc_id: r.sim for r in fuzzy_lines.line_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for key, text in rows:
        hashes = [xxhash.xxh64(w.encode(), 42).intdigest() for w in text.split()]
        pairs = {mixed(b, mixed(a, 42)) for a, b in zip(hashes, hashes[1:])} | {mixed(hashes[-1], 42)}
        assert sims[key] == sum(1 << b for b in range(fuzzy_lines.BITS) if 2 * sum(p >> b & 1 for p in pairs) > len(pairs))


@pytest.mark.parametrize("most", [contamination.MAX_PATTERN_CHARS, 8])
def test_each_row_is_judged_by_its_own_text(spark, most):
    bench = spark.createDataFrame([("i1", "bad words"), ("i2", "other things")], "item_id string, text string")
    rows = [(None, "bad words"), (None, "fine"), (1, "bad words"), (1, "clean text"), (2, None), (3, "bad words"), (3, "bad words")]
    kept = contamination.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, most)
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([rows[1], rows[3], rows[4]], "doc_id long, text string").collect()))
