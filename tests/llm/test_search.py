"""Ranked search against a brute-force score of every document."""

import math
import random
import re

import numpy as np
import pytest

from sequoria.llm import ranked_search

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    bags = [(i, terms(t)) for i, t in docs]
    n, total = sum(1 for _, b in bags if b), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for x in set(b):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, b in bags:
            m = 25 + (75 * len(b) * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * b.count(x)) // (1000 * b.count(x) + 8 * m)) for x in terms(text) if x in b)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def cases(seed=3):
    rnd = random.Random(seed)
    words = ["the", "The", "of", *[f"w{i}" for i in range(60)], "é", "a1", "9"]
    docs = [(i, rnd.choice((" ", "-", "\n")).join(rnd.choices(words, weights=[40, 20, 30] + [1] * (len(words) - 3), k=rnd.randrange(1, 60)))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, " \n!"), (403, "w1 the " * 30_000), (None, "w5 w6"), (404, "w7 w8"), (405, "w7 w8"), (405, "w7 w8"), (406, "w8 W7")]
    rnd.shuffle(docs)
    items = [(1, "the of w1 w2 W3"), (2, "w7 w8 w7"), (3, None), (4, "nowhere"), (5, "the the of"), (1, "the of w1 w2 W3"), (1, "é 9"), (6, "w5"), (7, " ".join(words))]
    return docs, items


@pytest.mark.parametrize("k,limit,block", [(10, 1 << 24, 200_000), (3, 900, 4), (1000, 5000, 200_000)])
def test_equals_brute_force(spark, k, limit, block, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block)
    docs, items = cases()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, shard long").repartition(5)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, query long")
    index = ranked_search.build_index(df, limit)
    assert index.shards > 5 or limit > 5000
    got = ranked_search.search(index, bench, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, k)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.best_documents(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert ranked_search.best_documents(some, items.limit(0)).count() == 0
    assert ranked_search.best_documents(some.filter("doc_id = 2"), items).count() == 0
    assert [tuple(r)[:3] for r in ranked_search.best_documents(some, items).collect()] == [(1, 1, 1)]


def test_packed_numbers_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**35 - 1, 2**62], np.int64)
    data, offsets = ranked_search.packed(values)
    assert np.array_equal(ranked_search.unpacked(data.tobytes()), values)
    assert [len(data[a:b]) for a, b in zip(offsets, offsets[1:])] == [1, 1, 1, 2, 2, 3, 4, 5, 9]
    assert len(ranked_search.unpacked(b"")) == 0
