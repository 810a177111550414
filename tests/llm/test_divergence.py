"""The divergence audit against sums over all terms and pairs."""

import random
import re
from collections import Counter

import pytest

from sequoria.llm import divergence

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCHEMA = "lang string, source string, text string, term string, n long, salt int"


def terms(text):
    return re.findall(TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, least):
    docs = [(a or "", b or "", Counter(terms(t))) for a, b, t, *_ in docs]
    out = []
    for lang in {a for a, _, _ in docs}:
        df, whole, by = Counter(), Counter(), {}
        for a, b, bag in docs:
            if a == lang:
                by.setdefault(b, Counter()).update(bag)
                df.update(bag.keys())
                whole.update(bag)
        kept = [t for t in df if df[t] >= least]
        share = lambda bag: {t: 1 + 10**9 * (bag[t] + 5) // (sum(bag[x] for x in kept) + 5 * len(kept)) for t in kept}
        q, p = share(whole), {s: share(bag) for s, bag in by.items()}
        for s in by:
            rows = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in by if o != s)
            out += [(lang, s, "pair", o.decode(), -v, r) for r, (v, o) in enumerate(rows, 1)]
            rows = sorted((q[t] - p[s][t], t.encode()) for t in kept if by[s][t] and p[s][t] > q[t])[:50]
            out += [(lang, s, "term", t.decode(), -v, r) for r, (v, t) in enumerate(rows, 1)]
    return sorted(out)


def cases(seed=5):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)] + ["The", "the", "é", "😀", "a"]
    docs = []
    for _ in range(400):
        lang, source = rnd.choice(["en", "en", "de", None]), rnd.choice(["hot"] * 4 + ["a", "é", "z", None, "rare"])
        low = rnd.randrange(60)
        docs.append((lang, source, rnd.choice((" ", "1", "\n")).join(rnd.choices(words[low:], k=rnd.randrange(1, 60))), "x", 1, 2))
    docs += [("en", "silent", None, "x", 1, 2), ("en", "silent", "", "x", 1, 2), ("fr", "one", "wa wb", "x", 1, 2), ("fr", "two", None, "x", 1, 2), ("it", "alone", "wa", "x", 1, 2), ("en", "long", "waa THE " * 40_000, "x", 1, 2)]
    return docs + docs[:20]


@pytest.mark.parametrize("least,chunk", [(30, 1 << 24), (2, 2000), (1, 1 << 24)])
def test_equals_brute_force(spark, least, chunk, monkeypatch):
    docs = cases()
    whole = divergence.gathered_chunks
    monkeypatch.setattr(divergence, "gathered_chunks", lambda batches: whole(batches, limit=chunk))
    got = divergence.divergence_audit(spark.createDataFrame(docs, SCHEMA).repartition(4), least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(docs, least)


def test_empty_table_and_large_counts(spark):
    assert divergence.divergence_audit(spark.createDataFrame([], SCHEMA)).count() == 0
    big = spark.sql(f"SELECT {divergence.share('n', 'total')} AS p FROM VALUES (90000000000000L, 900000000000000L), (7L, 3L) AS t(n, total)")
    assert [r.p for r in big.collect()] == [1 + 10**9 * (90000000000000 + 5) // 900000000000000, 1 + 10**9 * 12 // 3]
