"""The pair index against the library's own encoder and decoder."""

import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sequoria.llm import word_bpe

SPEC = open(word_bpe.DEFAULT_MODEL, encoding="utf-8").read()
LIBRARY = Tokenizer.from_str(SPEC)
OWN = word_bpe.WordBpe(SPEC)


def check(texts, own=OWN, library=LIBRARY):
    ids, count = own.encode(pa.array(texts, pa.string()))
    offsets = np.concatenate([[0], np.cumsum(count)])
    assert offsets[-1] == len(ids)
    for text, a, b, decoded, numbers in zip(texts, offsets, offsets[1:], own.decode(ids, offsets).to_pylist(), own.numbers(ids, offsets).to_pylist()):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids[a:b].tolist() == want, text
        assert decoded == library.decode(want, skip_special_tokens=False)
        assert numbers == " ".join(map(str, want))


AWKWARD = [
    None, "", " ", "\n\t", "Hello, World's 12345 isn't WE'LL", "á ́ ẹ́ ﬁ Å İstanbul ΣΑΣ ß", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|> <|end oftext|>",
    "zero​width nbsp em\u0085nel ls", "😀👩‍👩‍👧 日本語のテキスト नमस्ते", "aaaaaaaaaaaaaaaa" * 50, "aa " * 60 + "ababab " * 70, "×÷ª º µ ÀÞß'S L'AMI don't'll <|x|>y<|endoftext|>z", "naïve ÿÿ ÜBER £5 ¡ªñ!", "thththe" * 300, "x" * 5000, "'s's't 'S ''", "\x00\x01\x7f", "word " * 30_000, "abc\r\ndef\x0bghi\x0cjkl",
]


def test_awkward_texts():
    check(AWKWARD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_any_text(texts):
    check(texts)


@pytest.mark.parametrize("many", [2, 48])
@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text("abcd", max_size=24), min_size=1, max_size=4), seed=st.integers(0, 10**6))
def test_merges_in_any_order(monkeypatch, many, texts, seed):
    """Random merge lists, in which a merge can make a pair of lower rank; on arrays and one by one."""
    monkeypatch.setattr(word_bpe.PairIndex, "MANY", many)
    rnd = random.Random(seed)
    spec = json.loads(SPEC)
    vocab = [c + s for c in "abcd" for s in ("", "</w>")]
    others = [v for v in spec["model"]["vocab"] if len(v.removesuffix("</w>")) == 1 and v not in vocab]
    merges = []
    for _ in range(40):
        a, b = rnd.choice([v for v in vocab if not v.endswith("</w>")]), rnd.choice(vocab)
        if [a, b] not in merges and len(a + b) < 14:
            merges.append([a, b])
            vocab.append(a + b) if a + b not in vocab else None
    rnd.shuffle(merges)
    spec["model"] |= {"vocab": {v: i for i, v in enumerate(vocab + others)}, "merges": merges}
    spec["added_tokens"] = []
    text = json.dumps(spec)
    check(texts, word_bpe.WordBpe(text), Tokenizer.from_str(text))


def test_stored_ids_are_decoded(spark):
    df = spark.createDataFrame([(1, "Hello wide world"), (2, None), (None, "x")], "doc_id long, text string")
    encoded = word_bpe.encode_documents(df)
    want = {i: LIBRARY.encode(t or "", add_special_tokens=False).ids for i, t in ((1, "Hello wide world"), (2, None), (None, "x"))}
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    odd = spark.createDataFrame([(5, None), (6, [want[1][0], None, -4, 10**6, want[1][1]])], "doc_id long, ids array<int>")
    texts = {r.doc_id: r.text for r in word_bpe.decode_documents(encoded.unionByName(odd)).collect()}
    assert texts == {i: LIBRARY.decode(x, skip_special_tokens=False) for i, x in want.items()} | {5: "", 6: LIBRARY.decode(want[1][:2], skip_special_tokens=False)}


def test_report(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(AWKWARD)] + [(None, "a b", "x", 1), (1, "again", "x", 1), (1, "again", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, pieces int").repartition(3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    got = word_bpe.round_trip_report(df)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert word_bpe.round_trip_report(df.limit(0)).count() == 0


@pytest.mark.parametrize("remembered", [1 << 19, 50])
def test_documents_of_the_tables(spark, sf_dir, remembered, monkeypatch):
    docs = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    own = word_bpe.WordBpe(SPEC)
    monkeypatch.setattr(word_bpe, "REMEMBERED", remembered)
    for k in range(0, len(docs), 40):
        check(docs[k : k + 40], own)
