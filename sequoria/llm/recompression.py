"""Substring dedup of words by recompression.

Rounds replace runs of a symbol and then pairs of neighbours by new symbols. A name is a
hash of what it stands for, and whether two neighbours pair up depends on them alone (one
bit of each name), so every round names equal substrings alike in all documents. Each
symbol also carries its context: the words that its making depended on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sequoria.llm import repeats
from sequoria.llm import textgrid as g

WINDOW = 50
PAIR_ROUNDS = 5


def _merge_runs(symbol, begin, end, c0, c1, text, edge0, edge1):
    """Name maximal runs; single symbols stay. All depend on both neighbours."""
    new = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(symbol)]]) - 1
    size = (last - first + 1).astype(np.uint64)
    names = np.where(size > 1, g.mix(symbol[first] ^ g.mix(size, 31), 32), symbol[first])
    of = text[first]
    same = of[1:] == of[:-1]
    left, right = edge0[of], edge1[of]
    left[1:] = np.where(same, c0[first[:-1]], left[1:])
    right[:-1] = np.where(same, c1[last[1:]], right[:-1])
    return names, begin[first], end[last], left, right, of


def _merge_pairs(symbol, begin, end, c0, c1, text, edge0, edge1, level):
    """Pair a left-class symbol with a right-class one behind it; the others depend on the neighbour that they might have paired with."""
    n = len(symbol)
    is_left = (g.mix(symbol, 40 + level) & np.uint64(1)).astype(bool)
    next_same = np.zeros(n, dtype=bool)
    next_same[:-1] = text[1:] == text[:-1]
    pair = np.zeros(n, dtype=bool)
    pair[:-1] = is_left[:-1] & ~is_left[1:] & next_same[:-1]
    second = np.zeros(n, dtype=bool)
    second[1:] = pair[:-1]
    after = np.minimum(np.arange(n) + 1, n - 1)
    before = np.maximum(np.arange(n) - 1, 0)
    previous_same = np.zeros(n, dtype=bool)
    previous_same[1:] = next_same[:-1]
    right = np.where(pair, c1[after], np.where(is_left, np.where(next_same, c1[after], edge1[text]), c1))
    left = np.where(pair | is_left, c0, np.where(previous_same, c0[before], edge0[text]))
    names = np.where(pair, g.mix(symbol ^ g.mix(symbol[after], 50 + level), 60 + level), symbol)
    keep = ~second
    return names[keep], begin[keep], np.where(pair, end[after], end)[keep], left[keep], right[keep], text[keep]


def parse(data: np.ndarray, offsets: np.ndarray) -> repeats.Parsed:
    begin, end, per_text = g.runs_of(g.WORD_BYTE[data], offsets)
    words = g.mix(g.span_hash(g.prefix_hash(g.BYTE_CODES[data]), begin, end))
    return parse_units(words, per_text)


def parse_units(words: np.ndarray, per_text: np.ndarray, rounds: int = PAIR_ROUNDS, size: int = WINDOW) -> repeats.Parsed:
    text = np.repeat(np.arange(len(per_text) - 1), np.diff(per_text))
    at = np.arange(len(words))
    # what depends on the end of a text has a context beyond it, and is no anchor
    edge0, edge1 = per_text[:-1] - 1, per_text[1:] + 1
    state = words, at, at + 1, at, at + 1, text
    if len(words):
        state = _merge_runs(*state, edge0, edge1)
        for level in range(rounds):
            state = _merge_pairs(*state, edge0, edge1, level)
    symbol, _, _, c0, c1, _ = state
    return repeats.grouped(per_text, words, size, symbol, c0, c1)


def _kept_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, list[bytes]]]]]:
    """Chunks with (number of words, words that stay) of each text."""
    for part, _, _, parsed, gone in repeats.judged_chunks(batches, parse, WINDOW):
        texts = [(text.as_py() or "").encode().split() for text in part.column("text")]
        if parsed is None:
            yield part, [(len(words), words) for words in texts]
        else:
            places = zip(texts, parsed.offsets.tolist(), parsed.offsets[1:].tolist())
            yield part, [(len(words), [w for w, drop in zip(words, gone[a:b].tolist()) if not drop]) for words, a, b in places]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in _kept_words(batches):
        removed = pa.array([n - len(words) for n, words in texts], pa.int64())
        digests = pa.array([hashlib.sha256(b" ".join(words)).hexdigest() for _, words in texts], pa.string())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in texts], pa.int64()), removed, digests], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in _kept_words(batches):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([b" ".join(words).decode() for _, words in texts], pa.string())], ["doc_id", "text"])


def repeat_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs`` (doc_id, text).

    A word goes if a window of WINDOW words over it also starts in a document with a
    smaller doc_id. Null and empty texts have no words; texts shorter than a window lose
    none. Rows with one doc_id don't act on each other; rows with a null doc_id lose
    nothing and take nothing. Other columns are left out.
    """
    return repeats.with_instructions(docs, parse, WINDOW, prefilter=False).mapInArrow(_report, repeats._typed(docs, "n_words long, n_removed long, kept_sha256 string"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the words that stay, joined by one space; see ``repeat_report``."""
    return repeats.with_instructions(docs, parse, WINDOW, prefilter=False).mapInArrow(_cleaned, repeats._typed(docs, "text string"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
again AS (SELECT doc_id, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY gram) < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
marked AS (SELECT doc_id, i, word, max(CASE WHEN a.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS 49 PRECEDING) AS gone FROM words LEFT JOIN again a USING (doc_id, i)),
sums AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id)
"""
