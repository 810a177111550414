"""Quality rules: how much of a text lies inside repeated n-grams and repeated lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sequoria.llm import textgrid as g

_SYMBOL = np.zeros(256, dtype=np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1
_LEAD = g.LEAD_BYTE.astype(np.uint8)
#: N-gram lengths, in words; 8 is the contract's window.
LENGTHS = (5, 8, 10)


@dataclass(frozen=True)
class Rules:
    """Limits in per cent. ``max_dup_chars`` has, for n words, the share of word characters in n-grams found twice."""

    min_words: int = 20
    max_repeat_words: int = 30
    max_dup_chars: tuple[tuple[int, int], ...] = ((5, 40), (10, 30))
    max_dup_line_chars: int = 50


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_chars_5", "dup_chars_8", "dup_chars_10", "dup_line_chars")


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every text of a chunk."""
    texts = len(offsets) - 1
    begin, end, per_text = g.runs_of(g.WORD_BYTE[data], offsets)
    text_of = np.repeat(np.arange(texts), np.diff(per_text))
    lead = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_LEAD[data], out=lead[1:])
    chars = lead[end] - lead[begin]
    prefix = g.prefix_hash(g.BYTE_CODES[data])
    words = g.mix(g.span_hash(prefix, begin, end))
    out = {"n_words": np.diff(per_text), "word_chars": g.sums(chars, per_text), "n_symbols": g.sums(_SYMBOL[data], offsets)}

    grams, salt = g.prefix_hash(words), g.mix(text_of.astype(np.uint64), 1)
    for n in LENGTHS:
        at = np.arange(max(0, len(words) - n + 1))
        at = at[text_of[at] == text_of[at + n - 1]] if len(at) else at
        hit = g.covered(at[g.repeated(g.mix(g.span_hash(grams, at, at + n), 2) ^ salt[at])], n, len(words))
        out[f"dup_chars_{n}"] = g.sums(np.where(hit, chars, 0), per_text)
        if n == 8:
            out["n_repeat_words"] = g.sums(hit, per_text)

    # lines that have a word: runs of bytes other than \n, without their line ends
    lines, stop, line_at = g.runs_of(data != 0x0A, offsets)
    first = np.searchsorted(begin, lines)
    last = np.searchsorted(begin, stop)
    full = last > first
    lines, stop, first, last = lines[full], stop[full], first[full], last[full]
    of = np.repeat(np.arange(texts), np.diff(line_at))[full]
    keys = g.mix(g.span_hash(prefix, lines, stop), 3) ^ g.mix(of.astype(np.uint64), 4)
    again = np.ones(len(keys), dtype=bool)
    again[np.unique(keys, return_index=True)[1]] = False
    total = np.concatenate([[0], np.cumsum(chars)])
    out["n_dup_lines"] = np.bincount(of[again], minlength=texts)
    out["dup_line_chars"] = np.bincount(of[again], weights=(total[last] - total[first])[again], minlength=texts).astype(np.int64)
    return out


def verdict(m: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of the measured texts."""
    failed = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_words * m["n_words"])
    kept = ~failed & (100 * m["dup_line_chars"] <= rules.max_dup_line_chars * m["word_chars"])
    for n, most in rules.max_dup_chars:
        kept &= 100 * m[f"dup_chars_{n}"] <= most * m["word_chars"]
    return failed, kept


def repetition_report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): counts, ``base_failed`` and ``kept``.

    A null or empty text has no words: all counts are 0 and it fails. Other columns are
    ignored, repeated rows give repeated rows, an empty table an empty one. One narrow
    Arrow stage, no shuffle; a long text is measured whole.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in g.chunks(batch):
                m = measures(*g.texts_of(part.column("text")))
                failed, kept = verdict(m, rules)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(m[c].astype(np.int64)) for c in COUNTS), pa.array(failed), pa.array(kept)], ["doc_id", *COUNTS, "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; see ``repetition_report`` for edge cases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in g.chunks(batch):
                yield part.filter(pa.array(verdict(measures(*g.texts_of(part.column("text"))), rules)[1]))

    return docs.mapInArrow(run, docs.schema)


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
sizes AS (SELECT unnest([5, 8, 10]) AS n),
grams AS (SELECT doc_id, n, i, list_slice(words, i, i + n - 1) AS gram FROM (SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM w, sizes)),
twice AS (SELECT doc_id, n, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, n, gram) > 1),
hit AS (SELECT DISTINCT doc_id, n, i + d AS pos FROM twice, (SELECT unnest(range(10)) AS d) WHERE d < n),
cover AS (SELECT h.doc_id, n, count(*) AS words, sum(length(w.words[pos])) AS chars FROM hit h JOIN w USING (doc_id) GROUP BY ALL),
lines AS (SELECT doc_id, i, line, list_aggregate(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: length(x)), 'sum') AS chars
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
again AS (SELECT doc_id, count(*) AS n, sum(chars) AS chars FROM (SELECT doc_id, chars FROM lines QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(list_aggregate(list_transform(w.words, lambda x: length(x)), 'sum'), 0)::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(a.n, 0)::BIGINT AS n_dup_lines,
        coalesce(c8.words, 0)::BIGINT AS n_repeat_words, coalesce(c5.chars, 0)::BIGINT AS dup_chars_5, coalesce(c8.chars, 0)::BIGINT AS dup_chars_8,
        coalesce(c10.chars, 0)::BIGINT AS dup_chars_10, coalesce(a.chars, 0)::BIGINT AS dup_line_chars
      FROM w LEFT JOIN again a ON a.doc_id = w.doc_id LEFT JOIN cover c5 ON c5.doc_id = w.doc_id AND c5.n = 5
      LEFT JOIN cover c8 ON c8.doc_id = w.doc_id AND c8.n = 8 LEFT JOIN cover c10 ON c10.doc_id = w.doc_id AND c10.n = 10)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * dup_line_chars <= 50 * word_chars AND 100 * dup_chars_5 <= 40 * word_chars AND 100 * dup_chars_10 <= 30 * word_chars AS kept
FROM m
"""
