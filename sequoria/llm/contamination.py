"""Benchmark decontamination: one Aho-Corasick automaton over normalised test texts.

Texts are normalised to words with one space before and after each; a pattern is a window
of item words with its spaces, so a match is a match of whole words. The automaton reads a
text once; the ends of its matches are mapped back to word numbers of the text.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sequoria.llm.shared import written

WINDOW = 13
#: A document is contaminated if hit words are at least 1 in this many.
HIT_SHARE = 20
#: Characters of patterns in one broadcast automaton (some 60 bytes of memory each).
MAX_PATTERN_CHARS = 4_000_000

#: A-Z to a-z, other ASCII that is neither digit nor letter to a space; bytes from 0x80 stay.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def normalise(text: str | None) -> tuple[str, int]:
    """(words with a space before and after each, their number); one character for each byte of UTF-8."""
    words = (text or "").encode("utf-8").translate(_NORMAL).split(b" ")
    words = [w for w in words if w]
    return f" {b' '.join(words).decode('latin-1')} ", len(words)


def windows(text: str | None) -> Iterator[str]:
    """The patterns of one item; a short item is one pattern, an item without words none."""
    words = normalise(text)[0].split(" ")[1:-1]
    for k in range(max(1, len(words) - WINDOW + 1) if words != [""] else 0):
        yield f" {' '.join(words[k : k + WINDOW])} "


def patterns_of(items: DataFrame) -> DataFrame:
    """(pattern, ids of its items) of every different window of ``items``, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(batch.column(c).to_pylist() for c in ("item", "text"))):
                found = list(dict.fromkeys(windows(text)))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.string())], ["item", "pattern"])

    each = items.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "item string, pattern string")
    return written(each.groupBy("pattern").agg(F.collect_set("item").alias("ids")))


def pattern_parts(patterns: DataFrame, most: int) -> Iterator[dict[str, list[str]]]:
    """{pattern: ids of its items}, in parts of at most ``most`` characters (or one pattern)."""
    part: dict[str, list[str]] = {}
    size = 0
    for pattern, ids in patterns.toLocalIterator():
        if part and size + len(pattern) > most:
            yield part
            part, size = {}, 0
        size += len(pattern)
        part[pattern] = ids
    yield part


#: The automaton that this Python worker built last, by the name of its part.
_latest: dict[str, ahocorasick.Automaton] = {}


def automaton(name: str, patterns: dict[str, list[str]]) -> ahocorasick.Automaton:
    if name not in _latest:
        _latest.clear()
        found = ahocorasick.Automaton()
        for pattern, ids in patterns.items():
            found.add_word(pattern, (pattern.count(" ") - 1, ids))
        if patterns:
            found.make_automaton()
        _latest[name] = found
    return _latest[name]


def scan(text: str, found: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """(ranges of words hit, ids of the items found) in a normalised text."""
    hit, ids, word, at = [], set(), -1, 0
    for end, (length, items) in found.iter(text) if len(found) else ():
        word, at = word + text.count(" ", at, end + 1), end + 1
        hit.append((word - length, word))
        ids.update(items)
    return hit, ids


def union_size(ranges: list[tuple[int, int]]) -> int:
    total, last = 0, 0
    for a, b in sorted(ranges):
        total += max(0, b - max(a, last))
        last = max(last, b)
    return total


def spans_of(text: str | None, ranges: list[tuple[int, int]]) -> str:
    """begin:end of the maximal runs of hit words in the original text, in code points, joined by commas."""
    if not ranges:
        return ""
    raw = (text or "").encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    runs: list[list[int]] = []
    for a, b in sorted(ranges):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    out, at, chars = [], 0, 0
    for edge in (x for a, b in runs for x in (places[a][0], places[b - 1][1])):
        chars, at = chars + len(raw[at:edge].decode()), edge
        out.append(chars)
    return ",".join(f"{a}:{b}" for a, b in zip(out[::2], out[1::2]))


def is_contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and HIT_SHARE * n_hit >= n_words


#: (n_words, n_hit, ids of the items found, spans)
Judged = tuple[int, int, list[str], str]


def _verdicts(docs: DataFrame, table: DataFrame, most: int) -> Callable[[str | None], Judged] | None:
    """A function for tasks: text -> what is judged of it; None if the patterns need several automata."""
    n, size = table.agg(F.count("*"), F.sum(F.length("pattern"))).first()
    if n > 1 and size > most:
        return None
    first = next(pattern_parts(table, size or 0))
    patterns, name = docs.sparkSession.sparkContext.broadcast(first), uuid.uuid4().hex

    def judge(text: str | None) -> Judged:
        normal, n = normalise(text)
        hit, ids = scan(normal, automaton(name, patterns.value))
        return n, union_size(hit), sorted(ids), spans_of(text, hit)

    return judge


_REPORT = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("spans", T.StringType())]


def _rows(key: pa.Array, judged: list[Judged]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            key,
            pa.array([n for n, *_ in judged], pa.int64()),
            pa.array([h for _, h, *_ in judged], pa.int64()),
            pa.array([len(ids) for _, _, ids, _ in judged], pa.int64()),
            pa.array([hashlib.sha256(",".join(ids).encode()).hexdigest() for _, _, ids, _ in judged], pa.string()),
            pa.array([is_contaminated(n, h) for n, h, *_ in judged], pa.bool_()),
            pa.array([spans for *_, spans in judged], pa.string()),
        ],
        ["doc_id", *(c for c, _ in _REPORT)],
    )


def contamination_report(docs: DataFrame, items: DataFrame, most: int = MAX_PATTERN_CHARS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), judged against ``items`` (item_id, text).

    ``spans`` has the places of the hit words in the original text (code points, end exclusive).

    Null and empty texts have no words and no hits; an item without words matches nothing,
    an item without an id marks words but is not listed. Other columns are ignored, repeated
    rows give repeated rows, empty tables an empty result or no hits. Up to ``most``
    characters of patterns go into one broadcast automaton and the report is one narrow
    stage; beyond that each bounded part is scanned in turn and the hits of a text, which
    are few, are gathered by the text; copies of a text are scanned once.
    """
    table = patterns_of(items)
    judge = _verdicts(docs, table, most)
    if judge is None:
        return _report_in_parts(docs, table, most)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(*c) for c in _REPORT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows(batch.column("doc_id"), [judge(x.as_py()) for x in batch.column("text")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, most: int = MAX_PATTERN_CHARS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; see ``contamination_report``."""
    table = patterns_of(items)
    judge = _verdicts(docs, table, most)
    if judge is None:
        texts, merged = _hits_in_parts(docs, table, most)
        bad = _judged(texts.join(merged, "text_key").select(F.col("text_key").alias("doc_id"), "text", "hit", "ids")).filter("contaminated").select(F.col("doc_id").alias("_text_key"))
        return docs.withColumn("_text_key", _text_key()).join(bad, "_text_key", "left_anti").select(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not is_contaminated(n, h) for n, h, *_ in (judge(x.as_py()) for x in batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _text_key() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _hits_in_parts(docs: DataFrame, table: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(text_key, text) of every different text, and (text_key, hit, ids) of those with hits; a text has one row for each part."""
    texts = written(docs.select(_text_key().alias("text_key"), "text").dropDuplicates(["text_key"]))
    hit_type = "array<struct<a:long,b:long>>"
    parts = None
    for patterns in pattern_parts(table, most):
        found = texts.mapInArrow(_part_scanner(docs.sparkSession.sparkContext.broadcast(patterns), uuid.uuid4().hex), f"text_key string, hit {hit_type}, ids array<string>")
        parts = found if parts is None else parts.unionByName(found)
    merged = parts.groupBy("text_key").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    return texts, merged


def _report_in_parts(docs: DataFrame, table: DataFrame, most: int) -> DataFrame:
    _, merged = _hits_in_parts(docs, table, most)
    return _judged(docs.select("doc_id", _text_key().alias("text_key"), "text").join(merged, "text_key", "left").select("doc_id", "text", "hit", "ids"))


def _judged(joined: DataFrame) -> DataFrame:
    """The report of rows (doc_id, text, hit, ids)."""
    schema = T.StructType([T.StructField("doc_id", joined.schema["doc_id"].dataType), *(T.StructField(*c) for c in _REPORT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hits, ids = (batch.column(c).to_pylist() for c in ("text", "hit", "ids"))
            ranges = [[(x["a"], x["b"]) for x in h or ()] for h in hits]
            yield _rows(batch.column("doc_id"), [(normalise(t)[1], union_size(r), sorted(i or ()), spans_of(t, r)) for t, r, i in zip(texts, ranges, ids)])

    return joined.mapInArrow(run, schema)


def _part_scanner(patterns, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = automaton(name, patterns.value)
            hits = [(k, *scan(normalise(t.as_py())[0], found)) for k, t in zip(batch.column("text_key"), batch.column("text"))]
            hits = [x for x in hits if x[1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k.as_py() for k, _, _ in hits], pa.string()),
                    pa.array([[{"a": a, "b": b} for a, b in h] for _, h, _ in hits], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                    pa.array([sorted(i) for _, _, i in hits], pa.list_(pa.string())),
                ],
                ["text_key", "hit", "ids"],
            )

    return run


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS gram FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))),
h AS (SELECT doc_id, g.n, i, item FROM g JOIN p USING (gram) WHERE g.n = p.n),
places AS (SELECT DISTINCT doc_id, i + k AS place FROM h, (SELECT unnest(range(13)) AS k) WHERE k < h.n),
hit AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
runs AS (SELECT doc_id, min(place) AS a, max(place) AS b FROM (SELECT doc_id, place, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM places) GROUP BY doc_id, run),
-- lengths of what stands before each word, and of the words, up to a place of the original text
parts AS (SELECT doc_id, list_transform(regexp_extract_all(t, '([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)', 1), lambda x: length(x)) AS gap, list_transform(w, lambda x: length(x)) AS size FROM d SEMI JOIN hit USING (doc_id)),
marked AS (SELECT doc_id, string_agg(begin_ || ':' || end_, ',' ORDER BY begin_) AS spans FROM (
  SELECT doc_id, (list_sum(gap[1:a]) + coalesce(list_sum(size[1:a - 1]), 0))::BIGINT AS begin_, (list_sum(gap[1:b]) + list_sum(size[1:b]))::BIGINT AS end_ FROM runs JOIN parts USING (doc_id)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN marked USING (doc_id)
"""
