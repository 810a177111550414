"""Substring dedup of bytes by suffix arrays of shards, sorted by external induction.

The places where induced sorting cuts a text (an S-type byte behind an L-type one) are
told by a few bytes, so equal windows are cut alike. The cut of least rank inside a window
is its anchor; neighbouring windows of one anchor are one slice of the text. Slices of
different content whose anchors look alike meet in a shard, whose suffix array tells for
every window of every slice the smallest document that has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequoria.llm import induced, repeats
from sequoria.llm import textgrid as g
from sequoria.llm.shared import written

WINDOW = 50
#: Bytes from an anchor on that its symbol stands for.
ANCHOR = 24
#: Bytes of slices in a shard on average, and of the largest symbol that a shard takes (its queues wait on disk by then). A
#: symbol with more of them is compared by whole windows, which Spark spreads.
SHARD_BYTES, SYMBOL_BYTES = 2 << 20, 8 << 20
_NONE = np.uint64(2**64 - 1)


def _anchors(data: np.ndarray) -> np.ndarray:
    """Places of S-type bytes behind an L-type one, as far as the ANCHOR bytes from there tell."""
    at = np.flatnonzero(data[1:] < data[:-1]) + 1
    kept, k = [], 1
    while len(at) and k < ANCHOR:
        at = at[at + k < len(data)]
        later, own = data[at + k], data[at]
        kept.append(at[later > own])
        at, k = at[later == own], k + 1
    return np.sort(np.concatenate(kept)) if kept else at


def parse(data: np.ndarray, offsets: np.ndarray) -> repeats.Parsed:
    n = len(data)
    values = g.BYTE_CODES[data]
    prefix = g.prefix_hash(values)
    at = _anchors(data)
    at = at[at + ANCHOR <= n]
    bits = np.uint64(max(1, n.bit_length()))
    rank = np.full(n + WINDOW, _NONE)
    rank[at] = (g.mix(g.span_hash(prefix, at, at + ANCHOR), 11) >> bits << bits) | at.astype(np.uint64)
    # a window at s holds the bytes of anchors s + 1 .. s + WINDOW - ANCHOR and the byte before
    reach = WINDOW - ANCHOR
    least, width = rank[1:], 1
    while 2 * width <= reach:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < reach:
        least = np.minimum(least[: -(reach - width)], least[reach - width :])
    least = least[:n]
    edge = np.zeros(n + 1, dtype=np.int8)
    full = np.diff(offsets) > 0
    begin, end = offsets[:-1][full], offsets[1:][full]
    edge[np.maximum(end - WINDOW + 1, begin)] += 1
    edge[end] -= 1
    inside = np.cumsum(edge[:n], dtype=np.int8) == 0
    first = inside.copy()
    first[1:] &= ~((least[1:] == least[:-1]) & (least[1:] != _NONE) & inside[:-1])
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    own = least[first]
    place = (own & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    content = g.mix(g.span_hash(prefix, first, last + WINDOW), 12)
    symbol = g.mix(content, 14)
    has = np.flatnonzero(own != _NONE)
    symbol[has] = g.mix(g.span_hash(prefix, place[has], place[has] + ANCHOR), 13)
    return repeats.Parsed(offsets, values, np.searchsorted(offsets, first, side="right") - 1, first, last, symbol, content)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, symbol, content, slice) of the groups to look at."""
    for part, parsed, data, _ in repeats._chunks(batches, parse):
        k = repeats._once(parsed, parsed.symbol, parsed.content)
        k = k[repeats._listed(part, parsed, "expand", k, parsed.content)]
        size = parsed.last[k] + WINDOW - parsed.first[k]
        at = np.concatenate([[0], np.cumsum(size)])
        bytes_at = np.arange(at[-1]) - np.repeat(at[:-1] - parsed.first[k], size)
        slices = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[bytes_at])])
        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(parsed.text[k])), repeats._signed(parsed.symbol[k]), repeats._signed(parsed.content[k]), slices], ["doc_id", "symbol", "content", "slice"])


def _seen_earlier(text: np.ndarray, begin: np.ndarray, document: np.ndarray, room: induced.Room) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slice, offset) of the windows that a smaller document has too; ``begin``: the first place of each slice and the end."""
    rest = None
    for place, common in (*induced.suffixes(text, 257, WINDOW, room), (None, None)):
        if place is not None:
            of = np.searchsorted(begin, place, side="right") - 1
            new = np.asarray(common) < WINDOW
            if rest is not None:
                place, of, new = (np.concatenate(x) for x in zip(rest, (place, of, new)))
            cut = len(place) - 1 - int(np.argmax(new[::-1])) if new.any() else 0
            rest = place[cut:], of[cut:], new[cut:]
            place, of, new = place[:cut], of[:cut], new[:cut]
        else:
            place, of, new = rest
        if len(place):
            group = np.flatnonzero(new) if new[0] else np.concatenate([[0], np.flatnonzero(new)])
            least = np.repeat(np.minimum.reduceat(document[of], group), np.diff(np.append(group, len(place))))
            later = (document[of] > least) & (place + WINDOW < begin[of + 1])
            yield of[later], place[later] - begin[of[later]]


def _judged(batches: Iterator[pa.RecordBatch], room: induced.Room = induced.Room()) -> Iterator[pa.RecordBatch]:
    """A shard's slices as (doc_id, symbol, content, offset) of the windows that a smaller document has too."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    sizes = np.array([len(x.as_buffer()) for x in table.column("slice")])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = room.array(int(begin[-1]), np.uint16)
    at = 0
    for x in table.column("slice"):
        raw = np.frombuffer(x.as_buffer(), np.uint8)
        text[at : at + len(raw)] = raw
        text[at : at + len(raw)] += 1
        text[at + len(raw)] = 0
        at += len(raw) + 1
    names = table.select(["doc_id", "symbol", "content"]).combine_chunks()
    document = np.unique(names.column("doc_id").to_numpy(), return_inverse=True)[1]
    for of, offset in _seen_earlier(text, begin, document, room):
        rows = names.take(pa.array(of)).append_column("offset", pa.array(offset, pa.int64()))
        yield from rows.combine_chunks().to_batches()


def _by_suffix_arrays(wanted: DataFrame) -> DataFrame:
    """(doc_id, windows): the windows of the slices to look at that a smaller document has too."""
    kind = repeats._typed(wanted, "symbol long, content long")
    slices = written(wanted.mapInArrow(_slices, f"{kind}, slice binary"))
    by_symbol = slices.groupBy("symbol").agg(F.sum(F.octet_length("slice")).alias("size"))
    total = by_symbol.agg(F.sum("size")).first()[0] or 0
    # few, and told by size alone
    hot = by_symbol.filter(F.col("size") > SYMBOL_BYTES).select("symbol")
    spark = wanted.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    found = slices.join(hot, "symbol", "left_anti").repartition(shards, "symbol").select("doc_id", "symbol", "content", "slice").mapInArrow(_judged, f"{kind}, offset long")
    windows = slices.join(hot, "symbol").select("doc_id", "symbol", "content", "slice", F.explode(F.sequence(F.lit(0), F.octet_length("slice") - WINDOW)).alias("offset"))
    windows = windows.select("doc_id", "symbol", "content", F.col("offset").cast("long").alias("offset"), F.substring("slice", F.col("offset") + 1, F.lit(WINDOW)).alias("window"))
    least = windows.groupBy("symbol", "window").agg(F.min("doc_id").alias("least"))
    found = found.unionByName(windows.join(least, ["symbol", "window"]).filter("doc_id > least").select("doc_id", "symbol", "content", "offset"))
    return written(found.groupBy("doc_id").agg(F.collect_list(F.struct("symbol", "content", "offset")).alias("windows")))


def _names(parsed: repeats.Parsed, group: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    return {"symbol": parsed.symbol[group], "content": parsed.content[group], "offset": (at - parsed.first[group]).astype(np.uint64)}


def _with_instructions(docs: DataFrame) -> DataFrame:
    return repeats.with_instructions(docs, parse, WINDOW, True, _by_suffix_arrays)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets, parsed, gone in repeats.judged_chunks(batches, parse, WINDOW, _names):
        gone = np.zeros(len(data), dtype=bool) if parsed is None else gone
        begin, _, per_text = g.runs_of(gone, offsets)
        digests = [hashlib.sha256((data[a:b][~gone[a:b]] if n else data[a:b]).tobytes()).hexdigest() for a, b, n in zip(offsets.tolist(), offsets[1:].tolist(), np.diff(per_text).tolist())]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(g.sums(gone, offsets)), pa.array(np.diff(per_text)), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets, parsed, gone in repeats.judged_chunks(batches, parse, WINDOW, _names):
        gone = np.zeros(len(data), dtype=bool) if parsed is None else gone
        texts = [data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def substring_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs`` (doc_id, text).

    A byte goes if a WINDOW of bytes over it also starts in a document with a smaller
    doc_id. Null and empty texts have no bytes; texts shorter than a window lose none. Rows
    with one doc_id don't act on each other; rows with a null doc_id lose nothing and take
    nothing. Other columns are left out.
    """
    return _with_instructions(docs).mapInArrow(_report, repeats._typed(docs, "n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def remove_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the bytes that stay; characters that lost a byte go. See ``substring_report``."""
    return _with_instructions(docs).mapInArrow(_cleaned, repeats._typed(docs, "text string"))


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS gram FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM d)),
first AS (SELECT md5_number(gram) AS k, min(doc_id) AS least FROM g GROUP BY k),
again AS (SELECT doc_id, i FROM g JOIN first ON md5_number(gram) = k WHERE least < doc_id),
bytes AS (SELECT doc_id, i, substr(h, 2 * i - 1, 2) AS byte FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM d)),
marked AS (SELECT doc_id, i, byte, max(CASE WHEN a.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS 49 PRECEDING) AS gone FROM bytes LEFT JOIN again a USING (doc_id, i)),
runs AS (SELECT doc_id, i, byte, gone, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS begins FROM marked),
sums AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, sum(begins)::BIGINT AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (gone = 0), '') AS kept FROM runs GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id)
"""
