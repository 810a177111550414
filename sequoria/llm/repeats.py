"""Removal of passages that also begin in a document with a smaller id: the Spark plan.

A parser gives every window of a text an anchor, a symbol inside it that depends on the
window's content alone, so equal windows have equal anchors. Neighbouring windows with
the same anchor form a group. Groups are compared by (symbol, hash of their content):

* of equal groups all but the one in the smallest document are covered whole;
* a symbol with different groups is looked at window by window, one document for each
  different group.

So no pair of documents is ever formed, a passage that any number of documents share
costs one row for each of them, and what is gathered by document is bounded by its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequoria.llm import textgrid as g
from sequoria.llm.shared import dropped, in_common, written


@dataclass
class Parsed:
    """A chunk's units (words or bytes) and the groups of its windows.

    ``offsets``: first unit of each text; ``values``: a hash of each unit; of group k the
    windows first[k]..last[k] start at these units, and ``text``, ``symbol``, ``content``
    tell its text, anchor and content hash.
    """

    offsets: np.ndarray
    values: np.ndarray
    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    symbol: np.ndarray
    content: np.ndarray


Parser = Callable[[np.ndarray, np.ndarray], Parsed]
#: Text that is parsed at once, in bytes; a parse takes some hundred times as much memory.
CHUNK_BYTES = 1 << 18


def grouped(offsets: np.ndarray, values: np.ndarray, size: int, symbol: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Parsed:
    """Groups from symbols whose content and context lie in units begin..end (both never falling).

    The anchor of a window is the symbol of least rank, the leftmost of equal ones, with
    its context inside the window. It is told by that context, which fewer texts share by
    chance than the symbol. A window without one is its own anchor.
    """
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][text]
    prefix = g.prefix_hash(values)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Parsed(offsets, values, none, none, none, none.view(np.uint64), none.view(np.uint64))
    lo = np.searchsorted(begin, at)
    hi = np.searchsorted(end, at + size, side="right")
    anchor = np.full(len(at), -1, dtype=np.int64)
    some = hi > lo
    if some.any():
        bits = np.uint64(max(1, int(len(symbol)).bit_length()))
        ranks = (g.mix(symbol, 11) >> bits << bits) | np.arange(len(symbol), dtype=np.uint64)
        least = [ranks]
        while 2 << len(least) - 1 <= size:
            half = 1 << len(least) - 1
            least.append(np.minimum(least[-1][:-half], least[-1][half:]) if len(least[-1]) > half else least[-1][:0])
        a, b = lo[some], hi[some]
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        best = np.empty(len(a), dtype=np.uint64)
        for k in np.unique(level):
            m = level == k
            best[m] = np.minimum(least[k][a[m]], least[k][b[m] - (1 << int(k))])
        anchor[some] = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (anchor[1:] < 0) | (text[1:] != text[:-1])])
    first_at = np.flatnonzero(new)
    last_at = np.concatenate([first_at[1:], [len(at)]]) - 1
    first, last, own = at[first_at], at[last_at], anchor[first_at]
    content = g.mix(g.span_hash(prefix, first, last + size), 12)
    names = g.mix(content, 14)
    has = np.flatnonzero(own >= 0)
    names[has] = g.mix(g.span_hash(prefix, begin[own[has]], end[own[has]]), 13)
    return Parsed(offsets, values, text[first_at], first, last, names, content)


def _once(parsed: Parsed, *columns: np.ndarray) -> np.ndarray:
    """Indices of the groups that differ in text and columns."""
    key = g.mix(parsed.text.astype(np.uint64), 15)
    for c in columns:
        key = g.mix(key ^ c, 16)
    return np.unique(key, return_index=True)[1]


def _chunks(batches: Iterator[pa.RecordBatch], parse: Parser) -> Iterator[tuple[pa.RecordBatch, Parsed, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in g.chunks(batch, limit=CHUNK_BYTES):
            data, offsets = g.texts_of(part.column("text"))
            yield part, parse(data, offsets), data, offsets


def judged_chunks(batches: Iterator[pa.RecordBatch], parse: Parser, size: int, names: Callable[..., dict[str, np.ndarray]] | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Parsed | None, np.ndarray | None]]:
    """Chunks as (rows, bytes, offsets, parsed, units that go); texts that lose nothing come apart and are not parsed."""
    for batch in batches:
        loses = np.zeros(batch.num_rows, dtype=bool)
        for column in ("cover", "windows"):
            loses |= pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) > 0
        for rows in (loses, ~loses):
            for part in g.chunks(batch.filter(pa.array(rows)), limit=CHUNK_BYTES):
                data, offsets = g.texts_of(part.column("text"))
                parsed = parse(data, offsets) if rows is loses else None
                yield part, data, offsets, parsed, parsed and removed_units(part, parsed, size, names)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _symbols(batches, parse):
    for part, parsed, _, _ in _chunks(batches, parse):
        k = _once(parsed, parsed.symbol)
        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(parsed.text[k])), _signed(parsed.symbol[k])], ["doc_id", "symbol"])


def _groups(batches, parse):
    for part, parsed, _, _ in _chunks(batches, parse):
        k = _once(parsed, parsed.symbol, parsed.content)
        if "symbols" in part.schema.names:
            k = k[_listed(part, parsed, "symbols", k)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(parsed.text[k])), _signed(parsed.symbol[k]), _signed(parsed.content[k])], ["doc_id", "symbol", "content"])


def _pairs_of(part: pa.RecordBatch, column: str, fields: tuple[str, ...]) -> np.ndarray:
    """One number for each (row, fields...) of a list column, sorted."""
    lists = part.column(column)
    flat = lists.flatten()
    sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(lists)), np.where(np.asarray(lists.is_valid()), sizes, 0)).astype(np.uint64)
    values = [flat.field(f) for f in fields] if fields else [flat]
    key = g.mix(row, 15)
    for v in values:
        key = g.mix(key ^ v.to_numpy(zero_copy_only=False).view(np.uint64), 16)
    return np.sort(key)


def _member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


def _listed(part, parsed, column, k, *more) -> np.ndarray:
    key = g.mix(parsed.text[k].astype(np.uint64), 15)
    for c in (parsed.symbol, *more):
        key = g.mix(key ^ c[k], 16)
    return _member(_pairs_of(part, column, ("symbol", "content")[: 1 + len(more)] if more else ()), key)


def _window_hashes(parsed: Parsed, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    one, two = g.prefix_hash(parsed.values), g.prefix_hash(g.mix(parsed.values, 21))
    return g.mix(g.span_hash(one, starts, starts + size), 22), g.mix(g.span_hash(two, starts, starts + size), 23)


def _starts(parsed: Parsed, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, unit) of every window of groups k."""
    n = parsed.last[k] - parsed.first[k] + 1
    group = np.repeat(k, n)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n) + parsed.first[group]


def _hash_names(size: int, parsed: Parsed, group: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    return dict(zip(("w1", "w2"), _window_hashes(parsed, at, size)))


def _windows(batches, parse, size):
    """(doc_id, w1, w2) of the windows of the groups to expand."""
    for part, parsed, _, _ in _chunks(batches, parse):
        k = _once(parsed, parsed.symbol, parsed.content)
        k = k[_listed(part, parsed, "expand", k, parsed.content)]
        group, starts = _starts(parsed, k)
        w1, w2 = _window_hashes(parsed, starts, size)
        rows = np.unique(g.mix(g.mix(parsed.text[group].astype(np.uint64), 15) ^ w1, 16) ^ w2, return_index=True)[1]
        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(parsed.text[group[rows]])), _signed(w1[rows]), _signed(w2[rows])], ["doc_id", "w1", "w2"])


def removed_units(part: pa.RecordBatch, parsed: Parsed, size: int, names: Callable[..., dict[str, np.ndarray]] | None = None) -> np.ndarray:
    """For each unit of a chunk whether it goes; the chunk has the lists cover, expand and windows.

    ``names``: what ``windows`` calls the windows at units ``at`` of groups ``group``.
    """
    every = np.arange(len(parsed.text))
    starts = _starts(parsed, np.flatnonzero(_listed(part, parsed, "cover", every, parsed.content)))[1]
    group, at = _starts(parsed, np.flatnonzero(_listed(part, parsed, "expand", every, parsed.content)))
    if len(at):
        named = (names or partial(_hash_names, size))(parsed, group, at)
        key = g.mix(parsed.text[group].astype(np.uint64), 15)
        for x in named.values():
            key = g.mix(key ^ x, 16)
        starts = np.concatenate([starts, at[_member(_pairs_of(part, "windows", tuple(named)), key)]])
    return g.covered(starts, size, len(parsed.values))


def _typed(docs: DataFrame, rest: str) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {rest}"


def _by_window_hashes(wanted: DataFrame, parse: Parser, size: int) -> DataFrame:
    """(doc_id, windows): hashes of the windows of the groups to look at that a smaller document has too."""
    windows = written(wanted.mapInArrow(partial(_windows, parse=parse, size=size), _typed(wanted, "w1 long, w2 long")))
    again = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("w1", "w2", "least")
    return windows.join(again, ["w1", "w2"]).filter("doc_id > least").groupBy("doc_id").agg(F.collect_list(F.struct("w1", "w2")).alias("windows"))


def with_instructions(docs: DataFrame, parse: Parser, size: int, prefilter: bool, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``docs`` (doc_id, text) with the lists ``cover``, ``expand`` (symbol, content) and ``windows``.

    ``judge`` makes (doc_id, windows) of (doc_id, text, expand); by default from window hashes.
    With ``prefilter`` symbols that only one document has are sorted out by themselves
    before groups are compared, which pays where symbols are many.
    """
    source = docs.filter("doc_id IS NOT NULL AND octet_length(text) >= 50")
    if prefilter:
        named = source.mapInArrow(partial(_symbols, parse=parse), _typed(docs, "symbol long"))
        lists = written(in_common(named, "symbol", "doc_id").groupBy("doc_id").agg(F.collect_list("symbol").alias("symbols")))
        source = source.join(lists, "doc_id")
    groups = written(source.mapInArrow(partial(_groups, parse=parse), _typed(docs, "symbol long, content long")))
    # first by (symbol, content), then by symbol: a passage of any number of documents is one row by then; each step is
    # written, so that the shuffle files of one are on disk at a time
    classes = written(groups.groupBy("symbol", "content").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")))
    dealt = classes.repartition("symbol")
    symbols = dealt.groupBy("symbol").agg(F.min("least").alias("s_least"), F.max("most").alias("s_most"), F.count("*").alias("contents")).filter("s_least < s_most")
    useful = written(dealt.join(symbols.hint("shuffle_hash"), "symbol").filter("contents > 1 OR least < most").select("symbol", "content", "least", (F.col("contents") > 1).alias("several")))
    dropped(classes)
    told = groups.join(useful, ["symbol", "content"]).filter("doc_id > least OR several")
    pair = F.struct("symbol", "content")
    lists = written(told.groupBy("doc_id").agg(F.collect_list(F.when(F.col("doc_id") > F.col("least"), pair)).alias("cover"), F.collect_list(F.when(F.col("doc_id") == F.col("least"), pair)).alias("expand")))
    dropped(groups, useful)
    wanted = source.select("doc_id", "text").join(lists.filter(F.size("expand") > 0).select("doc_id", "expand"), "doc_id")
    later = (judge or partial(_by_window_hashes, parse=parse, size=size))(wanted)
    return docs.select("doc_id", "text").join(lists.join(later, "doc_id", "left"), "doc_id", "left")
