"""Ranked lexical search: compressed postings by shard, merged document at a time.

A shard is a chunk of documents in doc_id order; each term's postings there are gaps of
document places and term frequencies as variable-length bytes. A query merges the postings
of its terms with a k-way heap, one document at a time, and keeps its best documents in a
bounded heap; terms that cannot lift a document into that heap on their own are only looked
up. The heaps of all tasks meet in one global ranking.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sequoria.llm.shared import written
from sequoria.llm.terms import CHUNK_BYTES, alphabet, gathered_chunks, split_terms

_TABLE = alphabet(digits=True)
#: Terms of queries (with repeats in different queries) that are answered in one pass and broadcast.
BLOCK_TERMS = 200_000
#: Scores are integers in units of 10^-9 of a weight.
UNIT = 1_000_000_000
_NO_ID = 1 << 63


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first byte of each value and the total): seven bits a byte, the last one below 128."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        sizes += values >= np.uint64(1 << bits)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(offsets[-1], np.uint8)
    for k in range(int(sizes.max(initial=0))):
        of = np.flatnonzero(sizes > k)
        low = (values[of] >> np.uint64(7 * k)) & np.uint64(127)
        out[offsets[of] + k] = low.astype(np.uint8) | np.where(sizes[of] > k + 1, 128, 0).astype(np.uint8)
    return out, offsets


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    shift = (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)).astype(np.uint64) * np.uint64(7)
    return np.add.reduceat((raw & np.uint8(127)).astype(np.uint64) << shift, starts).astype(np.int64)


@dataclass(frozen=True)
class Index:
    """``postings`` (shard, term, df, data, ids): a row for each term of a shard, and one without a term for its
    documents: their ids, and their numbers of terms as ``data``. ``n`` documents have terms, ``total`` in all."""

    postings: DataFrame
    shards: int
    n: int
    total: int


def build_index(docs: DataFrame, limit: int = CHUNK_BYTES) -> Index:
    """An index of every row of ``docs`` (doc_id, text), written to the shared folder in one narrow stage.

    Null and empty texts have no terms and are never found; a null doc_id comes after all
    others; repeated rows are documents of their own. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for part in gathered_chunks(batches, limit=limit):
            part = part.take(pc.sort_indices(part, sort_keys=[("doc_id", "ascending")], null_placement="at_end"))
            rows, codes, words = split_terms(part.column("text"), _TABLE)
            n = part.num_rows
            pairs, tf = np.unique(codes.astype(np.int64) * n + rows, return_counts=True)
            code, place = pairs // n, pairs % n
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
            gap = place.copy()
            gap[1:] -= place[:-1]
            gap[first] = place[first]
            both = np.empty(2 * len(gap), np.int64)
            both[::2], both[1::2] = gap, tf
            data, offsets = packed(both)
            lengths = np.bincount(rows, minlength=n)
            own, _ = packed(lengths)
            bounds = np.concatenate([offsets[2 * first], [len(data)]])
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data.tobytes())])
            df = np.diff(np.concatenate([first, [len(code)]]))
            none = pa.nulls(len(first), pa.list_(pa.int64()))
            term = words.cast(pa.string()).take(pa.array(code[first])) if len(first) else pa.array([], pa.string())
            yield _rows([shard], [None], [int((lengths > 0).sum())], [own.tobytes()], pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), int(lengths.sum()))
            for at in range(0, len(first), 1 << 15):
                cut = slice(at, min(at + (1 << 15), len(first)))
                yield _rows(np.full(cut.stop - at, shard), term[cut], df[cut], blobs[cut].cast(pa.binary()), none[cut], None)
            shard += 1

    postings = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "shard long, term string, df long, data binary, ids array<long>, terms long"))
    shards, n, total = postings.filter("term IS NULL").agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return Index(postings, shards, n, total)


def _rows(shard, term, df, data, ids: pa.Array, terms: int | None) -> pa.RecordBatch:
    n = len(shard)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(term, pa.string()) if isinstance(term, list) else term, pa.array(df, pa.int64()), pa.array(data, pa.binary()) if isinstance(data, list) else data, ids, pa.array([terms] * n, pa.int64())], ["shard", "term", "df", "data", "ids", "terms"])


def query_terms(items: DataFrame) -> DataFrame:
    """(query, item_id, term, times) of every different row of ``items`` (item_id, text), written; null texts have none."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = TaskContext.get().partitionId() << 32
        for part in gathered_chunks(batches):
            rows, codes, words = split_terms(part.column("text"), _TABLE)
            pairs, times = np.unique(rows * max(1, len(words)) + codes, return_counts=True)
            row, code = pairs // max(1, len(words)), pairs % max(1, len(words))
            yield pa.RecordBatch.from_arrays([pa.array(row + query), part.column("item_id").take(pa.array(row)), words.take(pa.array(code)).cast(pa.string()), pa.array(times, pa.int64())], ["query", "item_id", "term", "times"])
            query += part.num_rows

    return written(items.select("item_id", "text").distinct().mapInArrow(run, f"query long, item_id {kind}, term string, times long"))


#: What a task knows of a term in a shard: the highest of its impacts, the places of its documents, their impacts.
Postings = tuple[int, list[int], list[int]]


def merge(lists: list[Postings], ids: list[int], best: list[tuple[int, int]], k: int) -> None:
    """Puts the documents of a shard into ``best``, a heap of (score, minus id) with at most ``k`` entries.

    ``lists`` is in ascending order of highest impact. Documents are met in ascending order;
    lists before ``needed`` sum to less than the lowest score kept, so documents that only
    they hold are passed over, and they are searched for the others.
    """
    most, n, needed = [], len(lists), 0
    for upper, _, _ in lists:
        most.append(upper + (most[-1] if most else 0))
    floor = best[0][0] if len(best) == k else 0
    while needed < n and most[needed] < floor:
        needed += 1
    places = [0] * n
    cursors = [(lists[i][1][0], i) for i in range(needed, n)]
    heapq.heapify(cursors)
    while cursors and needed < n:
        doc, score = cursors[0][0], 0
        while cursors and cursors[0][0] == doc:
            i = cursors[0][1]
            if i < needed:
                heapq.heappop(cursors)
                continue
            _, docs, impacts = lists[i]
            at = places[i]
            score += impacts[at]
            places[i] = at = at + 1
            if at < len(docs):
                heapq.heapreplace(cursors, (docs[at], i))
            else:
                heapq.heappop(cursors)
        for i in range(needed - 1, -1, -1):
            if score + most[i] < floor:
                break
            _, docs, impacts = lists[i]
            places[i] = at = bisect_left(docs, doc, places[i])
            if at < len(docs) and docs[at] == doc:
                score += impacts[at]
        if score > 0 and (len(best) < k or (score, -ids[doc]) > best[0]):
            if len(best) < k:
                heapq.heappush(best, (score, -ids[doc]))
            else:
                heapq.heapreplace(best, (score, -ids[doc]))
            if len(best) == k:
                floor = best[0][0]
                while needed < n and most[needed] < floor:
                    needed += 1


def _answered(shard: tuple[list[int], np.ndarray], found: dict[str, bytes], queries: dict[int, list[tuple[str, int, int]]], best: dict[int, list], k: int, n: int, total: int) -> None:
    """Merges one shard into the heaps of all ``queries`` {query: [(term, times, weight)]}."""
    ids, lengths = shard
    norm = 8 * (25 + (75 * lengths.astype(object) * n) // total).astype(np.int64)
    known: dict[tuple[str, int], Postings] = {}

    def postings(term: str, factor: int) -> Postings:
        if (term, factor) not in known:
            both = unpacked(found[term])
            docs, tf = np.cumsum(both[::2]), both[1::2]
            impact = factor * ((UNIT * tf) // (1000 * tf + norm[docs]))
            known[term, factor] = int(impact.max()), docs.tolist(), impact.tolist()
        return known[term, factor]

    for query, terms in queries.items():
        lists = sorted((postings(term, times * weight) for term, times, weight in terms if term in found and weight > 0), key=lambda x: x[0])
        if lists:
            merge(lists, ids, best.setdefault(query, []), k)


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents of every item (item_id, text).

    Equal scores rank by doc_id, nulls last; documents without a score above 0 are not
    ranked. Repeated items are answered once; equal item_ids with different texts are
    different items; an item without terms has no rows. Queries are answered in blocks of
    about ``BLOCK_TERMS`` terms, each one pass over the postings of the block's terms.
    """
    spark = items.sparkSession
    asked = query_terms(items)
    terms = asked.select("term").distinct()
    # of the terms' rows only shard, term and df are read here
    df = index.postings.filter("term IS NOT NULL").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    ratio = F.lit(float(2 * index.n + 2)) / (2 * F.col("df") + 1)
    weighed = written(asked.join(df, "term").select("query", "term", "times", F.floor(1000 * F.log(ratio)).cast("long").alias("weight")))
    blocks = -(-weighed.count() // BLOCK_TERMS)
    parts = [_block(index, weighed.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b), k) for b in range(blocks)]
    if not parts:
        parts = [spark.createDataFrame([], "query long, doc_id long, score long")]
    best = parts[0] if len(parts) == 1 else None
    if best is None:
        best = written(parts[0])
        for part in parts[1:]:
            best = best.unionByName(written(part))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = asked.select("query", "item_id").distinct()
    return ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")


def _block(index: Index, weighed: DataFrame, k: int) -> DataFrame:
    spark = weighed.sparkSession
    queries: dict[int, list[tuple[str, int, int]]] = {}
    for row in weighed.collect():  # one block, bounded by BLOCK_TERMS
        queries.setdefault(row["query"], []).append((row["term"], row["times"], row["weight"]))
    asked, n, total = spark.sparkContext.broadcast(queries), index.n, index.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        now, shard, found = None, None, {}
        for batch in batches:
            for number, term, data, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "term", "data", "ids"))):
                if number != now:
                    if found:
                        _answered(shard, found, asked.value, best, k, n, total)
                    now, found = number, {}
                if term is None:
                    shard = [_NO_ID if i is None else i for i in ids], unpacked(data)
                else:
                    found[term] = data
        if found:
            _answered(shard, found, asked.value, best, k, n, total)
        rows = [(query, None if -i == _NO_ID else -i, score) for query, heap in best.items() for score, i in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["query", "doc_id", "score"])

    columns = ["shard", "term", "data", "ids"]
    terms = index.postings.filter("term IS NOT NULL").join(F.broadcast(weighed.select("term").distinct()), "term", "left_semi").select(columns)
    tasks = min(max(1, index.shards), max(2 * spark.sparkContext.defaultParallelism, index.shards // 32))
    dealt = terms.unionByName(index.postings.filter("term IS NULL").select(columns)).repartition(tasks, "shard")
    return dealt.sortWithinPartitions("shard", F.col("term").asc_nulls_first()).mapInArrow(run, "query long, doc_id long, score long")


def best_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``search`` over an index of ``docs`` built for it."""
    return search(build_index(docs), items, k)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
x AS (SELECT item_id, doc_id, sum(times * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN t USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
