"""N-gram Jaccard join with prefix filters under several global token orders.

Under any global order two sets of Jaccard similarity 0.8 share a token among the first
fifth of each. Every order here is rare-first by one sketch of the corpus, and by another
hash among tokens of one frequency class. Buckets come from the first order; a candidate
pair must share prefix tokens under the other orders too before its texts are compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sequoria.llm import textgrid as g
from sequoria.llm.shared import components, dropped, written

#: Words in a shingle; links have 100 * intersection >= LEAST * union.
SHINGLE, LEAST = 5, 80
#: Orders besides the one that makes the buckets.
MORE_ORDERS = 2
#: 64-bit words of a set's parity sketch.
PARITY = 4
#: Counters of the frequency sketch: a fixed size, so what is broadcast does not grow with the corpus.
SKETCH_BITS, SKETCH_PART = 23, 15
#: Rounds in which a bucket's documents are compared with one of them only.
STAR_ROUNDS = 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of text after text, ascending in each; first of each text and the total)."""
    data = _LOWER[data]
    begin, end, per_text = g.runs_of(g.WORD_BYTE[data], offsets)
    words = g.mix(g.span_hash(g.prefix_hash(g.BYTE_CODES[data]), begin, end))
    prefix = g.prefix_hash(words)
    sets, sizes = [], [0]
    for a, b in zip(per_text.tolist(), per_text[1:].tolist()):
        if b > a:
            at = np.arange(a, max(a + 1, b - size + 1))
            sets.append(np.unique(g.mix(g.span_hash(prefix, at, np.minimum(at + size, b)), 71)))
        sizes.append(len(sets[-1]) if b > a else 0)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum(sizes)


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (g.mix(tokens, 72) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _profiles(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document (n, s1, s2: its set's size and two hashes), and rows with the task's part of the sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = np.zeros(1 << SKETCH_BITS, dtype=np.uint32), ["doc_id", "n", "s1", "s2", "part", "salt", "counts"]
        for batch in batches:
            for chunk in g.chunks(batch):
                tokens, at = shingle_sets(*g.texts_of(chunk.column("text")), size)
                np.add.at(counts, _slots(tokens), np.uint32(1))
                sums = []
                for seed in (73, 74):
                    total = np.zeros(len(tokens) + 1, dtype=np.uint64)
                    np.cumsum(g.mix(tokens, seed), out=total[1:])
                    sums.append(pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)))
                n = chunk.num_rows
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(np.diff(at)), *sums, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if counts.any():
            parts = counts.reshape(-1, 1 << SKETCH_PART)
            n = len(parts)
            salt = pa.array(np.full(n, TaskContext.get().partitionId() % 64, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.nulls(n, batch.schema.field("doc_id").type), *(pa.nulls(n, pa.int64()) for _ in range(3)), pa.array(np.arange(n, dtype=np.int32)), salt, pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, s1 long, s2 long, part int, salt int, counts binary")


def _summed(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << SKETCH_PART, dtype=np.uint64)
    for x in table.column("counts"):
        total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
    counts = np.minimum(total, 2**32 - 1).astype(np.uint32)
    return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())})


def _frequency_classes(profiles: DataFrame) -> np.ndarray:
    """A class from 0 (rare) for each slot of the sketch, half an octave above the mean each; one byte a slot."""
    parts = profiles.filter("part IS NOT NULL").select("part", "salt", "counts")
    # by salt first, so that a group's rows don't grow with the number of tasks
    once = parts.groupBy("part", "salt").applyInArrow(_summed, "part int, counts binary")
    rows = once.groupBy("part").applyInArrow(_summed, "part int, counts binary").collect()
    counts = np.zeros((1 << SKETCH_BITS - SKETCH_PART, 1 << SKETCH_PART), np.uint32)
    for r in rows:
        counts[r.part] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.uint32)
    above = np.maximum(counts.ravel() / np.float32(counts.mean() + 1), 1)
    return np.clip(2 * np.log2(above), 0, 127).astype(np.uint8)


def prefix_length(n: np.ndarray | int, least: int):
    return n - (least * n + 99) // 100 + 1


def _sketch() -> list[str]:
    return [f"p{w}" for w in range(PARITY)]


def parities(tokens: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """PARITY words for each (not empty) set: bit b tells whether the set has an odd number of tokens of bin b.

    Two sets differ in as many tokens at least as their sketches do in bits.
    """
    bins = g.mix(tokens, 95) >> np.uint64(64 - 6 - (PARITY - 1).bit_length())
    bit = np.uint64(1) << (bins & np.uint64(63))
    return [np.bitwise_xor.reduceat(np.where(bins >> np.uint64(6) == w, bit, np.uint64(0)), at) if len(at) else np.zeros(0, np.uint64) for w in range(PARITY)]


def _prefixes(docs: DataFrame, classes: np.ndarray, size: int, least: int) -> DataFrame:
    """(doc_id, n, p0 .. parity sketch, prefix array<long>, more0, more1 ... array<int>): prefix tokens, in order, under every order; documents without words are left out."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in g.chunks(batch):
                tokens, at = shingle_sets(*g.texts_of(chunk.column("text")), size)
                rank = shared.value[_slots(tokens)].astype(np.uint64) << np.uint64(56)
                orders = [rank | (g.mix(tokens, 80 + k) >> np.uint64(8)) for k in range(1 + MORE_ORDERS)]
                full = np.flatnonzero(np.diff(at) > 0)
                first, more = [], [[] for _ in range(MORE_ORDERS)]
                for i in full.tolist():
                    a, b = at[i], at[i + 1]
                    p = prefix_length(int(b - a), least)
                    for k, order in enumerate(orders):
                        x = tokens[a:b][np.argsort(order[a:b], kind="stable")[:p]]
                        (more[k - 1] if k else first).append(x if not k else (x & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
                lists = lambda xs, t: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32)), pa.array(np.concatenate(xs) if xs else [], t))
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id").take(pa.array(full)), pa.array(np.diff(at)[full]), *(pa.array(x.view(np.int64)) for x in parities(tokens, at[:-1][full])), lists([x.view(np.int64) for x in first], pa.int64()), *(lists(x, pa.int32()) for x in more)], ["doc_id", "n", *_sketch(), "prefix", *(f"more{k}" for k in range(MORE_ORDERS))])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, {', '.join(f'{c} long' for c in _sketch())}, prefix array<long>, {', '.join(f'more{k} array<int>' for k in range(MORE_ORDERS))}")


def _band(n: Column, least: int) -> Column:
    """Sets of linked documents differ by one band at most."""
    return F.floor(F.log(n.cast("double")) / -np.log(least / 100) + 1e-9).cast("int") if least < 100 else n.cast("int")


def _can_link(x, y, least: int) -> Column:
    """Whether two sets (functions from a column's name to the column) can be similar.

    If a token at these places of their orders is the first that they share, they share no
    more than what is behind it; a link passes at its first shared token. And they differ in
    as many tokens at least as their parity sketches do in bits.
    """
    most = F.least(x("n") - x("place"), y("n") - y("place"))
    differ = sum((F.bit_count(x(c).bitwiseXOR(y(c))) for c in _sketch()), F.lit(0))
    return (100 * most >= least * (x("n") + y("n") - most)) & ((100 + least) * differ <= (100 - least) * (x("n") + y("n")))


def _linked(pairs: DataFrame, docs: DataFrame, prefixes: DataFrame, size: int, least: int) -> DataFrame:
    """The pairs (a, b) that are links: filters of the other orders first, then both texts, which do not stay on disk."""
    more = [f"more{k}" for k in range(MORE_ORDERS)]
    side = lambda x: prefixes.select(F.col("doc_id").alias(x), *(F.col(m).alias(f"{m}_{x}") for m in more))
    candidates = pairs.join(side("a"), "a").join(side("b"), "b")
    for m in more:
        candidates = candidates.filter(F.arrays_overlap(f"{m}_a", f"{m}_b"))
    candidates = written(candidates.select("a", "b"))
    needed = candidates.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = written(docs.select("doc_id", "text").join(needed, "doc_id", "left_semi"))
    both = candidates.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    schema = both.select("a", "b").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in g.chunks(batch, "text_a"):
                sides = []
                for c in ("text_a", "text_b"):
                    tokens, at = shingle_sets(*g.texts_of(chunk.column(c)), size)
                    pair = np.repeat(np.arange(chunk.num_rows), np.diff(at))
                    sides.append((g.mix(tokens ^ g.mix(pair.astype(np.uint64), 90), 91), pair, np.diff(at)))
                (x, of, n), (y, _, m) = sides
                order = np.argsort(y)
                y = y[order]
                hit = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)
                both_n = np.bincount(of[hit], minlength=chunk.num_rows)
                yield chunk.select(["a", "b"]).filter(pa.array(100 * both_n >= least * (n + m - both_n)))

    found = written(both.mapInArrow(run, schema))
    dropped(candidates, texts)
    return found


def similar_groups(docs: DataFrame, size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    ``size`` words make a shingle, ``least`` is the least similarity of a link in per cent.

    Documents of equal sets are one class, found by their sets' hashes; links between
    classes are found as the module says, and only where they can join two components.
    component_id is the smallest doc_id that links reach. Null and empty texts have no
    shingles and stay alone; texts of fewer words than a shingle are one shingle. Rows of
    one doc_id with different texts are linked by it; a null doc_id gives a null
    component. Other columns are left out.
    """
    docs = docs.select("doc_id", "text")
    profiles = written(_profiles(docs, size))
    sets = profiles.filter("part IS NULL").select("doc_id", "n", "s1", "s2")
    # written, so that the join of a large class's rows at the end can be split
    classes = written(sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")))
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    prefixes = written(_prefixes(docs.filter("doc_id IS NOT NULL"), _frequency_classes(profiles), size, least).join(reps, "doc_id", "left_semi"))
    tokens = prefixes.select("doc_id", "n", F.posexplode("prefix").alias("place", "token"))
    common = tokens.groupBy("token").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("token")
    bands = tokens.join(common, "token", "left_semi").select("doc_id", "n", "place", F.explode(F.array(_band(F.col("n"), least), _band(F.col("n"), least) + 1)).alias("band"), "token")
    keyed = bands.select("doc_id", "n", "place", F.xxhash64("token", "band").alias("key"))
    full = keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("key")
    buckets = written(keyed.join(full, "key", "left_semi").join(prefixes.select("doc_id", *_sketch()), "doc_id"))
    links = roots = None
    for k in range(STAR_ROUNDS + 1):
        rooted = buckets.withColumn("root", F.col("doc_id")) if roots is None else buckets.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        w = Window.partitionBy("key")
        mixed = rooted.select("key", "doc_id", "n", "place", *_sketch(), "root", F.min("root").over(w).alias("r0"), F.max("root").over(w).alias("r1")).filter("r0 < r1")
        fits = lambda x, y: _can_link(x, y, least)
        if k < STAR_ROUNDS:
            # few rare tokens before the shared one: such a document is close to many
            centre = F.min_by(F.struct("doc_id", "n", "place", *_sketch(), "root"), F.struct("place", F.xxhash64("root", "doc_id", F.lit(k)))).over(w)
            pairs = mixed.withColumn("c", centre).filter("root <> c.root").filter(fits(F.col, lambda x: F.col(f"c.{x}"))).select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b"))
        else:
            other = mixed.select("key", F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), *(F.col(c).alias(f"{c}_b") for c in _sketch()), F.col("root").alias("root_b"))
            pairs = mixed.select("key", F.col("doc_id").alias("a"), "n", "place", *_sketch(), "root").join(other, "key").filter("a < b AND root <> root_b").filter(fits(F.col, lambda x: F.col(f"{x}_b"))).select("a", "b")
        found = _linked(pairs.distinct(), docs, prefixes, size, least)
        links = found if links is None else links.unionByName(found)
        roots = components(links)
    dropped(buckets, prefixes)
    by_class = sets.join(classes, ["n", "s1", "s2"], "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    return by_class.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its component's smallest, with all columns; rows with a null doc_id stay."""
    gone = similar_groups(docs, size, least).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_n >= 90 * (na.n + nb.n - both_n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS other FROM d UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) m ON m.id = d.doc_id
"""
