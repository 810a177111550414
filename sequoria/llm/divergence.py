"""Source divergence audit: how the terms of a source differ from those of other sources of its language.

Rows are dealt to shards by a hash of lang and term. DuckDB sums a shard's counts, picks
the terms that are kept, and sums what a shard adds to each pair of sources; Spark merges
the sums of all shards and ranks them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sequoria.llm.shared import written
from sequoria.llm.terms import alphabet, gathered_chunks, split_terms

_TABLE = alphabet(digits=False)
#: A term is kept in a lang if so many of the lang's documents have it.
LEAST_DOCUMENTS = 30
#: Terms of a source that are reported.
TOP_TERMS = 50
#: What a count of nothing adds, and the scale of a share.
PRIOR, SCALE = 5, 1_000_000_000
#: Parts that rows of one (lang, term) are summed in before they meet.
SALTS = 16
#: Memory of one shard's DuckDB.
SHARD_MEMORY = "512MB"

_COUNTS = "lang string, source string, term string, n long, docs long"


def chunk_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs, salt) of each chunk of ``docs`` (lang, source, text): occurrences and documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        for part in gathered_chunks(batches):
            rows, codes, words = split_terms(part.column("text"), _TABLE)
            langs, sources = (part.column(c).dictionary_encode() for c in ("lang", "source"))
            group = (langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy())[rows]
            n, size = part.num_rows, max(1, len(langs.dictionary) * len(sources.dictionary))
            # by term, then group, then document
            order = np.lexsort((rows, group, codes))
            key, doc = codes[order].astype(np.int64) * size + group[order], rows[order]
            new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            different = new | np.concatenate([[True], doc[1:] != doc[:-1]]) if len(key) else new
            count = np.diff(np.concatenate([first, [len(key)]]))
            docs_with = np.add.reduceat(different.astype(np.int64), first) if len(first) else first
            of = key[first]
            lang, source = (of % size) // max(1, len(sources.dictionary)), (of % size) % max(1, len(sources.dictionary))
            salt = (salt + 1) % SALTS
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), words.take(pa.array(of // size)).cast(pa.string()), pa.array(count, pa.int64()), pa.array(docs_with, pa.int64()), pa.array(np.full(len(of), salt), pa.int32())],
                ["lang", "source", "term", "n", "docs", "salt"],
            )

    return docs.select("lang", "source", "text").mapInArrow(run, f"{_COUNTS}, salt int")


def in_duckdb(statements: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for tasks: the rows of the last of ``statements``; the first may read the shard's rows, once, as ``shard``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        with duckdb.connect() as db:
            db.execute(f"SET threads = 1; SET memory_limit = '{SHARD_MEMORY}'; SET preserve_insertion_order = false")
            db.register("shard", pa.RecordBatchReader.from_batches(first.schema, _chain(first, batches)))
            for statement in statements:
                done = db.execute(statement)
            yield from done.to_arrow_reader(1 << 16)

    return run


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


_SUM = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM shard GROUP BY lang, source, term"


def kept_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n) of the terms that at least ``least`` documents of their lang have, written.

    Counts are summed in shards of (lang, term, salt) first, so no shard gets all rows of a
    frequent term.
    """
    salted = chunk_counts(docs).repartition("lang", "term", "salt").mapInArrow(in_duckdb([_SUM]), _COUNTS)
    keep = f"WITH c AS ({_SUM}) SELECT lang, source, term, n FROM c QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {int(least)}"
    return written(salted.repartition("lang", "term").mapInArrow(in_duckdb([keep]), "lang string, source string, term string, n long"))


def share(n: str, total: str) -> str:
    """SQL of both engines for the share of a count, exact in whole numbers: 1 + floor(SCALE * (n + PRIOR) / total)."""
    return f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + {PRIOR} AS DECIMAL(20, 0))) div CAST({total} AS DECIMAL(20, 0))"


#: In DuckDB whole numbers of 128 bits do the same.
_P = f"(1 + ({SCALE}::HUGEINT * (n + {PRIOR})) // total)::BIGINT"
_Z = f"(1 + ({SCALE}::HUGEINT * {PRIOR}) // total)::BIGINT"
_SHARD = f"CREATE TABLE k AS SELECT lang, source, term, {_P} AS p, {_Z} AS z, (1 + ({SCALE}::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + {PRIOR})) // lang_total)::BIGINT AS q FROM shard"
#: Of terms that both sources have, what their pair has beyond both sources' own parts.
_PAIRS = """SELECT 'pair' AS part, a.lang, a.source, b.source AS item, sum(abs(a.p - b.p) - abs(a.p - b.z) - abs(b.p - a.z) + abs(a.z - b.z))::BIGINT AS value
FROM k a JOIN k b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY a.lang, a.source, b.source"""
_TOP = f"SELECT 'term' AS part, lang, source, term AS item, p - q AS value FROM k WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {TOP_TERMS}"


def divergence_audit(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) of ``docs`` (lang, source, text).

    Part ``pair`` ranks all other sources of the lang by the summed differences of their
    shares, part ``term`` the ``TOP_TERMS`` terms whose share lies furthest above the
    lang's. Null lang, source and text count as empty; a lang without kept terms has pairs
    of value 0; a lang with one source has none. Repeated rows count each time; other
    columns are ignored; empty tables give no rows.

    A pair's sum over all kept terms is made of three: V times the difference of the shares
    of nothing; for each of both sources what its own terms add to that, from counts of
    equal counts; and what terms of both add, from the shards.
    """
    plain = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = kept_counts(plain, least)
    # a group's total, its lang's total and number of terms
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("v"))
    groups = plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0)
    groups = written(groups.select("lang", "source", "v", (F.col("n") + PRIOR * F.col("v")).alias("total"), (F.col("lang_n") + PRIOR * F.col("v")).alias("lang_total")).withColumn("z", F.expr(share("0", "greatest(total, 1)"))))
    counted = kept.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"]).repartition("lang", "term")
    shards = written(counted.mapInArrow(in_duckdb([_SHARD, f"{_PAIRS} UNION ALL ({_TOP})"]), "part string, lang string, source string, item string, value long"))

    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("other_z"))
    pairs = groups.select("lang", "source", "v", "z").join(other, "lang").filter("source < item")
    base = pairs.select("lang", "source", "item", (F.col("v") * F.abs(F.col("z") - F.col("other_z"))).alias("value"))
    equal = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("times"))
    own = equal.join(groups.select("lang", "source", "total", "z"), ["lang", "source"]).withColumn("p", F.expr(share("n", "total"))).join(other, "lang").filter("source <> item")
    own = own.select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), (F.col("times") * (F.abs(F.col("p") - F.col("other_z")) - F.abs(F.col("z") - F.col("other_z")))).alias("value"))
    both = shards.filter("part = 'pair'").drop("part")
    summed = base.unionByName(own).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pair = summed.select("lang", turned.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    term = shards.filter("part = 'term'").select("lang", "source", "part", "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    top = term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP_TERMS)
    return pair.withColumn("rank", F.row_number().over(order)).unionByName(top)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q FROM c JOIN v USING (lang) GROUP BY lang, term),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (coalesce(total, 0) + 5 * v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""
