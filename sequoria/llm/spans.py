"""Regular-expression spans with code-point offsets, from DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,rank:int,begin:int,end:int,value:string>"


def matches(text: Column, kind: str, rank: int, pattern: str, keep) -> Column:
    """The leftmost non-overlapping matches of ``pattern`` in ``text`` as an array of SPAN.

    ``pattern`` has no group and matches no empty string. ``keep`` maps a match to a
    condition; a match that fails it is dropped. Offsets count code points, ``end`` is
    exclusive. The text between matches is cut out only where there is a match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        span = F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), begin.alias("begin"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    none = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, F.filter(spans, lambda s: keep(s["value"]))).otherwise(none)


def in_order(spans: Column) -> Column:
    """By begin, then kind as listed."""
    return F.transform(F.sort_array(F.transform(spans, lambda s: F.struct(s["begin"], s["rank"], s["end"], s["kind"]))), lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string")))


def joined(spans: Column) -> Column:
    """kind:begin:end of every span, comma-joined; empty for none."""
    return F.array_join(in_order(spans), ",")
