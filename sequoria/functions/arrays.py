"""Expressions over arrays: sequences, vectors, ranking gains, time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def padded_left(xs: Column, length: int, fill: Column) -> Column:
    return F.concat(F.array_repeat(fill, F.greatest(F.lit(0), length - F.size(xs))), xs)


def padded_right(xs: Column, length: int, fill: Column) -> Column:
    return F.concat(xs, F.array_repeat(fill, F.greatest(F.lit(0), length - F.size(xs))))


def without_repeats(xs: Column) -> Column:
    """Later places of a value become null; a value counts at its nearest place."""
    return F.transform(xs, lambda x, i: F.when(F.array_position(xs, x) == i + 1, x))


def without_inputs(targets: Column, inputs: Column) -> Column:
    """Targets behind the first that are among the inputs become null."""
    return F.transform(targets, lambda x, i: F.when((i == 0) | ~F.coalesce(F.array_contains(inputs, x), F.lit(False)), x))


def quantile_bucket(value: Column, cuts: Column) -> Column:
    """The number of cuts that are not above ``value``; 0 (unknown) has a bucket behind the last."""
    return F.when(value == 0, F.size(cuts) + 1).otherwise(F.size(F.filter(cuts, lambda c: c <= value)))


def capped_known(values: Column, known: Column, most: int = 5) -> Column:
    """The first ``most`` of those values that are known, in their order."""
    return F.slice(F.filter(values, lambda g: F.array_contains(known, g)), 1, most)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def mixed(x: Column, y: Column, weight: float) -> Column:
    """(1 - weight) x + weight y."""
    return F.zip_with(x, y, lambda a, b: (1 - weight) * a + weight * b)


def decayed_weights(n: Column | int, mix: float) -> Column:
    """Weights of n inputs, the last the largest (1, then mix, mix squared ...), summing to 1."""
    n = F.lit(n) if isinstance(n, int) else n
    raw = F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda back: F.pow(F.lit(mix), back))
    return F.transform(raw, lambda w: w / F.aggregate(raw, F.lit(0.0), lambda acc, v: acc + v))


def gain(rank: Column, k: int = 10) -> Column:
    """1 / log2(1 + rank) within the first k, else 0."""
    return F.when((rank > 0) & (rank <= k), 1 / F.log2(rank + 1)).otherwise(F.lit(0.0))


def multi_target_gain(ranks: Column, weights: Column, k: int = 10) -> Column:
    """NDCG@k of several weighted targets; rank 0 is no target."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    valid = F.zip_with(ranks, weights, lambda r, w: F.when(r > 0, w).otherwise(F.lit(0.0)))
    found = total(F.zip_with(ranks, weights, lambda r, w: w * gain(r, k)))
    ordered = F.slice(F.sort_array(valid, asc=False), 1, k)
    best = total(F.transform(ordered, lambda w, i: w / F.log2(i + 2)))
    return F.when(best > 0, found / best).otherwise(F.lit(0.0))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def relative_day(seconds: Column, start: Column | int) -> Column:
    """Days since the window's start, not calendar days."""
    return F.floor((seconds - start) / DAY).cast("int")


def iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def recency_weight(seconds: Column, until: Column | int, half_life_days: float) -> Column:
    return F.pow(F.lit(0.5), (until - seconds) / F.lit(half_life_days * DAY))
