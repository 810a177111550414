"""Ranges, dense ids and quantiles under skew."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sequoria.operators import catalog, ids, quantiles, ranking, reports


@pytest.fixture(scope="module")
def skewed(spark):
    """99 % of the rows have one value."""
    rnd = random.Random(1)
    rows = [(k, 7.0 if rnd.random() < 0.99 else rnd.random() * 1e6) for k in range(40_000)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "key long, x double").repartition(6)


def test_no_range_holds_more_than_a_few_per_cent(skewed):
    rows, df = skewed
    parts = ids.ranged(df, "x", "key", ranges=64)
    sizes = [r["count"] for r in parts.groupBy("_range").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 0.05 * len(rows)


def test_dense_ids_and_running_totals_under_skew(skewed):
    rows, df = skewed
    want = {key: n for n, (key, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r.key: r.id for r in ids.with_dense_id(df, F.col("x"), "key").collect()} == want
    got = {r.key: r.total for r in ids.with_running_total(df, F.col("key") % 5, F.col("x"), "key").collect()}
    total, expected = 0, {}
    for key, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        total += key % 5
        expected[key] = total
    assert got == expected


def test_ranks_of_many_items_with_one_count(spark):
    rows = spark.range(5000).select((F.col("id") % 2000).alias("item")).filter("item > 0").unionByName(spark.range(50).select(F.lit(0).cast("long").alias("item")))
    got = ranking.popularity_ranks(rows).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 2001)) and [(r.n, r.item) for r in got] == sorted(((r.n, r.item) for r in got), key=lambda x: (-x[0], x[1]))


def test_vocabulary_ids_by_count_and_name(spark):
    genres = spark.createDataFrame([(a, [f"g{a % 7}", "all", "all"]) for a in range(70)], "artist long, genres array<string>")
    got = [(r.genre, r.artists, r.id) for r in catalog.genre_vocab(genres).orderBy("id").collect()]
    assert got == [("all", 70, 1), *((f"g{k}", 10, k + 2) for k in range(7))]


@pytest.mark.parametrize("sorted_rows", [3, 100_000])
def test_quantiles_equal_numpy(spark, skewed, sorted_rows):
    rows, df = skewed
    rnd = random.Random(2)
    values = {"skew": [x for _, x in rows], "few": [3.5], "two": [1.0, 2.0], "wide": [10.0 ** rnd.uniform(-9, 9) * rnd.choice((-1, 1)) for _ in range(3000)], "equal": [5.0] * 900, "steps": [float(rnd.randrange(4)) for _ in range(2000)]}
    data = spark.createDataFrame([(g, x) for g, xs in values.items() for x in [*xs, None]], "g string, x double").repartition(5)
    points = [0.0, 0.001, 0.25, 0.5, 0.9, 0.995, 1.0]
    got = {(r.g, r.point): r.value for r in quantiles.exact_quantiles(data, "x", points, "g", sorted_rows).collect()}
    assert len(got) == len(points) * len(values)
    for g, xs in values.items():
        for p, want in zip(points, np.quantile(xs, points)):
            assert got[g, p] == pytest.approx(want, rel=1e-12, abs=1e-12), (g, p)
    alone = {r.point: r.value for r in quantiles.exact_quantiles(df, "x", points, sorted_rows=sorted_rows).collect()}
    assert alone == {p: pytest.approx(w) for p, w in zip(points, np.quantile(values["skew"], points))}


def test_quantiles_of_nothing(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]).count() == 0
    assert reports.quantile_cuts(spark.createDataFrame([(0.0,)], "x double"), "x", 4).first().cuts == []


def test_items_that_wait_for_each_other_in_a_long_chain(spark):
    """More rounds than any fixed number of them: item k wants what item k - 1 wants, or one more."""
    n = 40
    items = spark.createDataFrame([(k, 1000 - k, f"o{k}", f"o{k + 1}") if k == 0 else (k, 1000 - k, f"o{k - 1}", f"o{k}") for k in range(n)], "item long, listens long, option1 string, option2 string")
    got = {r.item: r.uri for r in catalog.uniquely_assigned(items).collect()}
    taken, want = set(), {}
    for k in range(n):
        options = (f"o{k}", f"o{k + 1}") if k == 0 else (f"o{k - 1}", f"o{k}")
        want[k] = next((o for o in options if o not in taken), None)
        taken.add(want[k])
    assert got == want
