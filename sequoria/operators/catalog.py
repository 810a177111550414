"""Catalogs of items: who is in, by which name, with which attributes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sequoria.operators import sessions as s
from sequoria.operators.ids import with_dense_id
from sequoria.sources.tables import written

#: Lengths outside are not believed, in milliseconds.
PLAUSIBLE_MS = (20_000, 1_800_000)


def mode_per_item(rows: DataFrame, value: str, item: str = "item") -> DataFrame:
    """(item, mode): the most frequent value, the smaller of equally frequent ones; counts first, so a common item is spread."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(item, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(item).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("mode"))


def median_per_item(rows: DataFrame, value: str, item: str = "item") -> DataFrame:
    """(item, median): the lower middle value. From counts of values, so no item's rows meet in one sort."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(item, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(item)
    placed = counts.withColumn("_upto", F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    return placed.filter("2 * _upto >= _all").groupBy(item).agg(F.min(value).alias("median"))


def item_columns(listens: DataFrame) -> DataFrame:
    """(item, listens, track, release, length_ms) from every listen, not only those kept. Columns: item, track, release, duration_ms."""
    plausible = listens.withColumn("duration_ms", F.when(F.col("duration_ms").between(*PLAUSIBLE_MS), F.col("duration_ms")))
    out = listens.groupBy("item").agg(F.count("*").alias("listens"))
    for value, name in (("track", "track"), ("release", "release")):
        out = out.join(mode_per_item(listens, value).withColumnRenamed("mode", name), "item", "left")
    return out.join(median_per_item(plausible, "duration_ms").withColumnRenamed("median", "length_ms"), "item", "left").fillna(0, ["length_ms"])


def capped_catalog(listens: DataFrame, cap: int | None, min_users: int, gap: int = s.GAP, min_length: int = s.MIN_LENGTH, ties: Sequence[str] = ("item",)) -> DataFrame:
    """Listens left after the cap, the catalog filter and the session rules, which are applied again.

    A user's ``cap`` most recent listens count; an item is in the catalog if ``min_users``
    users with ``training`` true have it among these. Sessions come from the gaps between
    the catalog's listens, before repeats go.
    """
    capped = listens if cap is None else s.most_recent(listens, cap, ties)
    catalog = s.users_per_item(capped.filter("training")).filter(F.col("users") >= min_users).select("item")
    dropped = [c for c in ("starts", "session", "repeat") if c in listens.columns]
    return s.kept_listens(s.with_sessions(capped.drop(*dropped).join(catalog, "item", "left_semi"), gap, ties), min_length)


def choose_cap(listens: DataFrame, min_users: int, target: int, first: int = 4096, **rules) -> int | None:
    """The smallest cap whose catalog listens reach ``target``, None if no cap does.

    A driver loop of one count job for each trial (a doubling, then a binary search);
    ``listens`` should be a written or cached table.
    """
    most = listens.groupBy("user").count().agg(F.max("count")).first()[0] or 1
    trial: Callable[[int], bool] = lambda k: capped_catalog(listens, k, min_users, **rules).count() >= target
    lo, hi = 1, min(first, most)
    while not trial(hi):
        if hi >= most:
            return None
        lo, hi = hi + 1, min(hi * 2, most)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if trial(mid) else (mid + 1, hi)
    return hi


def coverage(held_out: DataFrame, catalog: DataFrame) -> DataFrame:
    """Share of held-out listens whose item is in the catalog."""
    known = catalog.select("item").distinct().withColumn("_in", F.lit(1))
    return held_out.join(known, "item", "left").agg(F.avg(F.when(F.col("_in").isNull(), 0.0).otherwise(1.0)).alias("coverage"))


def coverage_by_minimum(listens: DataFrame, held_out: DataFrame, minimums: Sequence[int] = (1, 2, 3, 5, 10, 20)) -> DataFrame:
    """(min_users, items, listen_share, coverage) for every minimum, from one pass over (item, users, listens, held-out listens)."""
    per_item = s.users_per_item(listens).join(listens.groupBy("item").agg(F.count("*").alias("n")), "item")
    both = per_item.join(held_out.groupBy("item").agg(F.count("*").alias("h")), "item", "full").fillna(0, ["users", "n", "h"])
    wide = both.agg(
        F.sum("n").alias("_n"), F.sum("h").alias("_h"), *(f(F.when(F.col("users") >= m, F.col(c) if c else F.lit(1)).otherwise(0)).alias(f"{name}_{m}") for m in minimums for name, c, f in (("items", None, F.sum), ("n", "n", F.sum), ("h", "h", F.sum)))
    )
    rows = F.array(*(F.struct(F.lit(m).alias("min_users"), F.col(f"items_{m}").alias("items"), (F.col(f"n_{m}") / F.col("_n")).alias("listen_share"), (F.col(f"h_{m}") / F.col("_h")).alias("coverage")) for m in minimums))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def lowest_id_lookup(items: DataFrame, key: str = "song_key") -> DataFrame:
    """(key, id): the lowest id of each key."""
    return items.groupBy(key).agg(F.min("id").alias("id"))


def best_version_lookup(items: DataFrame, key: str = "song_key") -> DataFrame:
    """(key, id): of a key's items the one with the largest ``n``, then the lowest id."""
    return items.groupBy(key).agg(F.min_by("id", F.struct(-F.col("n"), F.col("id"))).alias("id"))


def matched(plays: DataFrame, by_uri: DataFrame, by_key: DataFrame) -> DataFrame:
    """``plays`` (uri, song_key) with ``id`` and ``how``: 1 by uri, 2 by key, 0 not at all (id null)."""
    both = plays.join(by_uri.select("uri", F.col("id").alias("_u")), "uri", "left").join(by_key.select("song_key", F.col("id").alias("_k")), "song_key", "left")
    how = F.when(F.col("_u").isNotNull(), 1).when(F.col("_k").isNotNull(), 2).otherwise(0)
    return both.withColumns({"id": F.coalesce("_u", "_k"), "how": how}).drop("_u", "_k")


def resolved_genres(items: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """``items`` with ``genres`` from the first of ``sources`` (key, genres) that has any; none: empty."""
    out, names = items, []
    for i, source in enumerate(sources):
        names.append(f"_g{i}")
        out = out.join(source.select(key, F.col("genres").alias(f"_g{i}")), key, "left")
    found = [F.when(F.size(n) > 0, F.col(n)) for n in names]
    return out.withColumn("genres", F.coalesce(*found, F.array().cast("array<string>"))).drop(*names)


def merged_genre_sources(*sources: DataFrame) -> DataFrame:
    """(artist, genres) of the first source that has an artist."""
    tagged = None
    for i, source in enumerate(sources):
        one = source.select("artist", "genres", F.lit(i).alias("_source"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy("artist").agg(F.min_by("genres", "_source").alias("genres"))


def merged_votes(votes: DataFrame) -> DataFrame:
    """(artist, genres): names by summed votes, the most first, then by name. Columns: artist, genre, votes."""
    summed = votes.groupBy("artist", "genre").agg(F.sum("votes").alias("n"))
    return summed.groupBy("artist").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "genre"))), lambda g: g["genre"]).alias("genres"))


def genre_vocab(artist_genres: DataFrame, min_artists: int = 5) -> DataFrame:
    """(genre, artists, id from 1) of genres of ``min_artists`` artists, by count, then name."""
    counts = artist_genres.select("artist", F.explode(F.array_distinct("genres")).alias("genre")).groupBy("genre").agg(F.count("*").alias("artists")).filter(F.col("artists") >= min_artists)
    return with_dense_id(counts, -F.col("artists"), "genre", start=1).withColumn("id", F.col("id").cast("int"))


def uniquely_assigned(items: DataFrame) -> DataFrame:
    """``items`` (item, listens, option1, option2) with ``uri``: each option once, items with more listens choose first.

    Equal to the one-by-one rule. Items are settled in rounds: an item takes its first
    option that is not taken by a settled item if no unsettled item before it wants that
    option at all; else it waits. A round is a few shuffles of the unsettled items; the
    first of them is always settled, so the rounds end. They are as many as the longest
    chain of items that wait for each other.
    """
    order = F.struct(-F.col("listens"), F.col("item"))
    # a conflict needs an option that several items name; the others are settled at once
    options = F.array_compact(F.array("option1", "option2"))
    wide = items.withColumn("_rank", order)
    settled, open_items = None, wide
    for rounds in count(1):
        wants = open_items.select("item", "_rank", F.explode(options).alias("_o"))
        free = wants if settled is None else wants.join(settled.select(F.col("uri").alias("_o")).filter("_o IS NOT NULL"), "_o", "left_anti")
        first = free.groupBy("_o").agg(F.min_by("item", "_rank").alias("_first"))
        places = free.join(first, "_o").select("item", "_o", (F.col("_first") == F.col("item")).alias("_mine"))
        mine = places.groupBy("item").agg(F.collect_list(F.struct("_o", "_mine")).alias("_free"))
        state = open_items.join(mine, "item", "left")
        has = lambda o, m: F.exists(F.coalesce("_free", F.array().cast("array<struct<_o:string,_mine:boolean>>")), lambda x: (x["_o"] == F.col(o)) & (x["_mine"] | F.lit(not m)))
        one_free, one_mine = F.coalesce(has("option1", False), F.lit(False)), F.coalesce(has("option1", True), F.lit(False))
        two_free, two_mine = F.coalesce(has("option2", False), F.lit(False)), F.coalesce(has("option2", True), F.lit(False))
        choice = F.when(one_mine, F.col("option1")).when(~one_free & two_mine, F.col("option2"))
        done = written(state.withColumn("uri", choice).withColumn("_done", choice.isNotNull() | (~one_free & ~two_free)).drop("_free"))
        now = done.filter("_done").drop("_done")
        settled = now if settled is None else settled.unionByName(now)
        if rounds % 16 == 0:
            settled = written(settled)
        open_items = done.filter("NOT _done").drop("_done", "uri")
        if open_items.isEmpty():
            return settled.drop("_rank")


def joining_items(outside: DataFrame, known_artists: DataFrame, taken: DataFrame, min_users: int = 3, most: int = 2000) -> DataFrame:
    """New items: (key, artist, track, users) with enough users, a known artist and a free track; the ``most`` most listened, one for each track."""
    ok = outside.filter(F.col("users") >= min_users).join(known_artists.select("artist").distinct(), "artist", "left_semi").join(taken.select("track").distinct(), "track", "left_anti")
    top = ok.orderBy(F.desc("users"), "key").limit(most)
    first = F.row_number().over(Window.partitionBy("track").orderBy(F.desc("users"), "key"))
    return top.withColumn("_first", first).filter("track IS NULL OR _first = 1").drop("_first")


def conflicts(records: DataFrame, key: str, *attributes: str) -> DataFrame:
    """Keys that have several different records."""
    return records.groupBy(key).agg(F.count_distinct(F.struct(*attributes)).alias("variants")).filter("variants > 1")


def lookup_or(rows: DataFrame, table: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """``rows`` with ``value`` of their key, or a default."""
    return rows.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), default))
