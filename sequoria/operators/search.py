"""Finding items by name: exact, by prefix, by "track - artist", and with typing errors.

``items``: id, track, artist (keys of names, see functions.text) and n (plays).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequoria.functions import text as t
from sequoria.operators import ranking as r


def name_index(items: DataFrame) -> DataFrame:
    """``items`` in order of (track, most played, id): written so, a prefix reads few row groups."""
    return items.repartitionByRange("track").sortWithinPartitions("track", F.desc("n"), "id")


def _splits(queries: DataFrame) -> DataFrame:
    return queries.select("query", F.explode(t.name_splits(F.col("key"))).alias("_p")).select("query", "_p.track", "_p.artist")


def resolved(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(query, id): the most played item of exactly these names: "track - artist", else a track's name. ``queries``: query, key."""
    both = _splits(queries).join(items, ["track", "artist"]).select("query", "id", "n", F.lit(0).alias("_how"))
    alone = queries.select("query", F.col("key").alias("track")).join(items, "track").select("query", "id", "n", F.lit(1).alias("_how"))
    return both.unionByName(alone).groupBy("query").agg(F.min_by("id", F.struct("_how", -F.col("n"), F.col("id"))).alias("id"))


def starting_with(queries: DataFrame, items: DataFrame, limit: int, prefix: int = 3) -> DataFrame:
    """(query, id, n, rank): items whose track or artist begins with the key, or both with a split's parts; most played first.

    Joined on the first ``prefix`` characters, so a key meets items of its beginning only;
    shorter keys meet on as many as they have.
    """
    part = lambda c, k: F.concat(F.lit(f"{k}:"), F.substring(c, 1, k))
    wanted = queries.filter(F.length("key") > 0).select("query", F.col("key").alias("k1"), F.lit("").alias("k2"), F.lit(True).alias("_either"))
    wanted = wanted.unionByName(_splits(queries).select("query", F.col("track").alias("k1"), F.col("artist").alias("k2"), F.lit(False).alias("_either")))
    size = F.least(F.length("k1"), F.lit(prefix))
    keyed = wanted.withColumn("_cell", F.concat(size.cast("string"), F.lit(":"), F.substring("k1", F.lit(1), size)))
    named = items.select("id", "n", "track", "artist", F.explode(F.array(F.struct(F.col("track").alias("name"), F.lit(True).alias("is_track")), F.struct(F.col("artist").alias("name"), F.lit(False).alias("is_track")))).alias("_n"))
    spread = named.select("id", "n", "artist", "_n.*").withColumn("_cell", F.explode(F.array(*(part("name", k) for k in range(1, prefix + 1)))))
    met = keyed.join(spread, "_cell").filter(F.startswith("name", "k1") & (F.col("_either") | (F.col("is_track") & F.startswith("artist", "k2"))))
    return r.top_per_group(met.select("query", "id", "n").distinct(), ["query"], limit, F.desc("n"), "id")


def _deletions(word: Column, most: Column) -> Column:
    """A word and what is left of it without one or two of its letters, as ``most`` (0, 1 or 2) allows: two words within
    ``most`` insertions, deletions and changes of each other have one of these in common."""
    without_one = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))
    one = F.array_distinct(without_one(word))
    two = F.array_distinct(F.flatten(F.transform(one, without_one)))
    return F.array_distinct(F.when(most == 2, F.concat(F.array(word), one, two)).when(most == 1, F.concat(F.array(word), one)).otherwise(F.array(word)))


def typed(queries: DataFrame, items: DataFrame, limit: int, prefix: int = 3) -> DataFrame:
    """(query, id, rank): typed words in any order over track and artist; the last may be unfinished.

    A word of 4 letters may have one error, one of 8 two. More words found come first, then
    fewer errors, words of the track, popularity, id. A word meets the words of the
    vocabulary that share a deletion with it, wherever its errors are, and an unfinished one
    those of its beginning; no letter's words meet in one place.
    """
    words = queries.select("query", F.posexplode(t.name_words(F.col("key"))).alias("place", "word"))
    words = words.join(words.groupBy("query").agg(F.max("place").alias("_last")), "query")
    places = items.select("id", "n", F.explode(F.concat(F.transform(t.name_words(F.col("track")), lambda w: F.struct(w.alias("word"), F.lit(0).alias("field"))), F.transform(t.name_words(F.col("artist")), lambda w: F.struct(w.alias("word"), F.lit(1).alias("field"))))).alias("_w")).select("id", "n", "_w.*")
    vocabulary = places.select("word").distinct()
    allowed = F.when(F.length("word") >= 8, 2).when(F.length("word") >= 4, 1).otherwise(0)
    # a word of the vocabulary may be as much shorter as errors are allowed
    reached = F.when(F.length("word") >= 6, 2).when(F.length("word") >= 3, 1).otherwise(0)
    begin = lambda w, k: F.concat(F.lit("p"), k.cast("string"), F.lit(":"), F.substring(w, F.lit(1), k))
    cells = lambda most: F.transform(_deletions(F.col("word"), most), lambda x: F.concat(F.lit("d:"), x))
    unfinished = F.when(F.col("place") == F.col("_last"), F.array(begin(F.col("word"), F.least(F.length("word"), F.lit(prefix))))).otherwise(F.array().cast("array<string>"))
    a = words.withColumn("_cell", F.explode(F.concat(cells(allowed), unfinished)))
    b = vocabulary.select(F.col("word").alias("found"), F.explode(F.concat(cells(reached), F.array(*(begin(F.col("word"), F.lit(k)) for k in range(1, prefix + 1))))).alias("_cell"))
    begun = (F.col("place") == F.col("_last")) & F.startswith("found", "word")
    met = a.join(b, "_cell").select("query", "place", "_last", "word", "found").distinct()
    near = met.withColumn("errors", F.when(begun, 0).otherwise(F.levenshtein("word", "found"))).filter(F.col("errors") <= allowed)
    hits = near.join(places.select("id", "n", "field", F.col("word").alias("found")), "found").groupBy("query", "id", "place").agg(F.min(F.struct("errors", "field")).alias("best"), F.max("n").alias("n"))
    scored = hits.groupBy("query", "id").agg(F.count("*").alias("words"), F.sum("best.errors").alias("errors"), F.sum("best.field").alias("fields"), F.max("n").alias("n"))
    return r.top_per_group(scored, ["query"], limit, F.desc("words"), "errors", "fields", F.desc("n"), "id").select("query", "id", "rank")


def search_documents(items: DataFrame) -> DataFrame:
    """(id, name, album, popularity) for a text index."""
    return items.select("id", F.concat_ws(" ", "track", "artist").alias("name"), "album", F.col("n").alias("popularity"))


def upserted(documents: DataFrame, changed: DataFrame) -> DataFrame:
    """``documents`` with those of ``changed`` in place of equal ids."""
    return documents.join(changed.select("id"), "id", "left_anti").unionByName(changed)
