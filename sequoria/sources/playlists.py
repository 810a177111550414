"""Playlist slices in JSON, stores made of them, genre files, listeners' exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequoria.operators.ids import with_dense_id

_TRACK = "struct<pos:int,track_name:string,track_uri:string,artist_name:string,artist_uri:string,album_name:string,album_uri:string,duration_ms:long>"
SLICE = f"struct<playlists:array<struct<name:string,pid:long,tracks:array<{_TRACK}>>>>"


def playlist_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, playlist, name, pos, track_uri, ...) of slices; ``file`` is a path, so slices of one name in two folders stay apart."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", SLICE).alias("s"))
    lists = files.select("file", F.posexplode("s.playlists").alias("playlist", "p"))
    return lists.select("file", "playlist", F.col("p.name").alias("name"), F.posexplode("p.tracks").alias("place", "t")).select("file", "playlist", "name", F.col("place").alias("pos"), *(F.col(f"t.{c}").alias(c) for c in ("track_name", "track_uri", "artist_name", "artist_uri", "album_name", "album_uri", "duration_ms")))


def write_store(entries: DataFrame, path: str) -> None:
    """A store: ``tracks``, ``artists`` and ``albums`` by id in order of first appearance, ``entries`` (playlist, pos, track).

    The order is that of files by name (then path), playlists and places in them. The first record of a key gives its attributes; ``conflicts`` in ``tracks`` counts other ones.
    """
    ordered = entries.withColumn("_order", F.struct(F.element_at(F.split("file", "/"), -1), "file", "playlist", "pos"))
    attributes = ("track_name", "artist_name", "artist_uri", "album_name", "album_uri", "duration_ms")
    # one row for each different record of a track, then the first of them
    records = ordered.groupBy("track_uri", *attributes).agg(F.min("_order").alias("_first"))
    least = records.groupBy("track_uri").agg(F.min(F.struct("_first", *attributes)).alias("_least"), (F.count("*") - 1).alias("conflicts"))
    tracks = least.select("track_uri", "_least._first", "conflicts", *(f"_least.{c}" for c in attributes))
    tracks = with_dense_id(tracks, F.col("_first"), "track_uri", name="track")
    tables = {"tracks": tracks.drop("_first")}
    for kind in ("artist", "album"):
        own = tracks.groupBy(f"{kind}_uri").agg(F.min("_first").alias("_first"), F.min_by(f"{kind}_name", "_first").alias("name"))
        tables[f"{kind}s"] = with_dense_id(own, F.col("_first"), f"{kind}_uri", name=kind).drop("_first")
    lists = with_dense_id(ordered.groupBy("file", "playlist", "name").agg(F.min("_order").alias("_first")), F.col("_first"), "file", name="seq").drop("_first")
    tables["playlists"] = lists
    tables["entries"] = ordered.join(lists.select("file", "playlist", "seq"), ["file", "playlist"]).join(tracks.select("track_uri", "track"), "track_uri").select("seq", "pos", "track")
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")


def store_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def store_sequences(spark: SparkSession, path: str, min_length: int = 1, most: int | None = None) -> DataFrame:
    """(seq, pos, item) of the store's playlists of ``min_length``, the first ``most`` of them."""
    entries = store_table(spark, path, "entries").withColumnRenamed("track", "item")
    kept = entries.groupBy("seq").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_length).select("seq")
    if most is not None:
        kept = kept.orderBy("seq").limit(most)
    return entries.join(kept, "seq", "left_semi")


def gathered(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``chosen`` sequences (seq, ord), to be read in order of ord and pos."""
    return rows.join(chosen, "seq")


def artist_genres(spark: SparkSession, path: str) -> DataFrame:
    """(artist, genres) of JSON lines; genres keep their order by votes."""
    rows = spark.read.schema("artist string, mbid string, genres array<struct<name:string,count:int>>").json(path)
    return rows.select("artist", "mbid", F.transform("genres", lambda g: g["name"]).alias("genres"))


def artists_in_dump(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(mbid, link, genres) of an artist dump's lines that link to one of ``wanted`` (link)."""
    schema = "id string, genres array<struct<name:string,count:int>>, relations array<struct<url:struct<resource:string>>>"
    rows = spark.read.schema(schema).json(path).select(F.col("id").alias("mbid"), "genres", F.explode("relations.url.resource").alias("link"))
    return rows.join(wanted.select("link").distinct(), "link", "left_semi")


def listener_export(spark: SparkSession, path: str) -> DataFrame:
    """(sec, ms_played, skipped, uri, title, artist) of a listener's export in JSON (unpacked); rows without a track are left out."""
    schema = "ts string, ms_played long, skipped boolean, spotify_track_uri string, master_metadata_track_name string, master_metadata_album_artist_name string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).filter("spotify_track_uri IS NOT NULL")
    return rows.select(F.unix_seconds(F.to_timestamp("ts")).alias("sec"), "ms_played", F.coalesce("skipped", F.lit(False)).alias("skipped"), F.col("spotify_track_uri").alias("uri"), F.col("master_metadata_track_name").alias("title"), F.col("master_metadata_album_artist_name").alias("artist"))
