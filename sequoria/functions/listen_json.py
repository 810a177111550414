"""Fields of a listen's JSON, whose leaves have mixed types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Link and id formats.
SPOTIFY_TRACK = r"(?:open\.spotify\.com/(?:intl-[a-z]+/)?track/|spotify:track:)([A-Za-z0-9]{22})"
SPOTIFY_ARTIST = r"(?:open\.spotify\.com/(?:intl-[a-z]+/)?artist/|spotify:artist:)([A-Za-z0-9]{22})"
MBID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
INFO = "$.track_metadata.additional_info"


def _text(line: Column, path: str) -> Column:
    """A leaf as text; null where it is missing."""
    return F.get_json_object(line, path)


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def spotify_track_id(line: Column) -> Column:
    found = [F.regexp_extract(_or_empty(_text(line, f"{INFO}.{field}")), SPOTIFY_TRACK, 1) for field in ("spotify_id", "origin_url")]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in found), F.lit(""))


def artist_mbid(line: Column) -> Column:
    value = F.lower(F.coalesce(_text(line, f"{INFO}.artist_mbids[0]"), _text(line, f"{INFO}.lastfm_artist_mbid")))
    return F.when(value.rlike(MBID), value).otherwise(F.lit(""))


def spotify_artist_id(line: Column) -> Column:
    return F.regexp_extract(_or_empty(_text(line, f"{INFO}.spotify_artist_ids[0]")), SPOTIFY_ARTIST, 1)


def duration_ms(line: Column) -> Column:
    """duration_ms, else seconds in duration; 0 where neither is a positive number or a text of digits."""

    def positive(field: str, scale: int) -> Column:
        number = _text(line, f"{INFO}.{field}")
        value = number.try_cast("double")
        in_quotes = _text(line, INFO).rlike(f'[{{,]"{field}":"')
        valid = F.when(in_quotes, number.rlike("^[0-9]+$")).otherwise(number.rlike(r"^[0-9.]+(?:[eE][+-]?[0-9]+)?$"))
        return F.when(valid & (value > 0), F.floor(value * scale).cast("long"))

    return F.coalesce(positive("duration_ms", 1), positive("duration", 1000), F.lit(0).cast("long"))


def parsed_listen(line: Column) -> list[Column]:
    """The columns of a listen; ``user_id`` and ``ts`` are null where the line cannot be read."""
    artist = _or_empty(_text(line, "$.track_metadata.artist_name"))
    return [
        _text(line, "$.user_id").try_cast("long").alias("user_id"),
        _text(line, "$.timestamp").try_cast("long").alias("ts"),
        artist.alias("artist"),
        F.coalesce(_text(line, f"{INFO}.artist_names[0]"), artist).alias("first_artist"),
        _or_empty(_text(line, "$.track_metadata.track_name")).alias("title"),
        _or_empty(_text(line, "$.track_metadata.release_name")).alias("release"),
        spotify_track_id(line).alias("spotify_id"),
        _or_empty(_text(line, f"{INFO}.recording_mbid")).alias("recording_mbid"),
        duration_ms(line).alias("duration_ms"),
        artist_mbid(line).alias("artist_mbid"),
        spotify_artist_id(line).alias("spotify_artist_id"),
    ]
