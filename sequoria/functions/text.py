"""Cleaning of names and the keys made of them."""

from __future__ import annotations

import html
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The notes that are taken out of names, as patterns (Java syntax, Unicode classes).
FEATURING = r"(?U)\s*[\(\[](?:feat\.?|ft\.?|featuring|with)\s[^\)\]]*[\)\]]|\s+(?:feat\.?|ft\.?|featuring)\s.*$"
VERSION_WORDS = (
    r"remaster(?:ed)?(?:\s+version)?|\d{4}\s+remaster(?:ed)?|"
    r"(?:single|album|lp|single/lp|lp/single|original|soundtrack|film|movie|radio|mono|stereo)\s+version|"
    r"radio\s+edit|mono|stereo|explicit|edited|full\s+length|bonus\s+track"
)
VERSION_NOTE = rf"(?Ui)\s+-\s+(?:[^-]*\s)?(?:{VERSION_WORDS})(?:\s[^-]*)?$|\s*[\(\[](?:[^\)\]]*\s)?(?:{VERSION_WORDS})(?:\s[^\)\]]*)?[\)\]]"
YEAR_LEFT = r"(?U)\s+-\s+\d{4}$"
_BEYOND_ASCII = regex.compile(r"[^\x00-\x7F]")
#: Characters of a combining class.
_MARKS = regex.compile(r"[^\p{ccc=0}]")


@lru_cache(maxsize=1 << 16)
def _letter(char: str) -> str:
    bare = _MARKS.sub("", unicodedata.normalize("NFKD", char))
    return bare if bare.isascii() else unicodedata.normalize("NFKC", char)


def _plain(text: str) -> str:
    """Accents off where a plain ASCII letter is left; other scripts keep their marks."""
    return text if text.isascii() else _BEYOND_ASCII.sub(lambda m: _letter(m[0]), unicodedata.normalize("NFC", text))


def _folded(text: str) -> str:
    return " ".join(_MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold().split())


@F.pandas_udf(StringType())
def _unescaped_lower_plain(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _plain(html.unescape(t).lower()), na_action="ignore")


@F.pandas_udf(StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """Accents off Latin letters. Spark has no Unicode normal forms, so this is an Arrow UDF."""
    return text.map(_plain, na_action="ignore")


@F.pandas_udf(StringType())
def name_key(text: pd.Series) -> pd.Series:
    """What a typed name is compared by: no marks, case or repeated spaces."""
    return text.map(_folded, na_action="ignore")


def ascii_name_key(text: Column) -> Column:
    """``name_key`` of ASCII text, inside the JVM."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def words_only(text: Column) -> Column:
    """"&" as "and", punctuation as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" and ")), r"(?U)[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


def clean_text(text: Column) -> Column:
    return words_only(_unescaped_lower_plain(text))


def ascii_clean_text(text: Column) -> Column:
    """``clean_text`` of ASCII text without character references, inside the JVM."""
    return words_only(F.lower(text))


def without_notes(title: Column) -> Column:
    """A title without featured artists, version notes and the years that these leave, however many are stacked.

    A pass that changes a title takes off a dash or an opening bracket, or all behind a featured
    artist, so a title settles in as many passes as it has of these and one.
    """
    def once(text: Column, _: Column) -> Column:
        for pattern in (FEATURING, VERSION_NOTE, YEAR_LEFT):
            text = F.regexp_replace(text, pattern, "")
        return text

    passes = F.sequence(F.lit(0), F.length(F.regexp_replace(title, r"[^(\[-]", "")))
    return F.aggregate(passes, title, once)


def clean_title(title: Column) -> Column:
    return clean_text(without_notes(title))


def clean_artist(artist: Column) -> Column:
    return clean_text(F.regexp_replace(artist, FEATURING, ""))


def song_key(artist: Column, title: Column) -> Column:
    """"artist|title", both cleaned; a missing name counts as empty."""
    return F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in (clean_artist(artist), clean_title(title))))


def with_song_keys(plays: DataFrame, artist: str = "artist", title: str = "title") -> DataFrame:
    """``plays`` with ``song_key``; each different pair of names is cleaned once."""
    names = plays.select(artist, title).distinct().withColumn("song_key", song_key(F.col(artist), F.col(title)))
    both = plays.alias("p").join(names.alias("n"), F.col(f"p.{artist}").eqNullSafe(F.col(f"n.{artist}")) & F.col(f"p.{title}").eqNullSafe(F.col(f"n.{title}")), "left")
    return both.select("p.*", "n.song_key")


def name_words(name: Column) -> Column:
    """Lower-case words of a name, in order."""
    return F.regexp_extract_all(F.lower(name), F.lit(r"(?U)[\p{L}\p{N}_]+"), F.lit(0))


def name_splits(key: Column) -> Column:
    """Every (track, artist) at a " - " inside a name key, both not empty."""
    parts = F.split(key, " - ")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), " - ").alias("track"), F.array_join(F.slice(parts, i + 1, F.size(parts)), " - ").alias("artist")))
    return F.filter(pairs, lambda p: (p["track"] != "") & (p["artist"] != ""))
