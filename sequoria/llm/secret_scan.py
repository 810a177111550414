"""Secret scans: known shapes, and a randomness test battery for the rest. DataFrame functions only.

A long unbroken string is a discovery if no test of the battery rejects that its encoding's
symbols are random, and if its symbol counts and runs are so unlike text that
false-discovery control over the text passes it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequoria.llm import spans as s

_VALUE = "[A-Za-z0-9+/_.=-]+"
_SEP = "[\"']?\\x20*[:=]\\x20*[\"']?"
ASSIGN = f"(?:(?i)password|passwd|secret|token|api_?key)(?-i){_SEP}{_VALUE}"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: What the battery looks at: long unbroken strings of an encoding's characters.
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets in the order in which they are tried; the smallest that holds a string is its encoding.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "upper_hex": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "upper_base36": _DIGITS + _UPPER,
    "alphanumeric": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
#: Shares of a-z in text, in parts of 10,000: rounded averages of languages in Latin script. A text's own letters count beside PRIOR_LETTERS of these.
TEXT_LETTERS = (850, 130, 330, 400, 1350, 150, 170, 350, 750, 20, 60, 430, 260, 760, 680, 230, 30, 680, 680, 750, 350, 100, 110, 20, 120, 40)
PRIOR_LETTERS = 300
#: How names, paths and identifiers go on: shares of lower case, upper case, digits and other characters after one of each.
TEXT_STEPS = {"l": (0.88, 0.04, 0.03, 0.05), "u": (0.45, 0.45, 0.05, 0.05), "d": (0.1, 0.1, 0.6, 0.2), "o": (0.5, 0.25, 0.2, 0.05)}
_CLASSES = "ludo"
#: A string that a test of the battery rejects at this level is not random.
BATTERY_LEVEL = 0.01
#: Expected share of false discoveries among the strings reported of a text.
FALSE_DISCOVERY = 0.01


def _two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of a normal Z, by a logistic approximation (error below 0.0002)."""
    z = F.least(F.abs(z), F.lit(12.0))
    return 2 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _count(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def encoding(value: Column) -> Column:
    """The smallest alphabet that holds ``value``, null if none does."""
    out = F.lit(None).cast("string")
    for alphabet in reversed(sorted(ENCODINGS.values(), key=len)):
        out = F.when(F.translate(value, alphabet, "") == "", alphabet).otherwise(out)
    return out


def battery(value: Column, alphabet: Column) -> Column:
    """P-value of ``value`` under the hypothesis that it is uniform over ``alphabet``: what a discovery must not be too small in.

    The smallest of three tests times three: chi-squared of the symbol counts
    (Wilson-Hilferty), runs above and below the middle of the alphabet, and the
    lag-1 serial correlation of the symbols' numbers.
    """
    m, n = F.length(alphabet), F.length(value).cast("double")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    squares = total(F.transform(F.split(alphabet, ""), lambda c: F.pow(n - F.length(F.replace(value, c, F.lit(""))), F.lit(2.0))))
    df = m - 1.0
    z_chi = (F.cbrt((squares * m / n - n) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    p_chi = F.when(z_chi > 0, _two_sided(z_chi) / 2).otherwise(F.lit(0.5))
    low = F.floor(m / 2).cast("int")
    half = F.call_function("translate", value, alphabet, F.concat(F.repeat(F.lit("0"), low), F.repeat(F.lit("1"), m - low)))
    ones = _count(half, "1")
    both = 2 * ones * (n - ones)
    runs = 1 + _count(half, "01") + _count(half, "10")
    variance = both * (both - n) / (n * n * (n - 1))
    p_runs = F.when(variance > 0, _two_sided((runs - 1 - both / n) / F.sqrt(variance))).otherwise(F.lit(0.0))
    numbers = F.transform(F.split(value, ""), lambda c: F.instr(alphabet, c) - 1.0 - (m - 1) / 2)
    products = F.zip_with(F.slice(numbers, 1, F.length(value) - 1), F.slice(numbers, 2, F.length(value)), lambda x, y: x * y)
    p_serial = _two_sided(total(products) / F.greatest(total(F.transform(numbers, lambda x: x * x)), F.lit(1e-9)) * F.sqrt(n))
    return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))


def _once(value: Column, use) -> Column:
    """``use`` of ``value``, which is made once however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def letter_logs(text: Column) -> Column:
    """Logarithms of the shares of a-z in a text without its candidates, with PRIOR_LETTERS of the fixed shares added."""
    count = lambda plain: F.transform(F.array(*map(F.lit, _LOWER)), lambda c: F.length(plain) - F.length(F.replace(plain, c, F.lit(""))))
    prior = F.array(*(F.lit(x / sum(TEXT_LETTERS) * PRIOR_LETTERS) for x in TEXT_LETTERS))
    added = _once(_once(F.lower(F.regexp_replace(text, CANDIDATE, " ")), count), lambda counts: F.zip_with(counts, prior, lambda n, x: n + x))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    return _once(F.struct(added.alias("n")), lambda x: _once(F.struct(x["n"].alias("n"), total(x["n"]).alias("total")), lambda y: F.transform(y["n"], lambda n: F.log(n / y["total"]))))


def text_log(value: Column, logs: Column) -> Column:
    """Logarithm of the chance of ``value`` as text: its symbol counts by the text's own letters, its runs of classes by TEXT_STEPS."""
    symbol = lambda c: F.coalesce(F.get(logs, F.instr(F.lit(_LOWER), F.lower(c)) - 1), F.when(c.rlike("[0-9]"), math.log(0.1)).otherwise(math.log(0.25)))
    symbols = F.aggregate(F.split(value, ""), F.lit(0.0), lambda acc, c: acc + symbol(c))
    kinds = F.split(F.translate(value, _LOWER + _UPPER + _DIGITS + "+/_-", "l" * 26 + "u" * 26 + "d" * 10 + "o" * 4), "")
    steps = F.create_map(*(F.lit(x) for a, shares in TEXT_STEPS.items() for b, share in zip(_CLASSES, shares) for x in (a + b, math.log(share))))
    pairs = F.zip_with(F.slice(kinds, 1, F.length(value) - 1), F.slice(kinds, 2, F.length(value)), lambda a, b: F.element_at(steps, F.concat(a, b)))
    runs = F.aggregate(pairs, F.lit(math.log(0.25)), lambda acc, x: acc + x)
    return symbols + runs


def p_value(value: Column, alphabet: Column, logs: Column) -> Column:
    """The p-value of a candidate as a discovery, against text; 1 where the battery rejects randomness or ``alphabet`` is null.

    ``alphabet`` is its ``encoding``. The likelihood of its symbols and runs as text, over
    that of the encoding's uniform symbols, bounds the chance of text that looks so by
    Markov's inequality, at any length; the choice among the encodings counts as so many
    tests.
    """
    ratio = text_log(value, logs) + F.length(value) * F.log(F.length(alphabet).cast("double")) + math.log(len(ENCODINGS))
    return F.when(battery(value, alphabet) >= BATTERY_LEVEL, F.exp(F.greatest(F.least(ratio, F.lit(0.0)), F.lit(-600.0)))).otherwise(F.lit(1.0))


def discoveries(text: Column, candidates: Column) -> Column:
    """The candidates that pass Benjamini-Hochberg; the number of tests grows with the text's length."""
    told = F.transform(candidates, lambda c: F.struct(encoding(c["value"]).alias("alphabet"), c.alias("span")))
    scored = lambda logs: F.transform(told, lambda c: F.struct(p_value(c["span"]["value"], c["alphabet"], logs).alias("p"), c["span"].alias("span")))
    likely = F.sort_array(F.filter(_once(letter_logs(text), scored), lambda c: c["p"] < FALSE_DISCOVERY))

    def passed(x: Column) -> Column:
        places = F.transform(x["likely"], lambda c, i: F.when(c["p"] * x["tests"] <= FALSE_DISCOVERY * (i + 1), i + 1).otherwise(F.lit(0)))
        return F.transform(F.slice(x["likely"], 1, F.coalesce(F.array_max(places), F.lit(0))), lambda c: c["span"])

    return _once(F.struct(likely.alias("likely"), F.greatest(F.size(candidates), (F.length(text) / 20).cast("int")).alias("tests")), passed)


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) as (doc_id, text, base, found): arrays of spans of every row.

    ``base`` has the kinds assign, access and hex; ``found`` the discoveries of the battery
    (kind random) that overlap none of them. A null text counts as empty; empty texts have
    no spans; repeated rows stay; other columns are left out. No shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda v: F.regexp_extract(v, f"^[A-Za-z_]+{_SEP}({_VALUE})$", 1)
    always = lambda v: F.lit(True)
    base = F.concat(s.matches(text, "assign", 0, ASSIGN, lambda v: F.length(value(v)) >= 6), s.matches(text, "access", 1, ACCESS, always), s.matches(text, "hex", 2, HEX, always))
    free = lambda base: F.filter(s.matches(F.col("text"), "random", 3, CANDIDATE, always), lambda c: ~F.exists(base, lambda b: (b["begin"] < c["end"]) & (c["begin"] < b["end"])))
    found = _once(_once(F.col("base"), free), lambda c: F.when(F.size(c) > 0, discoveries(F.col("text"), c)).otherwise(c))
    return docs.select("doc_id", text.alias("text")).withColumn("base", base).select("doc_id", "text", "base", found.alias("found"))


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans of every row; see ``find_secrets``."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(s.joined(F.col("base")), 256).alias("base_sha256"), s.joined(F.concat("base", "found")).alias("spans"), F.size("found").cast("long").alias("n_random"))
