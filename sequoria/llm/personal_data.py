"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequoria.llm import spans as s

# Repeats are possessive, and a run is only entered at its start: time stays linear in long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Only the head is matched here, so what follows an account number, or looks like one before it, takes nothing from it.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Countries of the IBAN registry by the length of their account numbers.
_IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_REST, _END = r"[0-9]{2}(?:\x20?[A-Z0-9]){%d}", "(?![A-Za-z0-9])"
_LISTED = "^(?:" + "|".join(f"(?:{c.replace(' ', '|')}){_REST % (n - 4)}" for n, c in _IBAN_LENGTHS.items()) + ")" + _END
_UNLISTED = f"^(?!{'|'.join(_IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}"

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def is_luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def is_mod97(value: Column) -> Column:
    """Whether an account number without spaces passes the mod-97 check."""
    turned = F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4))
    number = lambda c: F.when(F.instr(F.lit(_LETTERS), c) > 0, F.instr(F.lit(_LETTERS), c) + 9).otherwise(F.try_to_number(c, F.lit("9")).cast("int"))
    step = lambda acc, c: F.when(F.instr(F.lit(_LETTERS), c) > 0, (acc * 100 + number(c)) % 97).otherwise((acc * 10 + number(c)) % 97).cast("int")
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _whole_ibans(text: Column, heads: Column) -> Column:
    """Spans of the account numbers whose first four characters are ``heads``: of their country's length, in other countries the longest that passes."""

    def whole(x: Column) -> Column:
        rest = F.substring(text, x["begin"] + 1, F.lit(68))
        proposed = F.array(*(F.regexp_extract(rest, p, 0) for p in (_LISTED, *(_UNLISTED + _REST % n + _END for n in range(30, 10, -1)))))
        value = F.get(F.filter(proposed, lambda v: (v != "") & is_mod97(F.replace(v, F.lit(" "), F.lit("")))), F.lit(0))
        return F.transform(F.array(value), lambda v: F.struct(x["kind"].alias("kind"), x["rank"].alias("rank"), x["begin"].alias("begin"), (x["begin"] + F.length(v)).alias("end"), v.alias("value")))

    return F.when(F.size(heads) > 0, F.filter(F.flatten(F.transform(heads, whole)), lambda x: x["value"].isNotNull())).otherwise(heads)


def _ip_parts(value: Column) -> Column:
    return value.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$")


@dataclass(frozen=True)
class Kind:
    """``prior``: score of a confirmed span; ``words``: what raises it when near; ``base``: kept at any score; ``whole``: makes spans of heads."""

    name: str
    pattern: str
    confirm: object
    prior: float
    words: str
    base: bool = True
    whole: object = None


KINDS = (
    Kind("email", EMAIL, lambda v: F.lit(True), 0.9, "mail|contact|write to"),
    Kind("ip", IP, _ip_parts, 0.6, "ip|host|server|address|login"),
    Kind("card", CARD, lambda v: F.length(digits(v)).between(12, 19) & is_luhn(digits(v)), 0.7, "card|visa|credit|amex|payment|karte|carte|tarjeta"),
    Kind("phone", PHONE, lambda v: F.length(digits(v)).between(9, 15), 0.6, "phone|tel|call|mobile|fax|anruf"),
    Kind("iban", IBAN, lambda v: F.lit(True), 0.8, "iban|account|bank|konto|cuenta|compte", False, _whole_ibans),
    Kind("ssn", SSN, lambda v: ~v.rlike("^(000|666|9)|-00-|-0000$"), 0.3, "ssn|social security|sozialversicherung", False),
)
#: Code points before a span in which words count, what they add, and the least score of an added span.
NEAR, CONTEXT_GAIN, LEAST_SCORE = 48, 0.3, 0.5


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) as (doc_id, base, added, scores) with spans of every row.

    ``base`` has the confirmed spans of the base kinds, ``added`` those of other kinds whose
    score reaches LEAST_SCORE, ``scores`` a score for each span of both. A null text
    counts as empty; empty texts have no spans; repeated rows stay; other columns are left
    out. No shuffle, whole texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = docs.select("doc_id", text.alias("text")).withColumns({k.name: s.matches(F.col("text"), k.name, i, k.pattern, k.confirm) for i, k in enumerate(KINDS)})

    def score(x: Column) -> Column:
        before = F.lower(F.substring(F.col("text"), F.greatest(x["begin"] + 1 - NEAR, F.lit(1)), F.least(x["begin"], F.lit(NEAR))))
        out = F.lit(0.0)
        for k in KINDS:
            out = F.when(x["kind"] == k.name, k.prior + F.when(before.rlike(f"(^|[^a-z])({k.words})"), CONTEXT_GAIN).otherwise(0.0)).otherwise(out)
        return F.least(out, F.lit(1.0))

    spans = spans.withColumns({k.name: k.whole(F.col("text"), F.col(k.name)) for k in KINDS if k.whole})
    names = lambda base: [k.name for k in KINDS if k.base == base]
    scored = spans.select("doc_id", "text", F.concat(*names(True)).alias("base"), F.concat(*names(False)).alias("other"))
    scored = scored.select("doc_id", "text", "base", F.when(F.size("other") > 0, F.filter("other", lambda x: score(x) >= LEAST_SCORE)).otherwise(F.col("other")).alias("added"))
    both = F.concat("base", "added")
    return scored.select("doc_id", "base", "added", F.when(F.size(both) > 0, F.transform(both, lambda x: F.round(score(x), 2))).otherwise(F.array().cast("array<double>")).alias("scores"))


def personal_data_report(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans of every row; see ``find_personal_data``."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_personal_data(docs).select("doc_id", *(count(k.name) for k in KINDS if k.base), F.sha2(s.joined(F.col("base")), 256).alias("base_sha256"), s.joined(F.concat("base", "added")).alias("spans"), "scores")
