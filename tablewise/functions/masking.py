"""Masking of personal data as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.text import let, substitute
from tablewise.functions.types import ident

# Words in a column name that mark the column as personal.
SENSITIVE_WORDS = (
    "name", "firstname", "first_name", "lastname", "last_name", "surname", "fullname", "full_name",
    "email", "e_mail", "mail", "phone", "telephone", "tel", "mobile", "msisdn", "fax",
    "address", "street", "addr", "postcode", "postal_code", "zip", "zipcode",
    "ssn", "sin", "nino", "national_id", "passport", "licence", "license",
    "iban", "bic", "swift", "account_number", "card_number", "credit_card", "cc_number",
    "dob", "date_of_birth", "birth_date", "birthdate",
    "latitude", "longitude", "lat", "lon", "lng", "ip", "ip_address", "user_agent",
)
# What each kind looks like, and its placeholder. (?U) gives \w, \d, \b and \s the
# Unicode meaning.
EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]{2,}"
IBAN = r"(?U)\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"
NATIONAL_ID = r"(?U)\b\d{3}-\d{2}-\d{4}\b"
IPV4 = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
CARD = r"(?U)\b(?:\d[ -]?){13,19}\b"
PHONE = r"(?U)(?<!\w)\+?\d[\d\s().-]{7,17}\d(?!\w)"
PLACEHOLDER = {
    "email": "<email>",
    "iban": "<iban>",
    "national_id": "<id>",
    "ip": "<ip>",
    "card": "<card>",
    "phone": "<phone>",
}
REDACTED = "<redacted>"
ANY_DIGIT = r"(?U)\d"

_SENSITIVE = re.compile(
    r"(?:^|_|\b)(?:" + "|".join(SENSITIVE_WORDS) + r")(?:$|_|\b)", re.IGNORECASE
)


def is_sensitive(column: str) -> bool:
    """Whether the column's name alone marks it as personal."""
    return _SENSITIVE.search(column) is not None


def luhn_valid(digits: Column) -> Column:
    """Luhn checksum over a string of ASCII digits."""
    value = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))

    def weigh(d: Column, i: Column) -> Column:
        doubled = d * (1 + i % 2)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    total = F.aggregate(F.transform(value, weigh), F.lit(0), lambda acc, d: acc + d)
    return total % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _is_card(match: Column) -> Column:
    digits = _digits(match)
    return F.length(digits).between(13, 19) & luhn_valid(digits)


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _is_phone(match: Column) -> Column:
    balanced = _count(match, "(") == _count(match, ")")
    return F.length(_digits(match)).between(7, 15) & balanced


#: Replaced without a further test, in this order; then those whose match must pass a test.
_PLAIN = (("email", EMAIL), ("iban", IBAN), ("national_id", NATIONAL_ID), ("ip", IPV4))
_TESTED = (("card", CARD, _is_card), ("phone", PHONE, _is_phone))


def mask_text(text: Column) -> Column:
    """The text with every recognised value replaced by its placeholder.

    Cards go before phones: both match long digit runs, and a Luhn-valid run is a card. Most texts have no digit, which every
    kind but e-mail needs.
    """


    def rest(t: Column) -> Column:
        for kind, _ in _PLAIN[1:]:
            t = mask_one(t, kind)
        for kind, _, _ in _TESTED:
            t = let(t, lambda x: mask_one(x, kind))
        return t

    return let(mask_one(text, "email"), lambda t: F.when(t.rlike(ANY_DIGIT), rest(t)).otherwise(t))


def mask_report(text: Column) -> Column:
    """Struct of the masked ``text`` and the ``kinds`` masked in it, in masking order."""

    def after(state: Column, kind: str) -> Column:
        return let(state, lambda s: let(mask_one(s["text"], kind), lambda masked: _step(s, kind, masked)))

    def rest(state: Column) -> Column:
        for kind in list(PLACEHOLDER)[1:]:
            state = after(state, kind)
        return state

    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return let(after(start, "email"), lambda s: F.when(s["text"].rlike(ANY_DIGIT), rest(s)).otherwise(s))


def mask_one(text: Column, kind: str) -> Column:
    """Apply the rule of a single kind."""
    mask = F.lit(PLACEHOLDER[kind])
    for name, pattern in _PLAIN:
        if name == kind:
            masked = F.regexp_replace(text, pattern, PLACEHOLDER[kind])
            return F.when(text.contains("@"), masked).otherwise(text) if kind == "email" else masked
    pattern, test = next((p, t) for name, p, t in _TESTED if name == kind)
    return substitute(text, pattern, lambda m: F.when(test(m), mask).otherwise(m))


def _step(state: Column, kind: str, masked: Column) -> Column:
    """A kind was found where its rule changed the text: no placeholder looks like what it stands for."""
    added = F.when(masked != state["text"], F.array(F.lit(kind))).otherwise(F.array().cast("array<string>"))
    return F.struct(masked.alias("text"), F.concat(state["kinds"], added).alias("kinds"))


def mask_value(value: Column, column: str) -> Column:
    """Mask one cell: redact by column name, else by content; null becomes an empty string."""
    if is_sensitive(column):
        return F.when(value.isNull(), F.lit("")).otherwise(F.lit(REDACTED))
    return F.coalesce(mask_text(value.cast("string")), F.lit(""))


def kinds_by(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """How many texts of each group hold each kind of personal value."""
    kinds = mask_report(F.col(ident(column)))["kinds"]
    hits = df.select(*[ident(c) for c in by], F.explode(kinds).alias("kind"))
    return hits.groupBy(*[ident(c) for c in by], "kind").agg(F.count("*").alias("n"))


def mask_table(df: DataFrame) -> DataFrame:
    """Every column masked: redacted when its name is sensitive, else masked by content if text."""
    out = []
    for name, dtype in df.dtypes:
        col = F.col(ident(name))
        if is_sensitive(name):
            out.append(F.when(col.isNotNull(), F.lit(REDACTED)).alias(name))
        elif dtype == "string":
            out.append(mask_text(col).alias(name))
        else:
            out.append(col)
    return df.select(*out)
