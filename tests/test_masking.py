"""Masking against the same rules written with Python's ``re``, on real texts and on edge cases."""

import re

import pytest
from pyspark.sql import functions as F

from tablewise.functions import masking


def luhn(digits):
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    def plain(kind, pattern, t):
        return re.sub(pattern.removeprefix("(?U)"), masking.PLACEHOLDER[kind], t)

    for kind in ("email", "iban", "national_id", "ip"):
        text = plain(kind, {"email": masking.EMAIL, "iban": masking.IBAN,
                            "national_id": masking.NATIONAL_ID, "ip": masking.IPV4}[kind], text)

    def card(m):
        d = re.sub(r"\D", "", m[0])
        return "<card>" if 13 <= len(d) <= 19 and luhn(d) else m[0]

    def phone(m):
        n = sum(c.isdigit() for c in m[0])
        return "<phone>" if 7 <= n <= 15 and m[0].count("(") == m[0].count(")") else m[0]

    text = re.sub(masking.CARD.removeprefix("(?U)"), card, text)
    return re.sub(masking.PHONE.removeprefix("(?U)"), phone, text)


def test_all_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("text", masking.mask_text(F.col("text")).alias("m")).collect()
    assert all(brute(r["text"]) == r["m"] for r in rows)
    assert any(r["text"] != r["m"] for r in rows)


CASES = [
    ("write to a.b+c@ex-ample.org now", "write to <email> now", ["email"]),
    ("host 192.168.0.1.", "host <ip>.", ["ip"]),
    ("DE89370400440532013000", "<iban>", ["iban"]),
    ("078-05-1120", "<id>", ["national_id"]),
    ("4111111111111111", "<card>", ["card"]),
    ("1234567890123456", "1234567890123456", []),
    ("call +49 170 1234567 today", "call <phone> today", ["phone"]),
    ("200 (26.1% with PokeBall", "200 (26.1% with PokeBall", []),
    ("(555) 123-4567", "(555) 123-4567", []),
    ("a@b.co and 10.0.0.1 and 4111 1111 1111 1111", "<email> and <ip> and <card>", ["email", "ip", "card"]),
    ("", "", []),
    (None, None, []),
]


def test_cases_and_kinds(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    rows = df.select("i", masking.mask_text(F.col("t")).alias("m"), masking.mask_report(F.col("t")).alias("r")).collect()
    for r in rows:
        _, want, kinds = CASES[r["i"]]
        assert r["m"] == want and r["r"]["text"] == want and r["r"]["kinds"] == kinds


@pytest.mark.parametrize(
    ("name", "sensitive"),
    [("c_name", True), ("Email", True), ("home_address", True), ("names", False), ("revenue", False),
     ("zip", True), ("zipper", False), ("ship_date", False), ("ip", True)],
)
def test_sensitive_names(name, sensitive):
    assert masking.is_sensitive(name) is sensitive


def test_table_is_redacted_by_name_and_content(spark):
    df = spark.createDataFrame([("Ada", "ada@x.org", 3), (None, "none", 4)], "full_name string, note string, n int")
    got = [tuple(r) for r in masking.mask_table(df).orderBy("n").collect()]
    assert got == [("<redacted>", "<email>", 3), (None, "none", 4)]
