"""Secret scan against Python's regular expressions on whole texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from basketry.llm import secrets


def brute_force(text, rules=secrets.BASE_RULES + secrets.EXTRA_RULES):
    out = []
    for i, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", (re.I if r.ignore_case else 0) | re.A):
            if len(m[r.group]) >= r.min_length:
                out.append((m.start(), i, r.kind, m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def scan(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return secrets.scan_secrets(docs, **kw).select("doc_id", secrets.span_text(F.col("secret_spans")).alias("s")).collect()


CASES = [
    None, "", "nothing here", "Password: abcdefgh", "password=short", "api_key = \"A1b2C3d4E5\" and API-KEY=notone123",
    "token: secret: abcdefghij", "token=token=abcdefgh1", "secret=abc\x01defgh12 \x01 passwd:'12345678'",
    "AKIA" + "Z" * 12, "AKIA" + "Z" * 11, "xAKIAAKIA" + "0" * 20, "f" * 32, "f" * 31 + "g" + "0" * 40,
    "é" * 50 + " token = \"" + "0123456789abcdef" * 3 + "\" \U0001f600 passwd=zzzzzzzzz",
    "ghp_" + "a" * 36 + " xoxb-1234567890123 AIza" + "b" * 35, "eyJhbGciOi.eyJzdWIiOiIx.abcdefghijkl",
    "-----BEGIN RSA PRIVATE KEY-----\nMII", "long " * 30000 + "secret:abcdefgh9" + " end" * 10,
]


def test_matches_python_regular_expressions(spark):
    got = scan(spark, list(enumerate(CASES)))
    assert {r["doc_id"]: r["s"] for r in got} == {i: brute_force(t) for i, t in enumerate(CASES)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    r = random.Random(seed)
    parts = ["token", "ToKeN", "=", ":", " ", "\"", "'", "api", "_", "key", "abcdefgh", "AKIA", "ABCDEFGHIJKL", "0f" * 9, "é", "\n"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for i in range(200)]
    assert {x["doc_id"]: x["s"] for x in scan(spark, rows)} == {i: brute_force(t) for i, t in rows}


def test_nulls_repeated_rows_clashing_columns_and_empty_tables(spark):
    rows = [(None, "passwd=abcdefgh", "x"), (7, "passwd=abcdefgh", "y"), (7, "passwd=abcdefgh", "y"), (7, "clean", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, secret_spans string")
    got = secrets.scan_secrets(docs).collect()
    assert sorted(len(r["secret_spans"]) for r in got) == [0, 1, 1, 1]
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_trigram_queries():
    (clause,) = secrets.trigram_query(r"(abcd|abxyz?)[0-9]+")
    assert frozenset({"abc", "bcd"}) in clause and frozenset({"abx", "bxy"}) in clause
    assert secrets.trigram_query("[0-9a-f]+") == []
    for rule in secrets.BASE_RULES + secrets.EXTRA_RULES:
        if rule.kind != "hex":
            assert secrets.trigram_query(rule.pattern)
