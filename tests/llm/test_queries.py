"""The registered queries on whole tables: equal to their SQL, or to the digest columns in plain Python."""

from __future__ import annotations

import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest

from basketry.llm import oracle, queries

SMALL = "/root/testdata/sf0.001"


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    found = queries.queries()[name](spark, SMALL)
    wanted = duck.execute(oracle.oracle_sql()[name])
    columns, rows = [c[0] for c in wanted.description], wanted.fetchall()
    assert rows and _rows(found.columns, [tuple(r) for r in found.collect()]) == _rows(columns, rows)


def test_op1_edited_texts(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op1_fingerprints(spark, SMALL).collect()}
    assert sorted(rows) == [d for d, _ in texts]
    for i, (doc_id, text) in enumerate(texts):
        following = texts[(i + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = rows[doc_id]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == edited)


def test_op4_index_against_the_tokenizer(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    start, wanted = 0, []
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        wanted.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = queries.op4_token_ids(spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, found.collect())) == wanted


@pytest.mark.parametrize(
    "query, modulus, held, threshold", [(queries.op5_toxicity, 5, 0, 0.5), (queries.op6_quality, 4, 2, 0.7)]
)
def test_classifier_columns(spark, texts, query, modulus, held, threshold):
    rows = query(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == [d for d, _ in texts]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
