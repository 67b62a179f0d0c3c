"""Poisson replication: counts, order and rates."""

import hashlib
import math

from basketry.llm import mixing


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy string")


def expected_count(rate, seed, key):
    u = int(hashlib.md5(f"{seed}|count|{'' if key is None else key}".encode()).hexdigest()[:13], 16) / 16**13
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_counts_follow_the_inverted_distribution(spark):
    rows = [(i, "x" * (10 + i % 7), f"s{i % 3}" if i % 5 else None, "c") for i in range(300)]
    docs = frame(spark, rows)
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(docs, temperature=0.5, epochs=2).collect()}
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t)
    root = sum(v**0.5 for v in sizes.values())
    for s, size in sizes.items():
        assert math.isclose(rates[s], 2 * sum(sizes.values()) * size**0.5 / root / size)
    got = {}
    for r in mixing.replicate(docs, temperature=0.5, epochs=2, seed=3).collect():
        got.setdefault(r["doc_id"], []).append(r["copy"])
    for key, _, s, _ in rows:
        assert sorted(got.get(key, [])) == list(range(1, expected_count(rates[s], 3, key) + 1))


def test_named_weights_and_global_order(spark):
    docs = frame(spark, [(i, "abc", "a" if i < 80 else "b", None) for i in range(100)])
    out = mixing.replicate(docs, weights={"b": 1.0}, epochs=3, seed=5).collect()
    assert {r["source"] for r in out} == {"b"}
    keys = [r["shuffle_key"] for r in out]
    assert keys == sorted(keys)
    again = mixing.replicate(docs.repartition(7), weights={"b": 1.0}, epochs=3, seed=5).collect()
    assert [(r["doc_id"], r["copy"]) for r in out] == [(r["doc_id"], r["copy"]) for r in again]
    other = mixing.replicate(docs, weights={"b": 1.0}, epochs=3, seed=6).collect()
    assert [(r["doc_id"], r["copy"]) for r in out] != [(r["doc_id"], r["copy"]) for r in other]


def test_large_rates_nulls_and_empty_tables(spark):
    docs = frame(spark, [(1, "tiny", "small", None), (2, "y" * 4000, "large", None), (None, None, None, None)])
    out = mixing.replicate(docs, weights={"small": 1.0, "large": 1.0}, epochs=1, seed=1).collect()
    n = sum(r["source"] == "small" for r in out)
    assert abs(n - 2002 / 4) < 6 * math.sqrt(2002 / 4)
    assert all(r["doc_id"] is not None for r in out)
    assert mixing.replicate(docs.limit(0)).count() == 0
