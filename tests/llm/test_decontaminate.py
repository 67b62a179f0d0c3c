"""Benchmark decontamination against containment of weighted shingles."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from basketry.llm import decontaminate as dc


def words(r, n):
    return [r.choice("al be co du en fo gi ha in jo ke lu ma no op".split()) + r.choice("ra se ti vo xu".split()) for _ in range(n)]


def planted(seed=3, n_items=30):
    r = random.Random(seed)
    items = [(i, " ".join(words(r, r.randint(12, 60)))) for i in range(n_items)]
    docs = []
    for d in range(120):
        w = words(r, r.randint(0, 300))
        if d % 3 == 0:
            it = items[d % n_items][1].split()
            kind = d % 4
            if kind == 1:
                it = [x.upper() + "," for x in it]  # case and punctuation
            elif kind == 2:
                it = it[: math.ceil(0.9 * len(it))]
            at = r.randint(0, len(w))
            w[at:at] = it
        docs.append((d, " ".join(w)))
    return items, docs


def containment(items, docs, threshold=0.8):
    df = Counter(s for _, t in items for s in set(dc.shingles(dc.word_list(t))))
    weight = {s: math.log1p(len(items) / n) for s, n in df.items()}
    out = set()
    for d, text in docs:
        there = set(dc.shingles(dc.word_list(text)))
        for i, t in items:
            mine = set(dc.shingles(dc.word_list(t)))
            if mine and sum(weight[s] for s in mine & there) >= threshold * sum(weight[s] for s in mine):
                out.add((d, i))
    return out


def scan(spark, items, docs, **kw):
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return {r["doc_id"]: r["benchmark_hits"] for r in dc.scan_benchmark(rows, bench, **kw).collect()}


@pytest.mark.parametrize("max_words", [2_000_000, 400])
def test_finds_what_containment_finds(spark, max_words):
    items, docs = planted()
    got = scan(spark, items, docs, max_words=max_words)
    pairs = {(d, h["item_id"]) for d, hs in got.items() for h in hs}
    # several passes weight shingles by their own chunk, which changes nothing for whole passages
    assert pairs == containment(items, docs)
    text = dict(docs)
    for d, hits in got.items():
        for h in hits:
            if h["similarity"] == 1.0 and h["end"] - h["start"] < len(text[d]):
                part = dc.word_list(text[d][h["start"] : h["end"]])
                assert part == dc.word_list(dict(items)[h["item_id"]])


def test_fingerprints_within_the_radius_are_all_found():
    r = np.random.default_rng(1)
    items = [(0, " ".join(f"w{i}" for i in range(40)))]
    rarity = {s: 1.0 for s in dc.shingles(dc.word_list(items[0][1]))}
    index = dc.BenchmarkIndex(items, rarity, 0.8, 3)
    ((size, (prints, item, offset, tables)),) = index.by_size.items()
    for _ in range(200):
        k = r.integers(0, len(prints))
        near = prints[k]
        for b in r.choice(64, r.integers(0, 4), replace=False):
            near ^= np.uint64(1) << np.uint64(b)
        hit = set()
        for (a, b), (starts, order, used) in zip(index.cuts, tables, strict=True):
            v = index._block(np.array([near]), a, b)[0]
            hit.update(order[starts[v] : starts[v + 1]].tolist())
        assert k in hit
    with pytest.raises(ValueError):
        dc.BenchmarkIndex(items, rarity, 0.8, 2)


def test_long_texts_across_stretches(spark):
    items, _ = planted()
    r = random.Random(9)
    w = words(r, 70_000)
    w[65_520:65_520] = items[4][1].split()
    got = scan(spark, items, [(1, " ".join(w))])
    assert [h["item_id"] for h in got[1]] == [4]


def test_odd_rows(spark):
    items = [(1, None), (2, ""), (3, "only three words"), (None, "x y z"), (4, "a b c d e f g h i j"), (5, "a b c d e f g h i j")]
    docs = [(None, None), (1, ""), (2, "here are only three words indeed"), (2, "here are only three words indeed"), (3, "A b, c d e f g h i j.")]
    rows = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id bigint, text string, benchmark_hits string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r["doc_id"] or 0, [h["item_id"] for h in r["benchmark_hits"]]) for r in dc.scan_benchmark(rows, bench).collect())
    assert got == [(0, []), (1, []), (2, [3]), (2, [3]), (3, [4, 5])]
    assert dc.scan_benchmark(rows, bench.limit(0)).filter("size(benchmark_hits) > 0").count() == 0
    assert dc.scan_benchmark(rows.limit(0), bench).count() == 0


def edited(r, w, k):
    w = list(w)
    for _ in range(k):
        at, kind = r.randrange(len(w)), r.randrange(3)
        w[at : at + (kind != 1)] = [] if kind == 2 else [f"new{r.randrange(10**6)}"]
    return w


def test_every_edited_passage_above_the_threshold_is_found(spark):
    r = random.Random(12)
    items = [(i, " ".join(words(r, r.choice([5, 12, 30, 39, 59, 120])))) for i in range(60)]
    docs = []
    for d in range(600):
        w = words(r, r.randint(0, 60))
        at = r.randint(0, len(w))
        it = items[d % 60][1].split()
        w[at:at] = edited(r, it, r.randint(0, max(1, len(it) // 20)))
        docs.append((d, " ".join(w)))
    pairs = {(d, h["item_id"]) for d, hs in scan(spark, items, docs).items() for h in hs}
    assert pairs == containment(items, docs) and len(pairs) > 200


def test_passes_share_the_rarities_of_the_whole_benchmark(spark):
    r = random.Random(13)
    frame = words(r, 24)  # every item starts with it, so its shingles are common
    items = [(i, " ".join(frame + words(r, 10))) for i in range(40)]
    docs = [(d, " ".join(frame[4:] + t.split()[24:])) for d, t in items] + [(50 + d, " ".join(frame)) for d in range(3)]
    docs += [(100 + d, " ".join(t.split()[8:])) for d, t in items]
    whole = scan(spark, items, docs)
    assert sum(map(len, whole.values())) > 40
    for max_words in (400, 50):
        assert {d: sorted(h) for d, h in scan(spark, items, docs, max_words=max_words).items()} == {d: sorted(h) for d, h in whole.items()}


@pytest.mark.parametrize("size,step", [(5, 1), (40, 5), (300, 37), (1000, 125)])
def test_long_windows_have_the_same_fingerprints(size, step):
    hashes = np.random.default_rng(size).integers(0, 2**63, 1500).astype(np.uint64)
    want = dc._fingerprints(dc._running(hashes, size), size, step)
    before = dc._STRETCH
    try:
        for dc._STRETCH in (64, 1 << 16):
            assert (dc._long_fingerprints(hashes, size, step) == want).all()
    finally:
        dc._STRETCH = before
    assert len(dc._long_fingerprints(hashes[: size - 1], size, step)) == 0


def test_an_item_of_very_many_words(spark):
    r = random.Random(8)
    item = [f"w{r.randrange(10**6)}" for _ in range(90_000)]
    other = [f"w{r.randrange(10**6)}" for _ in range(30_000)]
    cut = item[:40_000] + ["between"] * 3 + item[40_000:80_000]
    docs = [(1, " ".join(other + item)), (2, " ".join(cut)), (3, " ".join(item[:60_000])), (4, "short text"), (5, None)]
    got = scan(spark, [(7, " ".join(item)), (8, "a short item of seven words here")], docs)
    hits = {d: [h["item_id"] for h in hs] for d, hs in got.items()}
    assert hits == {1: [7], 2: [7], 3: [], 4: [], 5: []}
    assert got[1][0]["start"] == len(" ".join(other)) + 1


def test_several_passes_keep_rows_and_columns(spark):
    items, docs = planted(n_items=12)
    rows = spark.createDataFrame([(d, t, "x", 1.5) for d, t in docs] + [(None, None, None, None)] * 2, "doc_id bigint, text string, item_id string, benchmark_hits double")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    many = dc.scan_benchmark(rows, bench, max_words=60)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # the passes don't run in a row
    one = dc.scan_benchmark(rows, bench)
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)
    assert many.columns == one.columns == ["doc_id", "text", "item_id", "benchmark_hits"]
    assert sorted(many.collect(), key=key) == sorted(one.collect(), key=key)
