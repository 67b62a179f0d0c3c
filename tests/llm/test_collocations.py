"""Phrase collocations against a plain count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from basketry.functions.workspace import Workspace
from basketry.llm import collocations as co

SCHEMA = "doc_id bigint, lang string, text string"


def plain(docs, top=2000, least=10):
    counts, total = defaultdict(Counter), Counter()
    for _, lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    rows = []
    for lang, f in counts.items():
        longer = Counter()
        for p, a in f.items():
            if len(p) == 3 and a >= least:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        found = []
        for p, a in f.items():
            if len(p) == 1 or a < least or (len(p) == 2 and longer[p] and 100 * longer[p] >= 50 * a):
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top]):
            rows.append((lang, i + 1, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(rows)


def mined(spark, docs, **kw):
    rows = spark.createDataFrame(docs, SCHEMA).repartition(4)
    with Workspace(spark) as work:
        return sorted(tuple(r) for r in co.collocations(rows, work, **kw).collect())


def corpus(seed, n=150):
    r = random.Random(seed)
    words = [a + b for a in ("ba", "dé", "Fi", "go") for b in ("lor", "MIS", "tek", "vun", "Ästa", "x")] + [f"rare{i}" for i in range(60)]
    fixed = [["new", "york", "city"], ["la", "la", "la"], ["red", "tape"], ["Ab", "ovo", "usque"]]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(40):
            w = r.choice(fixed) if r.random() < 0.2 else [words[int(len(words) * r.random() ** 2)]]
            parts += w
            if r.random() < 0.1:
                parts[-1] += r.choice([".", ",", "\n", "\x0b", "?!", " ."])
        docs.append((i, r.choice(["en", "en", "de", None, "und"]), r.choice([" ", "  ", "\t"]).join(parts)))
    return docs


@pytest.mark.parametrize(
    "seed,kw", [(1, {}), (2, {"top": 7}), (3, {"head_words": 6}), (4, {"head_pairs": 5}), (5, {"head_words": 9, "head_pairs": 4})]
)
def test_equal_to_a_plain_count_whatever_the_ranks_hold(spark, seed, kw):
    docs = corpus(seed)
    assert mined(spark, docs, **kw) == plain(docs, kw.get("top", 2000))


def test_shares_of_tiles_change_nothing(spark, monkeypatch):
    docs = corpus(6)
    monkeypatch.setattr(co, "SHARE", 2)  # the driver's choice; the rest of the module's values are the workers'
    assert mined(spark, docs, head_words=40, head_pairs=30) == plain(docs)


@pytest.mark.parametrize("edge", [8, 32])
def test_tiles_hold_what_was_added_however_often_a_task_sends(monkeypatch, edge):
    monkeypatch.setattr(co, "TILE", 8)
    monkeypatch.setattr(co, "_FLUSH", 100)
    r = np.random.default_rng(2)
    held, expected, tiles, grid = co._Held(), Counter(), {}, co._Grid(edge)
    for step in range(20):
        codes = (r.integers(0, 90, 60) ** 2 // 90) * co._WIDTH + r.integers(0, 300, 60) ** 2 // 300
        expected.update(codes.tolist())
        held.add(codes)
        if step % 5 == 4:
            held.settle()
            for batch in co._tile_batch("en", held.codes, held.counts, 0, grid):
                for ti, tj, cells, counts in zip(*(batch[c].to_pylist() for c in ("ti", "tj", "cells", "counts")), strict=True):
                    tiles.setdefault((ti, tj), []).append((cells, counts))
            held = co._Held()
    got = Counter()
    for (ti, tj), arrays in tiles.items():
        cells, counts = co.add_up(iter(arrays), grid.width(ti) * grid.width(tj), 4)
        row, col = grid.start(ti) + cells // grid.width(tj), grid.start(tj) + cells % grid.width(tj)
        got.update(dict(zip((row * co._WIDTH + col).tolist(), counts.tolist(), strict=True)))
    assert got == expected and len(tiles) > 10


def test_dense_and_sparse_tiles_hold_the_same():
    r = np.random.default_rng(3)
    arrays, expected = [], Counter()
    for _ in range(30):
        cells = np.unique(r.integers(0, 1 << 20, 3000)).astype(np.int32)
        counts = r.integers(1, 1 << 40, len(cells))
        arrays.append((cells.tobytes(), counts.tobytes()))
        for c, n in zip(cells.tolist(), counts.tolist(), strict=True):
            expected[c] += n
    for area, share in ((1 << 20, 1 << 20), (1 << 20, 64), (1 << 20, 1), (1 << 28, 64)):
        cells, counts = co.add_up(iter(arrays), area, share)
        assert dict(zip(cells.tolist(), counts.tolist(), strict=True)) == expected


def test_large_counts_keep_exact_scores(spark):
    a, left, right = 3_000_000_019, 3_999_999_979, 4_100_000_057
    rows = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint")
    assert rows.select(co._score("a", "l", "r").alias("s")).first()["s"] == 1_000_000 * a * a // (left * right)


def test_odd_rows(spark):
    docs = [(None, None, None), (1, "en", ""), (2, "en", " \t\n.,"), (2, "en", "one two " * 9), (2, "en", "One\tTWO " * 9), (3, None, "a b c " * 20000)]
    docs += [(4, "und", "a b\x00c d e " * 12)]
    assert mined(spark, docs) == plain(docs)
    assert mined(spark, docs[:3]) == []
    empty = spark.createDataFrame([], SCHEMA + ", n bigint, w1 string, word string, rank int")
    with Workspace(spark) as work:
        assert co.collocations(empty, work).count() == 0
        clash = spark.createDataFrame([(*d, 1, "x", "y", 2) for d in docs], empty.schema)
        assert sorted(tuple(r) for r in co.collocations(clash, work).collect()) == plain(docs)
    with pytest.raises(ValueError):
        mined(spark, docs, head_words=1 << 19)
