"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from basketry.functions.workspace import Workspace
from basketry.llm import spelling

SCHEMA = "doc_id bigint, text string"


def plain_words(docs, min_count=3):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= min_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(words):
    out, forms = {}, {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = [n, len(near)]
    rows = []
    for w, (n, n_near) in out.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, forms[w], root, n, n_near, words[forms[w]] if forms[w] else None))
    return sorted(rows, key=str)


def variants(spark, docs, small=4096):
    rows = spark.createDataFrame(docs, SCHEMA).repartition(3)
    with Workspace(spark) as work:
        got = spelling.spelling_forms(spelling.count_words(rows), work, small=small).collect()
    return sorted((tuple(r) for r in got), key=str)


def corpus(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcé") for _ in range(r.randint(4, 9))) for _ in range(60)]
    base += ["inter" + "".join(r.choice("ab") for _ in range(5)) for _ in range(25)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aabaab", "aababaab"]
    docs = []
    for i in range(60):
        words = []
        for _ in range(80):
            w = base[int(len(base) * r.random() ** 2)]
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abcÉ") + w[at + 1 :], w[:at] + r.choice("abÀ") + w[at:]])
            words.append(w.upper() if r.random() < 0.1 else w)
        docs.append((i, r.choice([" ", ", ", "1"]).join(words)))
    return docs


@pytest.mark.parametrize("seed,small", [(1, 4096), (2, 1), (3, 30)])
def test_equal_to_all_pairs(spark, seed, small):
    docs = corpus(seed)
    assert variants(spark, docs, small) == plain_forms(plain_words(docs))


def test_words_under_one_frequent_chunk_are_cut_until_few_meet(spark):
    r = random.Random(4)
    words = {"common" + "".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(600)} | {"common" + "x" * 6, "common" + "x" * 7}
    rows = spark.createDataFrame([(w, 3 + len(w)) for w in sorted(words)], "word string, n bigint")
    with Workspace(spark) as work:
        pairs = {tuple(sorted((p["a"], p["b"]))) for p in spelling.near_pairs(rows, work, small=64).collect()}
        count = spelling.near_pairs(rows, work, small=64).count()
    ordered = sorted(words)
    expected = {(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if one_edit(a, b)}
    assert pairs == expected and count == len(expected)


def test_chains_of_forms_end_in_one_root(spark):
    words = [("chains", 1000), ("chainz", 400), ("chaizz", 150), ("chzizz", 60), ("cczizz", 20), ("single", 5), ("singlee", 9)]
    rows = spark.createDataFrame(words, "word string, n bigint")
    with Workspace(spark) as work:
        got = sorted((tuple(r) for r in spelling.spelling_forms(rows, work).collect()), key=str)
    assert got == plain_forms(dict(words))
    assert {w: root for w, _, root, *_ in got}["cczizz"] == "chains"


def test_odd_rows(spark):
    docs = [(None, None), (None, "Straße straße STRASSE strasse"), (1, ""), (2, "ÀÉÎÕÜ àéîõü " * 4), (2, "ÀÉÎÕÜ àéîõü " * 4), (3, "x" * 60000 + " " + "longer " * 30000)]
    docs += [(i, "x" * 60000) for i in range(4, 8)]
    assert variants(spark, docs) == plain_forms(plain_words(docs))
    assert variants(spark, docs[:1]) == []
    empty = spark.createDataFrame([], "doc_id bigint, text string, n int, word string, form string")
    with Workspace(spark) as work:
        assert spelling.spelling_variants(empty, work).count() == 0
        clash = spark.createDataFrame([(1, "peter peter peter Petar", 5, "w", "f")], empty.schema)
        assert [r["word"] for r in spelling.spelling_variants(clash, work).collect()] == [w for w in plain_words([(1, "peter peter peter Petar")])]
