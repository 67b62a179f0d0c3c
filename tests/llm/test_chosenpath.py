"""Jaccard join against all pairs, and connected components."""

import random
from itertools import combinations

import pytest

from basketry.functions.workspace import Workspace
from basketry.llm import chosenpath
from basketry.llm.components import components


def brute_force(docs, threshold=0.8):
    sh = chosenpath.Shingler()
    nodes = {}
    of = []
    for k, t in docs:
        node, s = sh(t)
        nodes.setdefault(node, (set(s.tolist()), []))[1].append(k)
        of.append((k, node))
    least = lambda ks: min(x for x in ks if x is not None) if any(x is not None for x in ks) else None
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(nodes, 0)
    for a, b in combinations(nodes, 2):
        x, y = nodes[a][0], nodes[b][0]
        if x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    members = {}
    for n in nodes:
        members.setdefault(root(n), []).extend(nodes[n][1])
    return sorted(((k, least(members[root(n)]), least(nodes[n][1]), links[n]) for k, n in of), key=str)


def run(spark, docs, **kw):
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    with Workspace(spark) as work:
        got = chosenpath.jaccard_join(rows, workspace=work, **kw).collect()
    return sorted((tuple(r) for r in got), key=str)


def corpus(seed, families=12, size=8, shared=True):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    docs = []
    for f in range(families):
        base = [r.choice(vocabulary) for _ in range(r.randint(40, 200))]
        for v in range(size):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if shared and r.random() < 0.3:
                w = w + passage
            docs.append((len(docs), " ".join(w)))
    return docs


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"small": 4}), (3, {"small": 2, "block": 3})])
def test_all_links_are_found(spark, seed, kw):
    docs = corpus(seed)
    assert run(spark, docs, **kw) == brute_force(docs)


def test_one_large_group_of_versions(spark):
    docs = corpus(5, families=1, size=150)
    assert run(spark, docs, small=16, block=40) == brute_force(docs)


def test_odd_rows(spark):
    docs = [(None, None), (1, ""), (2, "..."), (3, "one two"), (3, "One, two!"), (4, "one two three"), (5, "word " * 30000), (6, "word " * 500)]
    assert run(spark, docs) == brute_force(docs)
    assert run(spark, docs[:1]) == [(None, None, None, 0)]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    with Workspace(spark) as work:
        assert chosenpath.jaccard_join(empty, workspace=work).count() == 0


def test_needed_runs():
    assert chosenpath.needed_runs(0.99, 1.0, 1) == 5
    assert chosenpath.needed_runs(0.9999, 2.0, 3) >= chosenpath.needed_runs(0.99, 2.0, 3)


def test_components_of_a_chain_a_star_and_a_pair(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(201, 200), (7, 7)]
    with Workspace(spark) as work:
        got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a int, b int"), work).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
