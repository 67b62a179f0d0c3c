"""Near-duplicate vectors by collision counting over sorted projections.

A vector has ``projections`` random one-dimensional projections (Gaussian, of its direction).
The window of a vector in a sorted projection is centred on its own value; another vector
in it collides with it. For two vectors at the wanted cosine the difference in a projection
is normal with the distance of their directions as its deviation, independently for each
projection, so their number of collisions is binomial. ``calibrate`` takes from that the
smallest number that a pair at the threshold reaches with probability ``recall``; pairs with
fewer collisions are dropped, the others verified by their cosine in double precision.

No pair leaves its task. Tables are cut where a projection is sorted: a tree, fitted on a
bounded sample of ``SAMPLE`` vectors, halves the values of one projection at each step, and
vectors within half of a ``spill`` window of the cut go to both sides, so that a pair within
a window of each other in that projection stays together on one side at least. A pair that
is together on both sides belongs to the lower one. The leaves (by label and length of the
vectors) are the cells. A cell that the tree doesn't bring under ``block`` vectors (many
versions of one vector, a frequent label) is laid out in blocks, and each pair of blocks is
a task's work of its own. A cell puts out numbers of links and a spanning forest.

The chance that a pair at the threshold is parted by a cut is below the normal tail beyond
``spill`` (3.5: 0.0005) times the density of the vectors at the cut.

Equal vectors of a label are one node. Defined results: a vector that is null, empty, zero
or holds null or non-finite components links with nothing, nor does one whose label is null;
vectors of different lengths don't link; an id is compared as it is: rows with equal ids are
separate vectors, of which each counts; a null id stands behind all others as a component's
smallest. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import Workspace
from .batches import bound_batches
from .chosenpath import _groups
from .components import components

SAMPLE = 1 << 16
_DEPTH = 60


def distance(cosine: float) -> float:
    """Distance of two directions with that cosine."""
    return math.sqrt(2 - 2 * cosine)


def calibrate(projections: int, window: float, recall: float) -> int:
    """The largest number of collisions that a pair at the threshold reaches with probability
    ``recall``, for windows of ``window`` deviations to either side."""
    p = math.erf(window / math.sqrt(2))
    reached = 0.0
    for least in range(projections, 0, -1):
        reached += math.comb(projections, least) * p**least * (1 - p) ** (projections - least)
        if reached >= recall:
            return least
    return 0


def directions(length: int, projections: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, length]).standard_normal((length, projections))


class _Projector:
    def __init__(self, projections: int, seed: int):
        self.projections, self.seed, self.by_length = projections, seed, {}

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Projections of the directions of the rows of ``x``."""
        n = x.shape[1]
        if n not in self.by_length:
            if len(self.by_length) > 64:
                self.by_length.clear()
            self.by_length[n] = directions(n, self.projections, self.seed)
        return unit(x) @ self.by_length[n]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` over their length; the largest component goes out first, against overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vector) to (id, label, node, length, vector as doubles); without node where nothing can link."""
    for batch in batches:
        nodes, sizes, held = [], [], []
        column = batch["vector"]
        for i, label in enumerate(batch["label"].to_pylist()):
            v = column[i]
            x = None
            if label is not None and v.is_valid and len(v.values):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zeros
                x = x if np.isfinite(x).all() and x.any() else None
            nodes.append(None if x is None else xxhash.xxh3_128_digest(repr(label).encode() + b"|" + x.tobytes()))
            sizes.append(None if x is None else len(x))
            held.append(None if x is None else x.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["label"], pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(held, pa.binary())],
            ["id", "label", "node", "length", "vector"],
        )


def _matrix(vectors: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), np.float64).reshape(-1, length)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    sizes = batch["length"].to_numpy()
    for n in np.unique(sizes):
        yield int(n), np.flatnonzero(sizes == n)


def _sample_rows(projector: tuple[int, int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = _Projector(*projector)
        for batch in batches:
            for n, at in _by_length(batch):
                p = project(_matrix(batch["vector"].take(pa.array(at)), n)).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n] * len(at), pa.int32()), pa.array([x.tobytes() for x in p], pa.binary())], ["length", "projected"]
                )

    return rows


class Tree:
    """Cuts of sorted projections: of each inner node the projection, the cut, and both children."""

    def __init__(self, sample: np.ndarray, cell: float, half: float):
        """``cell``: vectors of the sample that a leaf may hold; ``half``: half the spill."""
        self.axis: list[int] = []
        self.cut: list[float] = []
        self.child: list[tuple[int, int]] = []
        self.half = half
        self._grow(sample, cell, 0)

    def _grow(self, p: np.ndarray, cell: float, depth: int) -> int:
        """The node's number; leaves are -1."""
        if len(p) <= max(cell, 32) or depth == _DEPTH:
            return -1
        spread = np.quantile(p, 0.75, axis=0) - np.quantile(p, 0.25, axis=0)
        axis = int(spread.argmax())
        cut = float(np.median(p[:, axis]))
        low, high = p[:, axis] <= cut + self.half, p[:, axis] >= cut - self.half
        if max(low.sum(), high.sum()) > 0.9 * len(p):  # versions of one vector: cuts don't part them
            return -1
        at = len(self.axis)
        self.axis.append(axis)
        self.cut.append(cut)
        self.child.append((-1, -1))
        self.child[at] = (self._grow(p[low], cell, depth + 1), self._grow(p[high], cell, depth + 1))
        return at

    def route(self, p: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows, lower): the rows of ``p`` in each leaf, and for each of them the steps to
        the higher side on which it also went to the lower one, as bits."""
        todo = [(0 if self.axis else -1, 1, 0, np.arange(len(p)), np.zeros(len(p), np.int64))]
        while todo:
            node, path, depth, rows, lower = todo.pop()
            if node < 0:
                if len(rows):
                    yield path, rows, lower
                continue
            x = p[rows, self.axis[node]]
            low, high = x <= self.cut[node] + self.half, x >= self.cut[node] - self.half
            also = np.where(low, np.int64(1) << depth, 0)
            todo.append((self.child[node][0], 2 * path, depth + 1, rows[low], lower[low]))
            todo.append((self.child[node][1], 2 * path + 1, depth + 1, rows[high], (lower | also)[high]))


_PLACE = "label {label}, length int, leaf bigint, lower bigint, node binary, copies bigint, vector binary"


def _place_rows(projector: tuple[int, int], trees: dict[int, Tree]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = _Projector(*projector)
        for batch in batches:
            for n, at in _by_length(batch):
                part = batch.take(pa.array(at))
                tree = trees.get(n)
                p = project(_matrix(part["vector"], n)) if tree else None
                places = tree.route(p) if tree else [(1, np.arange(len(at)), np.zeros(len(at), np.int64))]
                for leaf, which, lower in places:
                    k, take = len(which), pa.array(which)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part["label"].take(take), pa.array([n] * k, pa.int32()), pa.array([leaf] * k, pa.int64()), pa.array(lower),
                            *[part[c].take(take) for c in ("node", "copies", "vector")],
                        ],
                        ["label", "length", "leaf", "lower", "node", "copies", "vector"],
                    )

    return rows


def passing(x: np.ndarray, y: np.ndarray, width: float, least: int) -> np.ndarray:
    """Of two lists of projections, which pairs collide in ``least`` of them or more. Each
    projection of ``y`` is sorted and ``x``'s windows are looked up in it; pairs that can't
    reach the number any more are left out of the later projections."""
    m = x.shape[1]
    first = min(m, m - least + 4)  # counted for all pairs
    counts = np.zeros((len(x), len(y)), np.int16)
    for i in range(first):
        order = np.argsort(y[:, i], kind="stable")
        ranked = y[order, i]
        lows, highs = np.searchsorted(ranked, x[:, i] - width, "left"), np.searchsorted(ranked, x[:, i] + width, "right")
        for row, lo, hi in zip(counts, lows.tolist(), highs.tolist(), strict=True):
            row[order[lo:hi]] += 1
    r, c = np.nonzero(counts >= least - (m - first))
    found = counts[r, c]
    for i in range(first, m):
        found += np.abs(x[r, i] - y[c, i]) <= width
        able = found >= least - (m - 1 - i)
        r, c, found = r[able], c[able], found[able]
    return np.stack([r, c])


def _link_rows(projector: tuple[int, int], threshold: float, window: float, least: int):
    """From cells to rows (node, number of linked vectors, or an edge of the spanning forest)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = _Projector(*projector)
        width = window * distance(threshold)
        for cell in _groups(batches, ("cell", "a", "b")):
            a, b, n = (cell[c][0].as_py() for c in ("a", "b", "length"))
            vectors = unit(_matrix(cell["vector"], n))
            projected = project(vectors)
            part, lower, copies = (cell[c].to_numpy() for c in ("part", "lower", "copies"))
            nodes = cell["node"].to_pylist()
            left, right = np.flatnonzero(part == a), np.flatnonzero(part == b)
            links, parent, edges = np.zeros(len(nodes), np.int64), list(range(len(nodes))), []

            def root(i: int, parent: list[int] = parent) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for lo in range(0, len(left), 256):
                mine = left[lo : lo + 256]
                r, c = passing(projected[mine], projected[right], width, least)
                r, c = mine[r], right[c]
                owned = (lower[r] & lower[c]) == 0
                if a == b:
                    owned &= r < c
                r, c = r[owned], c[owned]
                if not len(r):
                    continue
                if len(r) > 4 * len(right):
                    cosine = (vectors[mine] @ vectors[right].T)[np.searchsorted(mine, r), np.searchsorted(right, c)]
                else:
                    cosine = np.einsum("ij,ij->i", vectors[r], vectors[c])
                near = cosine >= threshold
                r, c = r[near], c[near]
                np.add.at(links, r, copies[c])
                np.add.at(links, c, copies[r])
                known = np.array([root(i) for i in range(len(nodes))])
                apart = known[r] != known[c]
                for i, j in zip(r[apart].tolist(), c[apart].tolist(), strict=True):
                    p, q = root(i), root(j)
                    if p != q:
                        parent[p] = q
                        edges.append((nodes[i], 0, nodes[j]))
            out = [(nodes[i], int(k), None) for i, k in enumerate(links) if k] + edges
            if out:
                kinds = (pa.binary(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col, k) for col, k in zip(zip(*out, strict=True), kinds, strict=True)], ["node", "links", "other"]
                )

    return rows


def near_vectors(
    vectors: DataFrame,
    work: Workspace,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.98,
    projections: int = 24,
    window: float = 2.0,
    recall: float = 0.99999,
    spill: float = 3.5,
    block: int = 1024,
    seed: int = 17,
) -> DataFrame:
    """(key, n_links, component_id, kept) of every vector.

    ``n_links`` is the number of other vectors of the label with cosine ``threshold`` or more,
    ``component_id`` the smallest key that links reach, and ``kept`` marks it.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold has to lie between 0 and 1")
    spark = vectors.sparkSession
    bound_batches(spark)
    least = calibrate(projections, window, recall)
    projector = (projections, seed)
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    kind = rows.schema["label"].dataType.simpleString()
    held_schema = f"id {rows.schema['id'].dataType.simpleString()}, label {kind}, node binary, length int, vector binary"
    held = work.table(rows.mapInArrow(_vector_rows, held_schema), "vectors")
    nodes = held.filter("node is not null").groupBy("node").agg(
        F.min("id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"),
        F.first("length").alias("length"), F.first("vector").alias("vector"),
    )
    nodes = work.table(nodes, "nodes")

    # trees of cuts for the lengths in the sample; the digests put it in random order
    by_length = nodes.groupBy("length", "label").count().groupBy("length").agg(F.max("count").alias("most"), F.sum("count").alias("all"))
    sizes = {r["length"]: r for r in by_length.orderBy(F.desc("all")).limit(64).collect()}
    drawn = nodes.select("node", "length", "vector").orderBy("node").limit(SAMPLE)
    sample: dict[int, list[bytes]] = {}
    for r in drawn.mapInArrow(_sample_rows(projector), "length int, projected binary").collect():
        sample.setdefault(r["length"], []).append(r["projected"])
    trees = {}
    for n, drawn_rows in sample.items():
        if n in sizes and sizes[n]["most"] > block:
            p = np.frombuffer(b"".join(sorted(drawn_rows)), np.float32).reshape(-1, projections).astype(np.float64)
            trees[n] = Tree(p, block * len(p) / sizes[n]["most"], spill * distance(threshold) / 2)

    placed = nodes.select("label", "length", "node", "copies", "vector").mapInArrow(_place_rows(projector, trees), _PLACE.format(label=kind))
    placed = work.table(placed, "placed")
    counts = placed.groupBy("label", "length", "leaf").agg(F.count("*").alias("count")).filter("count > 1")
    counts = counts.withColumn("parts", F.ceil(F.col("count") / block).cast("int"))
    cells = placed.join(counts, ["label", "length", "leaf"])
    cells = cells.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    cells = cells.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select(
        F.xxhash64("label", "length", "leaf").alias("cell"),
        F.least("part", "with").alias("a"), F.greatest("part", "with").alias("b"),
        "part", "length", "lower", "node", "copies", "vector",
    )
    cells = cells.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b")
    found = cells.mapInArrow(_link_rows(projector, threshold, window, least), "node binary, links bigint, other binary")
    found = work.table(found, "links")

    degree = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("linked"))
    edges = found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    known = nodes.select("node", "least", "copies").join(components(edges, work), "node", "left").join(degree, "node", "left")
    known = known.select("node", "least", F.coalesce("label", "node").alias("group"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    smallest = known.groupBy("group").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "group").select("node", "component_id", "n_links")
    alone = held.filter("node is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    linked = held.filter("node is not null").select("id", "node").join(known, "node").select("id", "n_links", "component_id")
    return linked.unionByName(alone).select(
        F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
