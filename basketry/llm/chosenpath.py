"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles. Documents with the same words are one node.
A node walks down a forest of ``runs`` trees: at a tree's vertex it takes the branches
of those of its shingles whose hash with the vertex is below fanout / (threshold * |x|),
so two sets with similarity ``threshold`` take at least ``fanout`` branches in common on
average. A vertex with few nodes is a bucket; a larger one is split again, down to
``max_depth``, unless a branch holds half of its nodes or more: then splitting doesn't
part them and it stays a bucket. The nodes of a bucket are compared with each other. The number of runs follows from the target recall
(``needed_runs``: the chance that a pair at the threshold meets in a run is that of a
branching process of mean ``fanout``).

A pair that meets in several buckets belongs to the smallest of them, so it is compared
once. In a bucket the pairs stay inside the task: it puts out each node's number of links
and a spanning forest of the links, rows in proportion to the bucket's nodes. A bucket
that can't be split (many versions of one text) is laid out in blocks of at most
``block`` nodes, and each pair of blocks is a task's work of its own.

Before shingle sets are sent, a sketch (the smallest hash in each of 128 bins) drops
pairs whose estimated similarity is more than 0.2 below the threshold; six standard
deviations at the threshold. The similarity of the others is computed exactly from
the whole texts.

Defined results: a null text counts as empty; texts without words are copies of each
other; a text of fewer than five words is one shingle; rows with equal keys are
separate documents; a null key is a key like others. Columns besides key and text are
ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import Workspace, session_workspace
from .batches import bound_batches
from .components import components

_WORD = re.compile(r"\w+")
_MEMO = 150_000
_SAMPLE = 32  # shingles kept for choosing paths, times 1 / threshold
_BINS = 128
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def needed_runs(recall: float, fanout: float, max_depth: int) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``."""
    p = 1.0
    for _ in range(max_depth):
        p = 1 - math.exp(-fanout * p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Texts to their node (16 bytes, the same for the same words) and sorted shingle hashes."""

    def __init__(self, size: int = 5):
        self.size, self.memo = size, {}

    def __call__(self, text: str | None) -> tuple[bytes, np.ndarray]:
        words, memo = _WORD.findall((text or "").lower()), self.memo
        new = [w for w in set(words) if w not in memo]
        if len(memo) + len(new) > _MEMO:
            memo.clear()
            new = list(set(words))
        memo.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        node = xxhash.xxh3_128_digest(h.tobytes())
        if not len(h):
            return node, h
        n = max(1, len(h) - self.size + 1)
        s = np.zeros(n, np.uint64)
        for i in range(min(self.size, len(h))):
            s = _mix(s + h[i : i + n] + np.uint64(i + 1))
        return node, np.unique(s)


def _below(limit: float) -> np.uint64:
    return np.uint64(min(2**64 - 1, int(limit * 2**64)))


def _sketch(s: np.ndarray) -> bytes:
    """For each of the bins of the hash range, seven bits of its smallest shingle (0: none)."""
    out = np.zeros(_BINS, np.uint8)
    bins, first = np.unique(s >> np.uint64(57), return_index=True)
    out[bins.astype(np.int64)] = (_mix(s[first]) & np.uint64(127)).astype(np.uint8) | 128
    return out.tobytes()


def _profile_rows(threshold: float, size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            nodes, counts, samples, sketches = [], [], [], []
            for text in batch["_text"].to_pylist():
                node, s = shingler(text)
                # the same shingles for similar sets: those below a bound that follows the set's size
                kept = s[_mix(s + _M2) <= _below(_SAMPLE / (threshold * max(1, len(s))))]
                nodes.append(node)
                counts.append(len(s))
                samples.append(kept.view(np.int64))
                sketches.append(_sketch(s))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["_key"],
                    pa.array(nodes, pa.binary()),
                    pa.array(counts, pa.int32()),
                    pa.array(samples, pa.list_(pa.int64())),
                    pa.array(sketches, pa.binary()),
                ],
                ["_key", "node", "n", "sample", "sketch"],
            )

    return rows


_STEP = "path bigint, parent bigint, held bigint, node binary, n int"


def _step_rows(fanout: float, threshold: float):
    """From (node, n, sample, paths: (path, held)) to the chosen branches of each path. A
    shingle's chance, being in the sample included, is fanout / (threshold * n)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            cols = (batch[c].to_pylist() for c in ("node", "n", "sample", "paths"))
            for node, n, sample, paths in zip(*cols, strict=True):
                s = np.array(sample, np.int64).view(np.uint64)
                p = np.array([x["path"] for x in paths], np.int64).view(np.uint64)
                child = _mix(_mix(p)[:, None] + s[None, :])
                at, which = np.nonzero(_mix(child + _M1) <= _below(fanout / min(_SAMPLE, threshold * n)))
                out[0].append(child[at, which].view(np.int64))
                out[1].append(p.view(np.int64)[at])
                out[2].append(np.array([x["held"] for x in paths], np.int64)[at])
                out[3] += [node] * len(at)
                out[4] += [n] * len(at)
            ints = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out[:3]]
            yield pa.RecordBatch.from_arrays(
                [*ints, pa.array(out[3], pa.binary()), pa.array(out[4], pa.int32())],
                ["path", "parent", "held", "node", "n"],
            )

    return rows


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys in sorted input, as one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


_CELL = "path bigint, a int, b int, node binary, partners array<binary>"


def _partner_rows(threshold: float):
    """From the rows of cells to each node's partners there: the pairs that belong to the
    cell and whose sketches allow the threshold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _groups(batches, ("path", "a", "b")):
            m = cell.num_rows
            path, a, b = (cell[c][0].as_py() for c in ("path", "a", "b"))
            n = cell["n"].to_numpy().astype(float)
            part = cell["part"].to_numpy()
            nodes = cell["node"].to_pylist()
            sketch = np.frombuffer(b"".join(cell["sketch"].to_pylist()), np.uint8).reshape(m, _BINS)
            buckets = cell["buckets"].combine_chunks()
            flat, ends = buckets.values.to_numpy(), buckets.offsets.to_numpy()
            owner = np.repeat(np.arange(m), np.diff(ends))
            earlier = flat < path  # a pair that also meets in a smaller bucket belongs there
            ids, column = np.unique(flat[earlier], return_inverse=True)
            marks = np.zeros((m, max(1, len(ids))), np.float32)
            marks[owner[earlier], column] = 1
            partners: list[list[bytes]] = [[] for _ in range(m)]
            used = np.zeros(m, bool)
            for i in range(m):
                j = np.arange(i + 1, m)
                if a != b:
                    j = j[part[j] != part[i]]
                j = j[(np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]))]
                if len(j):
                    j = j[marks[j] @ marks[i] == 0]
                if len(j):
                    same = ((sketch[j] == sketch[i]) & (sketch[i] > 0)).sum(1)
                    either = ((sketch[j] > 0) | (sketch[i] > 0)).sum(1)
                    j = j[same >= (threshold - 0.2) * either]
                if len(j):
                    partners[i] = [nodes[x] for x in j]
                    used[i] = True
                    used[j] = True
            at = np.flatnonzero(used)
            if not len(at):
                continue
            k = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path] * k, pa.int64()), pa.array([a] * k, pa.int32()), pa.array([b] * k, pa.int32()),
                    pa.array([nodes[x] for x in at], pa.binary()), pa.array([partners[x] for x in at], pa.list_(pa.binary())),
                ],
                ["path", "a", "b", "node", "partners"],
            )

    return rows


def _set_rows(size: int):
    """From (text, node) to (node, shingle set); null for a
    row whose text isn't the node's, which is another document of the same key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            out = []
            for text, node in zip(batch["_text"].to_pylist(), batch["node"].to_pylist(), strict=True):
                found, s = shingler(text)
                out.append(s.tobytes() if found == node else None)
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(out, pa.binary())], ["node", "shingles"])

    return rows


_LINK = "node binary, links bigint, other binary"


def _link_rows(threshold: float):
    """From cells with sets to rows (node, number of links, or an edge of the spanning forest)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _groups(batches, ("path", "a", "b")):
            nodes = cell["node"].to_pylist()
            at = {x: i for i, x in enumerate(nodes)}
            sets = [np.frombuffer(x, np.uint64) for x in cell["shingles"].to_pylist()]
            sizes = np.array([len(s) for s in sets])
            ends = np.cumsum(sizes)
            _, local = np.unique(np.concatenate(sets), return_inverse=True)
            flag = np.zeros(int(local.max(initial=-1)) + 1, np.int32)
            links, parent, edges = np.zeros(len(nodes), np.int64), list(range(len(nodes))), []

            def root(x: int, parent: list[int] = parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i, partners in enumerate(cell["partners"].to_pylist()):
                j = np.array([at[p] for p in partners], np.int64)
                if not len(j):
                    continue
                mine = local[ends[i] - sizes[i] : ends[i]]
                flag[mine] = 1
                if len(j) > len(nodes) // 2:
                    common = np.add.reduceat(flag[local], ends - sizes)[j]
                else:
                    common = np.array([flag[local[ends[x] - sizes[x] : ends[x]]].sum() for x in j])
                flag[mine] = 0
                linked = j[common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9]
                links[i] += len(linked)
                links[linked] += 1
                for x in linked.tolist():
                    p, q = root(i), root(x)
                    if p != q:
                        parent[p] = q
                        edges.append((nodes[i], nodes[x]))
            counted = [(nodes[i], int(k), None) for i, k in enumerate(links) if k]
            out = counted + [(p, 0, q) for p, q in edges]
            if out:
                kinds = (pa.binary(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["node", "links", "other"]
                )

    return rows


def jaccard_join(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = 0.8,
    size: int = 5,
    recall: float = 0.9999,
    fanout: float = 2.0,
    max_depth: int = 3,
    small: int = 64,
    block: int = 512,
    workspace: Workspace | None = None,
) -> DataFrame:
    """(key, class_id, copy_of, n_links) of every document.

    ``copy_of`` is the smallest key with the same words, ``n_links`` the number of
    different texts with similarity ``threshold`` or more, and ``class_id`` the smallest
    key among the documents that links and copies connect.
    """
    spark = docs.sparkSession
    work = workspace or session_workspace(spark)
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    profile_schema = f"_key {docs.schema[key].dataType.simpleString()}, node binary, n int, sample array<bigint>, sketch binary"
    profiles = work.table(rows.mapInArrow(_profile_rows(threshold, size), profile_schema), "profiles")
    copies = profiles.groupBy("node").agg(F.min("_key").alias("copy_of"))
    nodes = profiles.filter("n > 0").groupBy("node").agg(
        F.min("_key").alias("rep"), F.first("n").alias("n"), F.first("sample").alias("sample"), F.first("sketch").alias("sketch")
    )
    nodes = work.table(nodes, "nodes")

    # the trees' roots are paths 1 to runs; every node starts at all of them
    runs = needed_runs(recall, fanout, max_depth)
    roots = F.transform(F.sequence(F.lit(1), F.lit(runs)), lambda r: F.struct(r.cast("bigint").alias("path"), F.lit(0).cast("bigint").alias("held")))
    walking = nodes.select("node", "n", "sample", roots.alias("paths"))
    found: list[DataFrame] = []
    wide = None  # buckets that are being split
    for depth in range(1, max_depth + 1):
        steps = work.table(walking.mapInArrow(_step_rows(fanout, threshold), _STEP), f"steps-{depth}")
        counts = steps.groupBy("path").agg(F.count("*").alias("count")).filter("count > 1")
        met = work.table(steps.join(counts, "path"), f"met-{depth}")
        if wide is not None:  # a bucket whose branches hold as many nodes is not split
            firm = met.filter("count >= 0.5 * held").select(F.col("parent").alias("path")).distinct()
            found.append(wide.join(firm, "path", "left_semi").select("path", "node", "n", "count"))
            met = met.join(firm.withColumnRenamed("path", "parent"), "parent", "left_anti")
        whole = F.lit(depth == max_depth) | (F.col("count") <= small)
        found.append(met.filter(whole).select("path", "node", "n", "count"))
        if depth < max_depth:
            wide = met.filter(~whole)
            on = wide.groupBy("node").agg(F.collect_list(F.struct("path", F.col("count").alias("held"))).alias("paths"))
            walking = nodes.select("node", "n", "sample").join(on, "node")
    buckets = found[0]
    for more in found[1:]:
        buckets = buckets.unionByName(more)
    buckets = work.table(buckets, "buckets")

    # cells: a bucket, or a pair of blocks of a large one
    lists = buckets.groupBy("node").agg(F.collect_list("path").alias("buckets"))
    parts = F.ceil(F.col("count") / block).cast("int")
    own = F.pmod(F.xxhash64("node", "path"), parts).cast("int")
    placed = buckets.select("path", "node", "n", parts.alias("parts"), own.alias("part"))
    cells = placed.select("path", "node", "n", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    cells = cells.select("path", F.least("part", "with").alias("a"), F.greatest("part", "with").alias("b"), "node", "n", "part")
    carried = nodes.select("node", "sketch").join(lists, "node")
    cells = cells.join(carried, "node").repartition("path", "a", "b").sortWithinPartitions("path", "a", "b", "node")
    partners = work.table(cells.mapInArrow(_partner_rows(threshold), _CELL), "partners")

    # shingle sets of the nodes with partners, from their texts
    wanted = partners.select("node").distinct().join(nodes.select("node", "rep"), "node")
    fetched = rows.join(wanted, rows["_key"].eqNullSafe(wanted["rep"])).select("_text", "node")
    sets = fetched.mapInArrow(_set_rows(size), "node binary, shingles binary").filter("shingles is not null")
    sets = work.table(sets.dropDuplicates(["node"]), "sets")
    compared = partners.join(sets, "node").repartition("path", "a", "b").sortWithinPartitions("path", "a", "b", "node")
    links = work.table(compared.mapInArrow(_link_rows(threshold), _LINK), "links")

    degree = links.filter("other is null").groupBy("node").agg(F.sum("links").alias("n_links"))
    labels = components(links.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), work)
    classes = copies.join(labels, "node", "left").join(degree, "node", "left").select(
        "node", "copy_of", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    least = classes.groupBy("label").agg(F.min("copy_of").alias("class_id"))
    known = classes.join(least, "label").select("node", "class_id", "copy_of", "n_links")
    return profiles.select("_key", "node").join(known, "node").select(F.col("_key").alias(key), "class_id", "copy_of", "n_links")
