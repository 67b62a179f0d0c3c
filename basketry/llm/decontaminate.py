"""Benchmark decontamination with SimHash windows and a multi-index.

Every benchmark item gets a window size: the largest of a geometric series of sizes
that, with the stride of that size, fits into the part of the item that a match must
have. All windows of that size in the item are fingerprinted (64-bit SimHash of their
words). Documents are cut into windows of the same sizes, one stride apart, so that a
passage that holds the required part of an item holds a document window that lies on
one of the item's windows word for word.

The 64 bits are split into ``radius + 1`` blocks; two fingerprints within ``radius``
bits agree on one block at least, so the block tables miss none of them. Fingerprints
within the radius are candidates. So that edits can't hide a passage, an item's rarest
shingles, as many as hold more weight than a match may lose, are looked up word for word
at every place of a document: a passage above the threshold holds one of them, however
its words were replaced, inserted or deleted, and is a candidate too. The exact check compares five-word shingles, each
weighted by its rarity among the items: a document passage of the item's length
(and a margin for insertions) is a hit if the shared weight is at least
``threshold`` of the item's.

The index of a benchmark chunk of at most ``max_words`` words (or of one longer item) is
broadcast; a larger benchmark is scanned in several passes over the documents, with the
rarities of the whole benchmark in each. The passes run side by side over a written copy
of the texts, one in a task, and their hits are put together by row. Texts and items of any
length are read in overlapping stretches; the time for an item of very many words grows
with its length times the number of places at which it may lie in a text.

Defined results: a null text counts as empty; no documents give no rows; items without
words match nothing; items with equal text are all reported, repeated items once; an item
of fewer than five words is one shingle; ties between places go to the first. Rows are kept
one for one, repeated ones too; an existing column ``benchmark_hits`` is replaced, all
others stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.workspace import session_workspace
from .batches import bound_batches

_WORD = re.compile(r"\w+")
_STRETCH = 1 << 16  # words at a time
_LONG = 1 << 16  # windows of so many words don't fit packed counts
_MEMO = 150_000
HITS = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
)


def word_list(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], size: int = 5) -> list[tuple[str, ...]]:
    """All runs of ``size`` words, or the whole if it is shorter."""
    if len(words) <= size:
        return [tuple(words)] if words else []
    return list(zip(*(words[i:] for i in range(size)), strict=False))


def window_sizes(largest: int) -> list[int]:
    sizes, w = [], 1
    while w <= largest:
        sizes.append(w)
        w = max(w + 1, round(w * 1.25))
    return sizes


def stride(size: int) -> int:
    return max(1, size // 8)


def item_window(n_words: int, threshold: float) -> int:
    """The window size of an item: it and its stride fit into a run that a match must have."""
    need = max(1, math.floor(threshold * n_words))
    return max(w for w in window_sizes(need) if w == 1 or w + stride(w) - 1 <= need)


def _hashes(words: list[str], memo: dict[str, int]) -> np.ndarray:
    new = [w for w in set(words) if w not in memo]
    if len(memo) + len(new) > _MEMO:
        memo.clear()
        new = list(set(words))
    memo.update((w, xxhash.xxh64_intdigest(w)) for w in new)
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def _spread(lane: int) -> np.ndarray:
    """Table of a byte's bits, each in a lane of ``lane`` bytes of unsigned 64-bit integers."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    return bits.astype(f"u{lane}").view(np.uint64).reshape(256, lane)


_LANES = {1: _spread(1), 2: _spread(2)}


def _running(hashes: np.ndarray, largest: int) -> np.ndarray:
    """Running counts of each hash bit over the words, packed into 64-bit integers.

    The counts run over their lanes, but the difference of two rows, taken as integers,
    holds the exact counts between them as long as these fit a lane.
    """
    lane = 1 if largest < 256 else 2
    wide = _LANES[lane][hashes.view(np.uint8)].reshape(len(hashes), 8 * lane)
    out = np.zeros((len(hashes) + 1, 8 * lane), np.uint64)
    np.cumsum(wide, axis=0, out=out[1:])
    return out


def _long_fingerprints(hashes: np.ndarray, size: int, step: int) -> np.ndarray:
    """As ``_fingerprints``, for windows whose counts don't fit a lane: from one window to the
    next the counts change by the words that enter and leave, a bounded part at a time."""

    def bits(lo: int, hi: int) -> np.ndarray:
        return np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)

    windows = max(0, (len(hashes) - size) // step + 1)
    out = np.zeros((windows, 8), np.uint8)
    if not windows:
        return out
    counts = sum(bits(lo, min(size, lo + _STRETCH)).sum(0, dtype=np.int64) for lo in range(0, size, _STRETCH))
    out[0] = np.packbits(counts > size // 2)
    done, many = 1, max(1, _STRETCH // step)
    while done < windows:
        n = min(many, windows - done)
        at = (done - 1) * step
        change = bits(at + size, at + size + n * step) - bits(at, at + n * step)
        counts = counts + np.cumsum(np.add.reduceat(change, np.arange(0, n * step, step), axis=0, dtype=np.int64), axis=0)
        out[done : done + n] = np.packbits(counts > size // 2, axis=1)
        counts, done = counts[-1], done + n
    return out


def _fingerprints(running: np.ndarray, size: int, step: int) -> np.ndarray:
    """(windows, 8) bytes: SimHash of the windows that start at 0, step, 2 step, ..."""
    n = len(running) - 1
    if n < size:
        return np.zeros((0, 8), np.uint8)
    counts = running[size::step][: (n - size) // step + 1] - running[: n - size + 1 : step]
    lane = running.shape[1] // 8
    return np.packbits(counts.view(f"u{lane}") > size // 2, axis=1)


def _combined(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, from the words' hashes."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return out ^ (out >> np.uint64(32))


_LOW = np.uint64((1 << 20) - 1)


class BenchmarkIndex:
    """Fingerprints of the items' windows by window size, in block tables, and the items'
    rarest shingles by their size."""

    def __init__(self, items: list[tuple[int, str]], rarity: dict[tuple[str, ...], float], threshold: float, radius: int):
        self.threshold, self.radius = threshold, radius
        self.ids = [i for i, _ in items]
        self.words = [word_list(t) for _, t in items]
        self.weights = [{s: rarity[s] for s in shingles(w)} for w in self.words]
        by_size: dict[int, list[int]] = {}
        for j, w in enumerate(self.words):
            if w:
                by_size.setdefault(item_window(len(w), threshold), []).append(j)
        self.by_size = {}
        self.packed = max((x for x in by_size if x < _LONG), default=0)  # the longest with packed counts
        n_blocks = radius + 1
        # block boundaries on bits; every block is at most 16 bits wide
        cuts = [round(b * 64 / n_blocks) for b in range(n_blocks + 1)]
        if max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) > 16:
            raise ValueError("radius must be at least 3")
        self.cuts = list(zip(cuts, cuts[1:], strict=False))
        for size, members in by_size.items():
            prints, item, offset = [], [], []
            for j in members:
                hashes = _hashes(self.words[j], {})
                f = _long_fingerprints(hashes, size, 1) if size >= _LONG else _fingerprints(_running(hashes, size), size, 1)
                prints.append(f)
                item += [j] * len(f)
                offset += range(len(f))
            prints = np.concatenate(prints).view(">u8").ravel().astype(np.uint64)
            tables = []
            for a, b in self.cuts:
                value = self._block(prints, a, b)
                order = np.argsort(value, kind="stable")
                starts = np.searchsorted(value[order], np.arange((1 << (b - a)) + 1))
                tables.append((starts, order, starts[1:] > starts[:-1]))
            self.by_size[size] = (prints, np.array(item), np.array(offset), tables)
        self.longest = max(self.by_size, default=0)
        rare: dict[int, list[tuple[int, int, int]]] = {}
        for j, w in enumerate(self.words):
            if w:
                size = min(5, len(w))
                keys = _combined(_hashes(w, {}), size).tolist()
                held = self._must_hold(j)
                rare.setdefault(size, []).extend(
                    (key, j, at) for at, (key, s) in enumerate(zip(keys, shingles(w, size), strict=True)) if s in held
                )
        self.rare = {}
        for size, rows in rare.items():
            key, item, offset = (np.array(x, t) for x, t in zip(zip(*sorted(rows), strict=True), ("u8", "i8", "i8"), strict=True))
            used = np.zeros(1 << 20, bool)
            used[(key & _LOW).astype(np.int64)] = True
            self.rare[size] = (key, item, offset, used)

    def _must_hold(self, j: int) -> set[tuple[str, ...]]:
        """The rarest shingles of item ``j``: without all of them no passage is a match."""
        weights = self.weights[j]
        spare = (1 - self.threshold) * sum(weights.values()) * (1 + 1e-9)
        held: set[tuple[str, ...]] = set()
        for s in sorted(weights, key=lambda s: (-weights[s], s)):
            if spare < 0:
                break
            held.add(s)
            spare -= weights[s]
        return held

    @staticmethod
    def _block(prints: np.ndarray, a: int, b: int) -> np.ndarray:
        return ((prints >> np.uint64(64 - b)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)

    def candidates(self, hashes: np.ndarray) -> set[tuple[int, int]]:
        """(item, aligned start) of all windows within the radius; starts count from the
        first word of ``hashes`` and can lie before it."""
        running = _running(hashes, self.packed) if self.packed else None
        found: set[tuple[int, int]] = set()
        for size, (prints, item, offset, tables) in self.by_size.items():
            step = stride(size)
            prints_here = _long_fingerprints(hashes, size, step) if size >= _LONG else _fingerprints(running, size, step)
            mine = prints_here.view(">u8").ravel().astype(np.uint64)
            for (a, b), (starts, order, used) in zip(self.cuts, tables, strict=True):
                value = self._block(mine, a, b)
                at = np.flatnonzero(used[value])
                if not len(at):
                    continue
                lo = starts[value[at]]
                n = starts[value[at] + 1] - lo
                window = np.repeat(at, n)
                theirs = order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                near = np.bitwise_count(mine[window] ^ prints[theirs]) <= self.radius
                window, theirs = window[near], theirs[near]
                found.update(zip(item[theirs].tolist(), (window * step - offset[theirs]).tolist(), strict=True))
        return found

    def rare_places(self, hashes: np.ndarray) -> set[tuple[int, int, int]]:
        """(item, aligned start, place) of all places that hold one of an item's rarest shingles."""
        found: set[tuple[int, int, int]] = set()
        for size, (key, item, offset, used) in self.rare.items():
            mine = _combined(hashes, size)
            at = np.flatnonzero(used[(mine & _LOW).astype(np.int64)])
            lo, hi = (np.searchsorted(key, mine[at], side) for side in ("left", "right"))
            n = hi - lo
            place = np.repeat(at, n)
            theirs = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.update(zip(item[theirs].tolist(), (place - offset[theirs]).tolist(), place.tolist(), strict=True))
        return found

    def similarity(self, j: int, words: list[str]) -> float:
        """The share of item ``j``'s shingle weight that ``words`` holds."""
        weights = self.weights[j]
        size = min(5, len(self.words[j]))
        there = set(zip(*(words[i:] for i in range(size)), strict=False))
        return sum(w for s, w in weights.items() if s in there) / sum(weights.values())


def _apart(starts: list[int], gap: int) -> Iterator[list[int]]:
    """The ascending ``starts``, cut where two are more than ``gap`` apart."""
    group: list[int] = []
    for start in starts:
        if group and start - group[-1] > gap:
            yield group
            group = []
        group.append(start)
    yield group


def _window_sums(found: list[tuple[int, tuple[str, ...]]], weights: dict, windows: list[tuple[int, int]], size: int) -> np.ndarray:
    """The weight of the distinct shingles in each window [a, b) of words; windows and
    ``found`` (place, shingle) ascend, so every shingle enters and leaves once."""
    held: Counter = Counter()
    total, head, tail, out = 0.0, 0, 0, []
    for a, b in windows:
        while head < len(found) and found[head][0] <= b - size:
            s = found[head][1]
            total += 0.0 if held[s] else weights[s]
            held[s] += 1
            head += 1
        while tail < head and found[tail][0] < a:
            s = found[tail][1]
            held[s] -= 1
            total -= 0.0 if held[s] else weights[s]
            tail += 1
        out.append(total)
    return np.array(out)


def _best_place(index: BenchmarkIndex, j: int, words: list[str], starts: list[int]) -> tuple[float, float, int]:
    """(similarity with a margin, without it, -start) of the best of the ascending ``starts``.
    Running sums pick it, the earliest of those that agree to 1e-7; its shares are computed in full."""
    n, weights = len(index.words[j]), index.weights[j]
    margin, size = max(1, n // 8), min(5, n)
    wide = [(max(0, at - margin), max(0, at + n + margin)) for at in starts]
    tight = [(max(0, at), max(0, at + n)) for at in starts]
    best = 0
    if len(starts) > 1:
        lo, part = wide[0][0], words[wide[0][0] : wide[-1][1]]
        runs = enumerate(zip(*(part[i:] for i in range(size)), strict=False), lo)
        found = [(at, s) for at, s in runs if s in weights]
        left = np.arange(len(starts))
        for windows in (wide, tight):
            sums = _window_sums(found, weights, [windows[i] for i in left], size)
            # of equal alignments with the margin the one that is best without it
            left = left[sums >= sums.max() - 1e-7]
        best = int(left[0])
    return index.similarity(j, words[slice(*wide[best])]), index.similarity(j, words[slice(*tight[best])]), -starts[best]


def _scan(index: BenchmarkIndex, texts: list[str | None], memo: dict[str, int]) -> list[list[tuple[int, int, int, float]]]:
    """The hits of each text: (item id, start, end, similarity), in code points."""
    lists = [word_list(t) for t in texts]
    out: list[list] = [[] for _ in texts]
    ends = np.cumsum([len(w) for w in lists])
    words = [w for ws in lists for w in ws]
    seen: set[tuple[int, int, int]] = set()
    overlap = max(5, index.longest)
    stretch = max(_STRETCH, overlap)
    for lo in range(0, len(words), stretch):
        hashes = _hashes(words[lo : lo + stretch + overlap], memo)
        for j, start in index.candidates(hashes):
            n = len(index.words[j])
            # the text that holds the passage's middle; windows across texts fail the check
            middle = min(max(lo + start + n // 2, 0), len(words) - 1)
            d = int(np.searchsorted(ends, middle, side="right"))
            first = int(ends[d]) - len(lists[d])
            seen.add((d, j, lo + start - first))
        for j, start, place in index.rare_places(hashes):
            d = int(np.searchsorted(ends, lo + place, side="right"))
            seen.add((d, j, lo + start - int(ends[d]) + len(lists[d])))
    places: dict[tuple[int, int], list[int]] = {}
    for d, j, start in sorted(seen):
        places.setdefault((d, j), []).append(start)
    best = {}
    for (d, j), starts in places.items():
        found = [_best_place(index, j, lists[d], near) for near in _apart(starts, 2 * len(index.words[j]))]
        if max(found)[0] >= index.threshold:
            best[d, j] = max(found)
    for (d, j), (s, _, start) in sorted(best.items()):
        spans = [m.span() for m in _WORD.finditer(texts[d].lower())]
        a, b = max(0, -start), min(len(spans), len(index.words[j]) - start)
        exact = len(texts[d].lower()) == len(texts[d])
        at = (spans[a][0], spans[b - 1][1]) if exact and b > a else (0, len(texts[d]))
        out[d].append((index.ids[j], *at, round(s, 6)))
    return out


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(id, text, n): items that have words, once each."""
    n = F.size(F.filter(F.split(F.col(text), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))
    rows = benchmark.filter(F.col(item).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(item).cast("bigint").alias("id"), F.col(text).alias("text"), n.alias("n")).distinct()


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, chunk in zip(batch["text"].to_pylist(), batch["chunk"].to_pylist(), strict=True):
            own = sorted({" ".join(s) for s in shingles(word_list(text))})
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(own), pa.int64()), pa.array(own, pa.string())], ["chunk", "shingle"])


def _counts(items: DataFrame, chunk: Column) -> DataFrame:
    """(chunk, shingle, n): the shingles of each chunk with the number of items of the whole
    benchmark that hold them."""
    spark = items.sparkSession
    rows = items.select("text", chunk.cast("bigint").alias("chunk")).mapInArrow(_shingle_rows, "chunk bigint, shingle string")
    by_chunk = session_workspace(spark).table(rows.groupBy("chunk", "shingle").agg(F.count("*").alias("n")), "chunk-shingles")
    return by_chunk.select("chunk", "shingle").join(by_chunk.groupBy("shingle").agg(F.sum("n").alias("n")), "shingle")


def scan_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    threshold: float = 0.8,
    radius: int = 3,
    max_words: int = 2_000_000,
) -> DataFrame:
    """``docs`` with ``benchmark_hits``: array<struct<item_id, start, end, similarity>>, the
    items that a text holds, with the place of the passage in code points."""
    bound_batches(docs.sparkSession)
    rows = docs.drop("benchmark_hits")
    items = _items(benchmark, item, item_text)
    size = items.agg(F.sum("n").alias("words"), F.count("*").alias("items")).first()
    chunks = math.ceil((size["words"] or 0) / max_words)
    schema = T.StructType([*rows.schema, T.StructField("benchmark_hits", HITS)])
    if not chunks:
        return rows.withColumn("benchmark_hits", F.array().cast(HITS))
    chunk = F.pmod(F.xxhash64("text"), F.lit(chunks))
    work = session_workspace(docs.sparkSession)
    counts = work.table(_counts(items, chunk), "shingle-counts") if chunks > 1 else None
    shared = []
    for c in range(chunks):
        # at most about max_words words
        own: Column = chunk == c
        held = sorted((r["id"], r["text"]) for r in items.filter(own).select("id", "text").collect())
        if not held:
            continue
        if counts is None:
            df = Counter(s for _, t in held for s in set(shingles(word_list(t))))
        else:  # the shingles of this chunk alone
            df = {tuple(r["shingle"].split(" ")): r["n"] for r in counts.filter(F.col("chunk") == c).collect()}
        rarity = {s: math.log1p(size["items"] / n) for s, n in df.items()}
        shared.append(docs.sparkSession.sparkContext.broadcast(BenchmarkIndex(held, rarity, threshold, radius)))
    if len(shared) == 1:
        return rows.mapInArrow(_pass(shared[0], text), schema)
    # numbered rows, written once: the numbers are the same in all passes
    numbered = work.table(rows.withColumn(_ROW, F.monotonically_increasing_id()), "numbered-documents")
    texts = numbered.select(_ROW, F.col(text))
    narrow = T.StructType([*texts.schema, T.StructField("benchmark_hits", HITS)])
    passes = [texts.mapInArrow(_pass(index, text), narrow).filter(F.size("benchmark_hits") > 0) for index in shared]
    found = reduce(DataFrame.unionByName, [p.select(_ROW, "benchmark_hits") for p in passes])
    merged = found.groupBy(_ROW).agg(F.sort_array(F.flatten(F.collect_list("benchmark_hits"))).alias("benchmark_hits"))
    merged = work.table(merged, "benchmark-hits")
    joined = numbered.join(merged, _ROW, "left").drop(_ROW)
    return joined.withColumn("benchmark_hits", F.coalesce("benchmark_hits", F.array().cast(HITS)))


#: A private column that numbers the rows between passes.
_ROW = "_benchmark_row"


def _pass(shared, text: str):
    kind = pa.list_(
        pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("similarity", pa.float64())])
    )
    names = ("item_id", "start", "end", "similarity")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memo = shared.value, {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                hits = [[dict(zip(names, h, strict=True)) for h in x] for x in _scan(index, batch[text].to_pylist(), memo)]
                yield batch.append_column("benchmark_hits", pa.array(hits, kind))

    return rows
