"""Phrase collocations by direct-address tiling.

The most frequent words of the corpus get ids by falling frequency, language by language. A
pair of ids is a cell of a matrix that is cut into tiles: counting a pair is adding one at an
address. Tiles in which many occurrences fall are counted by ``numpy.bincount`` over the
whole tile; the others as sorted coordinates with their counts (COO). The first tile of an
axis holds its ``TILE`` most frequent ids; the width of the others follows from the size of
the corpus (``_edge``). The pairs that reach the minimum count are ranked by frequency
themselves, and a phrase of three words is a word and a ranked pair, counted in tiles in the
same way.

A task adds up its own occurrences before it sends its tiles; the tiles of all tasks meet
by (language, tile, share), and then the shares of a tile, so that no task merges more
than ``SHARE`` arrays of a tile for each share, nor holds more than one tile.

Ranks reach as far as a fixed bound on the broadcast (``HEAD_WORDS``, ``HEAD_PAIRS``).
Beyond them a bit map of fixed size tells the words (pairs) that may have the minimum count
from those that don't; a phrase has the minimum count only if its parts have. Phrases with a
frequent word or pair beyond the ranks are counted exactly as well, as strings, by a grouped
sum. All results are the same wherever the bounds lie.

Words: A-Z lower-cased, texts split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at
spaces and tabs. Phrases don't cross pieces; overlapping occurrences count.

Defined results: a null text holds nothing; a null language is ``und``; rows with equal keys
are separate texts; an empty table gives an empty result; texts of any length are used
whole; ties in the score go by count, then by phrase in UTF-8 byte order; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workspace import Workspace
from .batches import bound_batches

HEAD_WORDS, HEAD_PAIRS = 1 << 16, 1 << 20
TILE = 2048
SHARE = 64
WORD_BITS, PAIR_BITS = 26, 27  # sizes of the bit maps, as powers of two
_SLICE = 18  # bits of a slice of a bit map, as a power of two
_FLUSH = 1 << 21  # occurrences that a task holds before it adds them up
_KEEP = 400_000  # different strings that a task holds before it sends them on
_IDS = 1 << 22  # ids of words in a task, ranked or not, are below this
_BREAK = b"\n"
_TABLE = bytes.maketrans(b"\t.,;:!?\x0b\x0c\r", b" " + _BREAK * 9)
_END, _RARE, _SKIP = -1, -2, -3
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _tokens(text: str) -> list[bytes]:
    """The words of a text and its breaks, with empty strings between."""
    return text.encode().lower().translate(_TABLE).replace(_BREAK, b" \n ").split(b" ")


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            words = [(w.decode(), n) for w, n in found.items() if w and w != _BREAK]
            for i in range(0, len(words), 50_000):
                part = words[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())],
                    ["lang", "word", "n"],
                )
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(_tokens(text))
            if sum(map(len, counts.values())) > _KEEP:
                yield from out()
    yield from out()


def _word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, seed=xxhash.xxh32_intdigest(lang))


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = (first ^ (first >> np.uint64(31))) * _M1 + second
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _bits_of(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - size)).astype(np.int64)


class BitMap:
    """Which hashes may be there; those whose bit isn't set are not."""

    def __init__(self, size: int, slices: list[tuple[int, bytes]]):
        self.size = size
        self.bits = np.zeros(1 << (size - 3), np.uint8)
        step = 1 << (_SLICE - 3)
        for number, held in slices:
            self.bits[number * step : (number + 1) * step] = np.frombuffer(held, np.uint8)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = _bits_of(hashes, self.size)
        return self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def _bit_rows(size: int, columns: tuple[str, ...]):
    """From words, or the two words of pairs, to the bits of their hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch["lang"].to_pylist()
            hashes = [
                np.array([_word_hash(lang, w.encode()) for lang, w in zip(langs, batch[c].to_pylist(), strict=True)], np.uint64) for c in columns
            ]
            bits = np.unique(_bits_of(hashes[0] if len(columns) == 1 else _pair_hash(*hashes), size))
            yield pa.RecordBatch.from_arrays([pa.array(bits >> _SLICE), pa.array(bits & ((1 << _SLICE) - 1))], ["slice", "bit"])

    return rows


def _slice_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits in order of their slices to the slices' bit maps."""

    def parts() -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            number, bit = batch["slice"].to_numpy(), batch["bit"].to_numpy()
            starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else []
            for a, b in zip(starts, [*starts[1:], len(number)], strict=True):
                yield int(number[a]), bit[a:b]

    for number, held in groupby(parts(), key=lambda p: p[0]):
        flags = np.zeros(1 << _SLICE, np.uint8)
        for _, bit in held:
            flags[bit] = 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["slice", "held"]
        )


def bit_map(frequent: DataFrame, columns: tuple[str, ...], size: int) -> BitMap:
    """The bit map of a table's words (lang, word) or pairs (lang, w1, w2): 2 ** (size - 3) bytes at most."""
    bits = frequent.select("lang", *columns).mapInArrow(_bit_rows(size, columns), "slice bigint, bit bigint")
    slices = bits.repartition("slice").sortWithinPartitions("slice").mapInArrow(_slice_rows, "slice bigint, held binary")
    return BitMap(size, [(r["slice"], bytes(r["held"])) for r in slices.toLocalIterator()])


class Ranks:
    """Ids of the ranked words, and of the ranked pairs, of each language, and what may be
    frequent beyond them."""

    def __init__(self, words: dict[str, list[str]], known: BitMap):
        self.words, self.known_words = words, known  # words by falling frequency
        self.pairs: dict[str, np.ndarray] = {}  # codes by falling frequency
        self.known_pairs: BitMap | None = None


class _Ids(dict):
    """Ids of one language's words in a task: ranked ones first; others that may be frequent
    get ids of the task's own; the rest are rare."""

    def __init__(self, lang: str, words: list[str], known: BitMap):
        super().__init__((w.encode(), i) for i, w in enumerate(words))
        self.lang, self.ranked, self.known = lang, len(words), known
        self.spelled = [w.encode() for w in words]
        self.hashes = [_word_hash(lang, w) for w in self.spelled]
        self.rare = 0
        self.update({b"": _SKIP, _BREAK: _END})

    def __missing__(self, word: bytes) -> int:
        h = _word_hash(self.lang, word)
        at = h >> (64 - self.known.size)
        if not self.known.bits[at >> 3] >> (at & 7) & 1:
            self.rare += 1
            if self.rare < _KEEP:  # remembered; past that number looked up each time
                self[word] = _RARE
            return _RARE
        new = self[word] = len(self.spelled)
        self.spelled.append(word)
        self.hashes.append(h)
        return new

    @property
    def full(self) -> bool:
        return len(self.spelled) > self.ranked + _KEEP

    def forget(self) -> None:
        """Drops the ids of words beyond the ranks."""
        for w in self.spelled[self.ranked :]:
            del self[w]
        del self.spelled[self.ranked :], self.hashes[self.ranked :]


class _Held:
    """Occurrences of cells, added up in a task."""

    def __init__(self):
        self.loose: list[np.ndarray] = []
        self.size = 0
        self.codes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, codes: np.ndarray) -> None:
        self.loose.append(codes)
        self.size += len(codes)
        if self.size > _FLUSH:
            self.settle()

    def settle(self) -> None:
        if not self.size:
            return
        codes, counts = np.unique(np.concatenate(self.loose), return_counts=True)
        merged, at = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
        # weights of bincount are doubles, exact up to 2 ** 53 in a task
        total = np.bincount(at, np.concatenate([self.counts, counts]), len(merged)).astype(np.int64)
        self.codes, self.counts, self.loose, self.size = merged, total, [], 0


_TILES = "lang string, ti bigint, tj bigint, share int, cells binary, counts binary"
_PHRASES = "lang string, w1 string, w2 string, w3 string, a bigint"
_WIDTH = 1 << 20  # of a code's column part: codes are row * _WIDTH + column


def _edge(words: int) -> int:
    """The width of tiles beyond the first of an axis: wide ones for few words, so that a task
    sends few small arrays; ``TILE`` from ten thousand million words on, so that tiles stay small."""
    return TILE << max(0, min(3, round(math.log2(1e10 / max(1, words)) / 2)))


class _Grid:
    def __init__(self, edge: int):
        self.edge = edge

    def tile(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < TILE, 0, 1 + (ids - TILE) // self.edge)

    def start(self, tile):
        return np.where(np.asarray(tile) == 0, 0, TILE + (np.asarray(tile) - 1) * self.edge)

    def width(self, tile: int) -> int:
        return TILE if tile == 0 else self.edge

    def widths(self, tile: np.ndarray) -> np.ndarray:
        return np.where(tile == 0, TILE, self.edge)


def _spans(starts: np.ndarray, ends: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of tiles with about ``most`` entries together."""
    cut = np.flatnonzero(np.diff(starts // most, prepend=-1))
    for i, lo in enumerate(cut):
        hi = cut[i + 1] if i + 1 < len(cut) else len(starts)
        yield starts[lo:hi], ends[lo:hi]


def _tile_batch(lang: str, codes: np.ndarray, counts: np.ndarray, share: int, grid: _Grid) -> Iterator[pa.RecordBatch]:
    """One row for each tile: its addresses (row * width + column within) and counts."""
    row, col = codes // _WIDTH, codes % _WIDTH
    ti, tj = grid.tile(row), grid.tile(col)
    order = np.lexsort((tj, ti))
    ti, tj, row, col, counts = ti[order], tj[order], row[order], col[order], counts[order]
    cells = ((row - grid.start(ti)) * grid.widths(tj) + col - grid.start(tj)).astype(np.int32)
    starts = np.flatnonzero(np.r_[True, (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])])
    for a, b in _spans(starts, np.r_[starts[1:], len(ti)]):
        k = len(a)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * k, pa.string()), pa.array(ti[a]), pa.array(tj[a]), pa.array([share] * k, pa.int32()),
                pa.array([cells[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary()),
                pa.array([counts[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary()),
            ],
            ["lang", "ti", "tj", "share", "cells", "counts"],
        )


def _encode(ids: _Ids, texts: list[str]) -> np.ndarray:
    """The ids of the texts' words, with a break after each text."""
    tokens: list[bytes] = []
    for t in texts:
        tokens += _tokens(t)
        tokens.append(_BREAK)
    found = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
    return found[found != _SKIP]


def _chunks(batch: pa.RecordBatch, size: int = 256) -> Iterator[tuple[str, list[str]]]:
    for lo in range(0, batch.num_rows, size):
        by: dict[str, list[str]] = {}
        part = batch.slice(lo, size)
        for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        yield from by.items()


class _Counting:
    """Phrases of ``width`` words of one language in a task."""

    def __init__(self, ranks: Ranks, lang: str, width: int):
        self.width, self.pairs = width, ranks.known_pairs
        self.ids = _Ids(lang, ranks.words.get(lang, []), ranks.known_words)
        self.hashes = np.array(self.ids.hashes, np.uint64)  # of the ranked words
        self.held, self.loose, self.triples = _Held(), _Held(), Counter()
        codes = ranks.pairs.get(lang, np.zeros(0, np.int64))
        self.order = np.argsort(codes)
        self.placed = codes[self.order]

    def _rank(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The rank of pairs of ids; -1 without one."""
        if not len(self.placed):
            return np.full(len(first), -1)
        code = first * HEAD_WORDS + second
        i = np.minimum(np.searchsorted(self.placed, code), len(self.placed) - 1)
        # ids of the task's own can't be codes of ranked pairs
        ranked = (self.placed[i] == code) & (first < self.ids.ranked) & (second < self.ids.ranked)
        return np.where(ranked, self.order[i], -1)

    def add(self, texts: list[str]) -> None:
        ids = _encode(self.ids, texts)
        n = len(ids) - self.width + 1
        if n <= 0:
            return
        views = [ids[i : i + n] for i in range(self.width)]
        at = np.flatnonzero(np.all([v >= 0 for v in views], axis=0))
        words = [v[at] for v in views]
        limit = self.ids.ranked
        if self.width == 2:
            ranked = (words[0] < limit) & (words[1] < limit)
            self.held.add(words[0][ranked] * _WIDTH + words[1][ranked])
            self.loose.add(words[0][~ranked] * _IDS + words[1][~ranked])
            return
        front, back = self._rank(words[0], words[1]), self._rank(words[1], words[2])
        hashes = np.concatenate([self.hashes, np.array(self.ids.hashes[limit:], np.uint64)])
        for rank, (x, y) in ((front, words[:2]), (back, words[1:])):
            open_ = np.flatnonzero(rank < 0)
            may = self.pairs.may_hold(_pair_hash(hashes[x[open_]], hashes[y[open_]]))
            rank[open_[~may]] = -2  # surely below the minimum count
        both = (front > -2) & (back > -2)
        tiled = both & (front >= 0) & (words[2] < limit)
        # ranks of pairs are below _WIDTH, like those of words
        self.held.add(words[2][tiled] * _WIDTH + front[tiled])
        rest = both & ~tiled
        self.triples.update(zip(*(w[rest].tolist() for w in words), strict=True))

    @property
    def full(self) -> bool:
        return len(self.held.codes) > 2 * _FLUSH or len(self.loose.codes) > _KEEP or len(self.triples) > _KEEP or self.ids.full

    def strings(self) -> Iterator[tuple[list[list[str | None]], list[int]]]:
        """The phrases with words or pairs beyond the ranks, in parts; forgets them."""
        self.loose.settle()
        if self.width == 2:
            columns = [self.loose.codes // _IDS, self.loose.codes % _IDS]
            counts = self.loose.counts
        else:
            listed = np.array(list(self.triples), np.int64).reshape(-1, 3)
            columns, counts = list(listed.T), np.array(list(self.triples.values()), np.int64)
        spelled = self.ids.spelled
        for lo in range(0, len(counts), 50_000):
            part = slice(lo, lo + 50_000)
            words: list[list[str | None]] = [[spelled[i].decode() for i in c[part].tolist()] for c in columns]
            words += [[None] * len(words[0])] * (3 - self.width)
            yield words, counts[part].tolist()
        self.loose, self.triples = _Held(), Counter()
        self.ids.forget()


def _count_rows(ranks: Ranks, width: int, shares: int, edge: int):
    """From texts to the tiles of their phrases of ``width`` words (the rows with ``cells``) and
    the phrases beyond the ranks as strings (the others)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        share, grid = TaskContext.get().partitionId() % shares, _Grid(edge)
        found: dict[str, _Counting] = {}

        def send(lang: str, own: _Counting) -> Iterator[pa.RecordBatch]:
            own.held.settle()
            for batch in _tile_batch(lang, own.held.codes, own.held.counts, share, grid) if len(own.held.codes) else ():
                k = batch.num_rows
                empty = [pa.nulls(k, pa.string())] * 3 + [pa.nulls(k, pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *empty], [*batch.schema.names, "w1", "w2", "w3", "a"])
            own.held = _Held()
            for words, counts in own.strings():
                k = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * k, pa.string()),
                        pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()),
                        pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()),
                        *[pa.array(w, pa.string()) for w in words],
                        pa.array(counts, pa.int64()),
                    ],
                    ["lang", "ti", "tj", "share", "cells", "counts", "w1", "w2", "w3", "a"],
                )

        for batch in batches:
            for lang, texts in _chunks(batch):
                if lang not in found:
                    if len(found) >= 16:  # languages that a task holds at a time
                        for other in list(found):
                            yield from send(other, found.pop(other))
                    found[lang] = _Counting(ranks, lang, width)
                found[lang].add(texts)
                if found[lang].full:
                    yield from send(lang, found[lang])
        for lang, own in found.items():
            yield from send(lang, own)

    return rows


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[tuple[bytes, bytes]]]]:
    """Groups of equal keys in sorted input, whose arrays are read one after another."""

    def read() -> Iterator[tuple[tuple, bytes, bytes]]:
        for batch in batches:
            cols = [batch[k].to_pylist() for k in (*keys, "cells", "counts")]
            for row in zip(*cols, strict=True):
                yield row[:-2], row[-2], row[-1]

    for key, rows in groupby(read(), key=lambda r: r[0]):
        yield key, ((cells, counts) for _, cells, counts in rows)


def add_up(arrays: Iterator[tuple[bytes, bytes]], area: int, share: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The addresses of a tile of ``area`` cells and their total counts. Sorted coordinates are
    merged; a tile of ``TILE`` by ``TILE`` cells or less becomes an array over all of it once
    they fill one in ``share`` of its cells."""
    cells, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    loose: list[tuple[np.ndarray, np.ndarray]] = []
    waiting, tile = 0, None
    step = max(1, min(area // share, _FLUSH))

    def merge() -> None:
        nonlocal cells, counts, loose, waiting, tile
        if not loose:
            return
        c = np.concatenate([x for x, _ in loose])
        n = np.concatenate([x for _, x in loose])
        loose, waiting = [], 0
        if tile is None and area <= TILE * TILE and len(cells) + len(c) >= area // share:
            tile = np.zeros(area, np.int64)
            tile[cells] = counts
        if tile is not None:
            # halves of the counts, so that the doubles of bincount stay exact
            tile += np.bincount(c, n & 0xFFFFFFFF, area).astype(np.int64)
            if (n >> 32).any():
                tile += np.bincount(c, n >> 32, area).astype(np.int64) << 32
            return
        c, n = np.concatenate([cells, c]), np.concatenate([counts, n])
        order = np.argsort(c, kind="stable")
        c, n = c[order], n[order]
        starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        cells, counts = c[starts], np.add.reduceat(n, starts)

    for a, b in arrays:
        x = np.frombuffer(a, np.int32)
        loose.append((x, np.frombuffer(b, np.int64)))
        waiting += len(x)
        if waiting >= max(step, len(cells)):
            merge()
    merge()
    if tile is not None:
        cells = np.flatnonzero(tile)
        counts = tile[cells]
    return cells, counts


def _share_rows(edge: int):
    """The shares of the tiles, added up."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = _Grid(edge)
        for (lang, ti, tj, share), arrays in _runs(batches, ("lang", "ti", "tj", "share")):
            cells, counts = add_up(arrays, grid.width(ti) * grid.width(tj))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang], pa.string()), pa.array([ti], pa.int64()), pa.array([tj], pa.int64()), pa.array([share], pa.int32()),
                    pa.array([cells.astype(np.int32).tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()),
                ],
                ["lang", "ti", "tj", "share", "cells", "counts"],
            )

    return rows


def _phrase_rows(ranks: Ranks, width: int, least: int, edge: int):
    """From the shares of the tiles to the phrases with ``least`` occurrences."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grid = {lang: np.array(ws, object) for lang, ws in ranks.words.items()}, _Grid(edge)
        for (lang, ti, tj), arrays in _runs(batches, ("lang", "ti", "tj")):
            cells, counts = add_up(arrays, grid.width(ti) * grid.width(tj))
            often = counts >= least
            cells, counts = cells[often], counts[often]
            if not len(cells):
                continue
            row, col = grid.start(ti) + cells // grid.width(tj), grid.start(tj) + cells % grid.width(tj)
            of = words[lang]
            if width == 2:
                phrase, code = [of[row], of[col], [None] * len(row)], row * HEAD_WORDS + col
            else:
                pair = ranks.pairs[lang][col]
                phrase, code = [of[pair // HEAD_WORDS], of[pair % HEAD_WORDS], of[row]], np.full(len(row), -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(row), pa.string()), *[pa.array(list(p), pa.string()) for p in phrase], pa.array(counts, pa.int64()), pa.array(code)],
                ["lang", "w1", "w2", "w3", "a", "code"],
            )

    return rows


def count_phrases(texts: DataFrame, ranks: Ranks, width: int, least: int, edge: int, work: Workspace) -> DataFrame:
    """(lang, w1, w2, w3, a, code): the phrases of ``width`` words with ``least`` occurrences or
    more. ``code`` has the ids of a pair of ranked words, -1 elsewhere."""
    shares = max(1, -(-texts.rdd.getNumPartitions() // SHARE))
    counted = texts.mapInArrow(_count_rows(ranks, width, shares, edge), f"{_TILES}, w1 string, w2 string, w3 string, a bigint")
    counted = work.table(counted, f"tiles-{width}")
    tiles = counted.filter("cells is not null").select("lang", "ti", "tj", "share", "cells", "counts")
    if shares > 1:
        tiles = tiles.repartition("lang", "ti", "tj", "share").sortWithinPartitions("lang", "ti", "tj", "share")
        tiles = tiles.mapInArrow(_share_rows(edge), _TILES)
    tiles = tiles.repartition("lang", "ti", "tj").sortWithinPartitions("lang", "ti", "tj")
    ranked = tiles.mapInArrow(_phrase_rows(ranks, width, least, edge), f"{_PHRASES}, code bigint")
    beyond = counted.filter("cells is null").groupBy("lang", "w1", "w2", "w3").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return work.table(ranked.unionByName(beyond.withColumn("code", F.lit(-1).cast("bigint"))), f"phrases-{width}")


def most_frequent(table: DataFrame, count: str, most: int) -> DataFrame:
    """The rows above a count that at most ``most`` rows reach. The bound comes from counts of
    equal logarithms, so that nothing is sorted in one place."""
    level = F.floor(F.log2(F.col(count)) * 64)
    levels = table.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()  # a few thousand at most
    total, lowest = 0, None
    for r in sorted(levels, reverse=True):
        total += r["rows"]
        if total > most:
            break
        lowest = r["level"]
    return table.filter(level >= lowest) if lowest is not None else table.filter(F.lit(False))


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)), in whole numbers of up to 38 digits."""
    product = (_wide(a) * _wide(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", product.cast("decimal(38,0)"), (_wide(left) * _wide(right)).cast("decimal(38,0)"))


def collocations(
    docs: DataFrame,
    work: Workspace,
    lang: str = "lang",
    text: str = "text",
    least: int = 10,
    top: int = 2000,
    inside: int = 50,
    head_words: int = HEAD_WORDS,
    head_pairs: int = HEAD_PAIRS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two and three words.

    ``a`` is the count of the phrase (``least`` or more), ``l`` and ``r`` those of its parts at
    the cut with the lowest score, ``n`` the words of the language. A pair that lies in a phrase
    of three words with ``inside`` percent of its count or more is left out.
    """
    if not (0 < head_words <= HEAD_WORDS and 0 < head_pairs <= HEAD_PAIRS):
        raise ValueError("head_words and head_pairs have to lie within the bounds of the broadcast")
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("text is not null")
    words = work.table(texts.mapInArrow(_word_rows, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.filter(F.col("n") >= least)
    size = words.agg(F.sum("n")).first()[0] or 0
    edge = _edge(size)

    head = most_frequent(often, "n", head_words).select("lang", "word", "n").toArrow().to_pylist()
    ranked: dict[str, list[str]] = {}
    for r in sorted(head, key=lambda r: (-r["n"], r["word"])):
        ranked.setdefault(r["lang"], []).append(r["word"])
    ranks = Ranks(ranked, bit_map(often, ("word",), WORD_BITS))
    pairs = count_phrases(texts, ranks, 2, least, edge, work)
    first = most_frequent(pairs.filter("code >= 0"), "a", head_pairs).select("lang", "code", "a").toArrow()
    langs = first["lang"].combine_chunks().dictionary_encode() if first.num_rows else None
    codes, counts = (first[c].to_numpy() for c in ("code", "a"))
    for i, lang in enumerate(langs.dictionary.to_pylist() if langs else []):
        own = np.flatnonzero(langs.indices.to_numpy() == i)
        ranks.pairs[lang] = codes[own][np.lexsort((codes[own], -counts[own]))]
    ranks.known_pairs = bit_map(pairs, ("w1", "w2"), PAIR_BITS)
    triples = count_phrases(texts, ranks, 3, least, edge, work)

    def of(kept: DataFrame, name: str, **columns: str) -> DataFrame:
        """``kept``'s counts as ``name``, with its columns under the names they are joined by."""
        count = "n" if "n" in kept.columns else "a"
        return kept.select("lang", *[F.col(c).alias(new) for c, new in columns.items()], F.col(count).alias(name))

    two = pairs.join(of(often, "l1", word="w1"), ["lang", "w1"]).join(of(often, "r1", word="w2"), ["lang", "w2"])
    two = two.select("lang", "w1", "w2", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("l1").alias("l"), F.col("r1").alias("r"))
    parts = F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))
    within = triples.select("lang", F.explode(parts).alias("p"), "a").groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longer"))
    two = two.join(within, ["lang", "w1", "w2"], "left")
    two = two.filter(F.coalesce(100 * F.col("longer"), F.lit(-1)) < inside * F.col("a"))
    two = two.select("lang", "phrase", "a", "l", "r", _score("a", "l", "r").alias("score"))

    three = triples.join(of(often, "l1", word="w1"), ["lang", "w1"]).join(of(pairs, "r1", w1="w2", w2="w3"), ["lang", "w2", "w3"])
    three = three.join(of(pairs, "l2", w1="w1", w2="w2"), ["lang", "w1", "w2"]).join(of(often, "r2", word="w3"), ["lang", "w3"])
    three = three.withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    late = F.col("s2") < F.col("s1")
    three = three.select(
        "lang",
        F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"),
        "a",
        F.when(late, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(late, F.col("r2")).otherwise(F.col("r1")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = two.unionByName(three).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
