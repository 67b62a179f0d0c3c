"""The sketches of ``fingerprints`` for many pairs of texts at a time, in numpy.

Same paragraphs, digests, cells, blocks and peeling as the column expressions of
``fingerprints``, for tasks that run Python; the query peels them as tables (``sketchtables``). Here a
task takes the pairs of an Arrow batch, lays the cells of all their blocks in one matrix and
peels them together: in a round every block gives what its cells with one entry hold.

Defined results: as in ``fingerprints``. A batch is bounded in rows and bytes; a text longer
than that goes alone, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from . import fingerprints as fp

_SEED = 42  # of the hash functions of column expressions
_BREAK = re.compile(fp._BREAK)
_SPACE = re.compile("(?<= )")
# The primes of the 64-bit xxHash.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
_LOW = np.uint64(0xFFFF)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def hash_long(x: np.ndarray, seed) -> np.ndarray:
    """The hash of 64-bit integers, as a column expression hashes them."""
    with np.errstate(over="ignore"):
        seed = np.asarray(seed, np.uint64)
        h = (seed + _P5 + np.uint64(8)) ^ (_turn(x * _P2, 31) * _P1)
        return _finish(_turn(h, 27) * _P1 + _P4)


def hash_int(x: np.ndarray, seed) -> np.ndarray:
    """The hash of 32-bit integers (not negative)."""
    with np.errstate(over="ignore"):
        seed = np.asarray(seed, np.uint64)
        h = (seed + _P5 + np.uint64(4)) ^ (x.astype(np.uint64) * _P1)
        return _finish(_turn(h, 23) * _P2 + _P3)


def hash_text(text: str, seed: int = _SEED) -> int:
    return xxhash.xxh64_intdigest(text.encode(), seed)


_CHECK = np.uint64(hash_text("check"))
_BLOCK = np.uint64(hash_text("block"))


def _cut_items(items: list[str], window: int, spacing: int, apart: int, longest: int) -> list[str]:
    n = len(items)
    if n < 2:
        return items
    memo: dict[tuple[str, ...], int] = {}
    marks = []
    for i in range(1, n):
        run = tuple(items[i : i + window])
        h = memo.get(run)
        if h is None:
            h = _SEED
            for x in run:  # past the end nothing is hashed
                h = hash_text(x, h)
            memo[run] = h = (h - (1 << 64) if h >> 63 else h) % spacing
        if h == 0:
            marks.append(i)
    kept = [m for j, m in enumerate(marks) if j == 0 or m - marks[j - 1] >= apart]
    starts = [s for a, b in zip([0, *kept], [*kept, n], strict=True) for s in range(a, b, longest)]
    return ["".join(items[a:b]) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def _short(sentence: str) -> list[str]:
    words = _SPACE.split(sentence)
    if all(len(w) <= fp.LONG for w in words):
        parts = _cut_items(words, 1, *fp.WORD_CUTS)
        return [p[i : i + fp.LONG] for p in parts for i in range(0, max(1, len(p)), fp.LONG)]
    out = []
    for w in words:
        out += [w] if len(w) <= fp.LONG else _cut_items(list(w), 4, fp.SPACING, fp.APART, fp.LONG)
    return out


def paragraphs(text: str) -> list[str]:
    out = []
    for sentence in _BREAK.split(text):
        if len(sentence) <= fp.LONG:
            out.append(sentence)
        else:
            out += _short(sentence)
    return out


def _checks(high: np.ndarray) -> np.ndarray:
    return hash_long(high, _CHECK) >> np.uint64(48)


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The digests of all texts, and the number of the text each belongs to."""
    hashed, sizes = [], []
    for t in texts:
        own = [hash_text(p) for p in paragraphs(t)]
        hashed += own
        sizes.append(len(own))
    h, of = np.array(hashed, np.uint64), np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    # equal paragraphs of a text are next to each other: their number makes them differ
    first = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])] if len(h) else np.zeros(0, bool)
    at = np.arange(len(h))
    number = at - np.maximum.accumulate(np.where(first, at, 0)) if len(h) else at
    d = hash_int(number, hash_long(h, _SEED)) & ~_LOW
    return d | _checks(d), of


def places(d: np.ndarray, salt: int) -> np.ndarray:
    """(digests, 3): the cells of each digest."""
    h = hash_int(np.full(len(d), salt), hash_long(d, _SEED)).view(np.int64)
    return np.stack([np.mod(h >> (16 * i), n) + first for i, (first, n) in enumerate(fp.PARTS)], axis=1)


def cells(d: np.ndarray, of: np.ndarray, blocks: int, salt: int, sign: np.ndarray | int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, cells): the number of entries and the exclusive-or of their digests."""
    n, x = np.zeros(blocks * fp.CELLS, np.int64), np.zeros(blocks * fp.CELLS, np.uint64)
    at = (of[:, None] * fp.CELLS + places(d, salt)).ravel()
    np.add.at(n, at, np.repeat(np.broadcast_to(np.asarray(sign, np.int64), d.shape), len(fp.PARTS)))
    np.bitwise_xor.at(x, at, np.repeat(d, len(fp.PARTS)))
    return n.reshape(blocks, fp.CELLS), x.reshape(blocks, fp.CELLS)


def peel(n: np.ndarray, x: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, sign) of the digests recovered from each block of differences; ``n`` and ``x``
    become what is left."""
    flat_n, flat_x = n.reshape(-1), x.reshape(-1)
    out_block, out_sign = [], []
    look = np.arange(len(flat_n))
    for _ in range(fp.ROUNDS):
        look = look[np.abs(flat_n[look]) == 1]
        held = flat_x[look]
        pure = look[(held & _LOW) == _checks(held & ~_LOW)]
        if not len(pure):
            break
        # a digest can stand alone in several of its cells: it is taken out once
        block, d, sign = pure // fp.CELLS, flat_x[pure], flat_n[pure]
        order = np.lexsort((sign, d, block))
        block, d, sign = block[order], d[order], sign[order]
        new = np.r_[True, (block[1:] != block[:-1]) | (d[1:] != d[:-1]) | (sign[1:] != sign[:-1])]
        block, d, sign = block[new], d[new], sign[new]
        out_block.append(block)
        out_sign.append(sign)
        at = (block[:, None] * fp.CELLS + places(d, salt)).ravel()
        np.subtract.at(flat_n, at, np.repeat(sign, len(fp.PARTS)))
        np.bitwise_xor.at(flat_x, at, np.repeat(d, len(fp.PARTS)))
        # only blocks that gave something can give more
        look = (np.unique(block)[:, None] * fp.CELLS + np.arange(fp.CELLS)).ravel()
    if not out_block:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_block), np.concatenate(out_sign)


def differing(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """How many digests only one side of each pair has, recovered from sketches of growing
    size, and how many digests lie in blocks that didn't come out of the largest."""
    d, pair = np.concatenate([a, b]), np.concatenate([of_a, of_b])
    side = np.concatenate([np.ones(len(a), np.int64), -np.ones(len(b), np.int64)])
    block, owner = pair.copy(), np.arange(pairs)
    found, rest = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    for tier in range(fp.TIERS + 1):
        if not len(owner):
            break
        n, x = cells(d, block, len(owner), tier, side)
        # a one-sided difference makes the squares grow faster: no more can differ than there are
        guess = np.minimum((n * n).sum(1) / len(fp.PARTS), np.bincount(block, minlength=len(owner)))
        tried = np.flatnonzero(guess <= fp.HOPELESS)
        mine, theirs = n[tried], x[tried]
        got, _ = peel(mine, theirs, tier)
        out = ((mine == 0) & (theirs == 0)).all(1)
        counted = np.bincount(got, minlength=len(tried))
        np.add.at(found, owner[tried[out]], counted[out])
        open_ = np.ones(len(owner), bool)
        open_[tried[out]] = False
        keep = open_[block]
        d, side, block = d[keep], side[keep], block[keep]
        # the blocks that are left are cut into smaller ones
        parts = np.maximum(2, np.ceil(guess / fp.LOAD)).astype(np.int64)
        start = np.cumsum(np.where(open_, parts, 0)) - np.where(open_, parts, 0)
        h = hash_int(np.full(len(d), tier), hash_long(d, _BLOCK)).view(np.int64)
        block = start[block] + np.mod(h, parts[block])
        owner = np.repeat(owner[open_], parts[open_])
    np.add.at(rest, owner[block] if len(block) else block, 1)
    return found, rest


def fingerprint(n: np.ndarray, x: np.ndarray) -> str:
    """A one-block sketch as text."""
    mask = (1 << 64) - 1
    return ",".join("" if not k else f"{int(k) & mask:X}:{int(v):X}" for k, v in zip(n.tolist(), x.tolist(), strict=True))


def likeness(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, pairs: int) -> np.ndarray:
    """Shared / all paragraphs of each pair, by the recovered differences; where a rest was left,
    by the digests themselves."""
    apart, rest = differing(a, of_a, b, of_b, pairs)
    for i in np.flatnonzero(rest):
        apart[i] = len(np.setxor1d(a[of_a == i], b[of_b == i]))
    total = np.bincount(of_a, minlength=pairs) + np.bincount(of_b, minlength=pairs)
    return (total - apart) / (total + apart)


RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared_rows(key: str):
    """From (key, text, next_text) to the key and ``RESULT``: each text against its edited form
    (its last half replaced by the beginning of the next) and against the next."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in (b.slice(lo, 64) for b in batches for lo in range(0, b.num_rows, 64)):
            texts, following = batch["text"].to_pylist(), batch["next_text"].to_pylist()
            edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
            k = len(texts)
            a, b, c = digests(texts), digests(edited), digests(following)
            prints = [[fingerprint(n, x) for n, x in zip(*cells(*d, k, 0), strict=True)] for d in (a, b)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch[key], pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    *[pa.array(p, pa.string()) for p in prints],
                    pa.array(likeness(*a, *b, k), pa.float64()), pa.array(likeness(*a, *c, k), pa.float64()),
                ],
                [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return rows
