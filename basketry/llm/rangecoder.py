"""Adaptive context-mixing range coder for token ids, many blocks in step.

Each block is coded on its own: its model starts from the same state, and it has a
checksum. Numpy codes one position of many blocks at a time.

Model of the next id: a mixture of three predictions,

    order 2   the id that last followed the two previous ids
    order 1   the id that last followed the previous id
    order 0   adaptive frequencies of the low byte (16 groups of 16), then the high
              byte last seen with that low byte, or any

P(id) = a2 [id = order 2] + a1 [id = order 1] + a0 P0(id). The weights are the
block's own running hit rates, kept apart by how many of the last ids the order-2
prediction got right. The interval of an id is the mixture's; the coder narrows a
60-bit range and puts out digits of 12 bits. A digit can exceed 12 bits; such
carries are added to the digits before it when the block is complete.

Block layout (big-endian): 4 bytes ``CMR1``, number of ids, CRC-32 of the ids as
little-endian unsigned 32-bit integers, number of digits (unsigned 32-bit each),
digits in pairs of 3 bytes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR1"
MAX_ID = (1 << 16) - 257  # its bytes swapped and one added still fit 16 bits
_HEAD = struct.Struct(">4sIII")
_SLOT_BITS = 12
_SLOTS = 1 << _SLOT_BITS
_F = 13  # bits of the frequencies of a low-byte half
_HI = 9  # bits of the high-byte frequencies: 256 even, 256 for the last one seen
_W = 6  # bits of the weights
_TOTAL = 2 * _F + _HI + _W
_DIGIT, _TOP = 12, 48  # digits leave the range at bit 48
_MASK = (1 << _TOP) - 1
_RATE = 5
_RUNS = 4
_TARGET = np.array([[i if i <= s else (1 << _F) - 16 + i for i in range(17)] for s in range(16)], np.int16)


def _swap(x: np.ndarray) -> np.ndarray:
    """Low byte first: the order in which the cumulative frequencies run."""
    return ((x & 255) << 8) | (x >> 8)


class _Model:
    """The state of ``lanes`` blocks and the prediction for their next symbols.

    A symbol is an id with its bytes swapped; 0 in a table marks an empty prediction,
    so the tables hold symbols plus one.
    """

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.base = self.lane * _SLOTS
        self.two = np.zeros(lanes * _SLOTS, np.uint16)
        self.one = np.zeros(lanes * _SLOTS, np.uint16)
        even = ((np.arange(17) << _F) // 16).astype(np.int16)
        self.group = np.tile(even, (lanes, 1))
        self.inner = np.tile(even, (lanes * 16, 1))
        self.group_flat, self.inner_flat = self.group.ravel(), self.inner.ravel()
        self.last = np.zeros(lanes * 256, np.uint8)
        self.rate2 = np.full(lanes * _RUNS, 1 << 12, np.int32)
        self.rate1 = np.full(lanes, 1 << 12, np.int32)
        self.run = np.zeros(lanes, np.int64)
        self.prev = np.zeros(lanes, np.int64)
        self.mixed = np.zeros(lanes, np.int64)  # the symbol before prev, hashed
        self.lane16, self.lane17, self.lane256 = self.lane * 16, self.lane * 17, self.lane * 256

    def predict(self) -> None:
        hashed = self.prev * 0x9E3779B1
        self.at1 = self.base + (hashed >> 15 & (_SLOTS - 1))
        self.at2 = self.base + ((hashed ^ self.mixed) >> 14 & (_SLOTS - 1))
        self.p1 = self.one.take(self.at1).astype(np.int64) - 1
        self.p2 = self.two.take(self.at2).astype(np.int64) - 1
        self.has1, self.has2 = self.p1 >= 0, self.p2 >= 0
        self.at_rate = self.lane * _RUNS + self.run
        self.r2 = self.rate2.take(self.at_rate)
        # weights in 64ths; an empty prediction gets none, and order 0 at least 3
        a2 = (self.r2 * 61 >> 16) * self.has2
        a1 = ((61 - a2) * self.rate1 >> 16) * self.has1
        self.a0 = (64 - a1 - a2).astype(np.int64)
        self.m1, self.m2 = a1.astype(np.int64) << (_TOTAL - _W), a2.astype(np.int64) << (_TOTAL - _W)

    def _order0(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cumulative, frequency) of symbols under order 0, in units of 2^-(2F+HI)."""
        lo, hi = x >> 8, x & 255
        g = lo >> 4
        at = self.lane17 + g
        g0 = self.group_flat.take(at).astype(np.int64)
        gf = self.group_flat.take(at + 1) - g0
        at = (self.lane16 + g) * 17 + (lo & 15)
        i0 = self.inner_flat.take(at).astype(np.int64)
        f = self.inner_flat.take(at + 1) - i0
        last = self.last.take(self.lane256 + lo)
        gi = gf * f
        cum = (((g0 << _F) + gf * i0) << _HI) + gi * (hi + ((hi > last) * 256))
        return cum, gi * (1 + ((hi == last) * 256))

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cumulative, frequency) of symbols under the mixture, in units of 2^-TOTAL."""
        cum, freq = self._order0(x)
        self.hit1, self.hit2 = self.p1 == x, self.p2 == x
        cum = cum * self.a0 + self.m1 * (self.p1 < x) + self.m2 * (self.p2 < x)
        return cum, freq * self.a0 + self.m1 * self.hit1 + self.m2 * self.hit2

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, cumulative, frequency) of the intervals that hold ``v``."""
        held: list[tuple[np.ndarray, ...]] = []
        below = np.zeros(len(v), np.int64)
        for p, m, q, n in ((self.p1, self.m1, self.p2, self.m2), (self.p2, self.m2, self.p1, self.m1)):
            at = np.flatnonzero(m)  # predictions without weight have no interval of their own
            if not len(at):
                continue
            start, end = self._at(at, p[at], q[at], m[at], n[at])
            va = v[at]
            hit = (va >= start) & (va < end)
            held.append((at[hit], p[at[hit]], start[hit], end[hit] - start[hit]))
            below[at] += m[at] * (va >= end)
        v = (v - below) // self.a0
        # order 0: group, then half byte, then high byte
        target = (v >> (_F + _HI)).astype(np.int16)
        g = (self.group[:, 1:16] <= target[:, None]).sum(1)
        at = self.lane17 + g
        g0 = self.group_flat.take(at).astype(np.int64)
        gf = self.group_flat.take(at + 1) - g0
        rest = v - (g0 << (_F + _HI))
        rows = self.inner.take(self.lane16 + g, 0)
        half = ((rest >> _HI) // gf).astype(np.int16)
        i = (rows[:, 1:16] <= half[:, None]).sum(1)
        at = self.lane17 + i
        rows = rows.ravel()
        i0 = rows.take(at).astype(np.int64)
        gi = gf * (rows.take(at + 1) - i0)
        lo = (g << 4) | i
        before = (gf * i0) << _HI
        h = (rest - before) // gi
        last = self.last.take(self.lane256 + lo)
        hi = np.where(h <= last, h, np.maximum(h - 256, last))
        x = (lo << 8) | hi
        cum = (((g0 << (_F + _HI)) + before) + gi * (hi + ((hi > last) * 256))) * self.a0 + below
        freq = gi * (1 + ((hi == last) * 256)) * self.a0
        for at, symbol, start, size in held:
            x[at], cum[at], freq[at] = symbol, start, size
        self.hit1, self.hit2 = self.p1 == x, self.p2 == x
        return x, cum, freq

    def _at(self, at, p, q, m, n) -> tuple[np.ndarray, np.ndarray]:
        """The mixture's interval of the predicted symbols ``p`` of the lanes ``at``."""
        lo, hi = p >> 8, p & 255
        g = lo >> 4
        j = at * 17 + g
        g0 = self.group_flat.take(j).astype(np.int64)
        gf = self.group_flat.take(j + 1) - g0
        j = (at * 16 + g) * 17 + (lo & 15)
        i0 = self.inner_flat.take(j).astype(np.int64)
        f = self.inner_flat.take(j + 1) - i0
        last = self.last.take(at * 256 + lo)
        gi, a0 = gf * f, self.a0[at]
        cum = (((g0 << _F) + gf * i0) << _HI) + gi * (hi + ((hi > last) * 256))
        start = cum * a0 + n * (q < p) * (q >= 0)
        return start, start + gi * (1 + ((hi == last) * 256)) * a0 + m + n * (q == p)

    def update(self, x: np.ndarray) -> None:
        lo = x >> 8
        g = lo >> 4
        step = _TARGET.take(g, 0)
        step -= self.group
        step >>= _RATE
        self.group += step
        at = self.lane16 + g
        rows = self.inner.take(at, 0)
        step = _TARGET.take(lo & 15, 0)
        step -= rows
        step >>= _RATE - 1
        rows += step
        self.inner[at] = rows
        self.last[self.lane256 + lo] = x & 255
        hit2 = self.hit2
        self.rate2[self.at_rate] = self.r2 + ((hit2 * 65536 - self.r2) * self.has2 >> 5)
        self.rate1 += ((self.hit1 * 65536 - self.rate1) * (self.has1 & ~hit2) >> 5).astype(np.int32)
        self.run = np.minimum(self.run + 1, _RUNS - 1) * hit2
        plus = (x + 1).astype(np.uint16)
        self.two[self.at2] = plus
        self.one[self.at1] = plus
        self.mixed, self.prev = self.prev * 0x85EBCA77, x


def encode_blocks(ids: np.ndarray, lengths: np.ndarray | None = None) -> list[bytes]:
    """Code blocks: ``ids`` is (blocks, length); ``lengths`` gives the ids that count of
    each, if not all do."""
    lanes, n = ids.shape
    if ids.size and int(ids.max()) > MAX_ID:
        raise ValueError(f"ids above {MAX_ID} can't be coded")
    lengths = np.full(lanes, n) if lengths is None else np.asarray(lengths)
    ends = {int(t): np.flatnonzero(lengths == t) for t in np.unique(lengths)}
    going = np.ones(lanes, bool)
    model = _Model(lanes)
    columns = _swap(np.ascontiguousarray(ids.T).astype(np.uint16))
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 60, np.int64)
    digits = np.zeros((n + 64, lanes), np.uint16)
    pos = np.zeros(lanes, np.int64)

    def room(most: int) -> None:
        nonlocal digits
        if most >= len(digits):
            digits = np.concatenate([digits, np.zeros((n // 2 + 64, lanes), np.uint16)])

    def put(lane: np.ndarray) -> None:
        at = pos[lane]
        room(int(at.max()))
        held = low[lane]
        digits[at, lane] = held >> _TOP
        low[lane] = (held & _MASK) << _DIGIT
        pos[lane] = at + 1

    def finish(lane: np.ndarray) -> None:
        for _ in range(5):
            put(lane)
        going[lane] = False

    if 0 in ends:
        finish(ends[0])
    for t, x in enumerate(columns):
        x = x.astype(np.int64)
        model.predict()
        cum, freq = model.interval(x)
        unit = span >> _TOTAL
        low += unit * cum
        span = unit * freq
        # the first digit of all lanes at once: one that isn't due is written over later
        if t % 32 == 0:
            room(int(pos.max()) + 128)
        digits.ravel()[pos * lanes + model.lane] = low >> _TOP
        due = span < (1 << _TOP)
        if not going.all():
            due &= going
        shift = due * _DIGIT
        low = np.where(due, low & _MASK, low) << shift
        span <<= shift
        pos += due
        while len(lane := np.flatnonzero((span < (1 << _TOP)) & going)):
            put(lane)
            span[lane] <<= _DIGIT
        model.update(x)
        if t + 1 in ends:
            finish(ends[t + 1])
        if not going.all():  # a lane at its end goes on without effect
            low[~going], span[~going] = 0, 1 << 60
    for j in range(len(digits) - 1, 0, -1):
        digits[j - 1] += digits[j] >> _DIGIT
    digits &= (1 << _DIGIT) - 1
    out, rows = [], np.ascontiguousarray(digits.T)
    for b in range(lanes):
        d = rows[b, : pos[b]].astype(np.uint32)
        if len(d) % 2:
            d = np.append(d, np.uint32(0))
        pair = (d[0::2] << 12) | d[1::2]
        body = np.column_stack([pair >> 16, pair >> 8, pair]).astype(np.uint8).tobytes()
        own = ids[b, : lengths[b]]
        out.append(_HEAD.pack(MAGIC, len(own), zlib.crc32(own.astype("<u4").tobytes()), int(pos[b])) + body)
    return out


def _digits(block: bytes) -> tuple[int, int, np.ndarray]:
    if len(block) < _HEAD.size:
        raise ValueError("not a block of this format")
    magic, n, crc, count = _HEAD.unpack_from(block)
    body = np.frombuffer(block, np.uint8, offset=_HEAD.size).astype(np.uint32)
    if magic != MAGIC or len(body) != (count + 1) // 2 * 3:
        raise ValueError("not a block of this format")
    pair = (body[0::3] << 16) | (body[1::3] << 8) | body[2::3]
    return n, crc, np.column_stack([pair >> 12, pair & 4095]).ravel()[:count]


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises if a checksum differs."""
    if not blocks:
        return []
    parsed = [_digits(b) for b in blocks]
    lanes, n = len(parsed), max(p[0] for p in parsed)
    # digits past a block's end read as zeros
    digits = np.zeros((max(len(p[2]) for p in parsed) + 8, lanes), np.uint16)
    for b, p in enumerate(parsed):
        digits[: len(p[2]), b] = p[2]
    flat = digits.ravel()
    model = _Model(lanes)
    code = np.zeros(lanes, np.int64)
    for j in range(5):
        code = (code << _DIGIT) | digits[j]
    pos = np.full(lanes, 5, np.int64)
    span = np.full(lanes, 1 << 60, np.int64)
    out = np.empty((n, lanes), np.uint16)
    most = (1 << _TOTAL) - 1
    try:
        for t in range(n):
            model.predict()
            unit = span >> _TOTAL
            x, cum, freq = model.find(np.minimum(code // unit, most))
            code -= unit * cum
            span = unit * freq
            due = span < (1 << _TOP)
            shift = due * _DIGIT
            code = (code << shift) | flat.take(pos * lanes + model.lane, mode="clip") * due
            span <<= shift
            pos += due
            while len(lane := np.flatnonzero(span < (1 << _TOP))):
                at = pos[lane]
                code[lane] = (code[lane] << _DIGIT) | flat.take(at * lanes + lane, mode="clip")
                span[lane] <<= _DIGIT
                pos[lane] = at + 1
                if int(at.max()) > 3 * n + len(digits):
                    raise ValueError("no digits left")
            model.update(x)
            out[t] = x
    except (IndexError, FloatingPointError, ValueError) as e:  # places that no coder leads to
        raise ValueError("the block is damaged") from e
    rows = _swap(np.ascontiguousarray(out.T)).astype("<u4")
    # a block shorter than the others has gone on without meaning
    ids = [rows[b, : p[0]] for b, p in enumerate(parsed)]
    for own, p in zip(ids, parsed, strict=True):
        if zlib.crc32(own.tobytes()) != p[1]:
            raise ValueError("checksum differs: the block is damaged")
    return ids


# -- checksums of joined parts -----------------------------------------------

_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """a * b modulo the CRC-32 polynomial, bits reflected."""
    out, m = 0, 1 << 31
    while m:
        if a & m:
            out ^= b
        m >>= 1
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
    return out


def _shift(n_bytes: int) -> int:
    """x^(8 n) modulo the polynomial."""
    out, square = 1 << 31, 1 << 30
    n = n_bytes * 8
    while n:
        if n & 1:
            out = _times(out, square)
        square = _times(square, square)
        n >>= 1
    return out


def join_crc(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings in a row from the CRC-32 of each."""
    return _times(_shift(second_bytes), first) ^ second
