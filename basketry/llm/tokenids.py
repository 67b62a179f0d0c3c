"""Token ids of documents in range-coded binary blocks.

``write_tokens`` orders the documents by key, tokenizes whole texts, appends an end
id to each, cuts the ids of a partition into blocks of equal length and writes the
coded blocks (``rangecoder``) with the keys of the documents that a block touches.
A table row is one block:

    part, block     place in the order: parts ascend by key, blocks within a part
    at              ids of the part before the block
    n               ids in the block
    keys            keys of the documents with ids in the block, in order
    counts          ids of each of them in the block
    row             place within its part of the first of them
    piece           how many blocks before this one hold ids of the first of them
    open            whether the last of them goes on in the next block
    payload         the coded block

``read_tokens`` gives the ids back, block by block; ``document_index`` gives each
document's start, number of ids and checksum from the decoded blocks alone.

A task holds at most ``LANES`` blocks of ids at a time. Defined results: a null text
counts as empty (one end id); rows with equal keys are ordered by text; a null key
comes first; columns besides key and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rangecoder
from .batches import bound_batches

BLOCK_IDS = 4096
LANES = 1024
_MEMO = 200_000
_ODD_SPACE = re.compile(r" \s|\s ")

BLOCK_SCHEMA = (
    "part int, block int, at bigint, n int, keys array<bigint>, counts array<int>, row bigint, piece int, open boolean, payload binary"
)


class DocumentTokenizer:
    """Ids of whole texts, the same as the tokenizer's own, with a memory of words.

    The byte-level pre-tokenizer always begins a new piece at a single space between
    two other characters, so such a text can be cut there and the pieces tokenized on
    their own. A text in which a space touches other white space is not cut.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        # ids whose token begins with a space: each begins a word of a text cut at its spaces
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.memo: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        """Put the ids of `` word`` in the memory, many words in one text."""
        for lo in range(0, len(words), 5000):
            part = words[lo : lo + 5000]
            ids = self._encode(" " + " ".join(part))
            cuts = np.flatnonzero(self.begins[ids])
            if len(cuts) == len(part) and cuts[0] == 0:
                raw, ends = ids.tobytes(), [*(4 * cuts[1:]).tolist(), 4 * len(ids)]
                self.memo.update((w, raw[a:b]) for w, a, b in zip(part, (4 * cuts).tolist(), ends, strict=True))
            else:  # a word that holds a space token of its own
                self.memo.update((w, self._encode(f" {w}").tobytes()) for w in part)

    def __call__(self, texts: list[str], end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text, ``end_id`` after them."""
        end = np.array([end_id], "<u4").tobytes()
        for lo in range(0, len(texts), 200):
            part = texts[lo : lo + 200]
            cut = [None if not t or _ODD_SPACE.search(t) or t[0] == " " or t[-1] == " " else t.split(" ") for t in part]
            words = {w for c in cut if c for w in c[1:]}
            new = [w for w in words if w not in self.memo]
            if len(self.memo) + len(new) > _MEMO:
                self.memo.clear()
                new = list(words)
            self._learn(new)
            known = self.memo.__getitem__
            for text, c in zip(part, cut, strict=True):
                if c is None:
                    raw = self._encode(text).tobytes() if text else b""
                else:
                    raw = b"".join([self._encode(c[0]).tobytes(), *map(known, c[1:])])
                yield np.frombuffer(raw + end, "<u4")


def _blocks(path: str, end_id: int, block_ids: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = DocumentTokenizer(path)
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []  # ids not yet coded
        spans: list[list] = []  # [key, row, piece, ids not yet coded] of their documents
        n_held, row, block, coded = 0, 0, 0, 0

        def code(last: bool) -> pa.RecordBatch:
            nonlocal held, n_held, block, coded, spans
            ids = np.concatenate(held) if held else np.zeros(0, "<u4")
            full = len(ids) // block_ids
            lengths = [block_ids] * full
            rest = ids[full * block_ids :]
            if last and len(rest):
                lengths.append(len(rest))
                ids = np.concatenate([ids, np.zeros(block_ids - len(rest), "<u4")])
                rest = rest[:0]
            rows = len(lengths)
            payloads = rangecoder.encode_blocks(ids[: rows * block_ids].reshape(rows, block_ids), lengths) if rows else []
            out = {c: [] for c in ("block", "at", "n", "keys", "counts", "row", "piece", "open")}
            at = 0
            for n in lengths:
                keys, counts, left = [], [], n
                first = spans[at]
                while left:
                    span = spans[at]
                    taken = min(left, span[3])
                    keys.append(span[0])
                    counts.append(taken)
                    span[3] -= taken
                    left -= taken
                    if span[3]:
                        break
                    at += 1
                still_open = at < len(spans) and spans[at][3] > 0 and spans[at][4] > spans[at][3]
                for c, v in zip(out, (block, coded, n, keys, counts, first[1], first[2], still_open), strict=True):
                    out[c].append(v)
                if still_open:
                    spans[at][2] = first[2] + 1 if spans[at] is first else 1
                block += 1
                coded += n
            spans = spans[at:]
            held, n_held = [rest] if len(rest) else [], len(rest)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(lengths), pa.int32()),
                    pa.array(out["block"], pa.int32()),
                    pa.array(out["at"], pa.int64()),
                    pa.array(out["n"], pa.int32()),
                    pa.array(out["keys"], pa.list_(pa.int64())),
                    pa.array(out["counts"], pa.list_(pa.int32())),
                    pa.array(out["row"], pa.int64()),
                    pa.array(out["piece"], pa.int32()),
                    pa.array(out["open"], pa.bool_()),
                    pa.array(payloads, pa.binary()),
                ],
                ["part", "block", "at", "n", "keys", "counts", "row", "piece", "open", "payload"],
            )

        for batch in batches:
            texts = [t or "" for t in batch["_text"].to_pylist()]
            for key, ids in zip(batch["_key"].to_pylist(), tokenize(texts, end_id), strict=True):
                spans.append([key, row, 0, len(ids), len(ids)])
                row += 1
                held.append(ids)
                n_held += len(ids)
                while n_held >= LANES * block_ids:
                    yield code(False)
        if n_held:
            yield code(True)

    return rows


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    block_ids: int = BLOCK_IDS,
    ordered: bool = True,
) -> None:
    """Write the coded blocks of all documents to ``path``, in ascending key order; or, not
    ``ordered``, in the order in which the rows come (a shuffled table stays shuffled, and
    nothing is exchanged)."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if ordered:
        rows = rows.repartitionByRange("_key").sortWithinPartitions("_key", "_text")
    blocks = rows.mapInArrow(_blocks(tokenizer, end_id, block_ids), BLOCK_SCHEMA)
    blocks.write.option("compression", "snappy").parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each batch in slices of at most LANES blocks, with the ids of its blocks."""
    for whole in batches:
        for lo in range(0, whole.num_rows, LANES):
            batch = whole.slice(lo, LANES)
            ids = rangecoder.decode_blocks(batch["payload"].to_pylist())
            yield batch, ids


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, ids in _decoded(batches):
        column = pa.array(ids, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch[c] for c in ("part", "block", "keys", "counts")] + [column], ["part", "block", "keys", "counts", "ids"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The decoded blocks: part, block, keys, counts, ids."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    return blocks.mapInArrow(_read_rows, "part int, block int, keys array<bigint>, counts array<int>, ids array<bigint>")


_PIECE = "part int, row bigint, piece int, key bigint, start bigint, n bigint, crc bigint, whole boolean"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    names = [x.split()[0] for x in _PIECE.split(", ")]
    for batch, ids in _decoded(batches):
        out = []
        cols = (batch[c].to_pylist() for c in ("part", "at", "keys", "counts", "row", "piece", "open"))
        for i, (part, start, keys, counts, row, piece, still_open) in enumerate(zip(*cols, strict=True)):
            raw, at = ids[i].tobytes(), 0
            for j, (key, n) in enumerate(zip(keys, counts, strict=True)):
                p = piece if j == 0 else 0
                whole = p == 0 and not (still_open and j == len(keys) - 1)
                out.append((part, row + j, p, key, start + at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), whole))
                at += n
        columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _with_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = batch["crc"].to_pylist()
        for i, pieces in enumerate(batch["pieces"].to_pylist()):
            if pieces:
                crcs[i] = 0
                for p in pieces:
                    crcs[i] = rangecoder.join_crc(crcs[i], p["crc"], 4 * p["n"])
        rest = [batch[c] for c in ("part", "key", "start", "n")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(crcs, pa.int64())], ["part", "key", "start", "n", "crc"])


def document_index(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the decoded blocks."""
    bound_batches(spark)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    pieces = blocks.mapInArrow(_pieces, _PIECE)
    # a document within one block is complete; the pieces of the others meet here
    parts = F.array_sort(F.collect_list(F.when(~F.col("whole"), F.struct("piece", "n", "crc"))))
    grouped = pieces.groupBy("part", "row").agg(
        F.first("key").alias("key"), F.min("start").alias("start"), F.sum("n").alias("n"),
        F.max("crc").alias("crc"), parts.alias("pieces"),
    )
    joined = grouped.mapInArrow(_with_crc, "part int, key bigint, start bigint, n bigint, crc bigint")
    totals = blocks.groupBy("part").agg(F.sum("n").alias("ids"))  # one row for each part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))
    return joined.join(offsets, "part").select(
        F.col("key").alias(key),
        (F.col("offset") + F.col("start")).alias("start"),
        F.col("n").alias("n_tokens"),
        F.col("crc").alias("ids_crc32"),
    )
