"""Range coder and token blocks: exact round trips."""

import zlib

import numpy as np
import pytest

from basketry.functions.workspace import Workspace
from basketry.llm import rangecoder, tokenids
from basketry.llm.queries import tokenizer_file


@pytest.mark.parametrize(
    "ids",
    [
        np.random.default_rng(0).integers(0, 50257, (7, 300)),
        np.zeros((3, 500), int),
        np.random.default_rng(1).integers(0, 3, (5, 1)),
        np.full((2, 700), rangecoder.MAX_ID),
        np.random.default_rng(2).zipf(1.3, (40, 900)) % 60000,
        np.tile(np.arange(50), (3, 30)),
    ],
)
def test_round_trip(ids):
    blocks = rangecoder.encode_blocks(ids)
    assert (np.array(rangecoder.decode_blocks(blocks)) == ids).all()
    one = rangecoder.encode_blocks(ids[:1])
    assert one[0] == blocks[0]  # a block doesn't depend on those coded beside it


def test_blocks_of_different_lengths():
    ids = np.random.default_rng(5).integers(0, 900, (6, 200))
    lengths = [200, 0, 1, 150, 199, 150]
    blocks = rangecoder.encode_blocks(ids, lengths)
    for row, n, block, back in zip(ids, lengths, blocks, rangecoder.decode_blocks(blocks), strict=True):
        assert back.tolist() == row[:n].tolist()
        assert block == rangecoder.encode_blocks(row[None, :n])[0]
    assert rangecoder.decode_blocks([]) == []


def test_repetitive_ids_get_short():
    ids = np.tile(np.arange(50), (2, 80))
    assert sum(map(len, rangecoder.encode_blocks(ids))) < ids.size * 2 / 8


def test_damage_and_bad_ids_are_found():
    block = bytearray(rangecoder.encode_blocks(np.arange(600)[None, :])[0])
    block[200] ^= 1
    with pytest.raises(ValueError):
        rangecoder.decode_blocks([bytes(block)])
    with pytest.raises(ValueError):
        rangecoder.decode_blocks([bytes(block[:100])])
    with pytest.raises(ValueError):
        rangecoder.encode_blocks(np.array([[65535]]))


def test_joined_checksums():
    a, b = b"hello wor" * 7, b"ld, again"
    assert rangecoder.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


ODD = [
    (3, "a  b"), (1, None), (2, ""), (5, " lead and trail "), (4, "x \n y\n\nz\tq  "), (9, "it's <|endoftext|> we'll go　on"),
    (7, "long " * 3000), (8, "é " * 500 + "\n日本語 テキスト"), (6, "\n"), (10, "tab\t x  y"), (11, "x  y  z"),
    (12, "the cat, the dog; 12 345 don't"), (None, "no key"), (12, "the same key again"),
]


def expected(rows):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(tokenizer_file()), 0, []
    for k, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("block_ids", [7, 64, 4096])
def test_documents_come_back(spark, block_ids):
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string").repartition(3)
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    with Workspace(spark) as work:
        path = work.path("tokens")
        tokenids.write_tokens(docs, path, tokenizer_file(), block_ids=block_ids)
        got = [tuple(r) for r in tokenids.document_index(spark, path).collect()]
        whole = tokenids.read_tokens(spark, path).orderBy("part", "block").collect()
    want = expected(order)
    assert sorted(got, key=lambda r: r[1]) == want
    assert sum(len(r["ids"]) for r in whole) == sum(r[2] for r in want)
    assert all(sum(r["counts"]) == len(r["ids"]) for r in whole)


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "x", "y", 5)], "doc_id bigint, text string, part string, n int")
    with Workspace(spark) as work:
        for name, rows, n in (("a", docs.limit(0), 0), ("b", docs, 1)):
            path = work.path(name)
            tokenids.write_tokens(rows, path, tokenizer_file(), ordered=False)
            assert tokenids.document_index(spark, path).count() == n
