"""Differences of pairs of digest arrays: the sketches of ``fingerprints``, peeled as tables.

Same cells, blocks and places as the column expressions of ``fingerprints``, which peel a
block by calls of interpreted lambdas for each of its cells. Here a row is one cell, of all
blocks of all pairs: an entry goes to its three cells by ``explode``, a cell is a sum and an
exclusive-or by ``groupBy``. Rows are exchanged by their pair once; all aggregations of a
retry keep that partitioning, so they share one stage.

A round looks at one part of the blocks. A digest has one cell in each part, so it is found
there once: its cell gives up its row for the two rows that take it out of its cells in the
other parts, and one that notes it. What cancels leaves no row: a digest that only chance put
together and that was noted for both sides is no difference.

The first sketch of a pair is one block, or as many as its estimated difference needs. The
rounds are few, because all their aggregations hold memory in one task, and so blocks are
loaded less than those that are peeled to the end: a twentieth doesn't come out.
Digests of blocks that don't come out are entered in a larger sketch by other hashes, and so
on (``TIERS`` retries); what is left then is compared itself.

Defined results: pairs without a difference count 0; equal pairs stay rows of their own by
their number. No step depends on the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import Workspace, release_shuffles
from . import fingerprints as fp

ROUNDS = 6  # each takes one part of the blocks
LOAD = 8  # differing digests for a block, as far as they can be estimated
TASK_ENTRIES = 150_000  # digests of a task, about
_WORD = 64  # blocks in a word of marks


def first_blocks(cells_a: Column, cells_b: Column, a: Column, b: Column) -> Column:
    """How many blocks the first sketch of a pair has, by its one-block sketches."""

    guess = fp.estimate(fp.subtract(cells_a, cells_b))
    return _blocks(guess, F.size(a) + F.size(b), 1)


def _blocks(guess: Column, most: Column, least: int) -> Column:
    # a one-sided difference makes the squares grow faster: no more can differ than there are
    return F.greatest(F.lit(least), F.ceil(F.least(guess, most.cast("double")) / LOAD).cast("int"))


def _block(d: Column, parts: Column, tier: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), d, F.lit(tier)), parts).cast("int")


def _cell(c: Column, n: Column, x: Column) -> Column:
    return F.struct(c.cast("bigint").alias("c"), n.cast("bigint").alias("n"), x.alias("x"))


def _gathered(rows: DataFrame) -> DataFrame:
    cells = rows.groupBy("pair", "block", "c").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"))
    return cells.filter("n <> 0 or x <> 0")


def difference_cells(state: DataFrame, tier: int) -> DataFrame:
    """(pair, block, c, n, x): the cells that aren't empty of each pair's sketch of ``a`` less
    that of ``b``."""

    def side(name: str, sign: int) -> Column:
        return F.transform(name, lambda d: F.struct(d.alias("d"), F.lit(sign).alias("s")))

    entries = state.select("pair", "parts", F.inline(F.concat(side("a", 1), side("b", -1))))
    block = _block(F.col("d"), F.col("parts"), tier).alias("block")
    hashed = entries.select("pair", block, "d", "s", F.xxhash64("d", F.lit(tier)).alias("h"))
    places = F.array(*[fp._place(F.col("h"), i).cast("bigint") for i in range(len(fp.PARTS))])
    return _gathered(hashed.select("pair", "block", F.explode(places).alias("c"), F.col("s").alias("n"), F.col("d").alias("x")))


def peel_part(cells: DataFrame, part: int, tier: int) -> DataFrame:
    """The cells less the digests that stand alone in a cell of this part. A recovered digest
    is noted in a row of its own: ``c`` is the digest, ``n`` its side, and ``x`` is 0."""
    hashed = cells.withColumn("h", F.xxhash64("x", F.lit(tier)))
    c, n, x, h = (F.col(name) for name in "cnxh")
    alone = fp._pure(F.struct("n", "x")) & (c == fp._place(h, part))
    others = [_cell(fp._place(h, i), -n, x) for i in range(len(fp.PARTS)) if i != part]
    given = F.array(*others, _cell(x, n, F.lit(0).cast("bigint")))
    rows = hashed.select("pair", "block", F.inline(F.when(alone, given).otherwise(F.array(_cell(c, n, x)))))
    return _gathered(rows)


def _outcome(cells: DataFrame) -> DataFrame:
    """(pair, found, guess, marks): digests recovered from the blocks that came out; about how
    many the others hold; and which these are, as bits of words by the word's number."""
    cell, n, at = F.col("c").between(0, fp.CELLS - 1), F.col("n"), F.col("block")
    blocks = cells.groupBy("pair", "block").agg(
        F.sum(F.when(cell, 0).otherwise(F.abs(n))).alias("found"),
        F.max(cell).alias("open"),
        F.sum(F.when(cell, n * n).otherwise(0)).alias("squares"),
    )
    guess = F.col("found") + F.col("squares") / len(fp.PARTS)
    words = blocks.groupBy("pair", F.floor(at / _WORD).cast("int").alias("word")).agg(
        F.sum(F.when(F.col("open"), 0).otherwise(F.col("found"))).alias("found"),
        F.sum(F.when(F.col("open"), guess).otherwise(0.0)).alias("guess"),
        F.bit_or(F.when(F.col("open"), fp._bit(at % _WORD)).otherwise(0)).alias("marks"),
    )
    held = F.collect_list(F.when(F.col("marks") != 0, F.struct("word", "marks")))
    return words.groupBy("pair").agg(F.sum("found").alias("found"), F.sum("guess").alias("guess"), held.alias("marks"))


def retry(state: DataFrame, tier: int) -> DataFrame:
    """(pair, found, parts, a, b) of every pair of ``state`` (pair, parts, a, b): the number of
    digests recovered, and the next state, with the digests of the blocks that didn't come out."""
    cells = difference_cells(state, tier)
    for i in range(ROUNDS):
        cells = peel_part(cells, i % len(fp.PARTS), tier)
    joined = state.join(_outcome(cells), "pair", "left")

    def left(name: str) -> Column:
        def marked(words: Column) -> Column:
            at = lambda d: _block(d, F.col("parts"), tier)
            bit = lambda b: F.call_function("shiftright", F.get(words, F.floor(b / _WORD).cast("int")), b % _WORD)
            return F.filter(name, lambda d: bit(at(d)).bitwiseAND(F.lit(1)) == 1)

        every = F.sequence(F.lit(0), F.floor(F.col("parts") / _WORD).cast("int"))
        words = fp._bind(F.map_from_entries("marks"), lambda m: F.transform(every, lambda w: F.coalesce(m[w], F.lit(0).cast("bigint"))))
        none = F.array().cast("array<bigint>")
        return F.when(F.coalesce(F.size("marks"), F.lit(0)) > 0, fp._bind(words, marked)).otherwise(none).alias(name)

    found = F.coalesce("found", F.lit(0)).alias("found")
    kept = joined.select("pair", found, "guess", left("a"), left("b"))
    parts = _blocks(F.coalesce("guess", F.lit(0.0)), F.size("a") + F.size("b"), 2)
    return kept.select("pair", "found", parts.alias("parts"), "a", "b")


def _spread(state: DataFrame, entries: int) -> DataFrame:
    tasks = max(state.sparkSession.sparkContext.defaultParallelism, math.ceil(entries / TASK_ENTRIES))
    return state.repartition(tasks, "pair")


def differing(pairs: DataFrame, work: Workspace, keep: Workspace) -> DataFrame:
    """(pair, apart): how many digests only one of ``a`` and ``b`` has, for each row of ``pairs``
    (pair, a number of its own; parts, blocks of its first sketch; a, b).

    The states between the retries are written to ``work``, the results to ``keep``."""
    state, results = pairs, []
    size = F.sum(F.size("a") + F.size("b")).alias("entries")
    for tier in range(fp.TIERS + 1):
        entries = state.agg(size).first()["entries"]
        if not entries:
            break
        tried = work.table(retry(_spread(state, entries), tier), f"sketch{tier}")
        release_shuffles(tried.sparkSession)
        results.append(tried.select("pair", "found"))
        state = tried.filter(F.size("a") + F.size("b") > 0).select("pair", "parts", "a", "b")
    else:
        apart = F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))
        results.append(state.select("pair", apart.cast("bigint").alias("found")))
    if not results:
        return keep.table(pairs.select("pair", F.lit(0).cast("bigint").alias("apart")).limit(0), "apart")
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    return keep.table(every.groupBy("pair").agg(F.sum("found").alias("apart")), "apart")
