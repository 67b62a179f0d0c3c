"""Spelling variants by asymmetric q-chunks.

Words are near if they differ by one inserted, deleted or replaced code point. Of two near
words the shorter one (or either, at equal length) is cut into two disjoint chunks that
cover it, and one edit leaves one of them whole. The other word gives its positional grams
of that chunk's length; only grams within shift one of the chunk's place can be the kept
chunk: the same distance from the start for the first chunk, from the end for the second
(there an inserted code point shifts the grams by one). So each word is listed under its
own two chunks and under the grams that it holds against words one code point shorter, and
equal keys are joined and verified.

A key under which many words meet ("inter...") is cut again: what its chunk leaves open is
a window of the word, which is halved in the same way, so the key then also holds the chunk
of the window that stayed whole. The windows end at one code point, where a key has no more
words than the alphabet letters, so no group stays large. A pair belongs to the window that
holds its edit (for an insertion that could stand in several places, the first of them), so
it is found once.

Defined results: a null text holds no words; a null key counts as the empty text in the
draw of the deleted code point; rows with equal keys are separate texts, drawn alike; ties
of two forms go to the smallest word in code-point order; an empty table gives an empty
result; texts and words of any length are used whole; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import Workspace

RUN = "[A-Za-z\\u00C0-\\u00FF]"


def corrupted_run(key: Column, run: Column, one_in: int) -> Column:
    """``run`` without one code point if ``one_in`` divides the crc32 of ``<key>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(key, F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % one_in == 0, shorter).otherwise(run)


def count_words(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 5, min_count: int = 3, one_in: int = 97
) -> DataFrame:
    """(word, n): the letter runs of all texts, A-Z lower-cased, one in ``one_in`` of them short
    of a code point, with their occurrences; those of ``min_length`` and ``min_count`` or more."""
    long_run = f"{RUN}{{{min_length},}}"  # a run is maximal, so shorter ones have no match inside
    runs = docs.select(
        F.col(key).cast("string").alias("_id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(long_run), F.lit(0))).alias("_run")
    )
    lower = runs.select("_id", F.translate("_run", string.ascii_uppercase, string.ascii_lowercase).alias("_run"))
    words = lower.select(corrupted_run(F.col("_id"), F.col("_run"), one_in).alias("word"))
    counted = words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count)


_ROW = ("word", "n", "extra", "size", "lo", "hi")


def _halves() -> Column:
    """The two windows of a row's window; a window of one code point stays as it is."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    whole = F.array(F.struct("lo", "hi"))
    cut = F.array(F.struct("lo", mid.alias("hi")), F.struct(mid.alias("lo"), "hi"))
    return F.when(F.col("hi") - F.col("lo") > 1, cut).otherwise(whole)


def _outside(word: Column, extra: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """What stands before and after the window in a word with ``extra`` more code points there."""
    return F.substring(word, F.lit(1), lo), F.substring(word, hi + extra + 1, F.length(word))


def _keyed(rows: DataFrame) -> DataFrame:
    cut = rows.select("word", "n", "extra", "size", F.explode(_halves()).alias("w")).select(
        "word", "n", "extra", "size", "w.lo", "w.hi"
    )
    outside = _outside(*(F.col(c) for c in ("word", "extra", "lo", "hi")))
    return cut.select(F.xxhash64("size", "lo", "hi", *outside).alias("key"), *_ROW)


def near_pairs(words: DataFrame, work: Workspace, small: int = 4096) -> DataFrame:
    """(a, a_n, b, b_n): the pairs of near words, once each, of a table (word, n) of distinct words.

    ``small``: a key with more candidate pairs than that is cut again."""
    roles = F.array(
        F.struct(F.lit(0).alias("extra"), F.length("word").alias("size")),
        F.struct(F.lit(1).alias("extra"), (F.length("word") - 1).alias("size")),
    )
    whole = words.select("word", "n", F.explode(roles).alias("r")).select(
        "word", "n", "r.extra", "r.size", F.lit(0).alias("lo"), F.col("r.size").alias("hi")
    )
    level, found = whole, []
    while True:
        rows = work.table(_keyed(level), "keys")
        chunks = F.sum(1 - F.col("extra"))
        counts = rows.groupBy("key").agg(chunks.alias("chunks"), F.count("*").alias("all")).filter("chunks > 0 and all > 1")
        met = work.table(rows.join(counts, "key"), "met")
        large = F.col("chunks") * F.col("all") > small
        large = large & (F.col("hi") - F.col("lo") > 1)
        found.append(met.filter(~large).select("key", *_ROW))
        level = met.filter(large).select(*_ROW)
        if level.isEmpty():
            break
    buckets = found[0]
    for more in found[1:]:
        buckets = buckets.unionByName(more)
    a = buckets.filter("extra = 0").select(*[F.col(c).alias(f"a_{c}") for c in ("key", *_ROW)])
    b = buckets.select(*[F.col(c).alias(f"b_{c}") for c in ("key", *_ROW)])
    same = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in ("key", "size", "lo", "hi")]
    lo, hi = F.col("a_lo"), F.col("a_hi")
    a_out = _outside(F.col("a_word"), F.lit(0), lo, hi)
    b_out = _outside(F.col("b_word"), F.col("b_extra"), lo, hi)
    first = lambda w: F.substring(F.col(w), F.lit(1), hi)
    owned = (a_out[0] == b_out[0]) & (a_out[1] == b_out[1]) & ((hi == F.col("a_size")) | (first("a_word") != first("b_word")))
    once = (F.col("b_extra") == 1) | (F.col("a_word") < F.col("b_word"))
    near = F.levenshtein(F.col("a_word"), F.col("b_word"), 1) == 1
    on = same[0]
    for c in [*same[1:], once, owned, near]:
        on = on & c
    return a.join(b, on).select(F.col("a_word").alias("a"), F.col("a_n"), F.col("b_word").alias("b"), F.col("b_n"))


def _roots(forms: DataFrame, work: Workspace) -> DataFrame:
    """(word, root) from (word, form): a form is at least twice as frequent as its word, so the
    chains are short; each round doubles the steps followed."""
    reached = work.table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        beyond = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = reached.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), "beyond")
        step = work.table(step, "roots")
        reached = step.select("word", "root")
        if step.filter("beyond is not null").isEmpty():
            return reached


def spelling_forms(words: DataFrame, work: Workspace, factor: int = 2, small: int = 4096) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a table (word, n) of distinct words.

    ``form`` is the near word of largest n if that is at least ``factor`` times the word's
    own; ``root`` the last of the forms from the word on, the word itself if it has none.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2, else forms may run in a circle")
    held = work.table(words.select("word", "n"), "words")
    pairs = near_pairs(held, work, small)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )
    both = pairs.select(F.explode(sides).alias("s")).select("s.*")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    strong = -F.col("best.less") >= factor * F.col("n")
    judged = held.join(near, "word", "left").select(
        "word",
        F.when(strong, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(strong, -F.col("best.less")).alias("form_n"),
    )
    judged = work.table(judged, "judged")
    roots = _roots(judged.filter("form is not null"), work)
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of ``docs`` with their forms and roots."""
    return spelling_forms(count_words(docs, key, text), work)
