"""Line deduplication with a deletion-neighbourhood join (built-in functions only).

A line is dropped if an earlier line (by document key, then line number) is equal to
it, whatever its length, or if both have at least ``min_chars`` characters and differ by
one edit (a character inserted, deleted or replaced). Whether the
earlier line is itself dropped makes no difference, so the result does not depend on
the order of work.

1. Distinct lines get their earliest place.
2. Two lines one edit apart share their first or their last half (of the shorter
   line). Lines that share no half with another line of fitting length have no
   partner and leave here; this loses nothing.
3. The others emit the variants within the edit bound, with one character deleted in the
   half where the edit must lie, as keys hashed with the shared half. Equal variants with the same
   place of deletion differ by a replacement there; a variant equal to a whole line
   differs by an insertion.
4. Each line's earliest partner is verified with the edit distance.

No pairs within a group are formed: a group of equal variants is aggregated to its
earliest lines before any join, and each line is compared with one of those.

Lookup tables of at most ``max_broadcast`` rows (shared halves, lines with a partner,
repeated lines) are broadcast after their rows have been counted, larger ones joined.

Defined results: a null text has no lines and stays null; an empty table gives an empty
one; lines of white space are never dropped; a line shorter than ``min_chars`` characters,
where one edit is a large part of it, is dropped for an equal line only; rows with
equal keys count as one document, so a line of theirs is kept in each of them; a null
key comes first. The work for a line that shares a half grows with the square of its
length (one hash for each deleted character). Columns of the input named like an
output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import Workspace, session_workspace


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, h, h2) of the lines that can be dropped: all but white space."""
    split = docs.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    return split.filter(F.rlike("line", F.lit(r"\S"))).select(
        "key", "line_no", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("check"), "line").alias("h2")
    )


def _small(table: DataFrame, limit: int) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``limit`` rows."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table


def _half_keys(n: Column, line: Column) -> Column:
    """Keys of the shared halves: (side, whether the line is the longer of the two, hash)."""
    out = []
    for longer in (0, 1):
        short = n - longer  # length of the shorter line of the pair
        q = F.floor(short / 2).cast("int")
        for side, half in ((0, F.substring(line, F.lit(1), q)), (1, F.substring(line, n - q + 1, q))):
            hashed = F.xxhash64(F.lit(side), short, half)
            out.append(F.struct(F.lit(side).alias("side"), F.lit(longer).alias("longer"), hashed.alias("k")))
    return F.array(*out)


# roles of a line in a group of equal variants
WHOLE, INSERTED, REPLACED = 0, 1, 2


def _open_half(n: Column, line: Column, side: Column, longer: Column) -> Column:
    """The part of a line where the edit must lie: what the shared half leaves."""
    q = F.floor((n - longer) / 2).cast("int")
    return F.when(side == 0, F.substring(line, q + 1, n)).otherwise(F.substring(line, F.lit(1), n - q))


def _cuts(part: Column, key: Column, longer: Column) -> Column:
    """array<bigint>: the open half with one character deleted, hashed with the key of the
    shared one. A replacement leaves the same place in both lines, an insertion any."""
    n = F.length(part)
    rest = lambda i: F.substring(part, i + 2, n)
    start = lambda i: F.substring(part, F.lit(1), i)
    places = F.sequence(F.lit(0), n - 1)
    inserted = F.transform(places, lambda i: F.xxhash64(key, F.concat(start(i), rest(i))))
    replaced = F.transform(places, lambda i: F.xxhash64(key, i, start(i), rest(i)))
    none = F.array().cast("array<bigint>")
    return F.when(n == 0, none).when(longer == 1, inserted).otherwise(replaced)


def duplicate_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = 20,
    max_edits: int = 1,
    max_broadcast: int = 200_000,
    workspace: Workspace | None = None,
) -> DataFrame:
    """(key, line_no, near): the lines to drop; ``near`` is true for those without an
    earlier equal line. ``max_edits`` is 0 (equal lines only) or 1, for lines of at least
    ``min_chars`` characters."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    work = workspace or session_workspace(docs.sparkSession)
    lines = _lines(docs, key, text)
    place = F.struct("key", "line_no")
    firsts = lines.groupBy("h", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    if max_edits:
        near = work.table(_near_lines(lines.filter(F.length("line") >= min_chars), work, max_broadcast), "near-lines")
        firsts = firsts.join(near.select("h", "h2", F.lit(True).alias("near")), ["h", "h2"], "left")
    else:
        firsts = firsts.withColumn("near", F.lit(None).cast("boolean"))
    # lines that occur once and are near no earlier one have nothing to drop
    firsts = work.table(firsts.filter((F.col("n") > 1) | F.col("near")), "repeated-lines")
    seen = lines.select("key", "line_no", "h", "h2").join(_small(firsts, max_broadcast), ["h", "h2"])
    is_first = F.col("first").eqNullSafe(F.struct("key", "line_no"))
    return seen.filter(~is_first | F.col("near")).select("key", "line_no", is_first.alias("near"))


def _near_lines(lines: DataFrame, work: Workspace, max_broadcast: int) -> DataFrame:
    """(h, h2) of the distinct lines with an earlier line one edit away."""
    n = F.length("line")
    keys = lines.select("h", F.explode(_half_keys(n, F.col("line"))).alias("x")).select("h", "x.*")
    shared = keys.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("k")
    shared = _small(work.table(shared, "shared-halves"), max_broadcast)
    halves = work.table(keys.join(shared, "k", "left_semi").select("h", "side", "longer", "k").distinct(), "half-matches")

    partners = _small(work.table(halves.select("h").distinct(), "partners"), max_broadcast)
    texts = lines.join(partners, "h", "left_semi").groupBy("h", "h2").agg(
        F.min(F.struct("key", "line_no")).alias("first"), F.min("line").alias("line")
    )
    texts = work.table(texts, "half-match-lines")

    part = _open_half(n, F.col("line"), F.col("side"), F.col("longer"))
    found = texts.join(halves, "h").select("h", "h2", "first", "k", "longer", part.alias("part"))
    role = F.when(F.col("longer") == 1, INSERTED).otherwise(REPLACED).alias("role")
    cuts = found.select("h", "h2", "first", F.explode(_cuts(F.col("part"), F.col("k"), F.col("longer"))).alias("v"), role)
    whole = found.filter("longer = 0").select("h", "h2", "first", F.xxhash64("k", "part").alias("v"), F.lit(WHOLE).alias("role"))
    cut = work.table(cuts.unionByName(whole), "variants")
    # the earliest line of each role; a line is compared with that of the role across from its own
    earliest = cut.groupBy("v", "role").agg(F.min(F.struct("first", "h", "h2")).alias("e"))
    across = F.when(F.col("role") == REPLACED, REPLACED).otherwise(1 - F.col("role"))
    links = (
        cut.withColumn("role", across)
        .join(earliest, ["v", "role"])
        .filter(F.col("first") > F.col("e.first"))
        .select("h", "h2", F.col("e.h").alias("eh"), F.col("e.h2").alias("eh2"))
        .distinct()
    )
    mine = texts.select("h", "h2", "line")
    theirs = texts.select(F.col("h").alias("eh"), F.col("h2").alias("eh2"), F.col("line").alias("earlier"))
    verified = links.join(mine, ["h", "h2"]).join(theirs, ["eh", "eh2"])
    within = F.levenshtein("line", "earlier", 1).between(0, 1)
    return verified.filter(within).select("h", "h2").distinct()


def dedup_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = 20,
    max_edits: int = 1,
    max_broadcast: int = 200_000,
    workspace: Workspace | None = None,
) -> DataFrame:
    """``docs`` with ``text`` less its dropped lines, and ``n_lines``, ``n_equal``, ``n_near``:
    the lines of the text, and those dropped for an equal and for a near earlier line."""
    drop = duplicate_lines(docs, key, text, min_chars, max_edits, max_broadcast, workspace)
    gone = drop.groupBy(F.col("key").alias("_key")).agg(
        F.collect_set(F.struct("line_no", "near")).alias("_gone")
    )
    rows = docs.drop("n_lines", "n_equal", "n_near")
    joined = rows.join(gone, rows[key].eqNullSafe(gone["_key"]), "left")
    numbers = F.transform("_gone", lambda g: g["line_no"])
    parts = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(F.col("_nos"), i)), "\n")
    counted = joined.withColumn("_nos", numbers)
    count = lambda near: F.coalesce(F.size(F.filter("_gone", lambda g: g["near"] == near)), F.lit(0))
    none = F.col("_gone").isNull()
    return counted.select(
        *[
            F.when(none, F.col(text)).otherwise(kept).alias(c) if c == text else F.col(f"`{c}`")
            for c in rows.columns
        ],
        F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"),
        F.when(none, 0).otherwise(count(False)).alias("n_equal"),
        F.when(none, 0).otherwise(count(True)).alias("n_near"),
    )
