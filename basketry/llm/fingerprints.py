"""Document fingerprints: invertible Bloom lookup sketches of paragraphs (built-in functions only).

A text is the set of its paragraphs: its lines, cut after every sentence end. A sentence
of more than ``LONG`` characters is cut further where a hash of the next four characters
says so, in any script, so that the content sets the cuts and an edit moves only those
beside it. A paragraph's digest is 48 bits of a hash of its text and of how many equal
paragraphs come before it, with 16 check bits of its own. A sketch has blocks of 32 cells; each digest is
entered in three cells of one block. A cell keeps the number of its entries
and the exclusive-or of their digests.

Two sketches of the same size are subtracted cell by cell, which leaves the entries in
which the texts differ. Peeling recovers them: a cell with one entry gives a digest,
which is then taken out of its other cells, until no such cell is left. The first
sketch is one block. The digests of a block that doesn't come out empty are entered in
a larger sketch of several blocks, by other hashes, and so on (``TIERS`` retries). How many
blocks follows from the difference that the cells' counts show; a block whose counts show
more than it can give back is cut without a try.

The fingerprint is the sketch of one block, written as text. Likeness is shared /
(shared + differing) paragraphs, from the numbers of paragraphs and the recovered
differences.

Defined results: a null text counts as empty; an empty text has one empty paragraph;
equal texts, repeated rows among them, have equal fingerprints and likeness 1, so ties need
no rule; an empty table gives an empty one; columns of the input named like an output column
are replaced. Texts of any length are sketched whole, the work grows with their paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 32
PARTS = ((0, 11), (11, 11), (22, 10))  # the three parts of a block: first cell, cells
ROUNDS = 9
TIERS = 8  # retries with larger sketches
LOAD = 16  # differing digests for a block, as far as they can be estimated
HOPELESS = 30  # a block with more of them by estimate isn't peeled but cut

LONG = 160  # characters of a paragraph at most
SPACING = 64  # characters from one place that the content marks to the next, on average
APART = 16  # a mark closer to the one before it is no cut
WORD_CUTS = (12, 3, 24)  # the same three between words: spacing, least distance, most words of a part

_BREAK = r"\n|(?<=[.!?]) |(?<=[。！？｡।؟۔])"


def _cut_items(items: Column, window: int, spacing: int, apart: int, longest: int) -> Column:
    """array<string>: the items of a sentence joined into parts. A part begins where a hash of the
    next ``window`` items says so; the same text has the same cuts."""

    def at(values: Column, i: Column, end: Column) -> Column:
        return F.coalesce(F.get(values, i), end)

    def cut(held: Column) -> Column:
        n = F.size(held)
        hashed = lambda i: F.xxhash64(*[F.get(held, i + j) for j in range(window)])
        marks = F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.pmod(hashed(i), F.lit(spacing)) == 0)

        def starts(marked: Column) -> Column:
            # a mark counts by the one before it, cut or not
            kept = F.filter(marked, lambda m, j: F.coalesce(m - F.get(marked, j - 1) >= apart, F.lit(True)))
            # what has no mark for long is cut at even distances
            even = lambda b: F.transform(b, lambda x, j: F.sequence(x, at(b, j + 1, n) - 1, F.lit(longest)))
            return F.flatten(_bind(F.concat(F.array(F.lit(0)), kept), even))

        def parts(first: Column) -> Column:
            return F.transform(first, lambda x, j: F.array_join(F.slice(held, x + 1, at(first, j + 1, n) - x), ""))

        return _bind(_bind(marks, starts), parts)

    return F.when(F.size(items) < 2, items).otherwise(cut(items))


def _short(sentence: Column) -> Column:
    """array<string> of a sentence's parts of at most ``LONG`` characters: itself, or runs of its
    words; longer words (or scripts without spaces) are cut between characters."""

    def word_runs(words: Column) -> Column:
        by_chars = lambda w: F.when(F.length(w) <= LONG, F.array(w)).otherwise(
            _bind(F.split(w, "", -1), lambda chars: _cut_items(chars, 4, SPACING, APART, LONG))
        )
        whole = F.forall(words, lambda w: F.length(w) <= LONG)
        evenly = lambda p: F.transform(F.sequence(F.lit(1), F.length(p), F.lit(LONG)), lambda i: F.substring(p, i, LONG))
        held = lambda p: F.when(F.length(p) <= LONG, F.array(p)).otherwise(evenly(p))
        runs = _bind(words, lambda ws: F.flatten(F.transform(_cut_items(ws, 1, *WORD_CUTS), held)))
        return F.when(whole, runs).otherwise(F.flatten(F.transform(words, by_chars)))

    cut = _bind(F.split(sentence, "(?<= )", -1), word_runs)
    return F.when(F.length(sentence) <= LONG, F.array(sentence)).otherwise(cut)


def paragraphs(text: Column) -> Column:
    """array<string> of a text's paragraphs."""
    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), _BREAK, -1), _short))


def digests(text: Column) -> Column:
    """array<bigint> of a text's paragraph digests, each once."""
    hashed = F.sort_array(F.transform(paragraphs(text), lambda p: F.xxhash64(p)))
    # equal paragraphs are next to each other: their number makes them differ
    numbered = lambda same: F.transform(same, lambda h, i: F.xxhash64(h, i))
    held = _bind(hashed, lambda hs: F.flatten(F.transform(_runs(hs, lambda h: h), numbered)))
    return F.transform(held, _checked)


def _checked(h: Column) -> Column:
    """48 bits of ``h`` and 16 check bits of them."""
    high = h.bitwiseAND(F.lit(~0xFFFF))
    return high.bitwiseOR(_check(high))


def _check(high: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("check"), high), 48)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _runs(items: Column, key) -> Column:
    """A sorted array cut into the arrays of items with the same ``key``."""

    def cut(starts: Column) -> Column:
        end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(items))
        return F.transform(starts, lambda x, j: F.slice(items, x + 1, end(j) - x))

    places = F.transform(items, lambda _, i: i)
    first = lambda i: F.coalesce(key(F.get(items, i)) != key(F.get(items, i - 1)), F.lit(True))
    return _bind(F.filter(places, first), cut)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def _place(h: Column, part: int) -> Column:
    """The cell of a digest in a part of the block, from 16 bits of its hash."""
    first, n = PARTS[part]
    return F.pmod(F.shiftright(h, 16 * part), F.lit(n)).cast("int") + first


def _entries(ds: Column, salt: Column) -> Column:
    """array<struct<d, m>>: digests with their cells, one in each part, as bits of ``m``."""

    def bits(h: Column) -> Column:
        out = F.lit(0)
        for i in range(len(PARTS)):
            out = out.bitwiseOR(_bit(_place(h, i)))
        return out

    return F.transform(ds, lambda d: F.struct(d.alias("d"), _bind(F.xxhash64(d, salt), bits).alias("m")))


def _hits(entries: Column, bit: Column) -> Column:
    return F.filter(entries, lambda e: e["m"].bitwiseAND(bit) != 0)


def _xor(entries: Column, start: Column) -> Column:
    return F.aggregate(entries, start, lambda acc, e: acc.bitwiseXOR(e["d"]))


def _cell(n: Column, x: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), x.alias("x"))


def cells(ds: Column, salt: Column) -> Column:
    """array<struct<n, x>>: one block's cells for the digests ``ds``, in linear time: the
    entries are sorted by their cell, so that each cell's entries are one run."""

    def placed(d: Column) -> Column:
        def three(h: Column) -> Column:
            return F.array(*[F.struct(_place(h, i).alias("c"), d.alias("d")) for i in range(len(PARTS))])

        return _bind(F.xxhash64(d, salt), three)

    def gathered(runs: Column) -> Column:
        own = F.transform(runs, lambda r: _cell(F.size(r), F.aggregate(r, F.lit(0).cast("bigint"), lambda x, e: x.bitwiseXOR(e["d"]))))
        empty = _cell(F.lit(0), F.lit(0).cast("bigint"))
        places = F.transform(runs, lambda r: F.get(r, F.lit(0))["c"])
        at = lambda p, held, c: F.coalesce(F.get(held, F.array_position(p, c).cast("int") - 1), empty)
        every = F.sequence(F.lit(0), F.lit(CELLS - 1))
        return _bind(F.struct(places.alias("p"), own.alias("o")), lambda s: F.transform(every, lambda c: at(s["p"], s["o"], c)))

    entries = F.sort_array(F.flatten(F.transform(ds, placed)))
    return _bind(_bind(entries, lambda es: _runs(es, lambda e: e["c"])), gathered)


def subtract(a: Column, b: Column) -> Column:
    """The cells of ``a`` less those of ``b``."""
    return F.zip_with(a, b, lambda p, q: _cell(p["n"] - q["n"], p["x"].bitwiseXOR(q["x"])))


def _pure(c: Column) -> Column:
    """Whether a cell holds one digest alone, as far as its check bits show."""
    return (F.abs(c["n"]) == 1) & (c["x"].bitwiseAND(F.lit(0xFFFF)) == _check(c["x"].bitwiseAND(F.lit(~0xFFFF))))


def estimate(difference: Column) -> Column:
    """About how many digests differ: in a part of the block, the squares of the cells' counts
    add up to them on average, as entries of both signs meet in a cell by chance."""
    squares = F.aggregate(difference, F.lit(0).cast("bigint"), lambda acc, c: acc + c["n"].cast("bigint") * c["n"])
    return squares / F.lit(len(PARTS))


def peel(difference: Column, salt: Column) -> Column:
    """struct<cells, a, b, done>: what is left, and the digests recovered from each side."""
    none = F.array().cast("array<bigint>")
    start = F.struct(difference.alias("cells"), none.alias("a"), none.alias("b"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        def taken(single: Column) -> Column:
            keys = lambda sign: F.array_distinct(
                F.transform(F.filter(single, lambda c: c["n"] == sign), lambda c: c["x"])
            )

            def apply(found: Column) -> Column:
                def less(entries: Column) -> Column:
                    masks = F.concat(entries["p"], entries["m"])
                    touched = F.aggregate(masks, F.lit(0).cast("bigint"), lambda acc, e: acc.bitwiseOR(e["m"]))

                    def update(c: Column, bit: Column) -> Column:
                        def out(hit: Column) -> Column:
                            return _cell(c["n"] - F.size(hit["p"]) + F.size(hit["m"]), _xor(hit["m"], _xor(hit["p"], c["x"])))

                        hits = F.struct(_hits(entries["p"], bit).alias("p"), _hits(entries["m"], bit).alias("m"))
                        return _bind(hits, out)

                    def cells_less(mask: Column) -> Column:
                        return F.transform(
                            state["cells"],
                            lambda c, i: F.when(mask.bitwiseAND(_bit(i)) == 0, c).otherwise(update(c, _bit(i))),
                        )

                    return F.struct(
                        _bind(touched, cells_less).alias("cells"),
                        F.concat(state["a"], found["p"]).alias("a"),
                        F.concat(state["b"], found["m"]).alias("b"),
                        F.lit(False).alias("done"),
                    )

                return _bind(
                    F.struct(_entries(found["p"], salt).alias("p"), _entries(found["m"], salt).alias("m")), less
                )

            finished = F.struct(
                state["cells"].alias("cells"), state["a"].alias("a"), state["b"].alias("b"), F.lit(True).alias("done")
            )
            return F.when(F.size(single) == 0, finished).otherwise(
                _bind(F.struct(keys(1).alias("p"), keys(-1).alias("m")), apply)
            )

        return F.when(state["done"], state).otherwise(_bind(F.filter(state["cells"], _pure), taken))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _came_out(peeled: Column) -> Column:
    return F.forall(peeled["cells"], lambda c: (c["n"] == 0) & (c["x"] == 0))


def differences(a: Column, b: Column, cells_a: Column | None = None, cells_b: Column | None = None) -> Column:
    """struct<a, b, rest>: the digests that only one of the two digest arrays has, recovered
    from sketches of growing size. ``rest`` counts paragraphs of blocks that didn't come
    out of the largest sketch; 0 means that the recovery is complete.

    ``cells_a`` and ``cells_b`` are the one-block sketches, if they are known.
    """
    none = F.array().cast("array<bigint>")
    kind = "struct<todo:array<struct<a:array<bigint>,b:array<bigint>>>,a:array<bigint>,b:array<bigint>>"

    def block(g: Column, tier: Column, difference: Column) -> Column:
        """struct<g, e, p>: a block's digests, their estimated difference, and what peeling gave."""

        def judged(s: Column) -> Column:
            unpeeled = F.struct(s["d"].alias("cells"), none.alias("a"), none.alias("b"), F.lit(True).alias("done"))
            peeled = F.when(s["e"] > HOPELESS, unpeeled).otherwise(peel(s["d"], tier))
            return F.struct(g.alias("g"), s["e"].alias("e"), peeled.alias("p"))

        with_estimate = lambda d: F.struct(d.alias("d"), estimate(d).alias("e"))
        return _bind(_bind(difference, with_estimate), judged)

    def sketch(g: Column, tier: Column) -> Column:
        return subtract(cells(g["a"], tier), cells(g["b"], tier))

    def after(tried: Column, state: Column, tier: Column) -> Column:
        """The state with the blocks that came out, and the others cut into smaller ones."""
        good = F.filter(tried, lambda t: _came_out(t["p"]))
        bad = F.filter(tried, lambda t: ~_came_out(t["p"]))

        def cut(t: Column) -> Column:
            g = t["g"]
            # a one-sided difference makes the squares grow faster: no more can differ than there are
            most = F.least(t["e"], (F.size(g["a"]) + F.size(g["b"])).cast("double"))
            parts = F.greatest(F.lit(2), F.ceil(most / LOAD).cast("int"))

            def side(ds: Column, n: int) -> Column:
                place = lambda d: F.pmod(F.xxhash64(F.lit("block"), d, tier), parts).alias("p")
                return F.transform(ds, lambda d: F.struct(place(d), F.lit(n).alias("s"), d.alias("d")))

            def part(run: Column) -> Column:
                own = lambda n: F.transform(F.filter(run, lambda e: e["s"] == n), lambda e: e["d"])
                return F.struct(own(0).alias("a"), own(1).alias("b"))

            dealt = F.sort_array(F.concat(side(g["a"], 0), side(g["b"], 1)))
            return F.transform(_bind(dealt, lambda es: _runs(es, lambda e: e["p"])), part)

        return F.struct(
            F.flatten(F.transform(bad, cut)).alias("todo"),
            F.concat(state["a"], F.flatten(F.transform(good, lambda t: t["p"]["a"]))).alias("a"),
            F.concat(state["b"], F.flatten(F.transform(good, lambda t: t["p"]["b"]))).alias("b"),
        )

    both = F.struct(a.alias("a"), b.alias("b"))
    start = F.struct(F.array(both).alias("todo"), none.alias("a"), none.alias("b")).cast(kind)
    if cells_a is not None and cells_b is not None:
        zero = F.lit(0)
        first = F.array(block(both, zero, subtract(cells_a, cells_b)))
        blank = F.struct(F.array().cast("array<struct<a:array<bigint>,b:array<bigint>>>").alias("todo"), none.alias("a"), none.alias("b"))
        start = _bind(first, lambda tried: after(tried, blank, zero))
        start = start.cast(kind)

    def step(state: Column, tier: Column) -> Column:
        tried = F.transform(state["todo"], lambda g: block(g, tier, sketch(g, tier)))
        return F.when(F.size(state["todo"]) == 0, state).otherwise(
            _bind(tried, lambda t: after(t, state, tier).cast(kind))
        )

    low = 0 if cells_a is None else 1
    end = F.aggregate(F.sequence(F.lit(low), F.lit(TIERS)), start, step)
    return _bind(
        end,
        lambda e: F.struct(
            e["a"].alias("a"),
            e["b"].alias("b"),
            F.aggregate(e["todo"], F.lit(0), lambda acc, g: acc + F.size(g["a"]) + F.size(g["b"])).alias("rest"),
        ),
    )


def likeness(a: Column, b: Column, difference: Column) -> Column:
    """Shared / all paragraphs of two digest arrays, by their recovered differences. If a
    rest was left, the digest arrays themselves are compared."""

    def ratio(apart: Column) -> Column:
        total = (F.size(a) + F.size(b)).cast("double")
        return (total - apart) / (total + apart)

    recovered = F.when(difference["rest"] == 0, F.size(difference["a"]) + F.size(difference["b"])).otherwise(
        F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    )
    return _bind(recovered, ratio)


def fingerprint(sketch: Column) -> Column:
    """A one-block sketch as text: ``count:digest`` of each cell in hexadecimal, empty cells blank."""
    text = F.transform(
        sketch,
        lambda c: F.when(c["n"] == 0, F.lit("")).otherwise(F.concat_ws(":", F.hex(c["n"].cast("bigint")), F.hex(c["x"]))),
    )
    return F.array_join(text, ",")


def allow_deep_plans(docs: DataFrame) -> None:
    """The analyzer needs an iteration for each level of nested lambdas; a session whose bound
    is lower gets one that suffices."""
    conf = docs.sparkSession.conf
    name = "spark.sql.analyzer.maxIterations"
    if int(conf.get(name, "100")) < 400:
        conf.set(name, "400")


def with_sketch(docs: DataFrame, text: str, digest_column: str, sketch_column: str) -> DataFrame:
    """``docs`` with the paragraph digests of ``text`` and their one-block sketch."""
    allow_deep_plans(docs)
    rows = docs.withColumn(digest_column, digests(F.col(text)))
    return rows.withColumn(sketch_column, cells(F.col(digest_column), F.lit(0)))


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``digests`` and ``fingerprint`` of their texts (replacing such columns)."""
    rows = with_sketch(docs.drop("digests", "fingerprint", "_sketch"), text, "digests", "_sketch")
    return rows.withColumn("fingerprint", fingerprint(F.col("_sketch"))).drop("_sketch")
