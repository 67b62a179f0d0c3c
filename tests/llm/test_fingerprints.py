"""Fingerprints: recovered differences and likeness against sets of paragraphs."""

import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from basketry.llm import fingerprints as fp
from basketry.llm.ordering import key_buckets, with_next


def _hash(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode(), h)
    return h


def _cut(items, window, spacing, apart, longest):
    n = len(items)
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    marks = [i for i in range(1, n) if signed(_hash(*items[i : i + window])) % spacing == 0]
    kept = [m for j, m in enumerate(marks) if j == 0 or m - marks[j - 1] >= apart]
    starts = []
    for a, b in zip([0, *kept], [*kept, n], strict=True):
        starts += range(a, b, longest)
    return ["".join(items[a:b]) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def cut(text):
    """The paragraphs of a text, by the rules of the module."""
    out = []
    for sentence in re.split(r"\n|(?<=[.!?]) |(?<=[。！？｡।؟۔])", text or ""):
        if len(sentence) <= fp.LONG:
            out.append(sentence)
            continue
        words = re.split(r"(?<= )", sentence)
        if all(len(w) <= fp.LONG for w in words):
            for part in _cut(words, 1, *fp.WORD_CUTS) if len(words) > 1 else words:
                out += [part[i : i + fp.LONG] for i in range(0, len(part), fp.LONG)] or [part]
        else:
            for w in words:
                out += [w] if len(w) <= fp.LONG else _cut(list(w), 4, fp.SPACING, fp.APART, fp.LONG)
    return out


def paragraphs(text):
    return Counter(cut(text))


def likeness(a, b):
    x, y = paragraphs(a), paragraphs(b)
    return sum((x & y).values()) / sum((x | y).values())


def compare(spark, pairs):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, s string, t string")
    rows = fp.with_sketch(fp.with_sketch(rows, "s", "a", "ka"), "t", "b", "kb")
    rows = rows.withColumn("d", fp.differences(F.col("a"), F.col("b"), F.col("ka"), F.col("kb")))
    return rows.select("i", "a", "b", "d", fp.likeness(F.col("a"), F.col("b"), F.col("d")).alias("l")).orderBy("i").collect()


def versions(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a = [f"line {r.randint(0, 60)}" for _ in range(r.randint(0, 120))]
        b = list(a)
        for _ in range(r.choice([0, 1, 3, 20, 100])):
            if b and r.random() < 0.5:
                b.pop(r.randrange(len(b)))
            else:
                b.insert(r.randint(0, len(b)), f"line {r.randint(0, 200)}")
        out.append(("\n".join(a), "\n".join(b)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_differences_are_recovered(spark, seed):
    pairs = versions(seed, 60)
    for row, (s, t) in zip(compare(spark, pairs), pairs, strict=True):
        a, b = set(row["a"]), set(row["b"])
        assert row["d"]["rest"] == 0
        assert sorted(row["d"]["a"]) == sorted(a - b) and sorted(row["d"]["b"]) == sorted(b - a)
        assert abs(row["l"] - likeness(s, t)) < 1e-12


def test_odd_texts(spark):
    long = "\n".join(f"paragraph number {i}" for i in range(3000))
    pairs = [(None, ""), ("", "x"), (None, None), ("same\nsame\nsame", "same"), (long, long[:-1]), (long, "short"), ("a", "a")]
    rows = compare(spark, pairs)
    for row, (s, t) in zip(rows, pairs, strict=True):
        assert abs(row["l"] - likeness(s, t)) < 1e-12
    assert rows[0]["l"] == rows[2]["l"] == rows[6]["l"] == 1.0


def test_equal_texts_have_equal_fingerprints(spark):
    rows = spark.createDataFrame([(1, "a. b\nc", "x"), (2, "a. b\nc", None), (3, None, "x"), (3, None, "x")], "k int, text string, fingerprint string")
    got = {r["k"]: r["fingerprint"] for r in fp.with_fingerprint(rows).collect()}
    assert got[1] == got[2] != got[3]
    assert fp.with_fingerprint(rows.limit(0)).count() == 0


def test_next_row_in_key_order(spark):
    r = random.Random(4)
    keys = r.sample(range(10**6), 500) + [10**15 + i for i in range(40)] + [7, 7]
    rows = [(k, f"t{i}") for i, k in enumerate(keys)] + [(None, "last")]
    df = spark.createDataFrame(rows, "k bigint, v string").repartition(5)
    got = {(x["k"], x["v"]): x["n"] for x in with_next(df, "k", ["v"], "v", "n").collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert got == {a: order[(i + 1) % len(order)][1] for i, a in enumerate(order)}
    one = spark.createDataFrame([(1, "x")], "k bigint, v string")
    assert [x["n"] for x in with_next(one, "k", ["v"], "v", "n").collect()] == ["x"]
    assert with_next(one.limit(0), "k", ["v"], "v", "n").count() == 0
    spread = key_buckets(df, "k", "b", rows=50).groupBy("b").count().collect()
    assert max(x["count"] for x in spread) < 150


LETTERS = {
    "latin": "abcdefghij klmno pqrst. ", "lower": "abcdefghij klmno pqrst ", "cyrillic": "абвгдежзи клмно прсту. ",
    "han": "天地玄黄宇宙洪荒日月盈昃辰宿列张。", "run": "abcdefghijklmnopqrst",
}


def test_half_an_edited_text_stays_alike_in_any_script(spark):
    r = random.Random(6)
    draw = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    pairs = []
    for letters in LETTERS.values():
        text = draw(letters, 800)
        pairs += [(text, text[:400] + draw(letters, 400)), (text, text[:300] + "#" + text[300:])]
    for row in compare(spark, pairs):
        half = row["i"] % 2 == 0
        assert 0.15 < row["l"] < 0.7 if half else 0.6 < row["l"] < 1


def test_paragraphs_are_short_and_whole(spark):
    r = random.Random(7)
    texts = ["a" * 5000, "", "x" * 160, "ab" * 300, "".join(r.choice("abc😀é 天") for _ in range(4000))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x["i"]: x["p"] for x in rows.select("i", fp._short(F.col("t")).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert "".join(got[i]) == t and max(map(len, got[i])) <= fp.LONG


def test_paragraphs_are_cut_as_the_rules_say(spark):
    r = random.Random(8)
    word = lambda a: "".join(r.choice(a) for _ in range(r.randint(1, 9)))
    texts = [None, "", "\n\n", ". . .", "a. b! c?", "x" * 500, " " * 400]
    for alphabet in ("abcdef", "äöüßéà", "жзиклм", "漢字仮名"):
        for _ in range(12):
            words = [word(alphabet) + r.choice(["", "", "", "", "."]) * (r.random() < 0.2) for _ in range(r.randint(1, 150))]
            texts.append(r.choice([" ", " ", "  "]).join(words))
        texts.append("".join(word(alphabet) for _ in range(200)) + " end. " + "".join(word(alphabet) for _ in range(100)))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    fp.allow_deep_plans(rows)
    got = {x["i"]: x["p"] for x in rows.select("i", fp.paragraphs(F.col("t")).alias("p")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == cut(t), (i, t)
        assert all(len(p) <= fp.LONG for p in got[i])


def test_query_is_the_plain_definition_on_every_document(spark, tmp_path):
    import hashlib

    from basketry.llm.queries import op1_fingerprints

    r = random.Random(9)
    sentence = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "rho"]) + str(r.randint(0, 30)) for _ in range(r.randint(2, 40)))
    docs = [(i * 3, r.choice([". ", "\n"]).join(sentence() for _ in range(r.randint(0, 30)))) for i in range(60)]
    docs += [(200, None), (201, ""), (202, docs[5][1]), (203, docs[5][1]), (204, "word " * 3000)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in op1_fingerprints(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    prints = {}
    for (key, text), (_, following) in zip(docs, [*docs[1:], docs[0]], strict=True):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        row = got[key]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["near_edited"] == pytest.approx(likeness(text, edited))
        assert row["near_next"] == pytest.approx(likeness(text, following))
        assert prints.setdefault(text, row["fingerprint"]) == row["fingerprint"]
    assert got[202]["near_next"] == 1.0 and got[200]["fingerprint"] == got[201]["fingerprint"]
    one = spark.createDataFrame([(1, "a. b. c")], "doc_id bigint, text string")
    one.write.parquet(f"{tmp_path}/one/documents.parquet")
    alone = op1_fingerprints(spark, f"{tmp_path}/one").collect()
    assert [(x["near_edited"] <= 1, x["near_next"]) for x in alone] == [(True, 1.0)]
    rows.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op1_fingerprints(spark, f"{tmp_path}/none").count() == 0


def test_numpy_sketches_are_those_of_the_column_expressions(spark):
    from basketry.llm import sketchpairs as sk

    pairs = versions(3, 60) + [("", ""), ("a" * 900, "b " * 700), ("x. " * 40, "x. " * 41), ("word " * 300, "other " * 300)]
    expected = compare(spark, pairs)
    a, b = sk.digests([s or "" for s, _ in pairs]), sk.digests([t or "" for _, t in pairs])
    for i, row in enumerate(expected):
        for (d, of), column in ((a, "a"), (b, "b")):
            assert sorted(d[of == i].view("i8").tolist()) == sorted(row[column])
    assert sk.likeness(*a, *b, len(pairs)).tolist() == pytest.approx([row["l"] for row in expected])
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(pairs)], "i int, text string")
    prints = [r["fingerprint"] for r in fp.with_fingerprint(rows).orderBy("i").collect()]
    assert [sk.fingerprint(n, x) for n, x in zip(*sk.cells(*a, len(pairs), 0), strict=True)] == prints


def test_query_runs_no_python_on_the_executors(spark):
    from basketry.llm.queries import op1_fingerprints

    plan = op1_fingerprints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_differences_peeled_as_tables(spark, monkeypatch):
    from basketry.functions.workspace import Workspace
    from basketry.llm import sketchtables as st

    r = random.Random(11)
    draw = lambda n: [r.getrandbits(64) - 2**63 for _ in range(n)]
    pairs = [([], []), (draw(1), []), ([], draw(3))]
    for same, a, b in [(0, 40, 3), (500, 0, 0), (300, 9, 9), (5, 700, 0), (2000, 300, 900), *[(20, 8, 8)] * 60]:
        shared = draw(same)
        pairs.append((shared + draw(a), draw(b) + shared))
    schema = "k int, a array<bigint>, b array<bigint>"
    raw = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], schema)
    # digests carry their own check bits
    checked = raw.select("k", *[F.transform(c, fp._checked).alias(c) for c in "ab"])
    sets = {x["k"]: len(set(x["a"]) ^ set(x["b"])) for x in checked.collect()}
    sketches = [fp.cells(F.col(c), F.lit(0)) for c in "ab"]
    pair = (F.col("k").cast("bigint") * 1000).alias("pair")
    rows = checked.select(pair, st.first_blocks(*sketches, F.col("a"), F.col("b")).alias("parts"), "a", "b")
    for tiers in (fp.TIERS, 0):  # the second leaves a rest, which is compared itself
        monkeypatch.setattr(fp, "TIERS", tiers)
        with Workspace(spark) as work:
            found = {x["pair"]: x["apart"] for x in st.differing(rows, work, work).collect()}
        assert found == {1000 * k: n for k, n in sets.items()}
    with Workspace(spark) as work:
        assert st.differing(rows.limit(0), work, work).count() == 0


def test_a_digest_noted_for_both_sides_is_no_difference(spark):
    from basketry.llm import sketchtables as st

    digest = spark.range(1).select(fp._checked(F.lit(123456789 << 20)).alias("x"), F.lit(0).alias("block"))
    place = fp._place(F.xxhash64("x", F.lit(0)), 0).cast("bigint")
    cells = digest.select(F.lit(5).alias("pair"), "block", F.inline(F.array(
        st._cell(place, F.lit(-1), F.col("x")), st._cell(F.col("x"), F.lit(1), F.lit(0).cast("bigint"))
    )))
    left = st.peel_part(cells, 0, 0).collect()
    assert [x["n"] for x in left] == [1, 1] and all(0 <= x["c"] < fp.CELLS for x in left)
