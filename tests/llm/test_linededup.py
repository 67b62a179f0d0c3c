"""Line deduplication against a brute-force version."""

import random

import pytest

from basketry.llm import linededup


def distance_within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute_force(docs, min_chars, max_edits=1):
    places = {}
    for k, text in docs:
        for no, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.strip():
                places.setdefault(line, []).append((k, no))
    first = {line: min(p) for line, p in places.items()}
    out = {}
    for k, text in docs:
        if text is None:
            out[k] = (None, 0, 0, 0)
            continue
        kept, equal, near, lines = [], 0, 0, text.split("\n")
        for no, line in enumerate(lines):
            if line in first and first[line] < (k, no):
                equal += 1
            elif line in first and max_edits and len(line) >= min_chars and any(
                o != line and len(o) >= min_chars and first[o] < first[line] and distance_within_one(line, o) for o in first
            ):
                near += 1
            else:
                kept.append(line)
        out[k] = ("\n".join(kept), len(lines), equal, near)
    return out


def run(spark, docs, **kw):
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = linededup.dedup_lines(rows, **kw).collect()
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_equal"], r["n_near"]) for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_small_alphabet_matches_brute_force(spark, seed):
    r = random.Random(seed)
    docs = [
        (i, "\n".join("".join(r.choice("ab") for _ in range(r.randint(3, 8))) for _ in range(r.randint(1, 4))))
        for i in range(40)
    ]
    assert run(spark, docs, min_chars=4) == brute_force(docs, 4)


def test_a_later_partner_across_an_unrelated_earlier_one(spark):
    # "axbcd" and "abxcd" share the variant "abcd" but are two edits apart
    docs = [(1, "axbcdefgh"), (2, "abcdefgh"), (3, "abcdefxgh")]
    assert run(spark, docs, min_chars=4) == brute_force(docs, 4)


def test_edge_cases(spark):
    long = "word " * 400
    docs = [
        (1, None), (2, ""), (3, "   \n\n   "), (4, long), (5, long[:-3] + "s" + long[-2:]), (6, "short\nshort"),
        (7, "é" * 30 + "\n" + "é" * 29 + "e"), (8, "the same line twice in one text\nthe same line twice in one text"),
    ]
    assert run(spark, docs) == brute_force(docs, 20)
    assert run(spark, docs, max_edits=0) == brute_force(docs, 20, 0)
    with pytest.raises(ValueError):
        run(spark, docs, max_edits=2)


def test_nulls_repeated_rows_and_extra_columns(spark):
    docs = [(None, "a line that comes before all others", "x"), (1, "a line that comes before all others", None)]
    rows = spark.createDataFrame(docs * 2, "doc_id bigint, text string, n_near string")
    got = sorted((r["doc_id"] or -1, r["text"], r["n_equal"], r["n_near"]) for r in linededup.dedup_lines(rows).collect())
    assert got == [(-1, docs[0][1], 0, 0)] * 2 + [(1, "", 1, 0)] * 2
    assert linededup.dedup_lines(rows.limit(0)).count() == 0
