"""The pipeline's stages on planted documents, and its end against a plain version."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from basketry.llm import chosenpath, mixing
from basketry.llm.queries import tokenizer_file

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted toxic texts, near copies and benchmark passages."""
    r = random.Random(6)
    vocabulary = [a + b for a in "ba de fi go ku la me ni po ru".split() for b in "dan lor mis tek vun sha".split()]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)) + "."
    items = [(i, text(30)) for i in range(8)]
    docs, labels, kind = [], [], {}
    for i in range(400):
        body = text(r.randint(60, 120))
        if i % 8 == 1:
            body = body.replace(" ", " vilegrub ", 4)
            kind[i] = "toxic"
        elif i % 8 == 2 and i > 8:
            source = docs[i - 2][1].split(" ")
            source[len(source) // 2] = "changed"
            body, kind[i] = " ".join(source), "near"
        elif i % 8 == 3:
            body, kind[i] = body + " " + items[i % 8][1], "leak"
        docs.append((i, body, "en", f"s{min(i % 7, 3)}", len(body)))
        labels.append((i, 1, int(kind.get(i) == "toxic")))
    docs += [docs[0], (None, None, None, None, None), (1000, "", "en", "s0", 0)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, kind


def test_stages_do_what_they_say(spark, folder):
    path, docs, kind = folder
    rows = spark.read.parquet(f"{path}/documents.parquet")
    work = cp.session_workspace(spark)
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "token_ids"]

    kept = work.table(stages["toxicity"](spark, rows, path))
    assert kept.columns == rows.columns
    ids = [r["doc_id"] for r in kept.collect()]
    gone = {d[0] for d in docs} - set(ids)
    assert gone == {i for i, k in kind.items() if k == "toxic"}

    unique = work.table(stages["ngram_jaccard"](spark, kept, path))
    left = [r["doc_id"] for r in unique.collect()]
    assert len(left) == len(set(left))
    near = {i for i, k in kind.items() if k == "near"}
    # one of the two texts without words stays as well
    assert set(ids) - set(left) - {None, 1000} == {i for i in near if i - 2 in ids} and len({None, 1000} & set(left)) == 1

    clean = work.table(stages["decontamination"](spark, unique, path))
    assert set(left) - {r["doc_id"] for r in clean.collect()} == {i for i, k in kind.items() if k == "leak"}

    mixed = work.table(stages["mixing"](spark, clean, path))
    assert mixed.columns == rows.columns
    copies = sorted(str(r["doc_id"]) for r in mixed.collect())
    assert copies == sorted(str(r["doc_id"]) for r in mixing.replicate(clean).collect())

    index = stages["token_ids"](spark, mixed, path).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    encoded = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in mixed.collect()}
    assert sorted(str(r["doc_id"]) for r in index) == copies
    at = 0
    for r in sorted(index, key=lambda r: r["start"]):
        ids = encoded[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_run_is_the_stages_in_turn(spark, folder):
    path, _, _ = folder
    a = sorted(map(str, cp.run(spark, path).select("doc_id", "n_tokens", "ids_crc32").collect()))
    b = sorted(map(str, cp.run(spark, path).select("doc_id", "n_tokens", "ids_crc32").collect()))
    assert a == b and a
    assert chosenpath.needed_runs(0.9999, 2.0, 3) == 6
