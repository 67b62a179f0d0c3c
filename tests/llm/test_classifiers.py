"""Toxicity and quality: held-out accuracy, and defined results for odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from basketry.llm import quality, toxicity
from basketry.llm.labelled import crc_bucket, labelled_sample

WORDS = [a + b for a in "ba de fi go ku la me ni po ru".split() for b in "dan lor mis tek vun sha".split()]


def corpus(seed=1, n=600):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(WORDS) for _ in range(r.randint(20, 80))]
        toxic = i % 4 == 0
        bad = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["vilegrub", "scornmop", "hatewhim"]) + r.choice(["", "s", "ed"]))
        text = " ".join(words) + "."
        docs.append((i, text.upper().replace(" ", "!! ") if bad else text))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def accuracy(scored, labels, score, label, held, threshold):
    rows = scored.join(labels, "doc_id").filter(held).select(F.col(score).alias("s"), F.col(label).alias("y")).collect()
    return sum((r["s"] >= threshold) == bool(r["y"]) for r in rows) / len(rows)


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    held = crc_bucket("doc_id", 5) == 0
    model = toxicity.train_toxicity(docs, labels, ~held)
    assert accuracy(toxicity.score_toxicity(docs, model), labels, "toxicity", "toxic", held, 0.5) > 0.9


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    held = crc_bucket("doc_id", 4) == 2
    model = quality.train_quality(docs, labels, ~held)
    assert accuracy(quality.score_quality(docs, model), labels, "quality_score", "quality", held, 0.7) > 0.95


def test_factorisation_identity():
    import numpy as np

    rng = np.random.default_rng(0)
    width = 8 + quality.N_STATS
    m = quality.QualityModel(8, 0.1, rng.normal(size=width), rng.normal(size=(width, 3)) * 0.1, np.zeros(quality.N_STATS), np.ones(quality.N_STATS))
    at, value, stats = np.array([1, 5]), np.array([0.5, -0.2]), rng.normal(size=quality.N_STATS).clip(-4, 4)
    x = np.zeros(width)
    x[at], x[8:] = value, stats
    z = 0.1 + m.linear @ x + sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for i in range(width) for j in range(i))
    assert abs(m.score(at, value, stats) - 1 / (1 + np.exp(-z))) < 1e-12


def test_odd_rows_and_missing_labels(spark, tables):
    docs, labels = tables
    odd = [(None, None, "a"), (1, "", "b"), (1, "", "b"), (2, "word " * 40000, None), (3, "é\x00☃", "c")]
    rows = spark.createDataFrame(odd, "doc_id bigint, text string, toxicity string")
    model = toxicity.train_toxicity(docs, labels, F.lit(True))
    got = toxicity.score_toxicity(rows, model).collect()
    assert len(got) == 5 and all(0 <= r["toxicity"] <= 1 for r in got)
    assert len({r["toxicity"] for r in got if not r["text"]}) == 1
    assert toxicity.score_toxicity(rows.limit(0), model).count() == 0
    good = quality.train_quality(docs, labels, F.lit(True), epochs=2)
    got = quality.score_quality(rows, good).collect()
    assert len(got) == 5 and all(0 <= r["quality_score"] <= 1 for r in got)

    nothing, one_class = labels.limit(0), labels.withColumn("toxic", F.lit(1)).withColumn("quality", F.lit(1))
    for lab, share in ((nothing, 0.0), (one_class, 1.0)):
        s = toxicity.score_toxicity(rows, toxicity.train_toxicity(docs, lab, F.lit(True))).first()["toxicity"]
        q = quality.score_quality(rows, quality.train_quality(docs, lab, F.lit(True))).first()["quality_score"]
        assert abs(s - share) < 1e-6 and abs(q - share) < 1e-6


def test_labelled_sample_is_bounded_and_repeatable(spark, tables):
    docs, labels = tables
    draw = lambda d: sorted(map(tuple, labelled_sample(d, labels, "toxic", F.lit(True), 20)[0].collect()))
    assert len(draw(docs)) == 40 and draw(docs) == draw(docs.repartition(7))
    sizes = labelled_sample(docs, labels.union(labels), "toxic", F.lit(True), 20)[1]
    assert sizes == {0: 450, 1: 150}


def test_toxic_dictionary_is_trained_on_toxic_windows_and_lengths_are_the_compressed_ones(tables):
    import zstandard

    docs, labels = tables
    held = crc_bucket("doc_id", 5) == 0
    model = toxicity.train_toxicity(docs, labels, ~held)
    word, plain = toxicity._window_bytes("hatewhim"), toxicity._window_bytes("badanbalor")
    assert word in model.toxic and word not in model.ordinary

    def length(content, raw):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(compression_params=toxicity._params(), dict_data=d).compress(raw))

    scorer = model.scorer()
    for window, raw in (("hatewhim", word), ("badanbalor", plain)):
        with_toxic = length(model.ordinary + model.toxic, raw)
        assert scorer.lengths(window) == (length(model.ordinary, raw) - with_toxic, with_toxic - scorer.frame)
    assert scorer.lengths("hatewhim")[0] > 0 >= scorer.lengths("badanbalor")[0]


def test_toxicity_without_marking_forms_is_the_share(spark):
    docs = spark.createDataFrame([(i, "same words in all of them") for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 4 // 3) for i in range(40)], "doc_id bigint, toxic int")
    model = toxicity.train_toxicity(docs, labels, F.lit(True))
    scores = {round(r["toxicity"], 6) for r in toxicity.score_toxicity(docs, model).collect()}
    assert scores == {0.25}
