"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on the
windows of toxic text that hold a marking word form (one whose document frequency is
many times higher in toxic than in ordinary documents). A window's distance is the
difference of its compressed lengths with the ordinary dictionary alone and with the
toxic one beside it, so text that has nothing to do with either costs the same. Windows
of ordinary text that the toxic dictionary shortens by chance (a shared beginning of a
word, say) train further parts of the ordinary one, in ``rounds`` rounds. Windows are
``window_words`` words in two bytes a character, so that a short word is long enough
beside the fixed cost of a frame; a window of one word, the default, keeps the noise of
its neighbours out of the comparison.

A document's features are its numbers of windows by bytes saved and by bytes left, from
each threshold up, and its number of windows; a logistic calibration with the class sizes
of all labels weights the thresholds and gives a score. Whole texts are scored, in one
pass, row by row.

Defined results: a null text counts as empty; an empty text gets the score of no
windows (the calibrated base). With no labelled rows of one class, or no marking form,
the score is the share of label 1 (0 without labels). An empty table gives no rows, equal
texts equal scores, ties at a threshold count as above it; a very long text holds one
counter for each different window. Rows are kept one for one; an existing column
``toxicity`` is replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import bound_batches
from .labelled import labelled_sample

_WORD = re.compile(r"\w+")
_SAVED = 24  # thresholds on the bytes that the toxic dictionary saves
_LEFT = (5, 7, 9, 12, 15)  # thresholds on the bytes that it leaves
EVIDENCE = 16.0  # least evidence for a marking word form
_MEMO = 120_000  # remembered windows per task


def _params() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=16, hash_log=16, search_log=5, min_match=6, target_length=32,
        strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False,
    )


def _window_bytes(window: str) -> bytes:
    return f" {window} ".encode("utf-16-le", "surrogatepass")


def _windows(words: list[str], k: int) -> list[str]:
    return words if k == 1 else [" ".join(words[i : i + k]) for i in range(0, max(1, len(words) - k + 1))]


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes  # contents of the trained dictionaries
    toxic: bytes
    weights: tuple[float, ...]  # intercept, bytes saved, bytes left, log(windows + 1)
    window_words: int

    def scorer(self) -> _Scorer:
        return _Scorer(self)


class _Scorer:
    def __init__(self, model: ToxicityModel):
        self.k, self.weights = model.window_words, np.array(model.weights)
        self.memo: dict[str, tuple[int, int]] = {}
        self.compressors = []
        for content in (model.ordinary, model.ordinary + model.toxic):
            # raw content: windows are coded alike with both, matches aside
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=_params())
            self.compressors.append(zstandard.ZstdCompressor(compression_params=_params(), dict_data=d))
        self.frame = len(self.compressors[0].compress(b""))

    def lengths(self, window: str) -> tuple[int, int]:
        """Bytes of a window that the toxic dictionary saves, and those that it leaves."""
        found = self.memo.get(window)
        if found is None:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            raw = _window_bytes(window)
            plain, toxic = (len(c.compress(raw)) for c in self.compressors)
            found = self.memo[window] = (plain - toxic, toxic - self.frame)
        return found

    def features(self, text: str) -> np.ndarray:
        windows = _windows(_WORD.findall(text.lower()), self.k)
        saved, left = np.zeros(_SAVED + 1), np.zeros(len(_LEFT) + 1)
        for window, n in Counter(windows).items():
            gain, rest = self.lengths(window)
            if gain > 0:
                saved[min(gain, _SAVED)] += n
                left[bisect_left(_LEFT, rest)] += n
        counts = np.concatenate([saved[:0:-1].cumsum()[::-1], left[:-1].cumsum()])
        return np.append(np.log1p(counts), np.log1p(len(windows)))

    def score(self, text: str) -> float:
        z = self.weights[0] + self.features(text) @ self.weights[1:] if len(self.weights) > 1 else self.weights[0]
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


# -- training ----------------------------------------------------------------


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), strict=True):
            units = sorted(set(_WORD.findall(text.lower())))
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array([y] * len(units), pa.int32())], ["unit", "y"])


def _marking_units(sample: DataFrame, n_toxic: int, n_ordinary: int, max_units: int, ratio: float, min_docs: int = 4) -> list[str]:
    """The units whose document frequency marks toxic text, strongest first."""
    df = (
        sample.dropDuplicates(["text", "y"])  # copies count once
        .mapInArrow(_unit_rows, "unit string, y int")
        .groupBy("unit")
        .agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
        .filter(F.col("a") >= min_docs)
    )
    p, q = (F.col("a") + 0.5) / (n_toxic + 1), (F.col("b") + 0.5) / (n_ordinary + 1)
    both = (F.col("a") + F.col("b") + 0.5) / (n_toxic + n_ordinary + 1)
    # likelihood ratio of two document frequencies against one: chance leaves it small
    evidence = 2 * (F.col("a") * F.log(p / both) + F.col("b") * F.log(q / both))
    marked = df.filter((p > ratio * q) & (evidence > EVIDENCE)).withColumn("w", F.col("a") * F.log(p / q))
    rows = marked.orderBy(F.desc("w"), "unit").limit(max_units).collect()  # max_units rows
    return [r["unit"] for r in rows]


def _plain_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch["text"].to_pylist():
            words = _WORD.findall(text.lower())
            lines = [" ".join(words[i : i + 8]) for i in range(0, len(words), 8)]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["window"])


def _marked_windows(marks: frozenset[str], k: int):
    """The windows that hold a marking form."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch["text"].to_pylist():
                found = [w for w in _windows(_WORD.findall(text.lower()), k) if not marks.isdisjoint(w.split(" "))]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["window"])

    return rows


def _mistaken_windows(model: ToxicityModel, marks: frozenset[str]):
    """The windows without a marking form that the toxic dictionary shortens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for text in batch["text"].to_pylist():
                windows = _windows(_WORD.findall(text.lower()), model.window_words)
                found = [w for w in windows if scorer.lengths(w)[0] > 0 and marks.isdisjoint(w.split(" "))]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["window"])

    return rows


def _drawn(windows: DataFrame, most: int) -> list[bytes]:
    """At most ``most`` windows, those of smallest hash with the number of the row."""
    rows = windows.groupBy("window").agg(F.count("*").alias("n"))
    # each occurrence is a sample of its own, as the trainer counts samples
    rows = rows.select("window", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    rows = rows.orderBy(F.xxhash64("window", "i"), "window", "i").limit(most).collect()  # ``most`` rows
    return [_window_bytes(r["window"]) for r in rows]


def _dictionary(windows: list[bytes], size: int) -> bytes:
    """The content of a dictionary trained on the windows."""
    try:
        return zstandard.train_dictionary(size, windows).as_bytes()
    except zstandard.ZstdError:  # too few windows to train on: plain content, the most frequent last
        counts = Counter(windows)
        return b"".join(sorted(counts, key=lambda w: (counts[w], w)))[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; weights for unscaled features."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    w = np.zeros(a.shape[1])

    def loss(v: np.ndarray) -> float:
        z = a @ v
        return float(weight @ (np.logaddexp(0, z) - y * z) + 0.5 * penalty @ v**2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, a.T @ (weight * (y - p)) - penalty * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w += step
        if np.abs(step).max() < 1e-7:
            break
    slopes = w[1:] / scale
    return np.append(w[0] - slopes @ mean, slopes)


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    keep: Column,
    label: str = "toxic",
    key: str = "doc_id",
    text: str = "text",
    max_docs_per_class: int = 6000,
    max_units: int = 2000,
    max_windows: int = 40_000,
    ordinary_bytes: int = 8192,
    toxic_bytes: int = 4096,
    ratio: float = 20.0,
    window_words: int = 1,
    rounds: int = 2,
) -> ToxicityModel:
    """Fit on at most ``max_docs_per_class`` labelled documents of each class among those
    that ``keep`` (a condition on ``labels``) admits. At most ``max_windows`` windows for
    each dictionary and ``max_units`` marking forms reach the driver."""
    bound_batches(docs.sparkSession)
    sample, sizes = labelled_sample(docs, labels, label, keep, max_docs_per_class, key, text)
    n = sizes[0] + sizes[1]
    share = sizes[1] / n if n else 0.0
    base = (math.log((share + 1e-9) / (1 - share + 1e-9)),)
    if not sizes[0] or not sizes[1]:
        return ToxicityModel(b"", b"", base, window_words)
    drawn = {y: min(max_docs_per_class, sizes[y]) for y in sizes}
    marks = frozenset(_marking_units(sample, drawn[1], drawn[0], max_units, ratio))
    if not marks:
        return ToxicityModel(b"", b"", base, window_words)
    plain, toxic_rows = sample.filter("y = 0"), sample.filter("y = 1")
    ordinary = _dictionary(_drawn(plain.mapInArrow(_plain_windows, "window string"), max_windows), ordinary_bytes)
    marked = toxic_rows.mapInArrow(_marked_windows(marks, window_words), "window string")
    toxic = _dictionary(_drawn(marked, max_windows), toxic_bytes)
    for _ in range(rounds):
        so_far = ToxicityModel(ordinary, toxic, (0.0,), window_words)
        mistaken = _drawn(plain.mapInArrow(_mistaken_windows(so_far, marks), "window string"), max_windows)
        if not mistaken:
            break
        ordinary += _dictionary(mistaken, min(ordinary_bytes, max(1024, 4 * len(mistaken))))

    blank = ToxicityModel(ordinary, toxic, (0.0,), window_words)
    spread = sample.mapInArrow(_feature_rows(blank), "x array<double>, y int")
    got = spread.collect()  # one short vector for each sampled document
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)
    if len(set(y)) < 2:
        return ToxicityModel(ordinary, toxic, base, window_words)
    weight = np.where(y == 1, sizes[1] / max(1, (y == 1).sum()), sizes[0] / max(1, (y == 0).sum()))
    weight *= len(y) / weight.sum()
    return ToxicityModel(ordinary, toxic, tuple(_logistic(x, y, weight)), window_words)


def _feature_rows(model: ToxicityModel):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            x = [scorer.features(t).tolist() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch["y"]], ["x", "y"])

    return rows


# -- scoring -----------------------------------------------------------------


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity``: double from 0 to 1, higher for toxic text."""
    bound_batches(docs.sparkSession)
    rows = docs.drop("toxicity")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer() if len(model.weights) > 1 else None
        base = 1 / (1 + math.exp(-model.weights[0]))
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            texts = batch[text].to_pylist()
            s = [scorer.score(t or "") if scorer else base for t in texts]
            yield batch.append_column("toxicity", pa.array(s, pa.float64()))

    return rows.mapInArrow(scored, T.StructType([*rows.schema, T.StructField("toxicity", T.DoubleType())]))
