"""Quality classifier: a factorisation machine on hashed words, structure and metadata.

A document's feature vector holds hashed word counts (sublinear, scaled to unit
length), statistics of its structure (line, word and character make-up, repetition)
and of its size (metadata that every text has), standardised. The score is

    logit = b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

which is the sum over all feature pairs of <v_i, v_j> x_i x_j by the sum-of-squares
identity, in time linear in the number of non-zero features.

Defined results: a null text counts as empty, and an empty text has all counts zero.
With no labelled rows of one class the score is the share of label 1 (0 without
labels). Rows are kept one for one; an existing column ``quality_score`` is replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .batches import bound_batches
from .labelled import labelled_sample

_WORD = re.compile(r"\w+")
_SYMBOLS = str.maketrans("", "", " \n\t.,;:'\"-()")
N_STATS = 18
_MEMO = 120_000


def structure(text: str, words: list[str], counts: Counter) -> list[float]:
    """Statistics of the text's make-up; all finite, 0 for empty text."""
    n, tokens, lines = len(text), text.split(), text.split("\n")
    n_tok, n_line = max(1, len(tokens)), len(lines)
    rest = text.translate(_SYMBOLS)  # letters, digits and unusual marks
    letters = sum(map(len, words))
    line_counts = Counter(lines)
    repeated = sum(len(x) * (c - 1) for x, c in line_counts.items())
    pairs = Counter(zip(tokens, tokens[1:], strict=False))
    top = max(counts.values(), default=0)
    return [
        math.log1p(n),
        math.log1p(len(tokens)),
        math.log1p(n_line),
        len(tokens) / n_line / 100,
        n / n_tok / 10,
        (len(rest) - letters) / max(1, n),
        sum(c.isdigit() for c in rest) / max(1, n),
        sum(c.isupper() for c in rest) / max(1, n),
        text.count("|") / n_tok,
        text.count("!") / n_tok,
        (text.count("#") + text.count("$") + text.count("%") + text.count("&") + text.count("*")) / n_tok,
        sum(t.isupper() for t in tokens) / n_tok,
        repeated / max(1, n),
        1 - len(line_counts) / n_line,
        len(counts) / max(1, len(words)),
        top / max(1, len(words)),
        1 - len(pairs) / max(1, len(tokens) - 1) if len(tokens) > 1 else 0.0,
        (text.count("{") + text.count("}") + text.count("<") + text.count(">") + text.count("@") + text.count("http")) / n_tok,
    ]


class _Featurizer:
    def __init__(self, n_hash: int):
        self.n_hash, self.memo = n_hash, {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, list[float]]:
        """(hash buckets, their values, structure statistics)."""
        words = _WORD.findall(text.lower())
        counts, memo = Counter(words), self.memo
        if len(memo) > _MEMO:
            memo.clear()
        idx = np.fromiter((memo.get(w) or memo.setdefault(w, zlib.crc32(w.encode()) % self.n_hash) for w in counts), np.int64, len(counts))
        val = np.bincount(idx, np.fromiter(counts.values(), float, len(counts)), self.n_hash) if len(idx) else np.zeros(1)
        at = np.flatnonzero(val)
        v = 1 + np.log(val[at])
        return at, v / max(1e-9, np.sqrt(v @ v)), structure(text, words, counts)


@dataclass(frozen=True)
class QualityModel:
    n_hash: int
    bias: float
    linear: np.ndarray  # n_hash + N_STATS
    factors: np.ndarray  # (n_hash + N_STATS, rank)
    mean: np.ndarray  # of the statistics
    scale: np.ndarray

    def score(self, at: np.ndarray, value: np.ndarray, stats: np.ndarray) -> float:
        x = np.concatenate([value, np.clip((stats - self.mean) / self.scale, -4, 4)])
        i = np.concatenate([at, np.arange(self.n_hash, self.n_hash + N_STATS)])
        v = self.factors[i]
        z = self.bias + self.linear[i] @ x + 0.5 * (((x @ v) ** 2).sum() - ((x * x) @ (v * v)).sum())
        return float(1 / (1 + math.exp(-min(35.0, max(-35.0, z)))))


def _feature_rows(n_hash: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _Featurizer(n_hash)
        for batch in batches:
            got = [f(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g[0].astype(np.int32) for g in got], pa.list_(pa.int32())),
                    pa.array([g[1].astype(np.float32) for g in got], pa.list_(pa.float32())),
                    pa.array([g[2] for g in got], pa.list_(pa.float64())),
                    batch["y"],
                ],
                ["i", "x", "stats", "y"],
            )

    return rows


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    keep: Column,
    label: str = "quality",
    key: str = "doc_id",
    text: str = "text",
    max_docs_per_class: int = 2500,
    n_hash: int = 1 << 13,
    rank: int = 8,
    epochs: int = 30,
    rate: float = 0.01,
    decay: float = 2e-4,
    seed: int = 7,
) -> QualityModel:
    """Fit on at most ``max_docs_per_class`` labelled documents of each class among those
    that ``keep`` (a condition on ``labels``) admits, by Adam steps on mini-batches. The
    driver holds at most 2 * max_docs_per_class * n_hash features."""
    bound_batches(docs.sparkSession)
    sample, sizes = labelled_sample(docs, labels, label, keep, max_docs_per_class, key, text)
    width = n_hash + N_STATS
    n = sizes[0] + sizes[1]
    got = sample.mapInArrow(_feature_rows(n_hash), "i array<int>, x array<float>, stats array<double>, y int")
    data = got.toPandas() if sizes[0] and sizes[1] else None
    if data is None or data["y"].nunique() < 2:
        share = sizes[1] / n if n else 0.0
        bias = math.log((share + 1e-9) / (1 - share + 1e-9))
        return QualityModel(n_hash, bias, np.zeros(width), np.zeros((width, rank)), np.zeros(N_STATS), np.ones(N_STATS))

    for column in ("i", "x", "stats"):  # lists without Arrow transfer
        data[column] = [np.asarray(v) for v in data[column]]
    # the same order in every run, wherever the rows came from
    data["_"] = [s.tobytes() + x.tobytes() for s, x in zip(data["stats"], data["x"], strict=True)]
    data = data.sort_values(["_", "y"]).reset_index(drop=True)
    stats = np.vstack(data["stats"])
    mean, scale = stats.mean(0), stats.std(0) + 1e-6
    z = np.clip((stats - mean) / scale, -4, 4)
    y = data["y"].to_numpy(float)
    weight = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())
    weight /= weight.mean()
    tail = np.arange(n_hash, width)
    rows = [(np.concatenate([i.astype(np.int64), tail]), np.concatenate([x, s])) for i, x, s in zip(data["i"], data["x"], z, strict=True)]

    rng = np.random.default_rng(seed)
    w, v = np.zeros(width), rng.normal(0, 0.01, (width, rank))
    b = math.log(sizes[1] / sizes[0])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v)]
    bias_moments, t, size = [0.0, 0.0], 0, 64
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), size):
            part = order[lo : lo + size]
            gw, gv, gb = np.zeros_like(w), np.zeros_like(v), 0.0
            for r in part:
                i, x = rows[r]
                vi = v[i]
                s = x @ vi
                out = b + w[i] @ x + 0.5 * ((s**2).sum() - ((x * x) @ (vi * vi)).sum())
                g = weight[r] * (1 / (1 + math.exp(-min(35.0, max(-35.0, out)))) - y[r]) / len(part)
                gb += g
                gw[i] += g * x
                gv[i] += g * (x[:, None] * s - vi * (x * x)[:, None])
            t += 1
            for p, grad, m in ((w, gw + decay * w, moments[0]), (v, gv + decay * v, moments[1])):
                m[0] = 0.9 * m[0] + 0.1 * grad
                m[1] = 0.999 * m[1] + 0.001 * grad * grad
                p -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
            bias_moments = [0.9 * bias_moments[0] + 0.1 * gb, 0.999 * bias_moments[1] + 0.001 * gb * gb]
            b -= rate * (bias_moments[0] / (1 - 0.9**t)) / (math.sqrt(bias_moments[1] / (1 - 0.999**t)) + 1e-8)
    return QualityModel(n_hash, float(b), w, v, mean, scale)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``quality_score``: double from 0 to 1, higher for good text."""
    bound_batches(docs.sparkSession)
    rows = docs.drop("quality_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n_hash * (rank + 1) numbers

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        f = _Featurizer(m.n_hash)
        for batch in batches:
            s = [m.score(at, x, np.array(stats)) for at, x, stats in map(f, (t or "" for t in batch[text].to_pylist()))]
            yield batch.append_column("quality_score", pa.array(s, pa.float64()))

    return rows.mapInArrow(scored, T.StructType([*rows.schema, T.StructField("quality_score", T.DoubleType())]))
