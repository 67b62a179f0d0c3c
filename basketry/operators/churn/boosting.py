"""Gradient-boosted trees with exact splits: every distinct value of a feature is a candidate.

Log-loss boosting: the margin starts at the weighted log odds; in each round a regression
tree of ``depth`` levels is grown on the residuals ``y - p`` of a seeded part of the rows,
leaves get Newton values ``sum(w r) / sum(w p (1 - p))`` times the step, and margins grow by
the leaf values. A split's gain is the weighted reduction of the squared residual,
``wl wr / (wl + wr) * (mean_l - mean_r)^2``; its threshold lies halfway between the two
neighbouring distinct values. Of equal gains the first feature's and then the smallest
threshold wins.

Work of a level is one aggregation: rows are put in long form (node, feature, value), summed
by it (on the map side first, so a value that a third of the rows have is one row for each
task), and the sums run over the sorted values with ``functions.position.running_sums``,
which never holds a whole feature in one task. What comes back to the driver is one split for
each open node: ``2 ** level`` rows. The number of features is fixed by the caller.

A part of the rows (``subsample``) is drawn by a hash of the key, the seed and the round,
without replacement; all rows get their margins updated. The margins of a round are a written
table in the workspace; that of the round before is removed, so rounds don't pile up and a
lost executor redoes one round at most. Rows with a missing feature are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.position import log_bucket, materialize, running_sums
from ...functions.workspace import Workspace, working_in

_UNIT = 1 << 20


@dataclass
class Node:
    value: float = 0.0  # of a leaf, the step included
    feature: str | None = None
    threshold: float = 0.0
    gain: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def expression(self) -> Column:
        if self.feature is None:
            return F.lit(self.value)
        low = F.col(self.feature).cast("double") <= F.lit(self.threshold)
        return F.when(low, self.left.expression()).otherwise(self.right.expression())

    def splits(self) -> list[Node]:
        return [] if self.feature is None else [self, *self.left.splits(), *self.right.splits()]


@dataclass
class BoostedTrees:
    features: tuple[str, ...]
    start: float
    trees: list[Node] = field(default_factory=list)

    def margin(self, rows: DataFrame, name: str = "margin", at_a_time: int = 20) -> DataFrame:
        """``rows`` with the margin; trees are added up a few at a time, so that expressions stay small."""
        out = rows.withColumn(name, F.lit(self.start))
        for lo in range(0, len(self.trees), at_a_time):
            total = F.col(name)
            for tree in self.trees[lo : lo + at_a_time]:
                total = total + tree.expression()
            out = out.withColumn(name, total)
        return out

    def score(self, rows: DataFrame, name: str = "score") -> DataFrame:
        """``rows`` with the probability of label 1; rows with a missing feature are left out."""
        known = rows.dropna(subset=list(self.features))
        return self.margin(known, "_margin").withColumn(name, _sigmoid(F.col("_margin"))).drop("_margin")

    def importances(self) -> dict[str, float]:
        """Mean over the trees of each feature's share of a tree's gain, brought to sum 1."""
        total = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            splits = tree.splits()
            whole = sum(s.gain for s in splits)
            for s in splits:
                total[s.feature] += s.gain / whole if whole else 0.0
        all_ = sum(total.values())
        return {f: (x / all_ if all_ else 0.0) for f, x in total.items()}


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def drawn(key: Column, seed: int, round_: int, share: float) -> Column:
    """Whether a row takes part in a round."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(round_), key), F.lit(_UNIT)) < F.lit(int(round(share * _UNIT)))


def best_splits(rows: DataFrame, features: Sequence[str], min_gain: float = 1e-12) -> DataFrame:
    """(node, feature, threshold, gain): the best split of each node that has one.

    ``rows`` has node, the features, ``_w`` and ``_wr`` (weight, weight times residual)."""
    values = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)])
    long = rows.select("node", "_w", "_wr", F.explode(values).alias("x")).select("node", "x.feature", "x.value", "_w", "_wr")
    sums = long.groupBy("node", "feature", "value").agg(F.sum("_w").alias("w"), F.sum("_wr").alias("wr"))
    sums = materialize(sums)  # read by the bucket totals, the rows and the next values
    below = running_sums(
        sums, ["value"], {"w_le": F.col("w"), "wr_le": F.col("wr")}, partition_by=["node", "feature"], bucket=log_bucket(F.col("value"))
    )
    totals = sums.filter("feature = 0").groupBy("node").agg(F.sum("w").alias("all_w"), F.sum("wr").alias("all_wr"))
    last = sums.groupBy("node", "feature").agg(F.max("value").alias("last"))
    small = last.join(totals, "node")  # a row for each open node and feature
    cut = below.join(F.broadcast(small), ["node", "feature"]).filter("value < last")
    left, right = F.col("w_le"), F.col("all_w") - F.col("w_le")
    apart = F.col("wr_le") / left - (F.col("all_wr") - F.col("wr_le")) / right
    gain = left * right / (left + right) * apart * apart
    able = cut.filter((left > 0) & (right > 0)).withColumn("gain", gain).filter(F.col("gain") > min_gain)
    # gains that differ by rounding alone are equal: the order of sums isn't fixed
    order = F.struct(-F.round("gain", 9), "feature", "value")
    best = able.groupBy("node").agg(F.min_by(F.struct("feature", "value", "gain"), order).alias("s")).select("node", "s.*")
    # the threshold lies halfway to the next distinct value
    above = sums.select("node", "feature", F.col("value").alias("next")).join(F.broadcast(best), ["node", "feature"])
    nexts = above.filter(F.col("next") > F.col("value")).groupBy("node", "feature", "value", "gain").agg(F.min("next").alias("next"))
    return nexts.select("node", "feature", ((F.col("value") + F.col("next")) / 2).alias("threshold"), "gain")


def fit_boosted_trees(
    rows: DataFrame,
    features: Sequence[str],
    work: Workspace,
    key: str,
    label: str = "label",
    weight: str | None = None,
    rounds: int = 200,
    depth: int = 4,
    step: float = 0.05,
    subsample: float = 0.8,
    seed: int = 42,
) -> BoostedTrees:
    """Trees fitted on ``rows`` (label 0 or 1). With one class only there is no tree."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = rows.dropna(subset=[*features, label]).select(
        key, *features, F.col(label).cast("double").alias("_y"), w.alias("_w0")
    )
    held = work.table(known, "boosting-rows")
    sums = held.agg(F.sum("_w0").alias("w"), F.sum(F.col("_w0") * F.col("_y")).alias("wy")).first()
    if not sums["w"] or not 0 < sums["wy"] < sums["w"]:
        return BoostedTrees(tuple(features), math.inf if sums["wy"] else -math.inf)
    out = BoostedTrees(tuple(features), math.log(sums["wy"] / (sums["w"] - sums["wy"])))
    current = work.table(held.withColumn("margin", F.lit(out.start)), "margins-0")
    for round_ in range(rounds):
        with Workspace(work.spark) as scratch, working_in(scratch):
            tree = _grow(current, features, key, depth, step, subsample, seed, round_)
        out.trees.append(tree)
        if round_ + 1 < rounds:
            before = current
            current = work.table(current.withColumn("margin", F.col("margin") + tree.expression()), f"margins-{round_ + 1}")
            for path in before.inputFiles()[:1]:
                work.remove(path.rsplit("/", 1)[0])
    return out


def _grow(current: DataFrame, features: Sequence[str], key: str, depth: int, step: float, subsample: float, seed: int, round_: int) -> Node:
    p = _sigmoid(F.col("margin"))
    residual = F.col("_y") - p
    part = current if subsample >= 1 else current.filter(drawn(F.col(key), seed, round_, subsample))
    part = part.select(
        *features, F.col("_w0").alias("_w"), (F.col("_w0") * residual).alias("_wr"), (F.col("_w0") * p * (F.lit(1.0) - p)).alias("_wh")
    )
    root = Node()
    open_ = {1: root}
    for _ in range(depth):
        placed = part.withColumn("node", _place(root, open_)).filter("node is not null")
        found = {r["node"]: r for r in best_splits(placed, features).collect()}  # a row for each open node
        following: dict[int, Node] = {}
        for number, node in open_.items():
            r = found.get(number)
            if r is None:
                continue
            node.feature, node.threshold, node.gain = features[r["feature"]], r["threshold"], r["gain"]
            node.left, node.right = Node(), Node()
            following |= {2 * number: node.left, 2 * number + 1: node.right}
        open_ = following
        if not open_:
            break
    leaves = _leaves(root)
    placed = part.withColumn("node", _place(root, leaves))
    for r in placed.groupBy("node").agg(F.sum("_wr").alias("wr"), F.sum("_wh").alias("wh")).collect():  # 2 ** depth rows
        if r["node"] in leaves and r["wh"]:
            leaves[r["node"]].value = step * r["wr"] / r["wh"]
    return root


def _leaves(root: Node, number: int = 1) -> dict[int, Node]:
    if root.feature is None:
        return {number: root}
    return _leaves(root.left, 2 * number) | _leaves(root.right, 2 * number + 1)


def _place(root: Node, wanted: dict[int, Node]) -> Column:
    """The number of the wanted node that a row falls into; NULL outside them."""

    def at(node: Node, number: int) -> Column:
        if number in wanted:
            return F.lit(number)
        if node.feature is None:
            return F.lit(None).cast("int")
        low = F.col(node.feature).cast("double") <= F.lit(node.threshold)
        return F.when(low, at(node.left, 2 * number)).otherwise(at(node.right, 2 * number + 1))

    return at(root, 1)
