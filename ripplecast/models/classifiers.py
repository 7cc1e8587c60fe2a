"""The models compared: Spark ML estimators and three written over DataFrames.

A fitted model is anything with ``transform`` that adds ``prediction`` to rows with ``features``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, NaiveBayes
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplecast.models.features import LABEL
from ripplecast.models.forests import Forest, random_forest, single_tree
from ripplecast.models.stages import JsonModel
from ripplecast.models.trees import ExtraTrees, Settings
from ripplecast.operators.ordering import bucket_of

SEED = 7
DEEPEST = 30  # as in Spark ML


def _dot(values: Column, weights: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for i, weight in enumerate(weights):
        total = total + values[i] * F.lit(float(weight))
    return total


class Discriminant(JsonModel):
    """Linear scores per class; the largest wins, the lower class on ties."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x, state = vector_to_array("features"), self.state
        scores = [
            F.struct((_dot(x, row) + F.lit(offset)).alias("score"), F.lit(-label).alias("low"))
            for label, row, offset in zip(state["classes"], state["weights"], state["offsets"])
        ]
        return dataset.withColumn("prediction", -F.array_max(F.array(*scores))["low"])


class LinearDiscriminant:
    """Class means and pooled covariance in one grouped aggregate, solved on the driver (d x d)."""

    def __init__(self, label: str = LABEL):
        self.label = label

    def fit(self, df: DataFrame) -> Discriminant:
        width = len(df.select("features").first()[0])
        x = vector_to_array("features")
        values = df.select(F.col(self.label), *[x[i].alias(f"x{i}") for i in range(width)])
        pairs = [(i, j) for i in range(width) for j in range(i, width)]
        rows = values.groupBy(self.label).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(f"x{i}").alias(f"m{i}") for i in range(width)],
            *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs],
        ).collect()  # one row per class
        rows.sort(key=lambda row: row[self.label])
        counts = np.array([row["n"] for row in rows], dtype=float)
        means = np.array([[row[f"m{i}"] for i in range(width)] for row in rows])
        pooled = np.zeros((width, width))
        for row, count in zip(rows, counts):
            for i, j in pairs:
                pooled[i, j] += row[f"c{i}_{j}"] * count
        pooled = (np.triu(pooled) + np.triu(pooled, 1).T) / counts.sum()
        weights = means @ np.linalg.pinv(pooled)
        offsets = np.log(counts / counts.sum()) - 0.5 * np.sum(weights * means, axis=1)
        classes = [float(row[self.label]) for row in rows]
        return Discriminant(classes=classes, weights=weights.tolist(), offsets=offsets.tolist())


class BoostedStumps(JsonModel):
    """Weighted votes of ``stumps``: (feature, cut, vote up to the cut, vote above it, weight)."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        x, votes = vector_to_array("features"), F.lit(0.0)
        for feature, cut, below, above, weight in self.state["stumps"]:
            side = F.when(x[feature] <= cut, F.lit(below)).otherwise(F.lit(above))
            votes = votes + F.lit(weight) * side
        return dataset.withColumn("prediction", (votes > 0).cast("double"))


def _coded_blocks(kind: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (y, codes) in blocks: one byte a label, codes feature by feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = batch.column(0).to_numpy(zero_copy_only=False) == 1
                codes = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                lines = np.ascontiguousarray(codes.T.astype(kind))
                yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()) for part in (y, lines)], ["y", "codes"])

    return run


def _weights_by_code(
    votes: list[tuple], scale: float, width: int, codes: int, kind: type
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(feature, code, y, w): a task's sums of what rows weigh after these stumps."""
    votes = list(votes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width, 2, codes))
        for batch in batches:
            for labels, coded in zip(batch.column(0), batch.column(1)):
                y = np.frombuffer(labels.as_buffer(), bool)
                lines = np.frombuffer(coded.as_buffer(), kind).reshape(width, -1)
                penalty = np.zeros(len(y))
                for feature, place, below, above, vote in votes:
                    missed = (np.where(lines[feature] <= place, below, above) > 0) != y
                    penalty += np.where(missed, vote, 0.0)
                weight = np.exp(penalty - scale)
                for label, own in enumerate((~y, y)):
                    held = weight[own]
                    for feature, line in enumerate(lines):
                        sums[feature, label] += np.bincount(line[own], held, codes)
        feature, label, code = np.nonzero(sums)
        parts = [pa.array(part, pa.int32()) for part in (feature, code, label)]
        yield pa.RecordBatch.from_arrays([*parts, pa.array(sums[feature, label, code])], ["feature", "code", "y", "w"])

    return run


class AdaBoost:
    """Reweighted stumps for 0/1 labels; rows missed by a stump weigh more for the next.

    Values are coded by their place among at most ``cuts`` quantiles of their feature, once, and kept
    in blocks. The weight of a row follows from the stumps so far, so in every round each task sums
    weights by code, and these few sums give the best stump (Gini) and its error.
    """

    def __init__(self, rounds: int = 50, label: str = LABEL, cuts: int = 32):
        self.rounds, self.label, self.cuts = rounds, label, cuts

    def fit(self, df: DataFrame) -> BoostedStumps:
        values = df.select(F.col(self.label).cast("int").alias("y"), vector_to_array("features").alias("x"))
        width = values.agg(F.max(F.size("x"))).first()[0] or 0
        flat = values.select(*[F.col("x")[i].alias(f"x{i}") for i in range(width)])
        shares = [i / self.cuts for i in range(self.cuts + 1)]
        names = [f"x{i}" for i in range(width)]
        found = flat.approxQuantile(names, shares, 0.1 / self.cuts) if width else []
        edges = [sorted(set(one))[:-1] for one in found]  # nothing lies above the greatest value
        codes = F.array(*[bucket_of(F.col("x")[i], one) for i, one in enumerate(edges)])
        kind = np.int8 if self.cuts < 128 else np.int32
        blocks = values.select("y", codes.alias("codes")).mapInArrow(_coded_blocks(kind), "y binary, codes binary").persist()
        stumps, votes, scale = [], [], 0.0
        try:
            for _ in range(self.rounds if width else 0):
                sums = (
                    blocks.mapInArrow(_weights_by_code(votes, scale, width, self.cuts + 1, kind), "feature int, code int, y int, w double")
                    .groupBy("feature", "code", "y")
                    .agg(F.sum("w").alias("w"))
                    .collect()  # features x (cuts + 1) x 2 rows
                )
                stump = _best_stump(sums, edges)
                if stump is None:
                    break
                feature, place, below, above, error, mass = stump
                if error >= 0.5 and stumps:
                    break
                vote = math.log((1 - error) / max(error, 1e-10)) if error < 1 else 0.0
                stumps.append([feature, edges[feature][place], below, above, vote])
                if error <= 0 or error >= 0.5:
                    break
                votes.append((feature, place, below, above, vote))
                scale += math.log(mass)
        finally:
            blocks.unpersist()
        if not stumps:  # no feature varies: the commoner class
            ones = values.agg(F.avg("y")).first()[0] or 0.0
            vote = 1.0 if ones > 0.5 else -1.0
            stumps = [[0, 0.0, vote, vote, 1.0]] if width else []
        return BoostedStumps(stumps=stumps)


def _best_stump(sums: list, edges: list[list[float]]) -> tuple | None:
    """(feature, place of the cut, vote below, vote above, error share, weight sum) of the purest sides."""
    best = None
    for feature, cuts in enumerate(edges):
        weight = np.zeros((len(cuts) + 1, 2))
        for row in sums:
            if row["feature"] == feature:
                weight[row["code"], int(row["y"] == 1)] += row["w"]
        total, left = weight.sum(axis=0), np.cumsum(weight, axis=0)[:-1]
        right = total - left
        for place, sides in enumerate(zip(left, right)):
            impurity = sum(2 * s[0] * s[1] / s.sum() for s in sides if s.sum() > 0)
            if best is None or impurity < best[0] - 1e-12 * total.sum():
                votes = [1.0 if s[1] > s[0] else -1.0 for s in sides]
                best = (impurity, feature, place, *votes, sum(min(s) for s in sides) / total.sum(), total.sum())
    return best and best[1:]


def logistic(rows: int, label: str = LABEL) -> LogisticRegression:
    """Ridge penalty of one over the row count on the mean loss."""
    return LogisticRegression(
        labelCol=label, regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False
    )


def cart(depth: int = DEEPEST, label: str = LABEL) -> Forest:
    return single_tree(depth, SEED, label)


def gaussian_bayes(label: str = LABEL) -> NaiveBayes:
    return NaiveBayes(labelCol=label, modelType="gaussian")


def boosted_trees(rounds: int = 100, label: str = LABEL) -> GBTClassifier:
    return GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=3, stepSize=0.1, seed=SEED)


def forest(trees: int = 100, depth: int = DEEPEST, label: str = LABEL) -> Forest:
    """Deep trees that are grown and kept by the executors, not by the driver."""
    return random_forest(trees, depth, SEED, label)


def extra_trees(
    trees: int = 100,
    depth: int | None = None,
    per_split: int | str = "sqrt",
    per_leaf: int = 1,
    per_node: int = 2,
    bootstrap: bool = False,
    label: str = LABEL,
) -> ExtraTrees:
    """Trees with drawn split points, on the whole sample unless told otherwise."""
    settings = Settings(trees, depth, per_split, per_leaf, per_node, bootstrap, SEED)
    return ExtraTrees(settings, label)


def base_models(
    rows: int, depth: int = DEEPEST, trees: int = 100, rounds: int = 50, boosts: int = 100
) -> dict[str, Callable[[], object]]:
    """The compared models by name, each made anew for every fit."""
    return {
        "LR": lambda: logistic(rows),
        "LDA": LinearDiscriminant,
        "CART": lambda: cart(depth),
        "NB": gaussian_bayes,
        "AB": lambda: AdaBoost(rounds),
        "GBM": lambda: boosted_trees(boosts),
        "RFC": lambda: forest(trees, depth),
        "ET": lambda: extra_trees(trees, None if depth >= DEEPEST else depth),
    }
