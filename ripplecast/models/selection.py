"""Feature scores and the vote over them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplecast.models.classifiers import DEEPEST
from ripplecast.models.features import LABEL
from ripplecast.models.forests import BINS, cut_points, random_forest
from ripplecast.models.trees import ExtraTrees, Settings
from ripplecast.operators.ordering import top_k

SEED = 7
# How many features each selector keeps, and the discards that drop a feature.
KEEP_CATEGORICAL = 10
KEEP_NUMERIC = 3
NUMERIC_SELECTORS = 4
DISCARDS_TO_DROP = 3


def _long(wide: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, feature, value) rows from one column per feature; ``wide`` is an aggregate."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns]
    )
    return wide.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.*")


def chi2_scores(df: DataFrame, columns: Sequence[str], label: str = LABEL) -> DataFrame:
    """Chi-square of each non-negative feature's sums per class against the class shares."""
    sums = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).cast("double").alias(c) for c in columns]
    )
    cells = _long(sums, columns, [label, "_n"])
    totals = cells.groupBy("feature").agg(
        F.collect_list(F.struct("_n", "value")).alias("classes"),  # one entry per class
        F.sum("_n").alias("rows"),
        F.sum("value").alias("total"),
    )
    per_class = totals.select(
        "feature", "rows", "total", F.explode("classes").alias("cell")
    ).select("feature", "cell.value", (F.col("total") * F.col("cell._n") / F.col("rows")).alias("e"))
    return per_class.groupBy("feature").agg(
        F.sum(F.try_divide((F.col("value") - F.col("e")) ** 2, F.col("e"))).alias("score")
    )


def anova_scores(df: DataFrame, columns: Sequence[str], label: str = LABEL) -> DataFrame:
    """One-way F statistic of each feature over the classes, from counts, means and deviations."""
    measures = []
    for c in columns:
        value = F.col(c).cast("double")
        measures.append(
            F.struct(F.avg(value).alias("mean"), F.var_pop(value).alias("var")).alias(c)
        )
    groups = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *measures)
    cells = _long(groups, columns, ["n"]).select(
        "feature", "n", F.col("value.mean").alias("mean"), F.col("value.var").alias("var")
    )
    summed = cells.groupBy("feature").agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("classes"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
        F.collect_list(F.struct("n", "mean")).alias("means"),  # one entry per class
    )
    between = F.aggregate(
        "means",
        F.lit(0.0),
        lambda acc, m: acc + m["n"] * (m["mean"] - F.col("grand")) ** 2,
    )
    return summed.select(
        "feature",
        F.try_divide(
            between / (F.col("classes") - 1),
            F.col("within") / (F.col("rows") - F.col("classes")),
        ).alias("score"),
    )


def chi2_top10(df: DataFrame, columns: Sequence[str], k: int = KEEP_CATEGORICAL) -> DataFrame:
    return top_k(chi2_scores(df, columns), k)


def anova_top3(df: DataFrame, columns: Sequence[str], k: int = KEEP_NUMERIC) -> DataFrame:
    return top_k(anova_scores(df, columns), k)


def _score_table(df: DataFrame, scores: dict[str, float]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(name, float(score)) for name, score in scores.items()], "feature string, score double"
    )


def _matrix(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    doubles = df.select(F.col(label).cast("double").alias("label"),
                        *[F.col(c).cast("double").alias(c) for c in columns])
    assembled = VectorAssembler(inputCols=list(columns), outputCol="features").transform(doubles)
    return assembled.select("label", "features")


def _importances(matrix: DataFrame, cuts: list[list[float]], trees: int, depth: int) -> list[float]:
    return random_forest(trees, depth, SEED, "label", cuts).fit(matrix).importances(len(cuts))


def tree_importance_top3(
    df: DataFrame, columns: Sequence[str], label: str = LABEL, trees: int = 50, depth: int | None = None
) -> DataFrame:
    """The features that remove most impurity in a forest of drawn splits."""
    model = ExtraTrees(Settings(trees=trees, depth=depth, seed=SEED), "label").fit(_matrix(df, columns, label))
    return top_k(_score_table(df, dict(zip(columns, model.importances(len(columns))))), KEEP_NUMERIC)


@dataclass(frozen=True)
class Moments:
    """Row count, means, and centred cross products of the columns and the target (the last one)."""

    n: int
    mean: np.ndarray
    cross: np.ndarray

    def without(self, other: Moments) -> Moments:
        """The moments of the rows that are not in the other ones, which are part of these."""
        n = self.n - other.n
        mean = (self.n * self.mean - other.n * other.mean) / max(n, 1)
        a, b = self.mean - mean, other.mean - mean
        cross = self.cross + self.n * np.outer(a, a) - other.cross - other.n * np.outer(b, b)
        return Moments(n, mean, cross)

    def error(self, weights: np.ndarray, other: Moments) -> float:
        """Mean squared error on these rows of weights fitted, with an intercept, to the others."""
        signed = np.append(-weights, 1.0)
        shift = signed @ (self.mean - other.mean)
        return float(signed @ self.cross @ signed / max(self.n, 1) + shift * shift)


def moments_by_fold(df: DataFrame, columns: Sequence[str], label: str, fold: Column, folds: int) -> list[Moments]:
    """One grouped aggregate: (width + 1) squared numbers for every fold."""
    names = [*columns, label]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    value = [F.col(c).cast("double") for c in names]
    rows = df.groupBy(fold.alias("_fold")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.array(*[F.avg(v) for v in value]).alias("_mean"),
        F.array(*[F.covar_pop(value[i], value[j]) for i, j in pairs]).alias("_cross"),
    ).collect()  # one row per fold
    found = []
    for row in rows:
        cross = np.zeros((len(names), len(names)))
        for (i, j), shared in zip(pairs, row["_cross"]):
            cross[i, j] = cross[j, i] = shared * row["_n"]
        found.append(Moments(row["_n"], np.array(row["_mean"]), cross))
    return found


def whole(parts: Sequence[Moments]) -> Moments:
    n = sum(p.n for p in parts)
    mean = sum(p.n * p.mean for p in parts) / n
    cross = sum(p.cross + p.n * np.outer(p.mean - mean, p.mean - mean) for p in parts)
    return Moments(n, mean, cross)


def lasso_path(
    moments: Moments, penalties: Sequence[float], tolerance: float = 1e-12, most: int = 10_000
) -> list[np.ndarray]:
    """Weights that minimise half the mean squared error plus penalty times absolute weights.

    Coordinate descent on the cross products, each penalty from the last one's weights.
    """
    gram, target = moments.cross[:-1, :-1] / moments.n, moments.cross[:-1, -1] / moments.n
    weights, found = np.zeros(len(target)), []
    for penalty in penalties:
        for _ in range(most):
            before = weights.copy()
            for j in np.flatnonzero(np.diag(gram) > 0):
                rest = target[j] - gram[j] @ weights + gram[j, j] * weights[j]
                weights[j] = np.sign(rest) * max(abs(rest) - penalty, 0.0) / gram[j, j]
            if np.abs(weights - before).max(initial=0) <= tolerance * max(1.0, np.abs(weights).max(initial=0)):
                break
        found.append(weights.copy())
    return found


def lasso_weights(
    df: DataFrame, columns: Sequence[str], label: str = LABEL, steps: int = 100, folds: int = 5, key: str = "tweet_id"
) -> dict[str, float]:
    """Lasso weights under the penalty with the least error over the folds, from one scan.

    The penalties fall geometrically from the smallest one that leaves no weight to a thousandth
    of it. A row's fold is a hash of its key, or of its values where the table has no key.
    """
    fold = F.pmod(F.xxhash64(F.col(key)) if key in df.columns else F.xxhash64(*columns, label), F.lit(folds))
    parts = moments_by_fold(df, columns, label, fold, folds)
    if not parts:
        return dict.fromkeys(columns, 0.0)
    every = whole(parts)
    top = float(np.abs(every.cross[:-1, -1]).max() / every.n) or 1.0
    penalties = [top * 1e-3 ** (i / max(steps - 1, 1)) for i in range(steps)]
    errors = np.zeros(steps)
    for part in parts:
        rest = every.without(part)
        if rest.n:
            errors += [part.error(w, rest) for w in lasso_path(rest, penalties)]
    weights = lasso_path(every, penalties[: int(errors.argmin()) + 1])[-1]
    return dict(zip(columns, weights.tolist()))


def lasso_top3(
    df: DataFrame, columns: Sequence[str], label: str = LABEL, steps: int = 100, folds: int = 5
) -> DataFrame:
    """The features with the largest absolute weights of a lasso with a cross-validated penalty."""
    found = lasso_weights(df, columns, label, steps, folds)
    return top_k(_score_table(df, {c: abs(w) for c, w in found.items()}), KEEP_NUMERIC)


def rfe_top3(
    df: DataFrame, columns: Sequence[str], label: str = LABEL, trees: int = 100, depth: int = DEEPEST
) -> DataFrame:
    """Drop the least important feature of a refitted forest until three remain.

    A feature's cut points follow from its values alone, so they are found once for all fits.
    """
    left, matrix = list(columns), _matrix(df, columns, label)
    cuts = cut_points(matrix.select(vector_to_array("features").alias("x")), len(left), BINS)
    scores = _importances(matrix, cuts, trees, depth)
    while len(left) > KEEP_NUMERIC:
        worst = scores.index(min(scores))
        left.pop(worst)
        cuts.pop(worst)
        scores = _importances(_matrix(df, left, label), cuts, trees, depth)
    return top_k(_score_table(df, dict(zip(left, scores))), KEEP_NUMERIC)


def votes(selectors: dict[str, DataFrame], columns: Sequence[str], spark) -> DataFrame:
    """(feature, selector, keep) rows from the features each selector kept."""
    features = spark.createDataFrame([(c,) for c in columns], "feature string")
    rows = None
    for name, kept in selectors.items():
        marked = features.join(
            kept.select("feature", F.lit(True).alias("keep")), "feature", "left"
        ).select("feature", F.lit(name).alias("selector"), F.coalesce("keep", F.lit(False)).alias("keep"))
        rows = marked if rows is None else rows.unionByName(marked)
    return rows


def feature_vote(cast: DataFrame, discards_to_drop: int = DISCARDS_TO_DROP) -> DataFrame:
    """(feature, discards, keep): a feature goes when that many selectors discard it."""
    return cast.groupBy("feature").agg(
        F.count_if(~F.col("keep")).alias("discards"),
    ).withColumn("keep", F.col("discards") < discards_to_drop)
