"""From processed years to a saved and evaluated popularity model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecast.functions.text import popularity
from ripplecast.models import evaluate, features, selection, stages
from ripplecast.models.balance import smote
from ripplecast.models.classifiers import base_models
from ripplecast.operators.filters import known_topic


@dataclass
class Outcome:
    kept: list[str]
    comparison: DataFrame
    best_base_model: str
    accuracy: float
    report: DataFrame
    scored: DataFrame


def model_rows(df: DataFrame) -> DataFrame:
    """Rows with a known topic and a fresh label."""
    return known_topic(df).withColumn(features.LABEL, popularity(F.col("retweet_count")))


def fit_preparation(train: DataFrame) -> tuple[dict[str, list], dict[str, tuple[float, float]]]:
    """Vocabulary and scaling of the training rows."""
    rows = model_rows(train)
    return features.vocabularies(rows, features.ONE_HOT), features.scaling(rows)


def prepare(
    train: DataFrame, test: DataFrame, fitted: tuple[dict, dict] | None = None
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Encoded and scaled train and test rows, and the names of the 0/1 columns.

    Vocabulary and scaling are fitted on the training rows and used for both.
    """
    found, scale = fitted or fit_preparation(train)
    train, test = model_rows(train), model_rows(test)
    made = [features.standardize(features.one_hot(df, found), scale) for df in (train, test)]
    coded = features.encoded_columns(made[0])
    return *(features.clean_nulls(df, coded) for df in made), coded


def numeric_votes(train: DataFrame, lasso_steps: int = 100) -> DataFrame:
    """(feature, selector, keep) of the numeric columns for the four selectors."""
    numeric = features.NUMERIC
    return selection.votes(
        {
            "ANOVA": selection.anova_top3(train, numeric),
            "Trees": selection.tree_importance_top3(train, numeric),
            "Lasso Regression": selection.lasso_top3(train, numeric, steps=lasso_steps),
            "RFE": selection.rfe_top3(train, numeric),
        },
        numeric,
        train.sparkSession,
    )


def select_features(train: DataFrame, coded: list[str], lasso_steps: int = 100) -> list[str]:
    """Categorical columns chi-square keeps and numeric ones enough selectors keep."""
    categorical = [row["feature"] for row in selection.chi2_top10(train, coded).collect()]
    kept = selection.feature_vote(numeric_votes(train, lasso_steps)).where("keep").collect()
    return categorical + sorted(row["feature"] for row in kept)


def train_test_model(
    train: DataFrame,
    test: DataFrame,
    model_path: str,
    search: bool = False,
    balance_inside_fold: bool = False,
    models: dict[str, Callable[[], object]] | None = None,
    grid: dict[str, list] = evaluate.GRID,
    folds: int = evaluate.FOLDS,
    lasso_steps: int = 100,
    final=None,
) -> Outcome:
    """Select features, balance, compare base models, tune, fit, save and evaluate.

    By default rows are oversampled before the folds are drawn; ``balance_inside_fold`` keeps
    synthetic rows out of the rows a model is scored on.
    """
    label = features.LABEL
    fitted = fit_preparation(train)
    train, test, coded = prepare(train, test, fitted)
    train = train.persist()
    kept = select_features(train, coded, lasso_steps)
    matrix = features.assemble_features(train, kept).persist()
    folded = evaluate.kfold_assign(matrix, ["tweet_id"], folds)
    balanced = smote(matrix, key="tweet_id").persist()
    if not balance_inside_fold:
        # real rows first, synthetic ones in the last folds, as when rows are appended
        folded = evaluate.kfold_assign(balanced, ["synthetic", "tweet_id"], folds)
    models = models or base_models(matrix.count())
    rebalance = smote if balance_inside_fold else None
    comparison = evaluate.compare_models(folded, models, rebalance=rebalance)
    best = evaluate.grid_search(folded, grid) if search else None
    model = final or evaluate.tuned_model(best)
    scored, accuracy = evaluate.train_evaluate(
        model, balanced, features.assemble_features(test, kept), model_path,
        before=stages.preparation(*fitted, kept),
    )
    for held in (train, matrix, balanced):
        held.unpersist()
    return Outcome(
        kept, comparison, evaluate.best_model(comparison), accuracy,
        evaluate.classification_report(scored), scored,
    )
