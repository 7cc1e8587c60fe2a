"""Queries for feature building, selection, balancing and models.

Model queries fit on all years but the last and score the last, with the library's settings and on
the columns that its selection keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplecast import adapters as ad
from ripplecast.models import balance, classifiers, evaluate, features, selection, stages
from ripplecast.operators import filters as fl
from ripplecast.operators import stats
from ripplecast.operators.ordering import top_k
from ripplecast.plans import predict
from ripplecast.session import cut_lineage, scratch_path, stored

LABEL = features.LABEL
NUMERIC = features.NUMERIC
# the columns of assemble_features, as its SQL lists them
MODEL_COLUMNS = [*NUMERIC, "hashtags_True", "verified_True", "sentiment_Neutral",
                 "sentiment_Positive"]


def kept_rows(spark: SparkSession, d: str) -> DataFrame:
    return predict.model_rows(fl.outlier_filter(ad.proc(spark, d)))


#: What the models are prepared from; texts and counts they do not use stay behind.
_NEEDED = ["tweet_id", "year", "topics_ids", "retweet_count", *NUMERIC, *features.ONE_HOT]


def prepared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Train and test rows from one stored copy, as between stages of a real run."""
    needed = list(dict.fromkeys(_NEEDED))
    held = stored(kept_rows(spark, d).select(*needed), "kept")
    return predict.prepare(*features.split_by_last_year(held))


_selections: dict[tuple[str, str], tuple[DataFrame, DataFrame, list[str]]] = {}


def selected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Train and test matrices of the kept columns, and these; stored once for a session's tables."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _selections:
        train, test, coded = prepared(spark, d)
        kept = predict.select_features(train, coded)
        tables = (stored(features.assemble_features(df, kept), "matrix") for df in (train, test))
        _selections[at] = (*tables, kept)
    return _selections[at]


def matrices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return selected(spark, d)[:2]


def standardize(spark, d):
    train, test, _ = prepared(spark, d)
    both = train.unionByName(test)
    return both.select("tweet_id", *[F.round(c, 6).alias(c) for c in NUMERIC])


def chi2_top10(spark, d):
    train, _, coded = prepared(spark, d)
    return selection.chi2_top10(train, coded).withColumn("score", F.round("score", 6))


def anova_top3(spark, d):
    train, _, _ = prepared(spark, d)
    return selection.anova_top3(train, NUMERIC).withColumn("score", F.round("score", 6))


def tree_importance_top3(spark, d):
    return selection.tree_importance_top3(prepared(spark, d)[0], NUMERIC)


def lasso_top3(spark, d):
    return selection.lasso_top3(prepared(spark, d)[0], NUMERIC)


def rfe_top3(spark, d):
    return selection.rfe_top3(prepared(spark, d)[0], NUMERIC)


def feature_vote(spark, d):
    """Votes of four selectors with closed forms: F, spread, mean and largest value."""
    rows = kept_rows(spark, d)
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in NUMERIC]
    )
    long = rows.select(F.explode(cells).alias("cell")).select("cell.*").groupBy("feature")
    scores = {
        "spread": long.agg(F.stddev_pop("v").alias("score")),
        "mean": long.agg(F.avg("v").alias("score")),
        "largest": long.agg(F.max("v").alias("score")),
    }
    kept = {name: top_k(score, 3) for name, score in scores.items()}
    kept["ANOVA"] = selection.anova_top3(rows, NUMERIC)
    cast = selection.votes(kept, NUMERIC, spark)
    return selection.feature_vote(cast, discards_to_drop=2)


def selector_vote(spark, d):
    """The vote of the four selectors, of which two have no closed form and hence no SQL."""
    return selection.feature_vote(predict.numeric_votes(prepared(spark, d)[0]))


def assemble_features(spark, d):
    train, test, _ = prepared(spark, d)
    both = features.assemble_features(train.unionByName(test), MODEL_COLUMNS)
    values = {c: F.round(features.feature_value(i), 6) for i, c in enumerate(MODEL_COLUMNS)}
    return both.select("tweet_id", LABEL, *[v.alias(c) for c, v in values.items()])


def smote(spark, d):
    train, _, kept = selected(spark, d)
    made = balance.smote(train)
    values = [F.round(features.feature_value(i), 6).alias(c) for i, c in enumerate(kept)]
    return made.select(LABEL, *values)


def _scored(make):
    def query(spark, d):
        train, test = matrices(spark, d)
        model = make(train).fit(train)
        return model.transform(test).select("tweet_id", LABEL, F.col("prediction").cast("int"))

    return query


def kfold_assign(spark, d):
    rows = kept_rows(spark, d).select("tweet_id", "timestamp")
    return evaluate.kfold_assign(rows, ["timestamp", "tweet_id"]).select("tweet_id", "fold")


def _folded(spark, d) -> DataFrame:
    return evaluate.kfold_assign(matrices(spark, d)[0], ["tweet_id"])


def compare_models(spark, d):
    """Mean and deviation of every model's fold scores, and their box statistics."""
    folded = _folded(spark, d)
    scores = evaluate.compare_models(folded, classifiers.base_models(folded.count()))
    boxes = stats.boxplot_stats(scores, ["score"], by=["model"]).drop("variable")
    return evaluate.comparison_summary(scores).join(boxes, "model")


def grid_search(spark, d):
    """The score of every combination of the grid."""
    return evaluate.grid_scores(_folded(spark, d))


def train_evaluate(spark, d):
    train, test = matrices(spark, d)
    scored, _ = evaluate.train_evaluate(evaluate.tuned_model(), train, test, scratch_path(spark, "model"))
    return evaluate.classification_report(scored)


def classification_report(spark, d):
    """The report on a fixed rule's predictions."""
    rows = kept_rows(spark, d)
    guess = F.when((F.col("followers") % 3 == 0) & (F.col("like_count") > 200), 0).otherwise(1)
    report = evaluate.classification_report(rows.withColumn("prediction", guess))
    return report.withColumns({m: F.round(m, 9) for m in ("precision", "recall", "f1")})


def _saved(spark, d, models: dict) -> tuple[dict[str, str], DataFrame]:
    """Where each model was saved with its preparation, and the posts of the last year."""
    posts = cut_lineage(fl.outlier_filter(ad.proc(spark, d)))
    train, test = features.split_by_last_year(posts)
    fitted, kept = predict.fit_preparation(train), selected(spark, d)[2]
    rows, scored, _ = predict.prepare(train, test, fitted)
    matrices = [cut_lineage(features.assemble_features(df, kept)) for df in (rows, scored)]
    paths, before = {}, stages.preparation(*fitted, kept)
    for name, model in models.items():
        paths[name] = scratch_path(spark, "model")
        evaluate.train_evaluate(model, *matrices, paths[name], before=before)
    return paths, test


def save_model(spark, d):
    """Predictions for posts of the closed-form, the boosted and the usual model, each saved and loaded."""
    models = {"LDA": classifiers.LinearDiscriminant(), "AB": classifiers.AdaBoost(), "ET": evaluate.tuned_model()}
    paths, posts = _saved(spark, d, models)
    made = None
    for name, path in paths.items():
        scored = evaluate.batch_predict(path, posts).select(
            "tweet_id", F.lit(name).alias("model"), F.col("prediction").cast("int")
        )
        made = scored if made is None else made.unionByName(scored)
    return made


def batch_predict(spark, d):
    """Posts of the last year, scored by a model of the years before that was saved with its preparation."""
    paths, posts = _saved(spark, d, {"RFC": classifiers.forest()})
    return evaluate.batch_predict(paths["RFC"], posts).select("tweet_id", F.col("prediction").cast("int"))


QUERIES = {
    "standardize": standardize,
    "chi2_top10": chi2_top10,
    "anova_top3": anova_top3,
    "tree_importance_top3": tree_importance_top3,
    "lasso_top3": lasso_top3,
    "rfe_top3": rfe_top3,
    "feature_vote": feature_vote,
    "selector_vote": selector_vote,
    "assemble_features": assemble_features,
    "smote": smote,
    "model_lr": _scored(lambda train: classifiers.logistic(train.count())),
    "model_lda": _scored(lambda train: classifiers.LinearDiscriminant()),
    "model_cart": _scored(lambda train: classifiers.cart()),
    "model_nb": _scored(lambda train: classifiers.gaussian_bayes()),
    "model_adaboost": _scored(lambda train: classifiers.AdaBoost()),
    "model_gbm": _scored(lambda train: classifiers.boosted_trees()),
    "model_rf": _scored(lambda train: classifiers.forest()),
    "model_extra_trees": _scored(lambda train: classifiers.extra_trees()),
    "kfold_assign": kfold_assign,
    "compare_models": compare_models,
    "grid_search": grid_search,
    "train_evaluate": train_evaluate,
    "classification_report": classification_report,
    "save_model": save_model,
    "batch_predict": batch_predict,
}
