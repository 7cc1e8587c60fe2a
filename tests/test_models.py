"""Encodings, selection, oversampling, models and evaluation."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ripplecast.models import balance, classifiers, evaluate, features, selection, stages
from ripplecast.plans import predict


def matrix(spark, points, labels):
    rows = [(i, int(y), [float(v) for v in x]) for i, (x, y) in enumerate(zip(points, labels))]
    df = spark.createDataFrame(rows, "tweet_id long, popularity int, x array<double>")
    return df.select("tweet_id", "popularity", array_to_vector("x").alias("features"))


@pytest.fixture(scope="module")
def separable(spark):
    random = np.random.default_rng(3)
    labels = np.arange(240) % 2
    points = random.normal(size=(240, 3)) + labels[:, None] * [4.0, 0.0, -4.0]
    return matrix(spark, points, labels).persist()


def test_one_hot_drops_the_first_and_counts_null_as_a_value(spark):
    df = spark.createDataFrame([("b", True), ("a", False), (None, True)], "c string, f boolean")
    found = features.vocabularies(df, ["c", "f"])
    assert found == {"c": ["a", "b", None], "f": [False, True]}
    rows = features.one_hot(df, found)
    assert rows.columns == ["c", "f", "c_b", "c_None", "f_True"]
    assert [r["c_None"] for r in rows.orderBy("c").collect()] == [1, 0, 0]


def test_vocabulary_must_be_small(spark):
    df = spark.range(30).select(F.col("id").alias("c"))
    with pytest.raises(ValueError):
        features.vocabularies(df, ["c"], limit=10)


def test_encoded_columns_follow_their_prefix(spark):
    names = ["topics", "topics_ids", "topics_cleaned", "topics_cleaned_News", "month_enc",
             "month_May", "year_2020", "verified_True"]
    df = spark.range(1).select(*[F.lit(0).alias(n) for n in names])
    assert features.encoded_columns(df) == ["topics_cleaned_News", "verified_True", "month_May"]


def test_chi2_and_anova_against_numpy(spark):
    random = np.random.default_rng(5)
    y = random.integers(0, 2, 200)
    x = (random.random((200, 2)) < 0.3 + 0.2 * y[:, None]).astype(int)
    rows = [(int(a), int(b), int(c)) for (a, b), c in zip(x, y)]
    df = spark.createDataFrame(rows, "a int, b int, popularity int")
    chi = {r["feature"]: r["score"] for r in selection.chi2_scores(df, ["a", "b"]).collect()}
    f = {r["feature"]: r["score"] for r in selection.anova_scores(df, ["a", "b"]).collect()}
    for i, name in enumerate("ab"):
        observed = np.array([x[y == k, i].sum() for k in (0, 1)])
        expected = x[:, i].sum() * np.array([(y == k).mean() for k in (0, 1)])
        assert chi[name] == pytest.approx(((observed - expected) ** 2 / expected).sum())
        groups = [x[y == k, i] for k in (0, 1)]
        between = sum(len(g) * (g.mean() - x[:, i].mean()) ** 2 for g in groups)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups)
        assert f[name] == pytest.approx(between / (within / 198))


def test_forests_of_the_selectors_grow_to_the_end(spark):
    """The label is the parity of three columns' bits; a split pays only below five others."""
    fields = [(i, *[i >> k & 1 for k in range(8)]) for i in range(256)]
    rows = [(*bits, sum(bits[:7]) % 2) for _, *bits in fields]
    names = [f"b{k}" for k in range(8)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in [*names, "popularity"]))
    grown = selection.tree_importance_top3(df, names, trees=3).collect()
    cut = selection.tree_importance_top3(df, names, trees=3, depth=5).collect()
    assert grown != cut
    wide = selection.rfe_top3(df, names[:4], trees=3).collect()
    assert wide == selection.rfe_top3(df, names[:4], trees=3, depth=classifiers.DEEPEST).collect()


def test_vote_counts_discards(spark):
    rows = [("a", s, s < "C") for s in "ABCD"] + [("b", s, s < "B") for s in "ABCD"]
    cast = spark.createDataFrame(rows, "feature string, selector string, keep boolean")
    got = {r["feature"]: (r["discards"], r["keep"]) for r in selection.feature_vote(cast).collect()}
    assert got == {"a": (2, True), "b": (3, False)}


def test_vote_equals_sql_and_names_the_selectors(spark):
    import duckdb

    from ripplecast.catalogue import learning

    rows = [(f, s, (i * 5 + k * 3) % 7 < 3) for i, f in enumerate("abcdefgh") for k, s in enumerate("ABCD")]
    got = selection.feature_vote(spark.createDataFrame(rows, "feature string, selector string, keep boolean"))
    listed = ", ".join(f"('{f}', '{s}', {k})" for f, s, k in rows)
    want = duckdb.sql(f"""SELECT feature, count(*) FILTER (NOT keep), count(*) FILTER (NOT keep) < 3
      FROM (VALUES {listed}) AS cast_(feature, selector, keep) GROUP BY feature""").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len({w[2] for w in want}) == 2
    assert "selector_vote" in learning.QUERIES
    random = np.random.default_rng(1)
    y = np.arange(60) % 2
    rows = [(int(l), *map(float, random.normal(size=4) + l * np.array([3, 2, 1, 0]))) for l in y]
    train = spark.createDataFrame(rows, "popularity int, " + ", ".join(f"{c} double" for c in features.NUMERIC))
    votes = predict.numeric_votes(train, lasso_steps=3).collect()
    assert {v["selector"] for v in votes} == {"ANOVA", "Trees", "Lasso Regression", "RFE"}
    assert len(votes) == 16 and sum(v["keep"] for v in votes) == 12


@pytest.mark.parametrize("leaf", [8, 10_000])
def test_nearest_points_are_exact(spark, leaf):
    random = np.random.default_rng(9)
    points = np.round(random.normal(size=(300, 3)), 3)
    points[:150, 1:] = 0  # half of the points on a line
    points = np.unique(points, axis=0)
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "pid long, x array<double>")
    got = {r["pid"]: r["neighbours"] for r in balance.nearest_points(df, 5, leaf).collect()}
    distances = np.linalg.norm(points[:, None] - points[None], axis=2)
    np.fill_diagonal(distances, np.inf)
    for pid, neighbours in got.items():
        assert len(set(neighbours)) == 5
        assert distances[pid, neighbours] == pytest.approx(np.sort(distances[pid])[:5])
    assert len(got) == len(points)


def test_points_of_mixed_columns_visit_few_cells(spark):
    """Four measured columns and ten 0/1 ones: no cell is over-full and no point wanders."""
    random = np.random.default_rng(12)
    points = np.c_[random.normal(size=(4000, 4)), random.random((4000, 10)) < random.random(10)]
    points = np.unique(np.round(points, 4), axis=0)
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "pid long, x array<double>")
    placed, nodes = balance.cells(df, 14, 128)
    sizes = {r["node"]: r["count"] for r in placed.groupBy("node").count().collect()}
    assert max(sizes.values()) <= 128 and sum(sizes.values()) == len(points)
    assert {r["node"]: r["n"] for r in nodes.where("leaf").collect()} == sizes
    home = balance._at_home(placed, nodes, 5)
    assert home.where("reach = double('infinity')").count() == 0
    seen = balance.visits(home, nodes).count()
    assert seen < 0.75 * len(points) * len(sizes)


def test_few_points_and_none(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [5.0])], "pid long, x array<double>")
    got = {r["pid"]: r["neighbours"] for r in balance.nearest_points(df, 5, 2).collect()}
    assert got == {0: [1, 2], 1: [0, 2], 2: [1, 0]}
    assert balance.nearest_points(df.limit(0), 5).count() == 0


def test_smote_balances_between_minority_rows(spark):
    random = np.random.default_rng(2)
    few = random.normal(size=(12, 2))
    few[:7] = few[0]  # copies hold more than half of the minority
    many = random.normal(size=(80, 2)) + 50
    df = matrix(spark, np.r_[few, many], [0] * 12 + [1] * 80)
    made = balance.smote(df).select("popularity", vector_to_array("features").alias("x")).collect()
    counts = {k: sum(r["popularity"] == k for r in made) for k in (0, 1)}
    assert counts == {0: 80, 1: 80}
    low, high = few.min(axis=0) - 1e-9, few.max(axis=0) + 1e-9
    for row in made:
        if row["popularity"] == 0:
            assert (low <= row["x"]).all() and (row["x"] <= high).all()
    again = balance.smote(df).select("popularity", vector_to_array("features").alias("x")).collect()
    assert sorted(made, key=str) == sorted(again, key=str)


def test_folds_of_seven_rows(spark):
    df = spark.range(7).select((F.lit(6) - F.col("id")).alias("o"))
    rows = evaluate.kfold_assign(df, ["o"]).orderBy("o").collect()
    assert [r["fold"] for r in rows] == [0, 0, 1, 1, 2, 3, 4]


@pytest.mark.parametrize("name", ["LR", "LDA", "CART", "NB", "AB", "GBM", "RFC", "ET"])
def test_models_learn_separable_rows(separable, name):
    model = classifiers.base_models(240, depth=4, trees=5, rounds=4, boosts=4)[name]()
    assert evaluate.accuracy(model.fit(separable).transform(separable)) > 0.95


def test_discriminant_is_the_closed_form(spark, separable):
    rows = separable.orderBy("tweet_id").collect()
    x = np.array([r["features"].toArray() for r in rows])
    y = np.array([r["popularity"] for r in rows])
    fitted = np.array(classifiers.LinearDiscriminant().fit(separable).state["weights"])
    within = sum((x[y == k] - x[y == k].mean(0)).T @ (x[y == k] - x[y == k].mean(0)) for k in (0, 1))
    weights = np.linalg.solve(within / len(x), (x[y == 1].mean(0) - x[y == 0].mean(0)))
    assert fitted[1] - fitted[0] == pytest.approx(weights)


def test_comparison_and_saved_model(spark, separable, tmp_path):
    folded = evaluate.kfold_assign(separable, ["tweet_id"], 3)
    models = {
        "NB": classifiers.gaussian_bayes,
        "CART": lambda: classifiers.cart(1),
    }
    scores = evaluate.compare_models(folded, models)
    assert scores.count() == 6 and evaluate.best_model(scores) in models
    path = str(tmp_path / "model")
    scored, accuracy = evaluate.train_evaluate(classifiers.forest(3, 3), separable, separable, path)
    again = evaluate.batch_predict(path, separable)
    assert scored.select("prediction").collect() == again.select("prediction").collect()
    assert accuracy > 0.95


def test_grid_scores_equal_forests_grown_for_each_combination(spark):
    random = np.random.default_rng(6)
    points = random.normal(size=(150, 4))
    folded = evaluate.kfold_assign(matrix(spark, points, points[:, 0] + random.normal(size=150) > 0), ["tweet_id"], 3)
    grid = {"bootstrap": [True], "depth": [None, 40, 3], "per_split": [2], "per_leaf": [2], "per_node": [4, 9], "trees": [2, 5]}
    rows = evaluate.grid_scores(folded, grid).collect()
    assert len(rows) == 12
    for row in rows:
        how = {name: row[name] for name in grid}
        model = evaluate.ExtraTrees(evaluate.Settings(**how))
        want = [
            evaluate.accuracy(model.fit(folded.where(f"fold <> {k}")).transform(folded.where(f"fold = {k}")))
            for k in range(3)
        ]
        assert row["score"] == pytest.approx(sum(want) / 3), how
    best = evaluate.grid_search(folded, grid)
    assert best["accuracy"] == max(r["score"] for r in rows)
    assert evaluate.tuned_model(best).settings.per_node == best["per_node"]
    with pytest.raises(ValueError, match="numTres"):
        evaluate.grid_search(folded, {"numTres": [3]})
    sizes = [len(v) for v in evaluate.GRID.values()]
    assert np.prod(sizes) == 216


def test_boosting_is_the_plain_algorithm(spark):
    """Stumps at the values themselves: with few distinct values the quantiles are all of them."""
    random = np.random.default_rng(8)
    x = random.integers(0, 6, (200, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3) | (random.random(200) < 0.1)).astype(int)
    got = classifiers.AdaBoost(12).fit(matrix(spark, x, y)).state["stumps"]
    weight = np.ones(200)
    for feature, cut, below, above, vote in got:
        best = None
        for f in range(3):
            for c in sorted(set(x[:, f]))[:-1]:
                sides = [(weight * (y == k))[s].sum() for s in (x[:, f] <= c, x[:, f] > c) for k in (0, 1)]
                impurity = sum(2 * a * b / (a + b) for a, b in (sides[:2], sides[2:]))
                if best is None or impurity < best[0] - 1e-9 * weight.sum():
                    best = (impurity, f, c, *(1.0 if b > a else -1.0 for a, b in (sides[:2], sides[2:])))
        assert (feature, cut, below, above) == best[1:]
        missed = (np.where(x[:, feature] <= cut, below, above) > 0) != (y == 1)
        error = weight[missed].sum() / weight.sum()
        assert vote == pytest.approx(np.log((1 - error) / error))
        weight = weight * np.exp(vote * missed)
    assert len(got) == 12
    alike = matrix(spark, np.ones((9, 2)), [0] * 3 + [1] * 6)
    assert evaluate.accuracy(classifiers.AdaBoost(3).fit(alike).transform(alike)) == pytest.approx(6 / 9)


#: Loads a model in a session of its own and scores the posts.
_ELSEWHERE = """
import sys
from pyspark.sql import SparkSession
from ripplecast.models import evaluate
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
posts = spark.read.parquet(sys.argv[1])
for name in sys.argv[3:]:
    evaluate.batch_predict(f"{sys.argv[2]}/{name}", posts).write.parquet(f"{sys.argv[2]}/{name}-scored")
"""


def test_saved_models_score_posts_in_another_session(spark, tmp_path):
    import subprocess
    import sys

    posts = [(i, i % 7 - 1, ["a", "b", None][i // 3 % 3], i % 4, float(i * 37 % 101), float(i % 5), i % 2) for i in range(90)]
    df = spark.createDataFrame(posts, "tweet_id long, kind int, tone string, month int, followers double, seniority double, popularity int")
    df.where("tweet_id % 3 > 0").write.parquet(str(tmp_path / "posts"))
    train = df.where("tweet_id % 3 = 0")
    vocabulary = features.vocabularies(train, ["kind", "tone", "month"])
    scale = features.scaling(train, ["followers", "seniority"])
    made = features.standardize(features.one_hot(train, vocabulary), scale)
    kept = ["kind_3", "tone_None", "month_2", "followers"]
    rows = features.assemble_features(features.clean_nulls(made, kept), kept)
    before = stages.preparation(vocabulary, scale, kept)
    models = {"LDA": classifiers.LinearDiscriminant(), "AB": classifiers.AdaBoost(5), "ET": classifiers.extra_trees(7),
              "NB": classifiers.gaussian_bayes()}
    fresh = spark.read.parquet(str(tmp_path / "posts"))
    want = {}
    for name, model in models.items():
        evaluate.train_evaluate(model, rows, rows, str(tmp_path / name), before=before)
        vectors = features.assemble_features(features.standardize(features.one_hot(fresh, vocabulary), scale).fillna(0, kept), kept)
        scored = evaluate.load_model(str(tmp_path / name)).stages[-1].transform(vectors)
        want[name] = sorted((r["tweet_id"], r["prediction"]) for r in scored.collect())
    command = [sys.executable, "-c", _ELSEWHERE, str(tmp_path / "posts"), str(tmp_path), *models]
    subprocess.run(command, check=True, timeout=240, capture_output=True, cwd=Path(__file__).parent.parent)
    for name in models:
        scored = spark.read.parquet(str(tmp_path / f"{name}-scored"))
        assert scored.columns == [*df.columns, "prediction"]
        assert sorted((r["tweet_id"], r["prediction"]) for r in scored.collect()) == want[name], name
        assert len({p for _, p in want[name]}) == 2


def test_report(spark):
    rows = [(1, 1.0)] * 6 + [(1, 0.0)] * 2 + [(0, 0.0)] * 1 + [(0, 1.0)] * 1
    df = spark.createDataFrame(rows, "popularity int, prediction double")
    got = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert got["1"]["precision"] == pytest.approx(6 / 7) and got["1"]["recall"] == 0.75
    assert got["0"]["precision"] == pytest.approx(1 / 3) and got["0"]["support"] == 2
    assert got["accuracy"]["f1"] == pytest.approx(0.7)
    assert got["macro avg"]["recall"] == pytest.approx((0.75 + 0.5) / 2)
    assert got["weighted avg"]["recall"] == pytest.approx(0.7)


def test_report_of_a_class_never_guessed(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0)], "popularity int, prediction double")
    got = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert got["0"]["precision"] == got["0"]["f1"] == 0


@pytest.mark.parametrize("inside", [False, True])
def test_whole_prediction_run(spark, tmp_path, inside):
    random = np.random.default_rng(4)
    rows = []
    for i in range(300):
        label = 0 if i % 4 == 0 else 1
        rows.append(
            (i, 2019 + (i // 4) % 2, int(label * (1 + i % 3)), int(random.integers(10, 99) + 60 * label),
             int(random.integers(1, 50)), int(random.integers(1, 50)), int(random.integers(1, 9)),
             i % 5 - 1, ["News", "Book"][i % 2], ["Neutral", "Positive"][label], bool(i % 3),
             bool(label), "Morning", ["Monday", "Friday"][i % 2], "May")
        )
    df = spark.createDataFrame(
        rows,
        "tweet_id long, year int, retweet_count long, followers long, following long, "
        "tweet_count long, seniority int, topics_ids int, topics_cleaned string, "
        "sentiment string, hashtags boolean, verified boolean, day_phase string, "
        "day_of_week string, month string",
    )
    train, test = features.split_by_last_year(df)
    outcome = predict.train_test_model(
        train, test, str(tmp_path / "m"), balance_inside_fold=inside, folds=2, lasso_steps=3,
        models={"NB": classifiers.gaussian_bayes, "LDA": classifiers.LinearDiscriminant},
        final=classifiers.forest(5, 4),
    )
    assert outcome.accuracy > 0.9 and "followers" in outcome.kept
    assert outcome.comparison.count() == 4 and outcome.report.count() == 5


def test_registered_queries_use_library_settings_and_kept_columns(spark, monkeypatch):
    from ripplecast.catalogue import learning

    class Anything:
        def __getattr__(self, name):
            return lambda *args, **named: self

    calls = {}

    def recorded(name, found):
        return lambda *args, **named: calls.update({name: (args, named)}) or found

    df = spark.createDataFrame([(1, 1, 2.0, 3.0)], "tweet_id long, popularity int, a double, b double")
    monkeypatch.setattr(learning, "prepared", lambda s, d: (df, df, ["a", "b"]))
    monkeypatch.setattr(predict, "select_features", lambda train, coded: ["b"])
    train, _ = learning.matrices(spark, "")
    assert [r["features"].toArray().tolist() for r in train.collect()] == [[3.0]]
    monkeypatch.setattr(learning, "matrices", lambda s, d: (Anything(), Anything()))
    monkeypatch.setattr(learning, "_folded", lambda s, d: Anything())
    makers = {"cart": "cart", "adaboost": "AdaBoost", "gbm": "boosted_trees", "rf": "forest", "extra_trees": "extra_trees"}
    for query, name in makers.items():
        monkeypatch.setattr(classifiers, name, recorded(name, Anything()))
        learning.QUERIES[f"model_{query}"](spark, "")
        assert calls[name] == ((), {}), name
    for name in ("tree_importance_top3", "lasso_top3", "rfe_top3"):
        monkeypatch.setattr(selection, name, recorded(name, None))
        learning.QUERIES[name](spark, "")
        assert calls[name][1] == {} and len(calls[name][0]) == 2, name
    monkeypatch.setattr(evaluate, "grid_scores", recorded("grid_scores", None))
    learning.grid_search(spark, "")
    assert calls["grid_scores"][1] == {} and len(calls["grid_scores"][0]) == 1


def test_boosting_sums_blocks_and_explodes_no_rows(spark, monkeypatch):
    """A round reads what was kept once, in blocks; its sums are those of all rows."""
    x = [[float(i % 7), float(i % 2), float(i * 37 % 101)] for i in range(400)]
    rows = [(v, int(v[2] > 60 or v[0] > 4)) for v in x]
    df = spark.createDataFrame(rows, "x array<double>, popularity int").select("popularity", array_to_vector("x").alias("features"))
    kept, persist = [], type(df).persist
    monkeypatch.setattr(type(df), "persist", lambda self: kept.append(self) or persist(self))
    model = classifiers.AdaBoost(2).fit(df)
    assert [k.columns for k in kept] == [["y", "codes"]] and kept[0].dtypes[1][1] == "binary"
    feature, cut, below, above, vote = model.state["stumps"][0]
    sides = [[y for v, y in rows if (v[feature] <= cut) == low] for low in (True, False)]
    assert [below, above] == [1.0 if 2 * sum(side) > len(side) else -1.0 for side in sides]
    missed = sum(min(sum(side), len(side) - sum(side)) for side in sides) / len(rows)
    assert vote == pytest.approx(math.log((1 - missed) / missed)) and len(model.state["stumps"]) == 2
