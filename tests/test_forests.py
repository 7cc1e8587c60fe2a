"""Forests of best splits against a plain recursive version, and what they keep on the driver."""

import inspect

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ripplecast.models import classifiers, forests, selection, trees
from ripplecast.models.trees import NODE, Settings


def table(spark, x, y):
    rows = [(i, [float(v) for v in a], int(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "tweet_id long, x array<double>, popularity int")
    return df.select("tweet_id", "popularity", array_to_vector("x").alias("features"))


@pytest.fixture(scope="module")
def sample():
    draw = np.random.default_rng(5)
    x = np.round(draw.normal(size=(300, 5)), 1)
    x[:, 3] = x[:, 3] > 0
    x[:, 4] = 7  # a constant
    y = ((x[:, 0] + x[:, 3] + draw.normal(size=300) / 2) > 0.5).astype(int)
    x[250:], y[250:] = x[:50], y[:50]  # equal rows
    return x, y


def plain_tree(codes, w, ones, tree, settings):
    """One node at a time, before leaves are joined; {path: (n, share, feature, code)}."""
    found = {}

    def impurity(at):
        n, k = w[at].sum(), ones[at].sum()
        return 2 * k * (1 - k / n)

    def visit(at, path):
        n, k = w[at].sum(), ones[at].sum()
        found[path] = (n, k / n, -1, 0)
        if n < settings.per_node or not 0 < k < n or len(path) >= settings.deepest():
            return
        key = trees.node_key(settings.seed, tree, path)
        least = (np.inf, -1, 0)
        for f in forests.competing(key, codes.shape[1], settings.competing(codes.shape[1]))[0]:
            for c in np.unique(codes[at, f])[:-1]:
                goes = codes[at, f] <= c
                cost = impurity(at[goes]) + impurity(at[~goes])
                if cost < least[0] - 1e-9:
                    least = (cost, f, c)
        if impurity(at) - least[0] > 1e-9:
            _, f, c = least
            found[path] = (n, k / n, f, c)
            goes = codes[at, f] <= c
            visit(at[goes], path + "0")
            visit(at[~goes], path + "1")

    visit(np.flatnonzero(w > 0), "")
    joined = sorted(found, key=len, reverse=True)
    for path in joined:
        if found[path][2] >= 0:
            kids = [found[path + side] for side in "01"]
            if all(k[2] < 0 for k in kids) and len({k[1] > 0.5 for k in kids}) == 1:
                found[path] = (*found[path][:2], -1, 0)
                del found[path + "0"], found[path + "1"]
    return found


def walk(nodes):
    found, waiting = {}, [(0, "")]
    while waiting:
        at, path = waiting.pop()
        node = nodes[at]
        found[path] = (node["n"], node["share"], node["feature"], node["cut"])
        if node["feature"] >= 0:
            waiting += [(node["left"], path + "0"), (node["left"] + 1, path + "1")]
    return found


@pytest.mark.parametrize("bootstrap,per_split,depth", [(True, 2, 30), (False, 1 << 30, 30), (True, 1, 3)])
def test_one_task_grows_the_plain_tree(bootstrap, per_split, depth):
    draw = np.random.default_rng(1)
    codes = draw.integers(0, 12, size=(200, 4)).astype(np.int8)
    codes[:, 3] = 0
    n0, n1 = draw.integers(0, 3, size=200), draw.integers(0, 4, size=200)
    ids = draw.integers(0, 1 << 62, size=200)
    settings = Settings(3, depth, per_split, 1, 2, bootstrap, 7, 1000)
    made = forests.finish(codes, n0, n1, ids, [(t, "") for t in range(3)], settings)
    for tree, nodes in enumerate(made):
        mine, plain = walk(nodes), plain_tree(codes, *forests.weights(settings, tree, ids, n0, n1), tree, settings)
        assert mine.keys() == plain.keys()
        for path in plain:
            assert mine[path] == pytest.approx(plain[path])


def test_large_nodes_split_on_grouped_counts_alike(spark, sample):
    df = table(spark, *sample)
    made = []
    for group_rows in (1000, 40):
        settings = Settings(4, 30, 2, 1, 2, True, 7, group_rows)
        model = forests.Forest(settings).fit(df)
        rows = model.transform(df).select("tweet_id", "prediction").collect()
        votes = model.votes(df, "v").select("tweet_id", F.round(F.col("v")[0], 9)).collect()
        made.append((sorted(rows), sorted(votes)))
    assert model.tops.count() > 4
    assert made[0] == made[1]


def test_equal_tables_dealt_otherwise_give_equal_forests(spark, sample):
    df = table(spark, *sample)
    model = lambda rows: forests.random_forest(5, 30, 7).fit(rows).subtrees.orderBy("tree").collect()
    assert model(df.repartition(1)) == model(df.repartition(7, "tweet_id"))


def test_repeated_rows_weigh_as_often(spark):
    """A row that stands there a hundred times is drawn about a hundred times, not 0, 100 or 200."""
    ids = np.arange(500)
    settings = Settings(1, 30, 2, 1, 2, True, 7, 1000)
    w, ones = forests.weights(settings, 0, ids, np.full(500, 100), np.zeros(500, dtype=np.int64))
    assert abs(w.mean() - 100) < 2 and abs(w.var() - 100) < 25 and not ones.any()
    few, _ = forests.weights(settings, 1, np.arange(20_000), np.ones(20_000, dtype=np.int64), np.zeros(20_000, dtype=np.int64))
    assert abs(few.mean() - 1) < 0.03 and abs((few == 0).mean() - np.exp(-1)) < 0.02


def test_cuts_lie_at_all_borders_or_at_equal_shares(spark):
    assert forests.cuts_of([(0.0, 0.0, 90), (1.0, 1.0, 1)], 32) == [0.5]
    assert forests.cuts_of([(3.0, 3.0, 5)], 32) == []
    runs = [(float(i), float(i), 1) for i in range(1000)]
    cuts = forests.cuts_of(runs, 32)
    assert len(cuts) == 31 and max(np.diff(cuts)) <= 33
    rows = spark.range(5000).select(F.array(F.col("id").cast("double"), F.lit(2.0), (F.col("id") % 3).cast("double")).alias("x"))
    found = forests.cut_points(rows, 3, 32)
    assert len(found[0]) == 31 and max(np.diff(found[0])) < 170 and found[1:] == [[], [0.5, 1.5]]


def test_forest_learns_as_sparks_own(spark, sample):
    from pyspark.ml.classification import RandomForestClassifier

    df = table(spark, *sample)
    theirs = RandomForestClassifier(labelCol="popularity", numTrees=60, maxDepth=30, seed=7).fit(df)
    mine = classifiers.forest(60).fit(df)
    assert np.allclose(mine.importances(5), theirs.featureImportances.toArray(), atol=0.06)
    hits = [m.transform(df).where("prediction = popularity").count() for m in (mine, theirs)]
    assert abs(hits[0] - hits[1]) < 12


def test_single_tree_is_sparks_own(spark, sample):
    """The same columns twice: equal cuts go to the first."""
    from pyspark.ml.classification import DecisionTreeClassifier

    x, y = sample
    df = table(spark, np.hstack([x, x]), y)
    theirs, mine = DecisionTreeClassifier(labelCol="popularity", maxDepth=30).fit(df), classifiers.cart().fit(df)
    assert np.allclose(mine.importances(10), theirs.featureImportances.toArray())
    rows = [sorted(m.transform(df).select("tweet_id", "prediction").collect()) for m in (mine, theirs)]
    assert rows[0] == rows[1]


def test_every_feature_is_drawn_as_often():
    keys = np.random.default_rng(2).integers(0, 1 << 63, size=20_000).astype(np.uint64)
    drawn = forests.competing(keys, 5, 2)
    assert (drawn[:, 0] != drawn[:, 1]).all()
    assert np.allclose(np.bincount(drawn.ravel(), minlength=5) / 20_000, 0.4, atol=0.02)


def test_forests_and_trees_stay_off_the_driver(spark, sample):
    """The fitted forest is a table; a forest of Spark ML would keep every node on the driver."""
    df = table(spark, *sample)
    for maker in (lambda: classifiers.forest(5), classifiers.cart):
        model = maker().fit(df)
        assert isinstance(model, trees.ForestModel)
        assert all(len(row["nodes"]) % NODE.itemsize == 0 for row in model.subtrees.collect())
    assert "random_forest" in inspect.getsource(selection._importances)


def test_rows_of_equal_codes_are_one_cell(spark):
    """Forests grow from at most as many cells as there are combinations of codes."""
    rows = spark.range(20_000).select(
        (F.col("id") % 2).cast("double").alias("y"),
        F.array((F.col("id") % 5000).cast("double"), (F.col("id") % 3).cast("double")).alias("x"),
    )
    cells = forests.cells_of(rows, forests.cut_points(rows, 2, 32))
    assert cells.count() == 96
    assert cells.agg(F.sum("n0"), F.sum("n1")).first()[:] == (10_000, 10_000)


def test_no_rows_and_one_label(spark):
    df = table(spark, [[1.0], [2.0]], [1, 1])
    assert [r["prediction"] for r in classifiers.forest(3).fit(df).transform(df).collect()] == [1.0, 1.0]
    assert forests.random_forest(3, 30, 7).fit(df.limit(0)).importances(1) == [0.0]


def test_runs_of_values_stay_off_the_driver(spark, monkeypatch):
    rows = spark.range(3000).select(F.array(F.col("id") * 1.0, F.col("id") % 7 * 1.0, F.lit(2.0)).alias("x"))
    kind, brought = type(rows), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: brought.append(collect(df)) or brought[-1])
    found = forests.cut_points(rows, 3, 32)
    assert sum(map(len, brought)) <= 3
    assert len(found[0]) == 31 and found[1:] == [[0.5, 1.5, 2.5, 3.5, 4.5, 5.5], []]


def test_elimination_finds_cut_points_once(spark, sample, monkeypatch):
    x, y = sample
    names = ["a", "b", "c", "d"]
    rows = [(*map(float, v), int(b)) for v, b in zip(x[:, :4], y)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", popularity int")
    calls, cut_points = [], forests.cut_points
    for place in (forests, selection):
        monkeypatch.setattr(place, "cut_points", lambda *a: calls.append(a) or cut_points(*a), raising=False)
    got = dict(map(tuple, selection.rfe_top3(df, names, trees=5, depth=4).collect()))
    assert len(calls) == 1
    monkeypatch.undo()
    left = [n for n in names if n in got]
    matrix = selection._matrix(df, left, "popularity")
    fresh = forests.random_forest(5, 4, selection.SEED, "label").fit(matrix).importances(3)
    assert got == pytest.approx(dict(zip(left, fresh)))


def test_levels_store_no_cells_for_a_tree(spark, sample, monkeypatch):
    """Cells are stored in blocks and without a tree, however many levels are split on counts."""
    stored, cut = [], forests.cut_lineage
    monkeypatch.setattr(forests, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    tops, _ = forests.grow(table(spark, *sample), Settings(4, 30, 2, 1, 2, True, 7, 40))
    assert tops.count() > 4
    assert [c for c in stored if "tree" in c] == [["tree", "path", "nodes"]] and len(stored) <= 2
