"""Trees with drawn splits against a plain recursive version; the lasso against a plain one."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from ripplecast.models import evaluate, selection, trees
from ripplecast.models.trees import ExtraTrees, ForestModel, Settings


def table(spark, x, y):
    rows = [(i, [float(v) for v in a], int(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "tweet_id long, x array<double>, popularity int")
    return df.select("tweet_id", "popularity", array_to_vector("x").alias("features"))


def plain_tree(x, y, rows, tree, settings):
    """One node at a time; returns {path: (n, share, feature, cut)}."""
    found = {}

    def visit(at, weight, path):
        n, total, ones = len(at), weight.sum(), (weight * y[at]).sum()
        found[path] = (n, ones / total, None, None)
        if n < settings.per_node or not 0 < ones < total or len(path) >= settings.deepest():
            return
        low, high = x[at].min(axis=0)[None], x[at].max(axis=0)[None]
        features, cuts = trees.competing(trees.node_key(settings.seed, tree, path), low, high, settings.competing(x.shape[1]))
        scored = []
        for place, (f, c) in enumerate(zip(features[0], cuts[0])):
            if f < 0:
                continue
            goes = x[at, f] <= c
            if min(goes.sum(), (~goes).sum()) < settings.per_leaf:
                continue
            cost = 0
            for side in (goes, ~goes):
                w, p = weight[side].sum(), (weight * y[at])[side].sum() / weight[side].sum()
                cost += w * 2 * p * (1 - p)
            scored.append((round(cost, 9), place, f, c, goes))
        if scored:
            _, _, f, c, goes = min(scored, key=lambda s: s[:2])
            found[path] = (n, ones / total, f, c)
            visit(at[goes], weight[goes], path + "0")
            visit(at[~goes], weight[~goes], path + "1")

    w = trees.weights(settings, tree, rows)
    visit(np.flatnonzero(w > 0), w[w > 0], "")
    return found


def walk(nodes, path=""):
    """The same table from an array of nodes."""
    found, waiting = {}, [(0, path)]
    while waiting:
        at, path = waiting.pop()
        node = nodes[at]
        split = node["feature"] >= 0
        found[path] = (node["n"], node["share"], *((node["feature"], node["cut"]) if split else (None, None)))
        if split:
            waiting += [(node["left"], path + "0"), (node["left"] + 1, path + "1")]
    return found


@pytest.fixture(scope="module")
def sample():
    draw = np.random.default_rng(11)
    x = np.round(draw.normal(size=(160, 5)), 2)
    x[:, 3] = x[:, 3] > 0  # a 0/1 column
    x[:, 4] = 7  # a constant
    y = ((x[:, 0] + x[:, 3] + draw.normal(size=160) / 2) > 0.5).astype(int)
    x[140:], y[140:] = x[:20], y[:20]  # equal rows
    order = np.lexsort((y, *x.T[::-1]))
    return x[order], y[order]


@pytest.mark.parametrize(
    "how",
    [{}, {"bootstrap": True, "per_leaf": 3, "per_node": 8, "per_split": 3}, {"per_split": 1, "depth": 4}],
)
@pytest.mark.parametrize("group_rows", [1000, 30])
def test_forest_equals_the_plain_one(spark, sample, how, group_rows):
    x, y = sample
    settings = Settings(trees=4, group_rows=group_rows, **how)
    tops, subtrees = trees.grow(table(spark, x, y), settings)
    found = {t: {} for t in range(4)}
    for r in tops.collect():
        found[r["tree"]][r["path"]] = (r["feature"], pytest.approx(r["cut"]))
    for r in subtrees.collect():
        for path, node in walk(np.frombuffer(bytes(r["nodes"]), trees.NODE), r["path"]).items():
            assert path not in found[r["tree"]]
            found[r["tree"]][path] = tuple(node[:2]) if node[2] is None else (node[2], pytest.approx(node[3]))
    assert (tops.count() > 0) == (group_rows < 160)
    for tree in range(4):
        want = plain_tree(x, y, np.arange(160), tree, settings)
        assert {p: (n, pytest.approx(s)) if f is None else (f, pytest.approx(c)) for p, (n, s, f, c) in want.items()} == found[tree]


def test_votes_do_not_depend_on_groups_or_chunks(spark, sample, monkeypatch):
    x, y = sample
    df = table(spark, x, y)
    whole = ExtraTrees(Settings(trees=6, bootstrap=True)).fit(df)
    want = [r["v"] for r in whole.votes(df, "v", [2, 6], [2, 9]).orderBy("tweet_id").collect()]
    few = [plain_tree(x, y, np.arange(160), t, whole.settings) for t in range(6)]
    for i in (0, 7, 99):
        shares = np.zeros((6, 2))
        for t, nodes in enumerate(few):
            for j, least in enumerate((2, 9)):
                path = ""
                while nodes[path][2] is not None and nodes[path][0] >= least:
                    path += "0" if x[i, nodes[path][2]] <= nodes[path][3] else "1"
                shares[t, j] = nodes[path][1]
        assert want[i] == pytest.approx([*shares[:2].sum(axis=0), *shares.sum(axis=0)])
    monkeypatch.setattr(trees, "CHUNK_BYTES", 4000)
    cut = ExtraTrees(Settings(trees=6, bootstrap=True, group_rows=40)).fit(df)
    assert sum(1 for _ in cut._chunks()) > 2
    got = [r["v"] for r in cut.votes(df, "v", [2, 6], [2, 9]).orderBy("tweet_id").collect()]
    assert np.array(got) == pytest.approx(np.array(want))
    assert cut.importances(5) == pytest.approx(whole.importances(5)) and cut.depth() == whole.depth()


def test_a_deeper_limit_or_larger_forest_extends_the_smaller(spark, sample):
    df = table(spark, *sample)
    small, large = (ExtraTrees(Settings(trees=n)).fit(df) for n in (3, 5))
    nodes = [{r["tree"]: bytes(r["nodes"]) for r in m.subtrees.collect()} for m in (small, large)]
    assert all(nodes[0][t] == nodes[1][t] for t in range(3))


def test_forest_learns_saves_and_loads(spark, sample, tmp_path):
    x, y = sample
    df = table(spark, x, y)
    model = ExtraTrees(Settings(trees=20, group_rows=50)).fit(df)
    assert evaluate.accuracy(model.transform(df)) > 0.95
    path = str(tmp_path / "forest")
    model.write().overwrite().save(path)
    again = ForestModel.load(path)
    want = model.transform(df).select("tweet_id", "prediction").collect()
    assert sorted(again.transform(df).select("tweet_id", "prediction").collect()) == sorted(want)
    shares = model.importances(5)
    assert sum(shares) == pytest.approx(1) and shares[4] == 0 and max(shares) == shares[0]


def test_forests_of_odd_tables(spark, sample):
    x, y = sample
    df = table(spark, x, y)
    none = ExtraTrees(Settings(trees=2)).fit(df.limit(0))
    assert none.transform(df).where("prediction = 1").count() == 0
    pure = ExtraTrees(Settings(trees=2)).fit(df.where("popularity = 1"))
    assert pure.transform(df).where("prediction = 1").count() == 160 and pure.depth() == 0


# ------------------------------------------------------------------ lasso


def plain_lasso(x, y, penalty):
    """Proximal gradient steps to convergence."""
    x, y = x - x.mean(axis=0), y - y.mean()
    w, step = np.zeros(x.shape[1]), 1 / np.linalg.eigvalsh(x.T @ x / len(x)).max()
    for _ in range(20_000):
        moved = w - step * (x.T @ (x @ w - y)) / len(x)
        w = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
    return w


def test_lasso_from_moments(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(120, 4)) @ draw.normal(size=(4, 4)) + [5, -3, 100, 0]
    y = (x @ [1.5, 0, 0.02, 0] + draw.normal(size=120) > 9).astype(int)
    rows = [(i, *map(float, a), int(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "tweet_id long, a double, b double, c double, d double, popularity int")
    names, steps = ["a", "b", "c", "d"], 12
    fold = {r[0]: r[1] for r in df.select("tweet_id", F.pmod(F.xxhash64("tweet_id"), F.lit(5))).collect()}
    at = np.array([fold[i] for i in range(120)])
    top = np.abs((x - x.mean(axis=0)).T @ (y - y.mean())).max() / 120
    penalties = [top * 1e-3 ** (i / (steps - 1)) for i in range(steps)]
    errors = []
    for penalty in penalties:
        total = 0
        for k in range(5):
            rest, own = at != k, at == k
            w = plain_lasso(x[rest], y[rest], penalty)
            guess = y[rest].mean() + (x[own] - x[rest].mean(axis=0)) @ w
            total += ((y[own] - guess) ** 2).mean()
        errors.append(total)
    want = plain_lasso(x, y, penalties[int(np.argmin(errors))])
    got = selection.lasso_weights(df, names, steps=steps)
    assert [got[n] for n in names] == pytest.approx(want.tolist(), abs=1e-6)
    kept = [r["feature"] for r in selection.lasso_top3(df, names, steps=steps).collect()]
    assert kept == [names[i] for i in np.argsort(-np.abs(want))[:3]]
    assert set(selection.lasso_weights(df.limit(0), names).values()) == {0.0}


def test_rows_are_never_broadcast_to_their_nodes(spark):
    """Whatever size Spark expects of checkpointed rows, a level's nodes are sent to them."""
    rows = spark.range(3).selectExpr(
        "0 AS tree", "'' AS path", "id AS row", "1D AS y", "1D AS w", "array(double(id), 1D) AS x"
    )
    nodes = spark.range(1).selectExpr(
        "0 AS tree", "'' AS path", "0 AS feature", "1D AS cut", "3L AS n", "0.5D AS share", "0D AS gain", "2L AS n_left"
    )
    moved = trees._moved(rows, nodes)
    plan = moved._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan and "leftHint" not in plan
    assert sorted(map(tuple, moved.select("path", "row", "size").collect())) == [("0", 0, 2), ("0", 1, 2), ("1", 2, 1)]


def test_levels_store_no_rows_for_a_tree(spark, sample, monkeypatch):
    """Rows are stored without a tree, however many levels are split on counts; what is stored for trees is nodes."""
    stored, cut = [], trees.cut_lineage
    monkeypatch.setattr(trees, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    tops, _ = trees.grow(table(spark, *sample), Settings(trees=4, group_rows=30))
    assert max(len(r["path"]) for r in tops.collect()) > 1
    assert len(stored) <= 3 and [c for c in stored if "tree" in c] == [["tree", "path", "nodes"]]


def test_equal_rows_are_one_entry_of_a_block(spark, sample):
    """Rows are handled in blocks, and without a bootstrap equal ones once; the forest is that of all rows."""
    x, y = (np.concatenate([part] * 3) for part in sample)
    df = table(spark, x, y)
    plain = df.select(F.col("popularity").cast("double").alias("y"), vector_to_array("features").alias("x"))
    for bootstrap, entries in ((False, len({tuple(v) for v in x})), (True, len(x))):
        blocks = trees._blocks(plain, Settings(bootstrap=bootstrap)).collect()
        assert sum(b["size"] for b in blocks) == entries > 4 * len(blocks)
        assert sum(np.frombuffer(b["counts"]).sum() for b in blocks) == len(x)
        assert sum(np.frombuffer(b["ones"]).sum() for b in blocks) == y.sum()
    for group_rows in (1000, 30):
        found = {}
        tops, subtrees = trees.grow(df, Settings(trees=1, group_rows=group_rows))
        for r in subtrees.collect():
            found |= {p: n[0] for p, n in walk(np.frombuffer(bytes(r["nodes"]), trees.NODE), r["path"]).items() if n[2] is None}
        whole = plain_tree(x, y, np.arange(len(x)), 0, Settings(trees=1))
        assert found == {path: n for path, (n, _, feature, _) in whole.items() if feature is None}


def test_a_node_of_many_equal_rows_is_finished_by_a_task(spark):
    """What a task holds is entries, so copies of few rows need no split on counts."""
    rows = spark.range(4000).selectExpr("id % 8 AS x", "CAST(id % 3 = 0 AS int) AS popularity")
    df = rows.select("popularity", array_to_vector(F.array(F.col("x").cast("double"))).alias("features"))
    tops, subtrees = trees.grow(df, Settings(trees=2, group_rows=30))
    assert tops.count() == 0 and sorted(r["tree"] for r in subtrees.collect()) == [0, 1]


def test_features_that_vary_late_compete_in_tops_and_tasks(spark):
    """Where none of the first features drawn varies, the first one that does takes their place."""
    draw = np.random.default_rng(5)
    x = np.ones((300, 9))
    x[:, 7], x[:, 8] = draw.normal(size=300), draw.normal(size=300)
    y = (x[:, 7] + draw.normal(size=300) > 1).astype(int)
    for group_rows in (1000, 60):
        tops, subtrees = trees.grow(table(spark, x, y), Settings(trees=3, per_split=1, group_rows=group_rows))
        for tree in range(3):
            found = {r["path"]: r["feature"] for r in tops.collect() if r["tree"] == tree}
            for r in subtrees.collect():
                if r["tree"] == tree:
                    nodes = walk(np.frombuffer(bytes(r["nodes"]), trees.NODE), r["path"])
                    found |= {path: node[2] for path, node in nodes.items()}
            want = plain_tree(x, y, np.arange(300), tree, Settings(trees=3, per_split=1))
            assert found == {path: node[2] for path, node in want.items()}


def test_no_tree_of_a_larger_forest_comes_to_the_driver(spark, sample, monkeypatch):
    df = table(spark, *sample)
    model = ExtraTrees(Settings(trees=6)).fit(df)
    want = sorted(model.transform(df).select("tweet_id", "prediction").collect())
    seen, collect = [], DataFrame.collect
    monkeypatch.setattr(trees, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(self.columns) or collect(self))
    scored = model.transform(df)
    assert seen and not any("nodes" in columns for columns in seen)
    assert scored.columns == [*df.columns, "prediction"]
    assert sorted(scored.select("tweet_id", "prediction").collect()) == want
