"""Synthetic minority rows between near neighbours.

Neighbours are exact. Space is cut into cells by quantiles of each cell's widest axis, level by
level, from grouped statistics of the points; every cell knows the tight box around its points.
A point looks in its own cell first. The k-th distance found there, or the far corner of the
smallest enclosing box with enough points, bounds the other cells that it has to visit; these are
found by descending the tree of boxes in joins. On 0/1 columns a tight box has no extent once its
points agree, so cells that differ in such a column lie at least 1 apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplecast.models.features import LABEL
from ripplecast.operators.ordering import row_index, running_sums
from ripplecast.session import cut_lineage

NEIGHBOURS = 5
SEED = 7
LEAF_POINTS = 512
CHILDREN = 16
VISITORS_PER_TASK = 100_000
DRAWS_PER_TASK = 100_000


def _boxes(placed: DataFrame, width: int) -> DataFrame:
    """(node, n, low, high): the tight box around the points of every node."""
    return placed.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.min(F.col("x")[i]) for i in range(width)]).alias("low"),
        F.array(*[F.max(F.col("x")[i]) for i in range(width)]).alias("high"),
    )


def cells(points: DataFrame, width: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """(pid, x, node) of every point's leaf, and (node, parent, leaf, n, low, high) of all nodes.

    A node of more than ``leaf`` points is cut at up to CHILDREN - 1 quantiles of its widest axis,
    all nodes of a level at once. Nodes are named by their path, the root by an empty one.
    """
    active = points.select("pid", "x", F.lit("").alias("node"), F.lit(None).cast("string").alias("parent"))
    done, nodes = None, None
    shares = [i / CHILDREN for i in range(1, CHILDREN)]
    while True:
        found = cut_lineage(_boxes(active, width))
        extent = F.zip_with("high", "low", lambda a, b: a - b)
        axis = (F.array_position(extent, F.array_max(extent)) - 1).cast("int")
        wide = found.where((F.col("n") > leaf) & (F.array_max(extent) > 0)).select(
            "node", axis.alias("axis"), F.get("low", axis).alias("least"), F.get("high", axis).alias("most")
        )
        listed = found.join(active.select("node", "parent").distinct(), "node").join(
            wide.select("node", F.lit(False).alias("_leaf")), "node", "left"
        )
        listed = listed.select("node", "parent", F.coalesce("_leaf", F.lit(True)).alias("leaf"), "n", "low", "high")
        nodes = listed if nodes is None else nodes.unionByName(listed)
        own = active.join(wide, "node", "left_anti").select("pid", "x", "node")
        done = own if done is None else done.unionByName(own)
        value = F.get("x", "axis")
        sought = active.join(wide, "node")
        cuts = sought.groupBy("node", "least", "most").agg(
            F.percentile_approx(value, shares, F.lit(1000)).alias("cuts")
        )
        below = F.array_distinct(F.filter("cuts", lambda c: c < F.col("most")))  # no child is empty
        middle = F.array((F.col("least") + F.col("most")) / 2)
        cuts = cuts.select("node", F.when(F.size(below) > 0, below).otherwise(middle).alias("cuts"))
        place = F.size(F.filter("cuts", lambda c: c < value)).cast("string")
        active = cut_lineage(
            sought.join(cuts, "node").select(
                "pid", "x", F.concat_ws(".", F.nullif("node", F.lit("")), place).alias("node"), F.col("node").alias("parent")
            )
        )
        if active.isEmpty():
            return cut_lineage(done), cut_lineage(nodes)


def _gap(near: bool) -> Column:
    """Squared distance from x to the nearest or farthest place of the box low, high."""
    edges = F.arrays_zip(F.col("x").alias("x"), F.col("low").alias("low"), F.col("high").alias("high"))

    def along(edge: Column) -> Column:
        under, over = edge["low"] - edge["x"], edge["x"] - edge["high"]
        gap = F.greatest(under, over, F.lit(0.0)) if near else F.greatest(-under, -over)
        return gap * gap

    return F.aggregate(F.transform(edges, along), F.lit(0.0), lambda total, part: total + part)


def _nearest(
    seekers: pd.DataFrame, residents: pd.DataFrame, k: int, block: int = 256
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Squared distances and ids of the k residents nearest to each seeker, itself left out."""
    there = np.stack(residents["x"].to_numpy())
    ids = residents["pid"].to_numpy()
    for start in range(0, len(seekers), block):
        part = seekers.iloc[start : start + block]
        here = np.stack(part["x"].to_numpy())
        own = part["pid"].to_numpy()
        squares = np.zeros((len(here), len(there)))
        for axis in range(here.shape[1]):
            squares += (here[:, axis, None] - there[None, :, axis]) ** 2
        squares[own[:, None] == ids[None, :]] = np.inf
        take = min(k, len(there))
        order = np.argpartition(squares, take - 1, axis=1)[:, :take]
        for row, pid in enumerate(own):
            chosen = order[row][np.isfinite(squares[row, order[row]])]
            yield pid, squares[row, chosen], ids[chosen]


_FOUND = "pid long, square double, neighbour long"


def _at_home(placed: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(pid, x, node, reach, squares, ids): what a point finds in its cell, and how far it must look.

    ``reach`` is the squared k-th distance there or, where the cell has too few points, that to the
    far corner of the smallest box around it with more than ``k``.
    """

    def look(cell: pd.DataFrame) -> pd.DataFrame:
        made = [
            (pid, max(squares) if len(squares) == k else None, list(squares), list(ids))
            for pid, squares, ids in _nearest(cell, cell, k)
        ]
        near = pd.DataFrame(made, columns=["pid", "kth", "squares", "ids"])
        return cell.merge(near, on="pid")[["pid", "x", "node", "kth", "squares", "ids"]]

    found = placed.groupBy("node").applyInPandas(
        look, "pid long, x array<double>, node string, kth double, squares array<double>, ids array<long>"
    )
    steps = F.split("node", "[.]")
    around = nodes.where("leaf").select(
        "node",
        F.explode(
            F.concat(
                F.array(F.lit("")),
                F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), ".")),
            )
        ).alias("around"),
    )
    boxes = nodes.where(F.col("n") > k).select(F.col("node").alias("around"), "low", "high")
    deepest = F.max_by(F.struct("low", "high"), F.length("around"))
    enclosing = around.join(boxes, "around").groupBy("node").agg(deepest.alias("_box")).select("node", "_box.*")
    bounded = found.join(enclosing, "node", "left")
    reach = F.least("kth", _gap(near=False))  # null only where there are at most k points in all
    return bounded.select("pid", "x", "node", F.coalesce(reach, F.lit(float("inf"))).alias("reach"), "squares", "ids")


def visits(home: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pid, x, node): the other cells whose box a point's reach touches."""
    nodes = nodes.withColumn("_depth", F.when(F.col("node") == "", 0).otherwise(F.size(F.split("node", "[.]"))))
    kids = nodes.where("parent is not null").select(
        F.col("parent").alias("at"), F.col("node").alias("to"), "leaf", "low", "high"
    )
    going, met = home.select("pid", "x", "reach", F.col("node").alias("home"), F.lit("").alias("at")), None
    for _ in range(nodes.agg(F.max("_depth")).first()[0] or 0):
        touched = cut_lineage(
            going.join(kids, "at").where(_gap(near=True) <= F.col("reach")).select("pid", "x", "reach", "home", "to", "leaf")
        )
        own = touched.where(F.col("leaf") & (F.col("to") != F.col("home"))).select("pid", "x", F.col("to").alias("node"))
        met = own if met is None else met.unionByName(own)
        going = touched.where("not leaf").select("pid", "x", "reach", "home", F.col("to").alias("at"))
    return home.select("pid", "x", "node").limit(0) if met is None else met


def nearest_points(points: DataFrame, k: int = NEIGHBOURS, leaf: int = LEAF_POINTS) -> DataFrame:
    """(pid, neighbours): the k nearest other points, exact; ``points`` has distinct (pid, x).

    A cell with many visitors is copied, and its visitors are split among the copies.
    """
    first = points.select(F.size("x")).first()
    if first is None:
        return points.select("pid", F.array().cast("array<long>").alias("neighbours"))
    placed, nodes = cells(points, first[0], max(leaf, 2))
    home = cut_lineage(_at_home(placed, nodes, k))
    seen = cut_lineage(visits(home, nodes))

    def abroad(seekers: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(seekers) and len(residents):
            for pid, squares, ids in _nearest(seekers, residents, k):
                made += [(pid, s, i) for s, i in zip(squares, ids)]
        return pd.DataFrame(made, columns=["pid", "square", "neighbour"])

    crowds = seen.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / VISITORS_PER_TASK).cast("int").alias("_copies"))
    spread = seen.join(crowds, "node").withColumn(
        "_copy", F.pmod(F.xxhash64("pid"), F.col("_copies")).cast("int")
    )
    copies = (
        placed.join(crowds, "node")
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    )
    met = (
        spread.select("pid", "x", "node", "_copy")
        .groupBy("node", "_copy")
        .cogroup(copies.select("pid", "x", "node", "_copy").groupBy("node", "_copy"))
        .applyInPandas(abroad, _FOUND)
    )
    own = home.select("pid", F.explode(F.arrays_zip("squares", "ids")).alias("n")).select(
        "pid", F.col("n.squares").alias("square"), F.col("n.ids").alias("neighbour")
    )
    # a point meets at most k points in each of the few cells it touches
    ranked = F.array_sort(F.collect_list(F.struct("square", "neighbour")))
    return own.unionByName(met).groupBy("pid").agg(
        F.transform(F.slice(ranked, 1, k), lambda n: n["neighbour"]).alias("neighbours")
    )


def _neighbour_rows(points: DataFrame, k: int, leaf: int) -> DataFrame:
    """(pid, x, c, others): values of the k nearest rows, copies of the point itself first."""
    near = nearest_points(points.select("pid", "x"), k, leaf).select(
        "pid", F.posexplode("neighbours").alias("at", "other")
    )
    values = points.select(
        F.col("pid").alias("other"), F.col("x").alias("_x"), F.col("c").alias("_c")
    )
    listed = near.join(values, "other").groupBy("pid").agg(
        F.array_sort(F.collect_list(F.struct("at", "_x", "_c"))).alias("_near")
    )  # at most k entries

    def repeated(value, count):
        return F.array_repeat(value, F.least(count, F.lit(k)).cast("int"))

    own = repeated(F.col("x"), F.col("c") - 1)
    rest = F.flatten(
        F.transform(
            F.coalesce("_near", F.array().cast("array<struct<at:int,_x:array<double>,_c:long>>")),
            lambda n: repeated(n["_x"], n["_c"]),
        )
    )
    return points.join(listed, "pid", "left").select(
        "pid", "x", "c", F.slice(F.concat(own, rest), 1, k).alias("others")
    )


def _unit(number: int, row: str) -> Column:
    """A repeatable draw from [0, 1) per row."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.lit(number), F.col(row)), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def smote(
    df: DataFrame, label: str = LABEL, k: int = NEIGHBOURS, leaf: int = LEAF_POINTS, key: str | None = None
) -> DataFrame:
    """(label, features): all rows and as many synthetic ones as the smaller class lacks.

    With a ``key`` also (synthetic, key), by which rows have an order: synthetic rows are numbered
    from 0 where others have their key.

    The synthetic rows start at the minority rows in turn and move a drawn share of the way to a
    drawn one of the k nearest. Equal rows are kept once with their count, and those of a count
    that calls for many synthetic rows are spread over tasks.
    """
    sizes = {row[label]: row["count"] for row in df.groupBy(label).count().collect()}
    ordered = [] if key is None else [F.lit(False).alias("synthetic"), F.col(key)]
    real = df.select(label, "features", *ordered)
    if len(sizes) < 2:
        return real
    minority = min(sizes, key=lambda value: (sizes[value], value))
    few, lacking = sizes[minority], max(sizes.values()) - sizes[minority]
    if lacking == 0 or few < 2:
        return real
    values = df.where(F.col(label) == minority).select(vector_to_array("features").alias("x"))
    distinct = values.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    points = cut_lineage(row_index(distinct, ["x"], "pid"))
    near = running_sums(_neighbour_rows(points, k, leaf), ["pid"], {"before": F.col("c")})
    wide = lambda rows: F.ceil(rows.cast("decimal(20,0)") * lacking / few).cast("long")
    runs = near.select("x", "others", wide(F.col("before")).alias("a"), wide(F.col("before") + F.col("c")).alias("b"))
    starts = F.explode(F.sequence(F.col("a"), F.col("b") - 1, F.lit(DRAWS_PER_TASK).cast("long"))).alias("first")
    spread = runs.where("a < b").select("x", "others", "b", starts).repartition("first")
    last = F.least(F.col("b"), F.col("first") + DRAWS_PER_TASK) - 1
    drawn = spread.select("x", "others", F.explode(F.sequence("first", last)).alias("id"))
    other = F.get("others", F.floor(_unit(1, "id") * F.size("others")).cast("int"))
    between = F.zip_with("x", other, lambda here, there: here + _unit(2, "id") * (there - here))
    made = drawn.select(
        F.lit(minority).cast(df.schema[label].dataType).alias(label),
        array_to_vector(between).alias("features"),
        *([] if key is None else [F.lit(True).alias("synthetic"), F.col("id").alias(key)]),
    )
    return real.unionByName(made)
