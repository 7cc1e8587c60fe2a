"""Forests of best splits for 0/1 labels, grown from counts of equal rows.

Every feature is cut into at most ``bins`` codes, once, at quantiles of all its values. Rows of equal
codes are one cell with its counts of 0 and 1, so a forest is grown from no more cells than there are
combinations of codes, however many rows they hold. A bootstrap draws each row Poisson(1) times, which
is Poisson(n) for the n rows of a cell and label.

A node draws ``per_split`` features into a reservoir, and the cut with the lowest Gini impurity of the
two sides wins, the first one drawn among equals. A node is a leaf when it is pure, at ``depth``, or
when no cut of the drawn features removes impurity; leaves of one parent that predict the same become
one. These are the rules of Spark ML, whose single tree is this one. As in ``trees``, draws are hashes of (seed, tree, path of the node) and of the cell, nodes of more than
``group_rows`` cells are split on grouped counts, which walk the cells down the splits so far, and one task
finishes a smaller one. Cells travel in blocks, so no tree has a copy of them before that.
No tree comes to the driver whole; the fitted model is that of ``trees``.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecast.models import trees as tr
from ripplecast.models.features import LABEL
from ripplecast.models.trees import NODE, ForestModel, Settings
from ripplecast.operators.ordering import running_sums
from ripplecast.session import cut_lineage

BINS = 32
#: Cells of a node that one task finishes: all those of four features.
GROUP_CELLS = 1 << 20
#: Runs of equal values that quantiles are read off, and entries that are split at a time.
_RUNS, _ENTRIES = 10_000, 400_000
_LEAST_GAIN = 1e-9

# ------------------------------------------------------------------ codes and cells


def cuts_of(runs: Sequence[tuple[float, float, int]], bins: int) -> list[float]:
    """At most ``bins`` - 1 thresholds between runs (least, greatest value, rows) in ascending order.

    All borders if they are so few, else those next to equal shares of the rows.
    """
    middle = [a[1] + (b[0] - a[1]) / 2 for a, b in zip(runs, runs[1:])]
    middle = [m if m < b[0] else a[1] for m, a, b in zip(middle, runs, runs[1:])]
    if len(middle) < bins:
        return middle
    stride = sum(n for *_, n in runs) / bins
    found, target, before = [], stride, 0
    for border, (*_, n), (*_, after) in zip(middle, runs, runs[1:]):
        before += n
        if abs(before - target) < abs(before + after - target):
            found.append(border)
            target += stride
    return found[: bins - 1]


def cut_points(rows: DataFrame, width: int, bins: int) -> list[list[float]]:
    """Thresholds of every element of the array ``x``, from the counts of all its values."""
    cells = rows.select(F.posexplode("x").alias("feature", "value"))
    counted = cells.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    one = F.lit(1).cast("long")
    placed = running_sums(
        counted, ["value"], {"rows": F.col("n"), "rank": one}, by=["feature"],
        whole={"all_rows": "rows", "values": "rank"},
    )
    place = F.when(F.col("values") <= _RUNS, F.col("rank")).otherwise(
        F.expr(f"cast(rows as decimal(38, 0)) * {_RUNS} div all_rows")
    )
    runs = placed.groupBy("feature", place.cast("long").alias("place")).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("n")
    )

    def borders(key: tuple, table: pa.Table) -> pa.Table:  # at most _RUNS + 1 rows
        table = table.sort_by("place")
        own = cuts_of(list(zip(*(table.column(c).to_pylist() for c in ("low", "high", "n")))), bins)
        return pa.table({"feature": pa.array([key[0].as_py()], pa.int32()), "cuts": pa.array([own], pa.list_(pa.float64()))})

    found: list[list[float]] = [[] for _ in range(width)]
    for feature, cuts in runs.groupBy("feature").applyInArrow(borders, "feature int, cuts array<double>").collect():
        found[feature] = cuts
    return found


def cells_of(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """(codes, n0, n1, id): every combination of codes with its rows of each label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = tr._matrix(batch.column(1))
            codes = [np.searchsorted(one, x[:, i]).astype(np.int8) for i, one in enumerate(cuts)]
            flat = pa.array(np.stack(codes, axis=1).ravel())
            sizes = pa.array(np.arange(0, len(flat) + 1, len(cuts), dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(sizes, flat)], ["y", "codes"]
            )

    coded = rows.select("y", "x").mapInArrow(run, "y double, codes array<tinyint>")
    counted = coded.groupBy("codes").agg(
        F.count_if(F.col("y") != 1).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")
    )
    return counted.withColumn("id", F.xxhash64("codes"))


# ------------------------------------------------------------------ draws


@functools.cache
def _poisson(bit: int) -> tuple[int, np.ndarray]:
    """The least count worth a name and, from it on, the distribution function of Poisson(2 ** bit)."""
    mean = 2.0**bit
    reach = 12 * math.sqrt(mean) + 20
    low = max(0, int(mean - reach))
    counts = np.arange(low, int(mean + reach))
    logs = counts * math.log(mean) - mean - np.array([math.lgamma(k + 1) for k in counts])
    return low, np.cumsum(np.exp(logs))


def drawn(n: np.ndarray, ids: np.ndarray, key: np.ndarray, label: int) -> np.ndarray:
    """Poisson(n) numbers, as the sum of those of the powers of two in n."""
    found = np.zeros(len(n))
    for bit in range(int(n.max(initial=0)).bit_length()):
        has = np.flatnonzero((n >> bit) & 1)
        salt = np.array([2 * bit + label + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        share = tr._uniform(tr._mix(ids[has] + salt) ^ key)
        low, upto = _poisson(bit)
        found[has] += low + np.searchsorted(upto, share, "right")
    return found


def weights(settings: Settings, tree: int, ids: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple:
    """How many rows of a cell are drawn for a tree, and how many of them are 1."""
    if not settings.bootstrap:
        return (n0 + n1).astype(float), n1.astype(float)
    key, ids = tr.node_key(settings.seed, tree), ids.view(np.uint64)
    ones = drawn(n1, ids, key, 1)
    return ones + drawn(n0, ids, key, 0), ones


def competing(keys: np.ndarray, width: int, count: int) -> np.ndarray:
    """The features that compete in each node; the order settles ties."""
    found = np.tile(np.arange(min(count, width)), (len(keys), 1))
    salts = np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(count, width):
        place = (tr._uniform(keys + salts[i]) * (i + 1)).astype(int)
        hit = np.flatnonzero(place < count)
        found[hit, place[hit]] = i
    return found


# ------------------------------------------------------------------ splits


def cheapest(key: np.ndarray, sums: np.ndarray, total: np.ndarray, per_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """The lowest impurity of a cut in each node and its code; ``key`` is node * BINS + code, ascending.

    ``sums`` holds (weight, weight of ones) per key, ``total`` the same per node.
    """
    node, nodes = key // BINS, np.arange(len(total))
    first = np.searchsorted(node, nodes)
    upto = np.cumsum(sums, axis=0)
    left = upto - (upto[first] - sums[first])[node]
    right = total[node] - left
    cost = tr._impurity(left[:, 0], left[:, 1]) + tr._impurity(right[:, 0], right[:, 1])
    cost[(left[:, 0] < per_leaf) | (right[:, 0] < per_leaf)] = np.inf
    lowest = np.minimum.reduceat(cost, first)
    hits = np.flatnonzero(cost == lowest[node])
    return lowest, key[hits[np.searchsorted(node[hits], nodes)]] % BINS


def _tallied(key: np.ndarray, weight: np.ndarray, ones: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur, ascending, and their sums."""
    if top <= 16 * len(key):  # a small table of all keys costs less than a sort
        seen = np.bincount(key, minlength=top) > 0
        found = np.flatnonzero(seen)
        return found, np.stack([np.bincount(key, w, top)[found] for w in (weight, ones)], axis=1)
    found, place = np.unique(key, return_inverse=True)
    return found, np.stack([np.bincount(place, w) for w in (weight, ones)], axis=1)


def _is_open(total: np.ndarray, depth: int, settings: Settings) -> np.ndarray:
    return tr.splittable(np.column_stack([total[:, 0], total]), depth, settings)


def finish(
    codes: np.ndarray, n0: np.ndarray, n1: np.ndarray, ids: np.ndarray, starts: Sequence[tuple[int, str]],
    settings: Settings,
) -> list[np.ndarray]:
    """The subtree of every (tree, path) whose node holds these cells; ``cut`` is a code."""
    keys = np.concatenate([tr.node_key(settings.seed, tree, path) for tree, path in starts])
    depth, width, compete = len(starts[0][1]), codes.shape[1], settings.competing(codes.shape[1])
    flat = codes.ravel()
    both = [weights(settings, tree, ids, n0, n1) for tree, _ in starts]
    held = [np.flatnonzero(w > 0) for w, _ in both]
    node = np.repeat(np.arange(len(starts)), [len(h) for h in held])
    at = np.concatenate(held)
    weight = np.concatenate([w[h] for (w, _), h in zip(both, held)])
    ones = np.concatenate([o[h] for (_, o), h in zip(both, held)])
    del both, held
    owner = np.arange(len(starts))
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    while len(keys):
        count = len(keys)
        total = np.stack([np.bincount(node, weight, count), np.bincount(node, ones, count)], axis=1)
        made = np.zeros(count, dtype=NODE)
        made["feature"], made["left"], made["n"], made["depth"] = -1, -1, total[:, 0], depth
        made["share"] = np.divide(total[:, 1], total[:, 0], out=np.zeros(count), where=total[:, 0] > 0)
        levels.append((owner, made))
        open_ = _is_open(total, depth, settings)
        kept = open_[node]
        node, at, weight, ones = (np.cumsum(open_) - 1)[node[kept]], at[kept], weight[kept], ones[kept]
        if not len(node):
            break
        order = np.argsort(node, kind="stable")
        node, at, weight, ones = node[order], at[order], weight[order], ones[order]
        inside, place_of = total[open_], at * width
        feature = competing(keys[open_], width, compete)
        cost = np.full(len(inside), np.inf)
        chosen, edge = np.full(len(inside), -1), np.zeros(len(inside), dtype=np.int64)
        for k in range(feature.shape[1]):
            code = flat.take(place_of + feature[node, k])
            tally = _tallied(node * BINS + code, weight, ones, len(inside) * BINS)
            lowest, place = cheapest(*tally, inside, settings.per_leaf)
            better = lowest < cost
            cost[better], chosen[better], edge[better] = lowest[better], feature[better, k], place[better]
        gain = tr._impurity(inside[:, 0], inside[:, 1]) - cost
        split = gain > _LEAST_GAIN
        parents = np.flatnonzero(open_)[split]
        made["feature"][parents], made["cut"][parents], made["gain"][parents] = chosen[split], edge[split], gain[split]
        goes = flat.take(place_of + np.maximum(chosen, 0)[node]) <= edge[node]
        kept = split[node]
        node = ((np.cumsum(split) - 1)[node] * 2 + ~goes)[kept]
        at, weight, ones = at[kept], weight[kept], ones[kept]
        keys = np.stack([tr.child_keys(keys[parents], 0), tr.child_keys(keys[parents], 1)], axis=1).ravel()
        owner = np.repeat(owner[parents], 2)
        depth += 1
    return [pruned(nodes) for nodes in tr._by_owner(levels, len(starts))]


def pruned(nodes: np.ndarray) -> np.ndarray:
    """Without the splits whose sides are leaves that predict the same, from the deepest up."""
    nodes, ones = nodes.copy(), nodes["share"] > 0.5
    bounds = np.searchsorted(nodes["depth"], np.arange(nodes["depth"][0], nodes["depth"][-1] + 2))  # level by level
    kept = np.ones(len(nodes), dtype=bool)
    for from_, to in zip(bounds[-2::-1], bounds[:0:-1]):
        split = from_ + np.flatnonzero(nodes["feature"][from_:to] >= 0)
        left = nodes["left"][split]
        leaf = (nodes["feature"][left] < 0) & (nodes["feature"][left + 1] < 0) & (ones[left] == ones[left + 1])
        gone = split[leaf]
        kept[left[leaf]] = kept[left[leaf] + 1] = False
        nodes["feature"][gone], nodes["left"][gone], nodes["gain"][gone], nodes["cut"][gone] = -1, -1, 0, 0
    split = nodes["left"] >= 0
    nodes["left"][split] = (np.cumsum(kept) - 1)[nodes["left"][split]]
    return nodes[kept]


# ------------------------------------------------------------------ DataFrames

#: Cells in one row; codes stand feature by feature.
_BLOCK = "size int, ids binary, n0 binary, n1 binary, codes binary"
_BLOCK_NAMES = ["size", "ids", "n0", "n1", "codes"]


def _block(ids: np.ndarray, n0: np.ndarray, n1: np.ndarray, lines: np.ndarray) -> list[pa.Array]:
    parts = (np.ascontiguousarray(part).tobytes() for part in (ids, n0, n1, lines))
    return [pa.array([len(ids)], pa.int32()), *[pa.array([part], pa.binary()) for part in parts]]


def _blocks(cells: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            numbers = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("id", "n0", "n1"))
            lines = np.concatenate([tr._matrix(b.column("codes")) for b in held]).astype(np.int8).T
            return pa.RecordBatch.from_arrays(_block(*numbers, lines), _BLOCK_NAMES)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= tr._BLOCK_ROWS:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    return cells.select("id", "n0", "n1", "codes").mapInArrow(run, _BLOCK)


def _cells(table: pa.Table | pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """(codes feature by feature, n0, n1, ids) of all blocks of a table."""
    sizes = table.column("size").to_pylist()
    lines, end = np.empty((width, sum(sizes)), dtype=np.int8), 0
    for size, codes in zip(sizes, table.column("codes")):
        lines[:, end : end + size] = np.frombuffer(codes.as_buffer(), np.int8).reshape(width, size)
        end += size
    numbers = (
        np.concatenate([np.frombuffer(c.as_buffer(), np.int64) for c in table.column(name)]) for name in ("n0", "n1", "ids")
    )
    return lines, *numbers


def _finished(small: DataFrame, settings: Settings, cuts: list[list[float]]) -> DataFrame:
    """(tree, path, nodes): trees ``first`` to ``last`` - 1 from the blocks of their common cells at a path."""
    table_of = np.array([[*one, *[np.inf] * (BINS - len(one))] for one in cuts])

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, path = key[0].as_py(), key[1].as_py(), key[2].as_py()
        lines, *numbers = _cells(pa.Table.from_batches(list(batches)), len(cuts))
        codes = np.ascontiguousarray(lines.T)
        del lines
        step = max(1, _ENTRIES // max(1, len(codes)))
        for at in range(first, last, step):
            starts = [(tree, path) for tree in range(at, min(last, at + step))]
            made = finish(codes, *numbers, starts, settings)
            for nodes in made:
                split = nodes["feature"] >= 0
                nodes["cut"][split] = table_of[nodes["feature"][split], nodes["cut"][split].astype(int)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([tree for tree, _ in starts], pa.int32()), pa.array([path] * len(made), pa.string()),
                 pa.array([one.tobytes() for one in made], pa.binary())],
                ["tree", "path", "nodes"],
            )

    return small.groupBy("first", "last", "path").applyInArrow(run, "tree int, path string, nodes binary")


def _draw(settings: Settings, n0: np.ndarray, n1: np.ndarray, ids: np.ndarray) -> Callable[[int], tuple[np.ndarray, ...]]:
    def of(tree: int) -> tuple[np.ndarray, ...]:
        w, ones = weights(settings, tree, ids, n0, n1)
        at = np.flatnonzero(w > 0)
        return at, w[at], ones[at]

    return of


def _chosen(
    blocks: DataFrame, tops: Sequence[np.ndarray], marks: Sequence[np.ndarray], settings: Settings,
    asked: np.ndarray, depth: int, width: int,
) -> DataFrame:
    """(node, feature, code, n, share, gain, n_left, cells): the winning cut of every marked node, feature -1 for leaves."""
    count = asked.shape[1]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(asked), count, BINS, 3))
        for block in tr._each(batches):
            lines, *numbers = _cells(block, width)
            for _, mark, own, weight, ones in tr._walked(lines, _draw(settings, *numbers), tops, marks):
                for k, feature in enumerate(asked[mark]):
                    code = lines[feature][own]
                    for j, value in enumerate((weight, ones, None)):
                        sums[mark, k, :, j] += np.bincount(code, value, BINS)
        sums = sums.reshape(-1, 3)
        place = np.flatnonzero(sums[:, 2])
        node, at = np.divmod(place, count * BINS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part) for part in (node, at, *sums[place].T)], ["node", "place", "w", "w1", "c"]
        )

    tallied = blocks.mapInArrow(tally, "node long, place long, w double, w1 double, c double")
    summed = tallied.groupBy("node", "place").agg(*[F.sum(c).alias(c) for c in ("w", "w1", "c")])

    def choose(key: tuple, table: pa.Table) -> pa.Table:  # at most count x BINS rows
        node, table = key[0].as_py(), table.sort_by("place")
        place, w, w1, c = (table.column(n).to_numpy() for n in ("place", "w", "w1", "c"))
        k, code, sums = place // BINS, place % BINS, np.stack([w, w1], axis=1)
        total = sums[k == 0].sum(axis=0)[None]
        found = (np.inf, -1, 0, 0)
        if _is_open(total, depth, settings)[0]:
            for i, own in enumerate(asked[node]):
                at = k == i
                lowest, cut = cheapest(code[at], sums[at], total, settings.per_leaf)
                if lowest[0] < found[0]:
                    found = (lowest[0], own, cut[0], c[at & (code <= cut[0])].sum())
        gain = float(tr._impurity(total[:, 0], total[:, 1])[0] - found[0])
        _, own, cut, left = found if gain > _LEAST_GAIN else (0.0, -1, 0, 0)
        row = (node, own, cut, total[0, 0], total[0, 1] / total[0, 0], max(gain, 0.0), left, c[k == 0].sum())
        kinds = (int, int, int, int, float, float, int, int)
        return pa.table([pa.array([kind(v)]) for v, kind in zip(row, kinds)], _CHOSEN.split())

    kinds = zip(_CHOSEN.split(), ("long", "long", "long", "long", "double", "double", "long", "long"))
    return summed.groupBy("node").applyInArrow(choose, ", ".join(map(" ".join, kinds)))


_CHOSEN = "node feature code n share gain n_left cells"


def _tops(blocks: DataFrame, settings: Settings, cuts: list[list[float]]) -> tuple[list, list, list, list, list]:
    """Splits (tree, path, feature, cut, gain, n, share), leaves (tree, path, n, share), and every tree's top.

    As in ``trees``: nodes above ``group_rows`` cells and their children, walked again on each level; cuts are codes.
    """
    width, root = len(cuts), np.zeros(1, dtype=NODE)
    root["feature"] = root["left"] = -1
    tops, paths = [root.copy() for _ in range(settings.trees)], [[""] for _ in range(settings.trees)]
    splits, whole, gone = [], [], set()
    waiting = [(tree, 0) for tree in range(settings.trees)]
    while waiting:
        marks = [np.full(len(nodes), -1) for nodes in tops]
        for i, (tree, at) in enumerate(waiting):
            marks[tree][at] = i
        own = [paths[tree][at] for tree, at in waiting]
        keys = np.concatenate([tr.node_key(settings.seed, tree, path) for (tree, _), path in zip(waiting, own)])
        asked = competing(keys, width, settings.competing(width))
        gone.update(waiting)
        made, opened = [[nodes] for nodes in tops], []
        for row in _chosen(blocks, tops, marks, settings, asked, len(own[0]), width).collect():  # a row a node
            tree, at = waiting[row["node"]]
            path, feature, code = own[row["node"]], row["feature"], row["code"]
            if feature < 0:
                whole.append((tree, path, row["n"], row["share"]))
                continue
            splits.append((tree, path, feature, float(cuts[feature][code]), row["gain"], row["n"], row["share"]))
            kids = len(paths[tree])
            tops[tree]["feature"][at], tops[tree]["cut"][at], tops[tree]["left"][at] = feature, code, kids
            made[tree] += [root, root]
            paths[tree] += [path + "0", path + "1"]
            sizes = row["n_left"], row["cells"] - row["n_left"]
            opened += [(tree, kids + side) for side in (0, 1) if sizes[side] > settings.group_rows]
        tops, waiting = [np.concatenate(parts) for parts in made], sorted(opened)
    marks = [np.array([-1 if (tree, at) in gone else at for at in range(len(p))]) for tree, p in enumerate(paths)]
    return splits, whole, tops, paths, marks


def _small(
    blocks: DataFrame, tops: Sequence[np.ndarray], paths: Sequence[Sequence[str]], marks: Sequence[np.ndarray],
    settings: Settings, width: int,
) -> DataFrame:
    """(first, last, path, block): every tree's cells at the nodes below its top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tr._each(batches):
            lines, n0, n1, ids = _cells(block, width)
            for tree, at, own, _, _ in tr._walked(lines, _draw(settings, n0, n1, ids), tops, marks):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree], pa.int32()), pa.array([tree + 1], pa.int32()), pa.array([paths[tree][at]]),
                     *_block(ids[own], n0[own], n1[own], lines.take(own, axis=1))],
                    ["first", "last", "path", *_BLOCK_NAMES],
                )

    return blocks.mapInArrow(run, f"first int, last int, path string, {_BLOCK}")


def _joined(tops: DataFrame, subtrees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tops and subtrees after leaves below tops that predict the same became one, as ``pruned`` does in a subtree.

    A top has more than ``group_rows`` cells, so tops and the leaves next to them are few.
    """
    spark, at = tops.sparkSession, ["tree", "path"]
    splits = {(r["tree"], r["path"]): r for r in tops.collect()}
    above = tops.select("tree", F.explode(F.array(F.concat("path", F.lit("0")), F.concat("path", F.lit("1")))).alias("path"))
    single = subtrees.where(F.octet_length("nodes") == NODE.itemsize).join(F.broadcast(above), at, "left_semi")
    leaf = {(r["tree"], r["path"]): float(np.frombuffer(r["nodes"], NODE)["share"][0]) > 0.5 for r in single.collect()}
    fresh, gone = {}, []
    for tree, path in sorted(splits, key=lambda node: -len(node[1])):
        kids = [(tree, path + side) for side in "01"]
        if all(k in leaf for k in kids) and leaf[kids[0]] == leaf[kids[1]]:
            gone += kids
            fresh[tree, path] = splits[tree, path]
            leaf[tree, path] = leaf[kids[0]]
    if fresh:
        lost = spark.createDataFrame(gone, "tree int, path string")
        last = [(*node, r["n"], r["share"]) for node, r in fresh.items() if node not in set(gone)]
        made = spark.createDataFrame(last, "tree int, path string, n long, share double").withColumn("feature", F.lit(-1))
        subtrees = subtrees.join(F.broadcast(lost), at, "left_anti").unionByName(tr._leaf_nodes(made))
        tops = tops.join(F.broadcast(spark.createDataFrame(list(fresh), "tree int, path string")), at, "left_anti")
    return tops.select("tree", "path", "feature", "cut", "gain"), subtrees


def grow(
    df: DataFrame, settings: Settings, label: str = LABEL, bins: int = BINS, cuts: list[list[float]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(tops, subtrees) of a forest, as ``trees.grow`` gives them; ``cuts`` are the cut points if they are known."""
    spark = df.sparkSession
    rows = df.select(F.col(label).cast("double").alias("y"), vector_to_array("features").alias("x"))
    tops = spark.createDataFrame([], tr.TOP)
    head = rows.select("x").first()
    if head is None:
        return tops, spark.createDataFrame([], "tree int, path string, nodes binary")
    width = len(head[0])
    cuts = cut_points(rows, width, min(bins, BINS)) if cuts is None else cuts
    blocks = cut_lineage(_blocks(cells_of(rows, cuts)))
    if blocks.agg(F.sum("size")).first()[0] <= settings.group_rows:  # few cells: each task grows a run of trees
        tasks = min(settings.trees, 2 * spark.sparkContext.defaultParallelism)
        ends = [i * settings.trees // tasks for i in range(tasks + 1)]
        runs = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in zip(ends, ends[1:])])
        small = blocks.select(F.explode(runs).alias("run"), F.lit("").alias("path"), *_BLOCK_NAMES)
        return tops, cut_lineage(_finished(small.select("run.*", "path", *_BLOCK_NAMES), settings, cuts))
    splits, whole, *below = _tops(blocks, settings, cuts)
    made = _finished(_small(blocks, *below, settings, width), settings, cuts)
    if whole:
        leaf = spark.createDataFrame(whole, "tree int, path string, n long, share double").withColumn("feature", F.lit(-1))
        made = made.unionByName(tr._leaf_nodes(leaf))
    return _joined(spark.createDataFrame(splits, f"{tr.TOP}, n long, share double"), cut_lineage(made))


class Forest(Estimator):
    """``fit`` grows the forest that the settings name; ``per_split`` 0 stands for the root of the width, rounded up."""

    def __init__(
        self, settings: Settings, label: str = LABEL, bins: int = BINS, cuts: list[list[float]] | None = None
    ):
        super().__init__()
        self.settings, self.label, self.bins, self.cuts = settings, label, bins, cuts

    def _fit(self, dataset: DataFrame) -> ForestModel:
        settings = self.settings
        if not settings.per_split:
            head = dataset.select("features").first()
            settings = replace(settings, per_split=math.ceil(math.sqrt(len(head[0]))) if head else 1)
        return ForestModel(settings, *grow(dataset, settings, self.label, self.bins, self.cuts))


def random_forest(
    trees: int, depth: int, seed: int, label: str = LABEL, cuts: list[list[float]] | None = None
) -> Forest:
    """Bootstrapped trees that try the root of the number of features, rounded up, at a node."""
    return Forest(Settings(trees, depth, 0, 1, 2, True, seed, GROUP_CELLS), label, cuts=cuts)


def single_tree(depth: int, seed: int, label: str = LABEL) -> Forest:
    """One tree on all rows that tries every feature."""
    return Forest(Settings(1, depth, 1 << 30, 1, 2, False, seed, GROUP_CELLS), label)
