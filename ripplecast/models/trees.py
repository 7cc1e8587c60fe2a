"""Extremely randomised trees for 0/1 labels, grown level by level over DataFrames.

A node draws an order of the features and, for every feature, a threshold between the node's least
and greatest value. Of the first ``per_split`` features in that order, those that vary compete
(if none does, the first one that varies), and the lowest Gini impurity of the two sides wins. A
node is a leaf when it is pure, at ``depth``, below ``per_node`` rows, or when no side has
``per_leaf`` rows. All draws are hashes of (seed, tree, path of the node), so a forest does not
depend on how its rows are dealt over tasks, its first trees are the forest of fewer trees, and a
greater ``per_node`` gives the same trees cut shorter.

A node of more than ``group_rows`` rows (as many as 48 MiB of values hold, if it is None) is split on
grouped counts: one pass for the extremes and
one for the competing splits, of all such nodes of a level at once. Both walk the rows down the splits
so far, so no tree has a copy of them before a smaller node is finished by one task, from its rows
alone; trees that start from the same few rows share them. Rows travel in blocks, column by column, and
without a bootstrap rows of equal features are one entry with its counts. Nothing depends
on ``group_rows`` but the time it takes. With ``bootstrap`` a row has a Poisson(1) weight for each
tree and takes part in the trees where it is not 0; row counts are counts of rows, shares are weighted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecast.models.features import LABEL
from ripplecast.operators.ordering import row_index
from ripplecast.session import cut_lineage

NODE = np.dtype(
    [("feature", "i4"), ("cut", "f8"), ("left", "i4"), ("n", "i8"), ("share", "f8"), ("gain", "f8"), ("depth", "i4")]
)
#: Bytes of trees that a task holds, those that the driver sends, and entries that are split at a time.
CHUNK_BYTES, SENT_BYTES, _ENTRIES = 64 << 20, 16 << 20, 400_000
#: Bytes of values that one task finishes trees from, where the settings name no number of rows.
_GROUP_BYTES = 48 << 20
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


@dataclass(frozen=True)
class Settings:
    trees: int = 100
    depth: int | None = None
    per_split: int | str = "sqrt"
    per_leaf: int = 1
    per_node: int = 2
    bootstrap: bool = False
    seed: int = 7
    group_rows: int | None = None

    def competing(self, width: int) -> int:
        return max(1, math.isqrt(width)) if self.per_split == "sqrt" else min(width, int(self.per_split))

    def deepest(self) -> int:
        return self.depth if self.depth is not None else 1 << 30


# ------------------------------------------------------------------ draws


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (_mix(x) >> np.uint64(11)) * 2.0**-53


def child_keys(keys: np.ndarray, side: int) -> np.ndarray:
    """The keys of the left (0) or right (1) children; a node's draws are hashes of its key."""
    return _mix(keys * np.uint64(2) + np.uint64(side + 1))


def node_key(seed: int, tree: int, path: str = "") -> np.ndarray:
    key = _mix(np.array([(seed << 32) + tree + 1], dtype=np.uint64))
    for step in path:
        key = child_keys(key, int(step))
    return key


def weights(settings: Settings, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often each row is drawn for a tree."""
    if not settings.bootstrap:
        return np.ones(len(rows))
    drawn = _uniform(_mix(rows.astype(np.uint64)) ^ node_key(settings.seed, tree))
    return np.searchsorted(_POISSON, drawn, "right").astype(float)


def competing(keys: np.ndarray, low: np.ndarray, high: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Features (-1: none) and thresholds that compete in each node, in the order they were drawn."""
    cells = keys[:, None] + np.arange(1, low.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = _uniform(cells).argsort(axis=1, kind="stable")
    varies = np.take_along_axis(high > low, order, axis=1)
    fit = varies & (np.arange(low.shape[1]) < count)
    late = ~fit.any(axis=1) & varies.any(axis=1)
    fit[late, varies[late].argmax(axis=1)] = True
    first = (~fit).argsort(axis=1, kind="stable")[:, :count]
    feature = np.where(np.take_along_axis(fit, first, axis=1), np.take_along_axis(order, first, axis=1), -1)
    at = np.maximum(feature, 0)
    least, most = np.take_along_axis(low, at, axis=1), np.take_along_axis(high, at, axis=1)
    cut = least + np.take_along_axis(_uniform(_mix(cells)), at, axis=1) * (most - least)
    return feature, np.where(cut >= most, least, cut)


def _impurity(weight: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Gini impurity times weight."""
    return 2 * ones * (1 - np.divide(ones, weight, out=np.zeros_like(ones), where=weight > 0))


def best(
    feature: np.ndarray, total: np.ndarray, left: np.ndarray, per_leaf: int
) -> tuple[np.ndarray, np.ndarray]:
    """Place of the winning split of each node (-1: none) and what impurity it removes.

    ``total`` holds (rows, weight, weight of ones) per node, ``left`` the same per split.
    """
    right = total[:, None, :] - left
    fits = (feature >= 0) & (left[:, :, 0] >= per_leaf) & (right[:, :, 0] >= per_leaf)
    cost = _impurity(left[:, :, 1], left[:, :, 2]) + _impurity(right[:, :, 1], right[:, :, 2])
    cost = np.where(fits, cost, np.inf)
    place = cost.argmin(axis=1)
    lowest = np.take_along_axis(cost, place[:, None], axis=1)[:, 0]
    gain = _impurity(total[:, 1], total[:, 2]) - lowest
    found = np.isfinite(lowest)
    return np.where(found, place, -1), np.where(found, gain, 0.0)


def splittable(total: np.ndarray, depth: int, settings: Settings) -> np.ndarray:
    n, weight, ones = total.T
    enough = (n >= settings.per_node) & (n >= 2 * settings.per_leaf) & (depth < settings.deepest())
    return enough & (ones > 0) & (ones < weight)


# ------------------------------------------------------------------ one task's nodes


def _drawn(
    counts: np.ndarray, ones: np.ndarray, rows: np.ndarray, tree: int, settings: Settings
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries that take part in a tree, their weights and weights of ones."""
    if not settings.bootstrap:
        return np.arange(len(counts)), counts, ones
    weight = weights(settings, tree, rows)
    at = np.flatnonzero(weight > 0)
    return at, weight[at], weight[at] * ones[at]


def _rivals(
    flat: np.ndarray, at: np.ndarray, held: np.ndarray, keys: np.ndarray, width: int, count: int
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """What ``competing`` draws in each node, and which of its entries each threshold sends left.

    Entries stand node by node, ``held`` in each. Only the first ``count`` features are looked at, and
    later ones of nodes where none of these varies.
    """
    many = len(flat) // width
    cells = keys[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = _uniform(cells).argsort(axis=1, kind="stable")

    def look(nodes, k: int, at: np.ndarray, held: np.ndarray) -> tuple:
        own = order[nodes, k]
        value = flat.take(np.repeat(own * many, held) + at)
        first = np.cumsum(held) - held
        least, most = np.minimum.reduceat(value, first), np.maximum.reduceat(value, first)
        cut = least + _uniform(_mix(cells[nodes, own])) * (most - least)
        cut = np.where(cut >= most, least, cut)
        return np.where(most > least, own, -1), cut, value <= np.repeat(cut, held)

    looked = [look(np.arange(len(keys)), k, at, held) for k in range(count)]
    feature, cut = (np.stack([one[i] for one in looked], axis=1) for i in (0, 1))
    goes = [one[2] for one in looked]
    late = (feature < 0).all(axis=1)
    place, nodes = np.flatnonzero(np.repeat(late, held)), np.flatnonzero(late)
    for k in range(count, width):
        if not len(nodes):
            break
        own, edge, went = look(nodes, k, at[place], held[nodes])
        found = own >= 0
        feature[nodes[found], 0], cut[nodes[found], 0] = own[found], edge[found]
        done = np.repeat(found, held[nodes])
        goes[0][place[done]] = went[done]
        place, nodes = place[~done], nodes[~found]
    return feature, cut, goes


def finish(
    cols: np.ndarray, counts: np.ndarray, ones: np.ndarray, rows: np.ndarray,
    starts: Sequence[tuple[int, str]], settings: Settings,
) -> list[np.ndarray]:
    """The subtree of every (tree, path) whose node holds these entries, as arrays of ``NODE``.

    ``cols`` holds a line for each feature, ``counts`` the rows of an entry and ``ones`` those of 1.
    Within a level the left children come first, then the right ones; ``rank`` is a node's place
    beside its sibling.
    """
    keys = np.concatenate([node_key(settings.seed, tree, path) for tree, path in starts])
    depth, width = len(starts[0][1]), len(cols)
    flat, compete = cols.ravel(), settings.competing(width)
    drawn = [_drawn(counts, ones, rows, tree, settings) for tree, _ in starts]
    at, weight, hits = (np.concatenate([one[i] for one in drawn]) for i in range(3))
    size = np.array([len(one[0]) for one in drawn])
    sums = np.array([[one[1].sum(), one[2].sum()] for one in drawn])
    del drawn
    total = np.column_stack([size if settings.bootstrap else sums[:, 0], sums]).astype(float)
    owner = rank = np.arange(len(starts))
    open_ = splittable(total, depth, settings)
    kept = np.repeat(open_, size)
    at, weight, hits = at[kept], weight[kept], hits[kept]
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    while len(keys):
        made = np.zeros(len(keys), dtype=NODE)
        made["feature"], made["left"], made["n"], made["depth"] = -1, -1, total[:, 0], depth
        made["share"] = np.divide(total[:, 2], total[:, 1], out=np.zeros(len(keys)), where=total[:, 1] > 0)
        inside = np.flatnonzero(open_)
        if not len(inside):
            levels.append((owner[np.argsort(rank)], made[np.argsort(rank)]))
            break
        held, whole = size[inside], total[inside]
        first = np.cumsum(held) - held
        feature, cut, goes = _rivals(flat, at, held, keys[inside], width, compete)
        left = np.empty((*feature.shape, 3))
        for k, went in enumerate(goes):
            left[:, k, 1] = np.add.reduceat(weight * went, first)
            left[:, k, 2] = np.add.reduceat(hits * went, first)
            left[:, k, 0] = np.add.reduceat(went.view(np.int8), first, dtype=np.int64) if settings.bootstrap else left[:, k, 1]
        place, gain = best(feature, whole, left, settings.per_leaf)
        split = place >= 0
        parents, taken = inside[split], np.maximum(place, 0)[:, None]
        made["feature"][parents] = np.take_along_axis(feature, taken, axis=1)[split, 0]
        made["cut"][parents] = np.take_along_axis(cut, taken, axis=1)[split, 0]
        made["gain"][parents] = gain[split]
        levels.append((owner[np.argsort(rank)], made[np.argsort(rank)]))
        went = goes[0]
        for k in range(1, len(goes)):
            np.copyto(went, goes[k], where=np.repeat(place == k, held))
        del goes
        below = left[np.arange(len(place)), taken[:, 0]][split]
        total = np.concatenate([below, whole[split] - below])
        keys = np.concatenate([child_keys(keys[parents], 0), child_keys(keys[parents], 1)])
        owner = np.concatenate([owner[parents], owner[parents]])
        pair = 2 * np.argsort(np.argsort(rank[parents]))
        rank = np.concatenate([pair, pair + 1])
        depth += 1
        open_ = splittable(total, depth, settings)
        stays = np.zeros((2, len(split)), dtype=bool)
        stays[:, split] = open_.reshape(2, -1)
        sent = np.add.reduceat(went.view(np.int8), first, dtype=np.int64)
        size = np.concatenate([sent[split], (held - sent)[split]])
        kept = np.concatenate(
            [np.flatnonzero(went & np.repeat(stays[0], held)), np.flatnonzero(~went & np.repeat(stays[1], held))]
        )
        at, weight, hits = at[kept], weight[kept], hits[kept]
    return _by_owner(levels, len(starts))


def _by_owner(levels: list[tuple[np.ndarray, np.ndarray]], count: int) -> list[np.ndarray]:
    """Every start's nodes, level after level, with places of left children; the right one is next."""
    parts: list[list[np.ndarray]] = [[] for _ in range(count)]
    size = np.zeros(count, dtype=np.int64)
    for owner, made in levels:
        bounds = np.searchsorted(owner, np.arange(count + 1))  # owners stay in order
        for i in range(count):
            own = made[bounds[i] : bounds[i + 1]]
            if len(own):
                size[i] += len(own)
                split = own["feature"] >= 0
                own["left"][split] = size[i] + 2 * np.arange(split.sum())
                parts[i].append(own)
    return [np.concatenate(p) for p in parts]


def leaf_shares(nodes: np.ndarray, per_node: Sequence[int]) -> np.ndarray:
    """For every node and every ``per_node``, the share of the first node from the root that stops there."""
    found = np.repeat(nodes["share"][:, None], len(per_node), axis=1)
    if max(per_node) <= 2:
        return found
    stopped = nodes["n"][:, None] < np.asarray(per_node)
    level = np.zeros(1, dtype=np.int64)
    while len(level):
        level = level[nodes["left"][level] >= 0]
        for side in (0, 1):
            kids = nodes["left"][level] + side
            found[kids] = np.where(stopped[level], found[level], found[kids])
            stopped[kids] |= stopped[level]
        level = np.concatenate([nodes["left"][level], nodes["left"][level] + 1])
    return found


def leaves(nodes: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The leaf of every row; ``cols`` holds a line for each feature."""
    left, feature, cut = (np.ascontiguousarray(nodes[name]) for name in ("left", "feature", "cut"))
    at, going = np.zeros(cols.shape[1], dtype=np.int64), np.arange(cols.shape[1])
    while len(going):
        own = at[going]
        split = left[own] >= 0
        going, own = going[split], own[split]
        at[going] = left[own] + (cols[feature[own], going] > cut[own])
    return at


def summed_shares(
    cols: np.ndarray, known: dict[tuple, tuple], above: dict[tuple, tuple], upto: Sequence[int], kinds: int
) -> np.ndarray:
    """(number of trees, kind, row): the shares of each row's leaves, summed over the known subtrees.

    ``known`` holds nodes and the shares of each kind by (tree, path), ``above`` the splits on the way there.
    """
    found = np.zeros((len(upto), kinds, cols.shape[1]))
    for tree in sorted({tree for tree, _ in known}):
        waiting = [("", np.arange(cols.shape[1]))]
        while waiting:
            path, rows = waiting.pop()
            if (tree, path) in known:
                nodes, shares = known[tree, path]
                own = shares[leaves(nodes, cols[:, rows])].T
                for i, count in enumerate(upto):
                    if tree < count:
                        found[i][:, rows] += own
            elif (tree, path) in above and len(rows):
                feature, cut = above[tree, path]
                goes = cols[feature, rows] <= cut
                waiting += [(path + "0", rows[goes]), (path + "1", rows[~goes])]
    return found


# ------------------------------------------------------------------ DataFrames


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _coded(cols: np.ndarray, bits: np.ndarray) -> bytes:
    """Lines of values, one byte a value where ``bits`` says that a line holds 0 and 1 only."""
    return bits.tobytes() + cols[bits].astype(np.uint8).tobytes() + cols[~bits].tobytes()


def _decode(coded: bytes, into: np.ndarray) -> np.ndarray:
    """Fill the lines of ``into``, and which of them hold 0 and 1 only."""
    width, many = into.shape
    bits = np.frombuffer(coded, bool, width)
    small = int(bits.sum()) * many
    into[bits] = np.frombuffer(coded, np.uint8, small, width).reshape(-1, many)
    into[~bits] = np.frombuffer(coded, np.float64, (width * many) - small, width + small).reshape(-1, many)
    return bits


#: Entries in one row, so that neither a shuffle nor Arrow handles them one by one.
_BLOCK = "size int, width int, rows binary, counts binary, ones binary, x binary"
_BLOCK_NAMES = ["size", "width", "rows", "counts", "ones", "x"]
_BLOCK_ROWS = 1 << 16


def _block(rows: np.ndarray, counts: np.ndarray, ones: np.ndarray, cols: np.ndarray, bits: np.ndarray) -> list[pa.Array]:
    one = lambda data: pa.array([data], pa.binary())
    numbers = [one(np.ascontiguousarray(part).tobytes()) for part in (rows, counts, ones)]
    return [pa.array([cols.shape[1]], pa.int32()), pa.array([len(cols)], pa.int32()), *numbers, one(_coded(cols, bits))]


def _blocks(plain: DataFrame, settings: Settings) -> DataFrame:
    """The rows (y, x) in blocks; without a bootstrap equal features are one entry with its counts.

    A bootstrap draws by row numbers in the order of features and label, so equal tables give equal forests.
    """
    if settings.bootstrap:
        entries = row_index(plain, ["x", "y"], "row").select("row", F.lit(1.0).alias("n"), F.col("y").alias("ones"), "x")
    else:
        counted = plain.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("ones"))
        entries = counted.select(F.lit(0).cast("long").alias("row"), "n", "ones", "x")
    entries = entries.withColumn("x", F.transform("x", lambda v: v.cast("double")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            rows, counts, ones = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("row", "n", "ones"))
            cols = np.concatenate([_matrix(b.column("x")) for b in held]).T
            bits = ((cols == 0) | (cols == 1)).all(axis=1)
            return pa.RecordBatch.from_arrays(
                _block(rows if settings.bootstrap else rows[:0], counts, ones, cols, bits), _BLOCK_NAMES
            )

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= _BLOCK_ROWS:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    return entries.mapInArrow(run, _BLOCK)


def _entries(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(lines of values, which hold 0 and 1 only, counts, ones, row numbers) of all blocks of a table."""
    sizes = table.column("size").to_pylist()
    cols = np.empty((table.column("width")[0].as_py(), sum(sizes)))
    bits, end = np.ones(len(cols), dtype=bool), 0
    for size, coded in zip(sizes, table.column("x")):
        bits &= _decode(coded.as_buffer(), cols[:, end : end + size])
        end += size
    kinds = (("counts", np.float64), ("ones", np.float64), ("rows", np.int64))
    numbers = (np.concatenate([np.frombuffer(c.as_buffer(), kind) for c in table.column(name)]) for name, kind in kinds)
    return cols, bits, *numbers


def _finished(small: DataFrame, settings: Settings) -> DataFrame:
    """(tree, path, nodes): trees ``first`` to ``last`` - 1 from the blocks of their common entries at a path."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        first, last, path = key[0].as_py(), key[1].as_py(), key[2].as_py()
        cols, _, *numbers = _entries(table)
        del table
        made, step = [], max(1, _ENTRIES // max(1, cols.shape[1]))
        for at in range(first, last, step):
            starts = [(tree, path) for tree in range(at, min(last, at + step))]
            made += [one.tobytes() for one in finish(cols, *numbers, starts, settings)]
        return pa.table(
            {
                "tree": pa.array(range(first, last), pa.int32()),
                "path": pa.array([path] * len(made), pa.string()),
                "nodes": pa.array(made, pa.binary()),
            }
        )

    return small.groupBy("first", "last", "path").applyInArrow(run, "tree int, path string, nodes binary")


def _walked(
    cols: np.ndarray, drawn: Callable[[int], tuple[np.ndarray, ...]], tops: Sequence[np.ndarray], marks: Sequence[np.ndarray]
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(tree, mark, entries, weights, weights of ones) of each tree's marked nodes; ``drawn`` gives a tree's entries.

    Marked nodes are leaves of the top; branches without one are not walked.
    """
    for tree, nodes in enumerate(tops):
        if marks[tree].max() < 0:
            continue
        left, sought = nodes["left"], marks[tree] >= 0
        for at in range(len(nodes) - 1, -1, -1):  # children come after their parent
            if left[at] >= 0:
                sought[at] = sought[left[at]] or sought[left[at] + 1]
        own, weight, hits = drawn(tree)
        waiting = [(0, np.arange(len(own)))] if len(own) else []
        while waiting:
            at, inside = waiting.pop()
            if marks[tree][at] >= 0:
                yield tree, int(marks[tree][at]), own[inside], weight[inside], hits[inside]
                continue
            goes = cols[nodes["feature"][at]][own[inside]] <= nodes["cut"][at]
            for kid, side in ((left[at], goes), (left[at] + 1, ~goes)):
                if sought[kid] and side.any():
                    waiting.append((kid, inside[side]))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block at a time."""
    return (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows))


def _extremes(
    blocks: DataFrame, tops: Sequence[np.ndarray], marks: Sequence[np.ndarray], settings: Settings, asked: np.ndarray
) -> DataFrame:
    """(node, n, w, w1, e, l0.., h0..): counts, weights, entries, extremes of the asked features of marked nodes."""
    names = ["n", "w", "w1", "e", *[f"l{i}" for i in range(asked.shape[1])], *[f"h{i}" for i in range(asked.shape[1])]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(asked), 4))
        low, high = np.full(asked.shape, np.inf), np.full(asked.shape, -np.inf)
        for block in _each(batches):
            cols, _, *numbers = _entries(block)
            draw = lambda tree: _drawn(*numbers, tree, settings)  # noqa: B023, E731
            for _, mark, own, weight, hits in _walked(cols, draw, tops, marks):
                n = len(own) if settings.bootstrap else weight.sum()
                total[mark] += n, weight.sum(), hits.sum(), len(own)
                for k, feature in enumerate(asked[mark]):
                    value = cols[feature][own]
                    low[mark, k], high[mark, k] = min(low[mark, k], value.min()), max(high[mark, k], value.max())
        yield _node_rows(np.hstack([total, low, high]), total[:, 0] > 0, names)

    made = blocks.mapInArrow(run, ", ".join(["node long", *[f"{n} double" for n in names]]))
    part = {"l": F.min, "h": F.max}
    return made.groupBy("node").agg(*[part.get(n[0], F.sum)(n).alias(n) for n in names])


def _sides(
    blocks: DataFrame, tops: Sequence[np.ndarray], marks: Sequence[np.ndarray], settings: Settings,
    feature: np.ndarray, cut: np.ndarray,
) -> DataFrame:
    """(node, s0..): rows, weight, weight of ones and entries that every competing split of a node sends left."""
    names = [f"s{i}" for i in range(4 * feature.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = np.zeros((*feature.shape, 4))
        for block in _each(batches):
            cols, _, *numbers = _entries(block)
            draw = lambda tree: _drawn(*numbers, tree, settings)  # noqa: B023, E731
            for _, mark, own, weight, hits in _walked(cols, draw, tops, marks):
                for k in np.flatnonzero(feature[mark] >= 0):
                    goes = cols[feature[mark, k]][own] <= cut[mark, k]
                    sent = weight[goes].sum()
                    left[mark, k] += goes.sum() if settings.bootstrap else sent, sent, hits[goes].sum(), goes.sum()
        left = left.reshape(len(left), -1)
        yield _node_rows(left, left.any(axis=1), names)

    made = blocks.mapInArrow(run, ", ".join(["node long", *[f"{n} double" for n in names]]))
    return made.groupBy("node").agg(*[F.sum(n).alias(n) for n in names])


def _node_rows(table: np.ndarray, kept: np.ndarray, names: Sequence[str]) -> pa.RecordBatch:
    columns = [pa.array(np.flatnonzero(kept)), *[pa.array(column) for column in table[kept].T]]
    return pa.RecordBatch.from_arrays(columns, ["node", *names])


def _by_node(summed: DataFrame, count: int) -> np.ndarray:
    """One short row for each node above a task's share, 0 where no task had any."""
    found = np.zeros((count, len(summed.columns) - 1))
    for row in summed.collect():
        found[row[0]] = row[1:]
    return found


def _node_extremes(
    blocks: DataFrame, tops: Sequence[np.ndarray], marks: Sequence[np.ndarray], settings: Settings,
    keys: np.ndarray, width: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and extremes of the marked nodes; features that can't compete in a node have none."""
    cells = keys[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    asked = _uniform(cells).argsort(axis=1, kind="stable")[:, : settings.competing(width)]
    found = _by_node(_extremes(blocks, tops, marks, settings, asked), len(keys))
    total, count = found[:, :4], asked.shape[1]
    low, high = np.zeros((2, len(keys), width))
    np.put_along_axis(low, asked, found[:, 4 : 4 + count], axis=1)
    np.put_along_axis(high, asked, found[:, 4 + count :], axis=1)
    late = ~(high > low).any(axis=1)
    if late.any() and count < width:  # none of the first ones varies: the others of these nodes too
        rest = [np.where((m >= 0) & late[m], m, -1) for m in marks]
        every = np.tile(np.arange(width), (len(keys), 1))
        found = _by_node(_extremes(blocks, tops, rest, settings, every), len(keys))
        low[late], high[late] = found[late, 4 : 4 + width], found[late, 4 + width :]
    return total, low, high


def _tops(blocks: DataFrame, settings: Settings, width: int, share: int) -> tuple[list, list, list, list, list]:
    """Splits (tree, path, feature, cut, gain), leaves (tree, path, n, share), and every tree's top.

    A top is the nodes above ``share`` entries and their children; with it come the paths of its nodes
    and, for those that a task is to finish, a mark. It is all that a level keeps: the next one walks the
    rows down it again, so no row is stored for a tree.
    """
    root = np.zeros(1, dtype=NODE)
    root["feature"] = root["left"] = -1
    tops, paths = [root.copy() for _ in range(settings.trees)], [[""] for _ in range(settings.trees)]
    splits, whole, gone = [], [], set()
    waiting = [(tree, 0) for tree in range(settings.trees)]
    while waiting:
        marks = [np.full(len(nodes), -1) for nodes in tops]
        for i, (tree, at) in enumerate(waiting):
            marks[tree][at] = i
        own = [paths[tree][at] for tree, at in waiting]
        keys = np.concatenate([node_key(settings.seed, tree, path) for (tree, _), path in zip(waiting, own)])
        total, low, high = _node_extremes(blocks, tops, marks, settings, keys, width)
        feature, cut = competing(keys, low, high, settings.competing(width))
        feature[~splittable(total[:, :3], len(own[0]), settings)] = -1
        left = _by_node(_sides(blocks, tops, marks, settings, feature, cut), len(waiting)).reshape(*feature.shape, 4)
        place, gain = best(feature, total[:, :3], left[..., :3], settings.per_leaf)
        made, opened = [[nodes] for nodes in tops], []
        for i, (tree, at) in enumerate(waiting):
            gone.add((tree, at))
            n, ones = int(total[i, 0]), total[i, 2] / total[i, 1] if total[i, 1] else 0.0
            if place[i] < 0:
                whole += [(tree, own[i], n, float(ones))] if n else []
                continue
            k = place[i]
            splits.append((tree, own[i], int(feature[i, k]), float(cut[i, k]), float(gain[i])))
            kids = len(paths[tree])
            tops[tree]["feature"][at], tops[tree]["cut"][at], tops[tree]["left"][at] = feature[i, k], cut[i, k], kids
            made[tree] += [root, root]
            paths[tree] += [own[i] + "0", own[i] + "1"]
            sizes = left[i, k, 3], total[i, 3] - left[i, k, 3]
            opened += [(tree, kids + side) for side in (0, 1) if sizes[side] > share]
        tops, waiting = [np.concatenate(parts) for parts in made], opened
    marks = [np.array([-1 if (tree, at) in gone else at for at in range(len(p))]) for tree, p in enumerate(paths)]
    return splits, whole, tops, paths, marks


def _small(
    blocks: DataFrame, tops: Sequence[np.ndarray], paths: Sequence[Sequence[str]], marks: Sequence[np.ndarray],
    settings: Settings,
) -> DataFrame:
    """(first, last, path, block): every tree's entries at the nodes below its top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _each(batches):
            cols, bits, counts, ones, rows = _entries(block)
            draw = lambda tree: _drawn(counts, ones, rows, tree, settings)  # noqa: B023, E731
            for tree, at, own, _, _ in _walked(cols, draw, tops, marks):
                sent = _block(rows[own] if settings.bootstrap else rows, counts[own], ones[own], cols.take(own, axis=1), bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree], pa.int32()), pa.array([tree + 1], pa.int32()), pa.array([paths[tree][at]]), *sent],
                    ["first", "last", "path", *_BLOCK_NAMES],
                )

    return blocks.mapInArrow(run, f"first int, last int, path string, {_BLOCK}")


def _at_node(active: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows with what is known of their node.

    The nodes are sent to the rows, never the other way: a node of a level has more than
    ``group_rows`` rows, so they are few, while the size that Spark expects of the checkpointed rows
    is that of the table they were drawn from.
    """
    return active.join(F.broadcast(nodes), ["tree", "path"])


def _moved(active: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of split nodes at the children, with the children's row counts."""
    goes = F.get("x", "feature") <= F.col("cut")
    return _at_node(active, chosen.where("feature >= 0")).select(
        "tree", F.concat("path", F.when(goes, "0").otherwise("1")).alias("path"), "row", "y", "w", "x",
        F.when(goes, F.col("n_left")).otherwise(F.col("n") - F.col("n_left")).alias("size"),
    )


def _leaf_nodes(chosen: DataFrame) -> DataFrame:
    """(tree, path, nodes) of the nodes that stay whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.zeros(batch.num_rows, dtype=NODE)
            made["feature"] = made["left"] = -1
            made["n"], made["share"] = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            made["depth"] = [len(p) for p in batch.column(1).to_pylist()]
            coded = pa.array([one.tobytes() for one in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), coded], ["tree", "path", "nodes"])

    leaf = chosen.where("feature < 0").select("tree", "path", "n", "share")
    return leaf.mapInArrow(run, "tree int, path string, nodes binary")


TOP = "tree int, path string, feature int, cut double, gain double"


def grow(df: DataFrame, settings: Settings, label: str = LABEL) -> tuple[DataFrame, DataFrame]:
    """(tops, subtrees) of a forest: split nodes above the subtrees, and the subtrees."""
    spark = df.sparkSession
    plain = df.select(F.col(label).cast("double").alias("y"), vector_to_array("features").alias("x"))
    blocks = cut_lineage(_blocks(plain, settings))
    total, width = blocks.agg(F.sum("size"), F.max("width")).first()
    tops = spark.createDataFrame([], TOP)
    if not total:
        return tops, spark.createDataFrame([], "tree int, path string, nodes binary")
    share = settings.group_rows or max(1, _GROUP_BYTES // (8 * width))
    if total <= share:  # all trees start from few rows: each task grows a run of trees
        tasks = min(settings.trees, 2 * spark.sparkContext.defaultParallelism)
        cuts = [i * settings.trees // tasks for i in range(tasks + 1)]
        runs = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in zip(cuts, cuts[1:])])
        small = blocks.select(F.explode(runs).alias("run"), F.lit("").alias("path"), *_BLOCK_NAMES)
        return tops, cut_lineage(_finished(small.select("run.*", "path", *_BLOCK_NAMES), settings))
    splits, whole, *below = _tops(blocks, settings, width, share)
    made = _finished(_small(blocks, *below, settings), settings)
    if whole:
        leaf = spark.createDataFrame(whole, "tree int, path string, n long, share double").withColumn("feature", F.lit(-1))
        made = made.unionByName(_leaf_nodes(leaf))
    return spark.createDataFrame(splits, TOP), cut_lineage(made)


_SCORED = "block long, size int, width int, at binary, x binary"


def _scored_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (number, x) in blocks that are named after their first row."""
    for batch in batches:
        if batch.num_rows:
            at, cols = batch.column(0).to_numpy(), _matrix(batch.column(1)).T
            bits = ((cols == 0) | (cols == 1)).all(axis=1)
            size, width = (pa.array([n], pa.int32()) for n in reversed(cols.shape))
            data = (pa.array([one], pa.binary()) for one in (at.tobytes(), _coded(cols, bits)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(at[0])]), size, width, *data], ["block", "size", "width", "at", "x"]
            )


def _known(held, per_node: Sequence[int]) -> dict[tuple, tuple]:
    """Nodes and shares of the subtrees by their place."""
    nodes = {at: np.frombuffer(coded, NODE) for at, coded in held}
    return {at: (own, leaf_shares(own, per_node)) for at, own in nodes.items()}


class ExtraTrees(Estimator):
    """``fit`` grows the forest that the settings name."""

    def __init__(self, settings: Settings = Settings(), label: str = LABEL):
        super().__init__()
        self.settings, self.label = settings, label

    def with_(self, **changed) -> ExtraTrees:
        return ExtraTrees(replace(self.settings, **changed), self.label)

    def _fit(self, dataset: DataFrame) -> ForestModel:
        return ForestModel(self.settings, *grow(dataset, self.settings, self.label))


class ForestModel(Model, MLWritable, MLReadable):
    """The trees as two tables; rows are scored by bounded runs of trees."""

    def __init__(self, settings: Settings, tops: DataFrame, subtrees: DataFrame):
        super().__init__()
        self.settings, self.tops, self.subtrees = settings, tops, subtrees

    def depth(self) -> int:
        """Depth of the deepest node."""

        @F.pandas_udf("int")
        def deepest(nodes: pd.Series) -> pd.Series:
            return pd.Series([int(np.frombuffer(n, NODE)["depth"].max()) for n in nodes])

        return self.subtrees.agg(F.max(deepest("nodes"))).first()[0] or 0

    def importances(self, width: int) -> list[float]:
        """Impurity removed by each feature, as a share of its tree's, averaged over trees."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for tree, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = np.frombuffer(nodes, NODE)
                    own = own[own["feature"] >= 0]
                    gain = np.bincount(own["feature"], own["gain"], width).astype(float)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tree] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array(gain)],
                        ["tree", "feature", "gain"],
                    )

        below = self.subtrees.select("tree", "nodes").mapInArrow(run, "tree int, feature int, gain double")
        both = below.unionByName(self.tops.select("tree", "feature", "gain"))
        gains = both.groupBy("tree", "feature").agg(F.sum("gain").alias("gain")).collect()  # trees x width
        table = np.zeros((self.settings.trees, width))
        for tree, feature, gain in gains:
            table[tree, feature] = gain
        whole = table.sum(axis=1)
        shares = table[whole > 0] / whole[whole > 0][:, None]
        return (shares.mean(axis=0) if len(shares) else np.zeros(width)).tolist()

    def _chunks(self) -> Iterator[tuple[list[tuple[int, str]], int]]:
        """The places of runs of subtrees of at most CHUNK_BYTES, or of one subtree, and their bytes."""
        sized = self.subtrees.select("tree", "path", F.octet_length("nodes").alias("b"))
        run, size = [], 0
        for tree, path, own in sorted(map(tuple, sized.collect())):  # one short row for a task's share of a tree
            if run and size + own > CHUNK_BYTES:
                yield run, size
                run, size = [], 0
            run.append((tree, path))
            size += own
        if run:
            yield run, size

    def votes(
        self, df: DataFrame, name: str, upto: Sequence[int] | None = None, per_node: Sequence[int] = (2,)
    ) -> DataFrame:
        """Add an array: for each number of trees in ``upto``, and in it each ``per_node``, the summed shares of 1.

        A forest of one small run is sent to the rows. Of others, each task holds one run and scores some
        rows with it, so no tree comes to the driver; the sums of the runs meet by blocks of rows.
        """
        upto, per_node = sorted(upto or [self.settings.trees]), list(per_node)
        runs = list(self._chunks())
        if not runs:
            return df.withColumn(name, F.array_repeat(F.lit(0.0), len(upto) * len(per_node)))
        above = {(r["tree"], r["path"]): (r["feature"], r["cut"]) for r in self.tops.collect()}  # as _tops held them
        if len(runs) == 1 and runs[0][1] <= SENT_BYTES:
            return self._sent(df, name, above, upto, per_node)
        return self._met(df, name, [run for run, _ in runs], above, upto, per_node)

    def _sent(self, df: DataFrame, name: str, above: dict, upto: list[int], per_node: list[int]) -> DataFrame:
        held = {(r["tree"], r["path"]): bytes(r["nodes"]) for r in self.subtrees.collect()}
        sent = df.sparkSession.sparkContext.broadcast((held, above))

        @F.pandas_udf("array<double>")
        def voted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            held, above = sent.value
            known = _known(held.items(), per_node)
            for values in batches:
                cols = np.array(values.tolist(), dtype=float).reshape(len(values), -1).T
                found = summed_shares(np.ascontiguousarray(cols), known, above, upto, len(per_node))
                yield pd.Series(list(found.reshape(-1, len(values)).T.tolist()))

        return df.withColumn(name, voted(vector_to_array("features")))

    def _met(
        self, df: DataFrame, name: str, runs: list[list[tuple[int, str]]], above: dict, upto: list[int],
        per_node: list[int],
    ) -> DataFrame:
        spark = df.sparkSession
        rows = cut_lineage(df.withColumn("_at", F.monotonically_increasing_id()))
        blocks = rows.select("_at", vector_to_array("features").alias("x")).mapInArrow(_scored_blocks, _SCORED)
        bytes_ = 8 * rows.count() * len((rows.select("features").first() or [[]])[0])
        parts = max(-(-bytes_ // _GROUP_BYTES), -(-2 * spark.sparkContext.defaultParallelism // len(runs)))
        every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        seekers = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")).withColumn("run", every(len(runs)))
        places = [(tree, path, i) for i, run in enumerate(runs) for tree, path in run]
        named = spark.createDataFrame(places, "tree int, path string, run int")
        trees = self.subtrees.join(F.broadcast(named), ["tree", "path"]).withColumn("part", every(parts))
        sent = spark.sparkContext.broadcast(above)
        schema = "block long, run int, at binary, votes binary"

        def score(key: tuple, blocks: pa.Table, trees: pa.Table) -> pa.Table:
            run, made = key[0].as_py(), []
            held = zip(zip(trees.column("tree").to_pylist(), trees.column("path").to_pylist()), trees.column("nodes"))
            known = _known(((at, nodes.as_buffer()) for at, nodes in held), per_node)
            for block in _each([blocks]):
                cols = np.empty((block.column("width")[0].as_py(), block.column("size")[0].as_py()))
                _decode(block.column("x")[0].as_buffer(), cols)
                found = summed_shares(cols, known, sent.value, upto, len(per_node))
                at = block.column("at")[0].as_py() if run == 0 else None  # the rows' numbers go along once
                made.append((block.column("block")[0].as_py(), run, at, found.tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            parts = [pa.array(part, kind) for part, kind in zip(zip(*made) if made else [[]] * 4, kinds)]
            return pa.table(parts, ["block", "run", "at", "votes"])

        def add(table: pa.Table) -> pa.Table:
            table = table.sort_by("run")  # so that sums don't depend on the tasks
            at = np.frombuffer(table.column("at")[0].as_buffer(), np.int64)
            total = sum(np.frombuffer(one.as_buffer()) for one in table.column("votes")).reshape(-1, len(at))
            ends = pa.array(np.arange(0, total.size + 1, len(total), dtype=np.int32))
            return pa.table([pa.array(at), pa.ListArray.from_arrays(ends, pa.array(total.T.ravel()))], ["_at", name])

        scored = seekers.groupBy("run", "part").cogroup(trees.groupBy("run", "part")).applyInArrow(score, schema)
        whole = cut_lineage(scored.groupBy("block").applyInArrow(add, f"_at long, `{name}` array<double>"))
        sent.destroy()
        return rows.join(whole, "_at").select(*df.columns, name)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds ``prediction``: 1.0 where the mean share of 1 is above a half."""
        counted = self.votes(dataset, "_votes")
        share = F.col("_votes")[0] / self.settings.trees
        return counted.withColumn("prediction", (share > 0.5).cast("double")).drop("_votes")

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.model.subtrees.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark, extraMetadata={"settings": asdict(self.model.settings)})
        self.model.tops.write.parquet(f"{path}/tops")
        self.model.subtrees.write.parquet(f"{path}/subtrees")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        spark = self.sparkSession
        found = DefaultParamsReader.loadMetadata(path, spark)
        tables = [spark.read.parquet(f"{path}/{name}") for name in ("tops", "subtrees")]
        return ForestModel(Settings(**found["settings"]), *tables)
