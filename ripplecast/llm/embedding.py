"""Near-duplicate vectors: p-stable hashing for the Euclidean distance, then exact cosines.

Unit vectors with a cosine of 0.98 lie 0.2 apart. A table hashes a vector to the steps
``floor((a . v + b) / WIDTH)`` of ``STEPS`` Gaussian projections; at that distance one step agrees
with a probability of 0.920 and a table with 0.264, so a pair is missed by all ``TABLES`` tables
with a probability of 4e-8. Only vectors of equal label meet in a bucket.

Equal vectors of a label are one class with a count. Buckets of one class are dropped by their
count before any vector moves. A bucket is cut into blocks of at most ``BLOCK`` classes, and a
task compares two blocks at a time, so a large bucket never meets whole. A pair is counted in the
first table where it shares a bucket; of the pairs found, only sums and the edges of a spanning
forest leave the task.

Edge cases: a vector that is null, empty or zero, holds null or non-finite components, or has no
label links with nothing and is kept; vectors of different lengths are not compared; rows that
repeat an id are separate vectors; a null id takes part, and its component is the smallest known
id; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplecast.llm.common import components, stored
from ripplecast.llm.words import mix

TABLES, STEPS, WIDTH = 56, 16, 2.0
BLOCK = 1024


@functools.lru_cache(maxsize=4)
def _projections(length: int, tables: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and offsets, the same in every task."""
    random = np.random.default_rng([length, tables, steps])
    return random.standard_normal((length, tables * steps)), random.uniform(0, WIDTH, tables * steps)


def bucket_codes(unit: np.ndarray, tables: int = TABLES, steps: int = STEPS) -> np.ndarray:
    """A 64-bit code of every vector (a row) in every table (a column)."""
    directions, offsets = _projections(unit.shape[1], tables, steps)
    step = np.floor((unit @ directions + offsets) / WIDTH).astype(np.int64).view(np.uint64)
    step = step.reshape(len(unit), tables, steps)
    code = np.tile(mix(np.arange(1, tables + 1, dtype=np.uint64)), (len(unit), 1))
    for k in range(steps):
        code = mix(code + step[:, :, k])
    return code


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors, in double precision, of a batch of lists of equal length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = flat.reshape(len(column), -1)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither over- nor underflow
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    lengths = np.diff(batch.column(column).offsets.to_numpy())
    for length in np.unique(lengths):
        yield batch.filter(pa.array(lengths == length))


def _bucketed(classes: DataFrame) -> DataFrame:
    """(bucket, t, class) for every table t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                for batch in _by_length(whole.slice(at, 2048), 2):
                    code = bucket_codes(_matrix(batch.column(2)))
                    label = mix(batch.column(1).to_numpy().view(np.uint64))
                    length = np.uint64(len(batch.column(2)[0]))
                    key = mix(code + label[:, None] + length).view(np.int64)
                    own = np.repeat(batch.column(0).to_numpy(), key.shape[1])
                    number = np.tile(np.arange(key.shape[1], dtype=np.int32), len(key))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.ravel()), pa.array(number), pa.array(own)], ["bucket", "t", "class"]
                    )

    rows = classes.select("class", F.xxhash64("label").alias("label"), "embedding")
    return rows.mapInArrow(run, "bucket long, t int, class long")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of equal (bucket, i, j), and the starts of the groups in them."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        keys = [table.column(n).to_numpy() for n in ("bucket", "i", "j")]
        changed = np.logical_or.reduce([key[1:] != key[:-1] for key in keys])
        return np.concatenate([[0], np.flatnonzero(changed) + 1])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        starts = cut(table)
        if len(starts) > 1:  # the last group may go on
            yield table.slice(0, starts[-1]), starts[:-1]
            held = table.slice(starts[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, cut(table)


def _pairs(starts: np.ndarray, total: int, block: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows to compare: all pairs of small groups together, large ones by blocks."""
    sizes = np.diff(starts, append=total)
    cross = i[starts] != j[starts]
    for size in np.unique(sizes[(sizes <= 64) & ~cross]):
        a, b = np.triu_indices(size, 1)
        chosen = starts[(sizes == size) & ~cross]
        for at in range(0, len(chosen), max(1, 200_000 // max(1, len(a)))):
            some = chosen[at : at + max(1, 200_000 // max(1, len(a)))]
            yield (some[:, None] + a).ravel(), (some[:, None] + b).ravel()
    for start, size, apart in zip(starts, sizes, cross):
        if size <= 64 and not apart:
            continue
        place = np.arange(start, start + size)
        left = place[block[place] == i[start]]
        right = place[block[place] == j[start]]
        for row in range(0, len(left), 128):
            part = left[row : row + 128]
            a, b = np.repeat(part, len(right)), np.tile(right, len(part))
            if not apart:
                a, b = a[a < b], b[a < b]
            yield a, b


def _merge(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each place, with the links x-y added."""
    while True:
        fresh = root.copy()
        low = np.minimum(root[x], root[y])
        for ends in (x, y, root[x], root[y]):
            np.minimum.at(fresh, ends, low)
        fresh = fresh[fresh]
        if (fresh == root).all():
            return root
        root = fresh


def _linked(groups: DataFrame, least: float) -> DataFrame:
    """(a, b, links): sums of the counts of linked classes (b null), and edges (links 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _grouped(batches):
            ids, row_of = np.unique(table.column("class").to_numpy(), return_inverse=True)
            count, number = table.column("n").to_numpy(), table.column("t").to_numpy()
            block, i, j = (table.column(name).to_numpy() for name in ("block", "i", "j"))
            unit = _matrix(table.column("embedding").combine_chunks())
            codes, known = np.zeros((len(unit), TABLES), dtype=np.uint64), np.zeros(len(unit), dtype=bool)
            links, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
            for a, b in _pairs(starts, len(unit), block, i, j):
                near = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
                a, b = a[near], b[near]
                rows = np.unique(np.concatenate([a, b]))
                rows = rows[~known[rows]]
                for some in np.array_split(rows, len(rows) // 2048 + 1):
                    codes[some] = bucket_codes(unit[some])
                known[rows] = True
                for earlier in range(int(number[a].max(initial=0))):  # counted there
                    again = (number[a] > earlier) & (codes[a, earlier] == codes[b, earlier])
                    a, b = a[~again], b[~again]
                if len(a):
                    np.add.at(links, row_of[a], count[b])
                    np.add.at(links, row_of[b], count[a])
                    root = _merge(root, row_of[a], row_of[b])
            summed, tied = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids[summed], ids[tied]]), pa.int64()),
                    pa.array([None] * len(summed) + ids[root[tied]].tolist(), pa.int64()),
                    pa.array(np.concatenate([links[summed], np.zeros(len(tied), np.int64)])),
                ],
                ["a", "b", "links"],
            )

    return groups.mapInArrow(run, "a long, b long, links long")


def link(
    vectors: DataFrame,
    least: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector."""
    values = F.col("embedding")
    size = lambda x: F.abs(x.cast("double"))
    known = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (size(x) < float("inf")))
    finite = F.coalesce(known & F.exists(values, lambda x: size(x) > 0), F.lit(False))
    named = vectors.select(
        F.col(id_col).alias("vec_id"),
        F.col(label_col).alias("label"),
        F.col(vector_col).alias("embedding"),
    ).withColumn("class", F.when(finite & F.col("label").isNotNull(), F.xxhash64("label", "embedding")))
    rows = stored(named, "vectors")
    classes = (
        rows.where("class is not null")
        .groupBy("class")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("label", "embedding")).alias("one"))
        .select("class", "n", "one.label", "one.embedding")
    )
    entries = stored(_bucketed(classes), "entries")
    several = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("class", "bucket"), blocks).cast("int")
    met = (
        entries.join(several, "bucket")
        .select("bucket", "t", "class", blocks.alias("blocks"), mine.alias("block"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "bucket", "t", "class", "block",
            F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        )
    )
    groups = (
        met.join(classes.select("class", "n", "embedding"), "class")
        .select("bucket", "i", "j", "t", "block", "class", "n", "embedding")
        .repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
    )
    found = stored(_linked(groups, least), "links")
    sums = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    merged = components(found.where("b is not null"))
    named = (
        rows.where("class is not null")
        .groupBy("class")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .join(merged.withColumnRenamed("node", "class"), "class", "left")
        .join(sums.withColumnRenamed("a", "class"), "class", "left")
        .select(
            "class",
            "first",
            F.coalesce("component", "class").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        )
    )
    first = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.join(first, "component").select("class", "n_links", "component_id")
    with_class = rows.where("class is not null").select("vec_id", "class").join(ids, "class")
    without = rows.where("class is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    both = with_class.select("vec_id", "n_links", "component_id").unionByName(without)
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
