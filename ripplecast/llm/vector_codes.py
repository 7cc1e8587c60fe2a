"""Vector codes: vectors cut into parts, every part named by the nearest entry of its codebook.

Training works on the distinct parts of the table with their counts, in lexicographic order, so a
run of them is a trie over dimensions. A depth-first walk of the trie carries the squared
distances to all entries summed so far: parts with a common prefix share its sums, and a leaf takes
the nearest entry and adds its part to that entry's weighted sum. Only these sums (entries x
dimensions) leave a task; the driver divides them. Coding walks the trie of a batch's distinct parts.

All numbers are integers, so results do not depend on how rows are dealt over tasks. Distances
that may pass 64 bits are added up as Python integers.

Edge cases: a vector that is null or holds null or non-finite components is dropped; vectors of
another length than that of the smallest kept id get a null code and error; a length that the
parts do not divide gives parts that differ by one; integer components stop at 2**60 and an
error at 2**63 - 1; a null id comes last in the order of ids, equal ids are ordered by vector;
fewer vectors than entries give codebooks of as many entries; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplecast.llm.common import stored

#: Nodes of one depth that the walk takes at a time, and rows of a batch.
_WIDE, _ROWS = 4096, 1 << 16
_FAR = 1 << 60


@dataclass(frozen=True)
class Codebooks:
    """Entries by part: ``books[part][entry]`` holds its integer components."""

    books: list[list[list[int]]]
    scale: int

    @property
    def length(self) -> int:
        return sum(len(book[0]) for book in self.books)

    def bounds(self) -> list[int]:
        return np.cumsum([0, *(len(book[0]) for book in self.books)]).tolist()

    def sha256(self) -> str:
        listed = (x for book in self.books for entry in book for x in entry)
        return hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest()


def _exact(numbers: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in 64 bits where no sum of squares can pass them, else as Python integers."""
    far = max((int(abs(a).max()) for a in (numbers, entries) if a.size), default=0)
    kind = np.int64 if (2 * far) ** 2 * max(1, numbers.shape[1]) < 1 << 62 else object
    return numbers.astype(kind), entries.astype(kind)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the first of equals) and squared distance of distinct parts in lexicographic order."""
    parts, entries = _exact(parts, entries)
    count, depth = parts.shape
    chosen, error = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=parts.dtype)
    if not count or not depth:
        return chosen, error
    fresh = np.ones((count, depth), dtype=bool)  # where a node of each depth begins
    fresh[1:] = np.logical_or.accumulate(parts[1:] != parts[:-1], axis=1)
    first = [np.flatnonzero(fresh[:, k]) for k in range(depth)]
    parent = [np.zeros(len(first[0]), dtype=np.int64)]
    parent += [np.searchsorted(first[k - 1], first[k], "right") - 1 for k in range(1, depth)]
    kids = [np.append(np.searchsorted(first[k + 1], first[k]), len(first[k + 1])) for k in range(depth - 1)]
    # a waiting run: nodes of a depth, where their parents begin, and the sums of these parents
    waiting = [(0, 0, len(first[0]), 0, np.zeros((1, len(entries)), dtype=parts.dtype))]
    while waiting:
        k, start, stop, base, sums = waiting.pop()
        end = min(stop, start + _WIDE)
        if end < stop:
            waiting.append((k, end, stop, base, sums))
        step = parts[first[k][start:end], k][:, None] - entries[:, k]
        own = sums[parent[k][start:end] - base] + step * step
        if k + 1 < depth:
            waiting.append((k + 1, kids[k][start], kids[k][end], start, own))
        else:
            chosen[start:end] = own.argmin(axis=1)
            error[start:end] = own.min(axis=1)
    return chosen, error


def _sorted_distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, and each row's place among them."""
    if not parts.shape[1]:
        return parts[:1], np.zeros(len(parts), dtype=np.int64)
    order = np.lexsort(parts.T[::-1])
    ranked = parts[order]
    fresh = np.ones(len(parts), dtype=bool)
    fresh[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    place = np.empty(len(parts), dtype=np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ranked[fresh], place


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of about ``_ROWS``."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    rows = len(column)
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, len(flat) // rows)


def _components(vector: Column, scale: int) -> Column:
    far = F.lit(float(_FAR))
    return F.transform(
        vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, -far), far)).cast("long")
    )


def _kept(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, q): the usable vectors as integers."""
    finite = F.forall(
        vector_col,
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")),
    )
    return vectors.where(F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).alias("vec_id"),
        F.col(label_col).alias("label"),
        _components(F.col(vector_col), scale).alias("q"),
    )


def _summed(parts: DataFrame, books: list[list[list[int]]]) -> DataFrame:
    """(p, e, k, s, n): per part, entry and dimension, the weighted sum of a task's parts and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[[0] * len(entry) for entry in book] for book in books]
        counts = [[0] * len(book) for book in books]
        for table in _gathered(batches):
            number, weight = table.column("p").to_numpy(), table.column("n").to_numpy()
            for p in np.unique(number):
                own = table.filter(pa.array(number == p))
                values, times = _matrix(own.column("v")), weight[number == p]
                chosen, _ = nearest(values, np.array(books[p], dtype=object))
                small = int(abs(values).max(initial=0)) * int(times.sum()) < 1 << 62
                values = values if small else values.astype(object)
                for e in np.unique(chosen):
                    mine = chosen == e
                    gained = (values[mine] * times[mine][:, None]).sum(axis=0)
                    totals[p][e] = [a + int(b) for a, b in zip(totals[p][e], gained)]
                    counts[p][e] += int(times[mine].sum())
        rows = [
            (p, e, k, Decimal(total), counts[p][e])
            for p, book in enumerate(totals)
            for e, entry in enumerate(book)
            for k, total in enumerate(entry)
            if counts[p][e]
        ]
        kinds = {"p": pa.int32(), "e": pa.int32(), "k": pa.int32(), "s": pa.decimal128(38, 0), "n": pa.int64()}
        columns = zip(*rows) if rows else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), kind) for c, kind in zip(columns, kinds.values())], list(kinds)
        )

    sums = parts.mapInArrow(run, "p int, e int, k int, s decimal(38,0), n long")
    return sums.groupBy("p", "e", "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def train(
    vectors: DataFrame,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> Codebooks | None:
    """Codebooks that start as the parts of the smallest ids and move to the floored means, or None.

    The driver holds ``entries`` vectors; the distinct parts are stored once, sorted in ranges.
    """
    kept = _kept(vectors, scale, id_col, vector_col, label_col)
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(1).select(F.size("q")).first()
    if seeds is None:
        return None
    length = seeds[0]
    cuts = [p * length // parts for p in range(parts + 1)]
    fit = kept.where(F.size("q") == length)
    chosen = [row["q"] for row in fit.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()]
    books = [[row[a:b] for row in chosen] for a, b in zip(cuts, cuts[1:])]
    cut = F.array(*[F.slice("q", a + 1, b - a) for a, b in zip(cuts, cuts[1:])])
    distinct = (
        fit.select(F.posexplode(cut).alias("p", "v"))
        .groupBy("p", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .repartitionByRange("p", "v")
        .sortWithinPartitions("p", "v")
    )
    distinct = stored(distinct, "parts")
    for _ in range(rounds):
        for p, e, k, s, n in _summed(distinct, books).collect():  # entries x length rows
            books[p][e][k] = int(s) // n
    return Codebooks(books, scale)


def encode(
    vectors: DataFrame,
    codebooks: Codebooks,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(vec_id, label, code, error) of every usable vector: two hex digits a part, summed squared distances."""
    books, cuts = codebooks.books, codebooks.bounds()
    kept = _kept(vectors, codebooks.scale, id_col, vector_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            values = _matrix(table.column("q"))
            codes, error = np.zeros((len(values), len(books)), dtype=np.uint8), 0
            for p, book in enumerate(books):
                own, place = _sorted_distinct(values[:, cuts[p] : cuts[p + 1]])
                chosen, far = nearest(own, np.array(book, dtype=object).reshape(len(book), -1))
                codes[:, p] = chosen[place]
                error = error + far[place].astype(object)
            named = pa.array([row.tobytes().hex() for row in codes])
            capped = pa.array([min(e, (1 << 63) - 1) for e in error], pa.int64())
            columns = [table.column(name).combine_chunks() for name in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*columns, named, capped], ["vec_id", "label", "code", "error"])

    fields = [kept.schema["vec_id"], kept.schema["label"]]
    schema = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    fits = F.size("q") == codebooks.length
    coded = kept.where(fits).mapInArrow(run, schema)
    other = kept.where(~fits).select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")
    )
    return coded.unionByName(other)


def compress(vectors: DataFrame, **columns: str) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row per usable vector.

    ``label_error`` adds up the errors of equal labels, nulls together.
    """
    books = train(vectors, **columns)
    if books is None:
        books = Codebooks([[[]] * 1 for _ in range(8)], 4096)
    coded = stored(encode(vectors, books, **columns), "codes")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    total = F.sum(F.col("error").cast("decimal(28,0)")).cast("decimal(38,0)")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(
        F.least(total, most).cast("long").alias("label_error")
    )
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )
