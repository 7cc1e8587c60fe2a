"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

An archive is a folder in the shared storage with three tables:

``docs``     a row per document, in ascending id order over the files: id, ``part`` (its range),
             ``local`` (tokens before it in the range), ``n_tokens``, ``control``, ``data``
``parts``    a row per range: ``part`` and ``base``, the tokens in all earlier ranges
``ranks``    token id and rank; the commonest token has rank 0

A token is its rank in 1 to 4 little-endian bytes in ``data``; its length minus one is two bits of
``control``, four tokens to a byte, lowest bits first, the last byte padded with zeros. So the
commonest 256 tokens take ten bits.

Edge cases: null text is the empty text, which holds just the end id; null ids come first;
documents that repeat an id follow one another, each with its own tokens; an empty table gives an
archive without rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplecast.llm.common import slices, stored
from ripplecast.llm.tokens import codec
from ripplecast.session import scratch_path

#: Lengths of the four values of every control byte.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Control bytes and data bytes of documents of ``counts`` ranks (below 2**32) each."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    widest = 1 + int(np.searchsorted([1 << 8, 1 << 16, 1 << 24], ranks.max(initial=0), side="right"))
    lengths = np.ones(len(ranks), dtype=np.uint8)
    for bits in range(8, 8 * widest, 8):
        lengths += ranks >> np.uint32(bits) > 0
    used = np.arange(widest) < lengths[:, None]
    data = ranks.view(np.uint8).reshape(-1, 4)[:, :widest][used].tobytes()
    groups = -(-counts // 4)
    padding = 4 * groups - counts  # after each document, to whole control bytes
    place = np.arange(len(ranks)) + np.repeat(np.cumsum(padding) - padding, counts)
    codes = np.zeros(4 * int(groups.sum()), dtype=np.uint8)
    codes[place] = lengths - 1
    codes = codes.reshape(-1, 4)
    control = (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).tobytes()
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[np.cumsum(counts)].tolist()
    stops = np.cumsum(groups).tolist()
    return [
        (control[a:b], data[c:d])
        for a, b, c, d in zip([0, *stops[:-1]], stops, [0, *ends[:-1]], ends)
    ]


def unpack(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """Ranks of documents of ``counts`` tokens that follow one another in both byte strings."""
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)]  # a table lookup for four tokens
    groups = -(-counts // 4)
    real = np.ones(lengths.size, dtype=bool)
    last = np.cumsum(groups)[groups > 0] * 4
    for back in range(1, 4):  # padding of each document's last control byte
        short = (-counts[groups > 0]) % 4 >= back
        real[last[short] - back] = False
    width = lengths.ravel()[real]
    ends = np.cumsum(width, dtype=np.int64)
    at = ends - width
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    values = raw[at].astype(np.uint32)
    for place in range(1, int(width.max(initial=1))):
        more = width > place
        values[more] |= raw[at[more] + place].astype(np.uint32) << np.uint32(8 * place)
    return values


def encoded(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_tokens, ids): the ids of every whole text and the end id, in little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        tail = np.array([end_id], dtype=coder.dtype).tobytes()
        for batch in slices(batches, "text"):
            coded = [ids + tail for ids in coder.encode(batch.column(1).to_pylist())]
            sizes = pa.array([len(ids) // coder.dtype.itemsize for ids in coded], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(coded, pa.binary())], ["doc_id", "n_tokens", "ids"]
            )

    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def ranking(ids: DataFrame, vocabulary: str) -> DataFrame:
    """(token, rank) by falling count over all documents, then by token; unused tokens come last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        total = np.zeros(coder.size, dtype=np.int64)
        for batch in slices(batches, "ids", 2 << 20):
            ids = coder.ids(b"".join(batch.column(0).to_pylist()))
            total += np.bincount(ids, minlength=coder.size)
        tokens = np.arange(coder.size)
        yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(total)], ["token", "n"])

    seen = ids.select("ids").mapInArrow(count, "token long, n long")
    totals = seen.groupBy("token").agg(F.sum("n").alias("n"))  # one row per vocabulary entry
    place = F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1
    return totals.select("token", place.alias("rank"))


def write_archive(
    docs: DataFrame,
    vocabulary: str,
    path: str | None = None,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> str:
    """Encode all documents and write the archive; the path, by default one in the shared folder.

    The texts are encoded once and the ids written down, counted, ranked (a table as long as the
    vocabulary, the only thing that is broadcast), dealt into ranges by document id and coded
    range by range.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    ids = stored(encoded(docs, vocabulary, end_id, id_col, text_col), "ids")
    ranking(ids, vocabulary).write.parquet(f"{path}/ranks")
    rank_of = _rank_table(spark, path)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, local, part = codec(vocabulary), 0, TaskContext.get().partitionId()
        for batch in slices(batches, "ids", 2 << 20):
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            ids = coder.ids(b"".join(batch.column(2).to_pylist()))
            packed = pack(rank_of.value[ids], sizes)
            starts = local + np.cumsum(sizes) - sizes
            local += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(len(sizes), part, dtype=np.int32)),
                    pa.array(starts),
                    batch.column(1),
                    pa.array([p[0] for p in packed], pa.binary()),
                    pa.array([p[1] for p in packed], pa.binary()),
                ],
                ["doc_id", "part", "local", "n_tokens", "control", "data"],
            )

    kind = dict(ids.dtypes)["doc_id"]
    order = ["doc_id", "_tie"]
    ranged = ids.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).mapInArrow(
        code, f"doc_id {kind}, part int, local long, n_tokens long, control binary, data binary"
    ).write.option("compression", "zstd").parquet(f"{path}/docs")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spark.read.parquet(f"{path}/docs").groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")
    ).write.parquet(f"{path}/parts")  # one row per range
    return path


def _rank_table(spark: SparkSession, path: str):
    """Rank by token, broadcast: four bytes for each entry of the vocabulary."""
    rows = spark.read.parquet(f"{path}/ranks").collect()
    ranks = np.zeros(len(rows), dtype=np.uint32)
    for token, rank in rows:
        ranks[token] = rank
    return spark.sparkContext.broadcast(ranks)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document's ids as little-endian 32-bit numbers."""
    ranks = _rank_table(spark, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_of = np.empty(len(ranks.value), dtype="<u4")
        token_of[ranks.value] = np.arange(len(ranks.value))
        for batch in slices(batches, "data", 2 << 20):
            counts = batch.column(3).to_numpy(zero_copy_only=False)
            control, data = (b"".join(batch.column(i).to_pylist()) for i in (4, 5))
            ids = token_of[unpack(control, data, counts)].tobytes()
            ends = (4 * np.cumsum(counts)).tolist()
            cut = [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(cut, pa.binary())],
                ["doc_id", "part", "local", "n_tokens", "ids"],
            )

    docs = spark.read.parquet(f"{path}/docs").select(
        "doc_id", "part", "local", "n_tokens", "control", "data"
    )
    kind = dict(docs.dtypes)["doc_id"]
    found = docs.mapInArrow(decode, f"doc_id {kind}, part int, local long, n_tokens long, ids binary")
    return found.join(spark.read.parquet(f"{path}/parts"), "part").select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids"
    )


def id_digests(archive: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents of an archive."""
    return archive.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
