"""Exact de-duplication against a persistent digest index, bucketed and sorted by digest.

The index holds one row per distinct text: its SHA-256, the document that stays and the batch that
brought it. It is a Parquet table cut into buckets and sorted by digest, so a new batch is shuffled
once, to the index's buckets, and meets the index in a sort-merge anti-join in which the index
itself is not shuffled. Digests that are not in it yet are appended. Documents of earlier batches
stay.

Texts are equal when they are identical without blanks (space, and U+0009 to U+000D). Of equal
texts in a batch, the one with the most code points stays, then the one with the smallest id.

Edge cases: null counts as the empty text, and all empty texts are equal; a null id is larger than
any other; rows that repeat both id and text count in ``group_size``, are all marked as kept if
their id is, and the pipeline's stage keeps one of them; an empty table leaves the index as it is.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplecast.llm.common import free_name, stored

BUCKETS = 64


def plain(text: Column) -> Column:
    """The text without blanks."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, length): narrow rows that stand for the documents."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(plain(text).cast("binary"), 256).alias("digest"),
        F.coalesce(F.char_length(text), F.lit(0)).alias("length"),
    )


class DigestIndex:
    """A table of (digest, keep_id, batch) in a folder of its own, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.name = self.path.rsplit("/", 1)[-1].replace("-", "_")

    def open(self, id_type: str = "bigint") -> DigestIndex:
        """Name the table for this session; its files, if there are any, come from earlier ones."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{self.name}` (digest STRING, keep_id {id_type}, batch INT) "
            f"USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        return self

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, prints: DataFrame) -> int:
        """Add the digests of a batch (``fingerprints``) that the index lacks; the batch's number.

        The batch is shuffled to the index's buckets; the index's side of the join is not.
        """
        order = F.struct(
            (-F.col("length")).alias("l"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d")
        )
        batch = 1 + (self.rows().agg(F.max("batch")).first()[0] or 0)
        found = prints.groupBy("digest").agg(F.min(order).alias("first"))
        fresh = found.select("digest", F.col("first.d").alias("keep_id"), F.lit(batch).alias("batch")).join(
            self.rows().hint("merge"), "digest", "left_anti"
        )
        fresh.repartition(self.buckets, "digest").write.insertInto(self.name)
        return batch


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Append the documents to the index; (doc_id, keep_id, group_size, kept, text_sha256) of each.

    ``group_size`` counts the batch's documents with that text. Texts are read once; everything
    after works on digests. A very large group is a skewed join key, which AQE splits.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "prints")
    batch = index.append(prints)
    sizes = prints.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = index.rows().join(sizes, "digest")
    own = F.col("batch") == batch
    return prints.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (own & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, all columns as they were; one row of those that repeat id and text."""
    digest, place = free_name(docs, "_digest"), free_name(docs, "_place")
    marked = docs.withColumn(digest, F.sha2(plain(F.col(text_col)).cast("binary"), 256))
    kept = deduplicate(docs, index, id_col, text_col).where("kept").select(
        F.col("text_sha256").alias("_k"), F.col("doc_id").alias("_i")
    ).distinct()
    same = (F.col(digest) == F.col("_k")) & F.col(id_col).eqNullSafe(F.col("_i"))
    ours = marked.join(kept, same, "left_semi")
    length = F.coalesce(F.char_length(F.col(text_col)), F.lit(0))
    first = Window.partitionBy(digest, id_col).orderBy(F.desc(length), F.xxhash64(text_col))
    return ours.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*docs.columns)
