"""A corpus from raw documents to token ids: one stage after another over the whole table.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes its rows as Parquet in the
shared folder and rereads them for the next one. All stages but the last return the columns of
``documents`` as they were, also columns that clash with names the operators use.

Edge cases: nulls, empty and repeated rows and empty tables are handled as the operators' own
docstrings say; a document whose text is null is clean, is one of the empty texts in the exact
stage (one of which stays), and is never drawn into the mix, as it holds no words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplecast.llm import bpe, exact_dedup, minhash, mixing, toxicity
from ripplecast.llm.common import stored, table
from ripplecast.session import scratch_path


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more go."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.keep_clean(docs, model, least=0.7)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without blanks stays: the longest."""
    kind = dict(docs.dtypes)["doc_id"]
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "index")).open(kind)
    return exact_dedup.keep_one(docs, index)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 over five-word shingles stays."""
    return minhash.keep_one(docs, width=5, per_cent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once, or up to three times."""
    return mixing.drawn(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic_filter),
    ("exact_dedup", exact_copies),
    ("minhash_near_dedup", near_copies),
    ("source_mix", mixed),
    ("bpe", encoded),
]

#: The classifier, the mix's shuffle and BPE have no SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
