"""Mixing sources to target weights by weighted fair queueing.

Every source has a queue of its documents in a shuffled order, repeated up to ``passes`` times.
An entry's virtual finish time is the source's tokens up to and including it, divided by the
source's target. All entries are range-sorted by finish time and the sequence is cut where its
tokens reach the total budget. At virtual time 1 every source has its target, so the cut falls
there for all of them at once, to within a document.

Targets share the budget by weight. A target stops at ``passes`` times its source's tokens and the
excess is shared by weight among the others, until none is above: with the sources in the order of
cap per weight, the common level is the largest of (budget - caps before) / (weights from here on).

Edge cases: a null text has no tokens; documents without tokens are listed with ``taken`` 0; a
null source is a source of its own, last in the order; rows that repeat an id are separate
documents; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplecast.llm.common import free_name, running, stored

WEIGHTS = (5.0, 2.0, 1.0)
PASSES = 3


def token_count(text: Column) -> Column:
    """Runs of characters other than blanks; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, passes: int = PASSES, share: float = 1.0
) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources take the weights in turn, in code-point order, null last.
    """
    one, listed = F.lit(1).cast("long"), F.array(*[F.lit(float(w)) for w in weights])
    named = sizes.withColumn("_last", F.col("source").isNull())
    turn = running(named, ["_last", "source"], {"_turn": one})
    weighed = turn.select(
        "source",
        "source_size",
        F.get(listed, (F.col("_turn") % len(weights)).cast("int")).alias("weight"),
        (F.col("source_size") * passes).cast("double").alias("cap"),
    )
    weighed = weighed.withColumn("_ratio", F.col("cap") / F.col("weight"))
    ordered = running(
        weighed, ["_ratio", "source"], {"_caps": F.col("cap"), "_weights": F.col("weight")}
    )
    budget = float(sizes.agg(F.sum("source_size")).first()[0] or 0) * share
    total = float(weighed.agg(F.sum("weight")).first()[0] or 0)
    rest = (F.lit(budget) - F.col("_caps")) / (F.lit(total) - F.col("_weights"))
    level = float(ordered.agg(F.max(rest)).first()[0] or 0)
    return weighed.select(
        "source", "source_size", F.least("cap", F.col("weight") * level).alias("target")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    passes: int = PASSES,
    share: float = 1.0,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, taken), one row per document.

    ``taken`` is the tokens that the mix takes from the document, repeats counted: whole documents
    only. ``key`` is a hash of id, text and source. Texts are read once; all sorting and adding
    works on narrow rows, in ranges that split a large source.
    """
    own = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")), F.col(source_col))
    counted = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            token_count(F.col(text_col)).alias("size"),
            own.alias("key"),
        ).withColumn("draw", F.xxhash64(F.lit(seed), "key")),
        "counted",
    )
    sizes = counted.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, passes, share), "targets")
    one = F.lit(1).cast("long")
    queued = running(counted, ["draw", "doc_id"], {"before": F.col("size"), "place": one}, by=["source"])
    known = targets.withColumnRenamed("source", "_source")
    queued = queued.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rounds = F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))
    entries = queued.withColumn("round", rounds).withColumn(
        "finish",
        F.when(
            F.col("target") > 0,
            (F.col("round") * F.col("source_size") + F.col("before") + F.col("size")) / F.col("target"),
        ).otherwise(F.lit(float("inf"))),
    )
    line = running(entries, ["finish", "source", "round", "place"], {"upto": F.col("size")})
    budget = float(sizes.agg(F.sum("source_size")).first()[0] or 0) * share
    inside = (F.col("upto") + F.col("size") <= budget) & (F.col("finish") < float("inf"))
    return (
        line.groupBy("doc_id", "key", "source", "place", "size", "source_size", "target")
        .agg(F.coalesce(F.sum(F.when(inside, F.col("size"))), F.lit(0)).alias("taken"))
        .select("doc_id", "key", "source", "size", "source_size", "target", "taken")
    )


def drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken, all columns as they were.

    Rows that agree in id, text and source each come as often as their mean copies, rounded up.
    """
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how).where("taken > 0")
    key, times = free_name(docs, "_key"), free_name(docs, "_times")
    copies = taken.groupBy(F.col("key").alias(key)).agg(
        F.ceil(F.avg(F.col("taken") / F.col("size"))).cast("int").alias(times)
    )
    own = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")), F.col(source_col))
    joined = docs.withColumn(key, own).join(copies, key)
    repeats = F.explode(F.array_repeat(F.lit(0), F.col(times)))
    return joined.withColumn(times, repeats).select(*docs.columns)
