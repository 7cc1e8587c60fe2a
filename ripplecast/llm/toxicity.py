"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes, of ``BITS`` bits, of its words, of neighbouring
words and of words with one between them. Follow-the-regularised-leader learns a weight for each
with a rate of its own; L1 keeps all weights that the data do not call for at exactly zero, so the
model is a short list of (feature, weight), at most 2**BITS of them, and is broadcast.

The model is fitted on at most ``rows`` labelled documents, half of each label, those with the
smallest hashes of their id, one for each id; the rest is weighed so that the labels keep their shares. Scoring
reads every whole text once and shuffles nothing.

Edge cases: a null or empty text gets the score of the bias alone; without labelled rows of both
kinds the score is the share of label 1, 0 without any; a document with several labels is toxic
if one of them is 1; null labels are ignored; an empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplecast.llm.common import free_name, slices, stored
from ripplecast.llm.words import LETTERS, window_hashes, word_hashes

BITS = 20
GRAMS = ((0,), (0, 1), (0, 2))  # offsets of the words of a feature


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct features of each text."""
    words, counts = word_hashes(texts, LETTERS)
    ends = np.cumsum(counts)
    grams = [(offsets[-1], window_hashes(words, offsets) >> np.uint64(64 - BITS)) for offsets in GRAMS]
    found = []
    for start, end in zip((ends - counts).tolist(), ends.tolist()):
        parts = [hashes[start : max(start, end - reach)] for reach, hashes in grams]
        found.append(np.unique(np.concatenate(parts)).astype(np.int32))
    return found


@dataclass
class Model:
    """Weights of features; ``values`` are in the order of ``places``."""

    bias: float = 0.0
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float64))


class Learner:
    """Per-coordinate FTRL-proximal for one pass after another over the same rows."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        size = (1 << BITS) + 1  # the last coordinate is the bias, which has no penalty
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        bias = at == 1 << BITS
        l1 = np.where(bias, 0.0, self.l1)
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + np.where(bias, 1e-6, self.l2)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / rate)

    def learn(self, at: np.ndarray, label: int, weight: float) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        slope = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * weight
        n = self.n[at]
        self.z[at] += slope - (np.sqrt(n + slope * slope) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + slope * slope


def fit(
    docs: DataFrame,
    labels: DataFrame,
    rows: int = 12_000,
    passes: int = 3,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 6.0,
    l2: float = 0.0,
    least_docs: int = 4,
    toxic_weight: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Learn from the labelled rows; ``labels`` holds the ids that may be learned from.

    Only ids and labels are sorted, the chosen ones (at most ``rows``) are broadcast to the
    documents, and one task learns from their features, without those of fewer than
    ``least_docs`` of them. ``toxic_weight`` is how much more a toxic document counts.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("_y"))
    totals = {y: n for y, n in known.groupBy("_y").count().collect()}  # two rows
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    if len(totals) < 2:
        return Model(bias=float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    draw = F.xxhash64("_id")
    parts = [known.where(f"_y = {y}").orderBy(draw, "_id").limit(rows // 2) for y in (0, 1)]
    chosen = stored(parts[0].unionByName(parts[1]), "sample")
    mean = sum(totals.values()) / sum(min(n, rows // 2) for n in totals.values())
    weight = {y: totals[y] / min(totals[y], rows // 2) / mean for y in (0, 1)}
    weight[1] *= toxic_weight

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            found = features([t.encode() for t in batch.column(2).to_pylist()])
            coded = pa.array([one.tobytes() for one in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), coded], ["draw", "y", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(d, y, np.frombuffer(at, np.int32)) for b in batches for d, y, at in zip(*(c.to_pylist() for c in b.columns))]
        held.sort(key=lambda row: (row[0], row[1], row[2].tobytes()))
        seen = np.zeros(1 << BITS, dtype=np.int32)
        for _, _, at in held:
            seen[at] += 1
        held = [(y, at[seen[at] >= least_docs]) for _, y, at in held]
        learner = Learner(alpha, beta, l1, l2)
        for turn in range(passes):
            for place in np.random.default_rng(turn).permutation(len(held)):
                y, at = held[place]
                learner.learn(at, y, weight[y])
        w = learner.weights(np.arange((1 << BITS) + 1))
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), pa.array(w[kept])], ["place", "value"])

    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # at most ``rows`` ids; of documents that repeat one, the first text in order, so as many rows
    sample = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("text").alias("text"))
    described = sample.select(F.xxhash64("_id").alias("draw"), "_y", "text").mapInArrow(
        describe, "draw long, y int, at binary"
    )
    learned = stored(described, "features").coalesce(1).mapInArrow(learn, "place int, value double")
    got = sorted(learned.collect())  # at most 2**BITS rows, a few hundred with the L1 penalty
    bias = sum(value for place, value in got if place == 1 << BITS)
    got = [(place, value) for place, value in got if place < 1 << BITS]
    return Model(bias, np.array([p for p, _ in got], np.int32), np.array([v for _, v in got], np.float64))


def with_score(docs: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """The documents with one more column: the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.places, model.values))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        bias, places, values = sent.value
        dense = np.zeros(1 << BITS)
        dense[places] = values
        found, held, size = [], [], 0
        for text in [*texts, None]:
            if text is not None:
                held.append(text.encode())
                size += len(text)
            if held and (text is None or size > 1 << 20):
                found += [bias + dense[at].sum() for at in features(held)]
                held, size = [], 0
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(found, dtype=float), -35, 35))))

    return docs.withColumn(name, score(F.coalesce(F.col(text_col), F.lit(""))))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_clean(docs: DataFrame, model: Model, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents with a score below ``least``, all columns as they were."""
    name = free_name(docs, "_score")
    return with_score(docs, model, name, text_col).where(F.col(name) < least).select(*docs.columns)
