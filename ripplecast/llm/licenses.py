"""License scan by diagonal voting.

Every run of ``WIDTH`` words of a text is hashed and joined, in Spark, to the places of equal runs
in the templates. A hit votes for its diagonal: word of the text minus word of the template. Votes
are added up by (text, template, diagonal).

- A *phrase* template stands wherever a diagonal has the votes of all its runs and its words agree.
- A *notice* template may have words added, left out or replaced, which moves the rest to a
  neighbouring diagonal. Diagonals at most ``DRIFT`` apart are merged to one span, and a span with
  ``LEAST_VOTES`` per cent of the template's runs is verified on the text: the words that agree in
  order, as a share of the template's, must reach ``least``. Of notices that overlap, as a license
  and its variant do, the one that agrees best stays, then the one with more words.

A text is known by its 128-bit digest, so equal texts are voted on and verified once. Texts that
hold a candidate are found by a table of digest bits, which has a fixed size, and only these are
shuffled to their candidates. Long texts pass in stretches; spans are cut out of them for the check.

Edge cases: a null text has no words and no labels; a text of fewer than ``WIDTH`` words holds no
template, as none is shorter; rows that repeat an id or a text are answered each; an empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplecast.llm.common import slices, stored
from ripplecast.llm.words import LETTERS, window_hashes, word_hashes

WIDTH, DRIFT, LEAST_VOTES = 3, 6, 40
_STRETCH = 4096
_BITS = 1 << 24
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Phrases that name a license, and the wording of licenses and their notices.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software.""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in
        all copies.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the
        License, or (at your option) any later version.""",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc": """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International
        License""",
}


@dataclass(frozen=True)
class Template:
    """The words of a phrase, which must agree exactly, or of a notice."""

    label: str
    words: tuple[str, ...]
    exact: bool

    @property
    def runs(self) -> int:
        return len(self.words) - WIDTH + 1


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(_CAPITALS))


def templates(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> list[Template]:
    listed = [Template(label, tuple(words(phrase)), True) for phrase, label in phrases.items()]
    listed += [Template(label, tuple(words(notice)), False) for label, notice in notices.items()]
    short = [t.label for t in listed if t.runs < 1]
    if short:
        raise ValueError(f"templates of fewer than {WIDTH} words: {short}")
    return listed


def _runs(texts: list[bytes]) -> list[np.ndarray]:
    """The hash of the run of WIDTH words from every word of each text."""
    hashed, counts = word_hashes(texts, LETTERS)
    rolled = window_hashes(hashed, tuple(range(WIDTH)))
    ends = np.cumsum(counts)
    return [rolled[end - n : max(end - n, end - WIDTH + 1)] for end, n in zip(ends.tolist(), counts.tolist())]


def _places(known: list[Template]) -> list[tuple[int, int, int]]:
    """(hash, template, word): every run of every template."""
    found = _runs([" ".join(t.words).encode() for t in known])
    return [(int(h), k, at) for k, own in enumerate(found) for at, h in enumerate(own.view(np.int64))]


def _rolled(texts: DataFrame) -> DataFrame:
    """(digest, pos, hash): every run of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            found = _runs([t.as_buffer().to_pybytes() for t in batch.column(1)])
            digests, starts, lists = [], [], []
            for digest, own in zip(batch.column(0).to_pylist(), found):
                for at in range(0, len(own), _STRETCH):
                    digests.append(digest)
                    starts.append(at)
                    lists.append(own[at : at + _STRETCH])
            offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            flat = np.concatenate(lists).view(np.int64) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(digests, pa.string()),
                    pa.array(starts, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                ["digest", "start", "hashes"],
            )

    rolled = texts.mapInArrow(run, "digest string, start int, hashes array<long>")
    return rolled.select("digest", "start", F.posexplode("hashes").alias("at", "hash")).select(
        "digest", (F.col("start") + F.col("at")).alias("pos"), "hash"
    )


def _candidates(texts: DataFrame, known: list[Template]) -> DataFrame:
    """(digest, t, first, last): the words of a text to hold against a template, the last excluded."""
    spark = texts.sparkSession
    places = spark.createDataFrame(_places(known), "hash long, t int, at int")
    # the templates are constants of a few hundred runs
    hits = _rolled(texts).join(F.broadcast(places), "hash")
    # equal texts vote alike: a vote counts once
    votes = hits.select("digest", "t", (F.col("pos") - F.col("at")).alias("diagonal"), "at").distinct()
    voted = votes.groupBy("digest", "t", "diagonal").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high")
    )
    shape = [(k, t.exact, t.runs, len(t.words)) for k, t in enumerate(known)]
    shapes = F.broadcast(spark.createDataFrame(shape, "t int, exact boolean, runs int, size int"))
    voted = stored(voted.join(shapes, "t"), "votes")
    whole = voted.where("exact AND n = runs").select(
        "digest", "t", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("size")).alias("last")
    )
    across = Window.partitionBy("digest", "t").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(across) > DRIFT, F.lit(True))
    merged = (
        voted.where("NOT exact")
        .withColumn("_new", far.cast("int"))
        .withColumn("span", F.sum("_new").over(across))
        .groupBy("digest", "t", "span", "runs")
        .agg(
            F.sum("n").alias("n"),
            F.min(F.col("diagonal") + F.col("low")).alias("first"),
            F.max(F.col("diagonal") + F.col("high") + WIDTH).alias("last"),
            F.min("low").alias("low"),
            F.max(F.col("size") - F.col("high") - WIDTH).alias("rest"),
        )
        .where(F.col("n") * 100 >= F.col("runs") * LEAST_VOTES)
        # the template's words before its first vote and after its last one may stand there, changed
        .select(
            "digest", "t",
            F.greatest(F.col("first") - F.col("low") - DRIFT, F.lit(0)).alias("first"),
            (F.col("last") + F.col("rest") + DRIFT).alias("last"),
        )
    )
    return whole.unionByName(merged)


@functools.lru_cache(maxsize=8)
def _matcher(template: tuple[str, ...]) -> difflib.SequenceMatcher:
    matcher = difflib.SequenceMatcher(autojunk=False)
    matcher.set_seq2(template)
    return matcher


def agreement(found: list[str], template: tuple[str, ...]) -> tuple[float, int, int]:
    """Share of the template's words found in order, and where the agreeing words begin and end."""
    matcher = _matcher(template)
    matcher.set_seq1(found)
    blocks = [b for b in matcher.get_matching_blocks() if b.size]
    if not blocks:
        return 0.0, 0, 0
    return sum(b.size for b in blocks) / len(template), blocks[0].a, blocks[-1].a + blocks[-1].size


def best_apart(notices: list[tuple[float, int, int, int, str]]) -> list[tuple[float, int, int, int, str]]:
    """Of notices (share, size, first, last, label) that overlap, the one that agrees best, then the longest."""
    kept, starts = [], []
    for one in sorted(notices, key=lambda n: (-n[0], -n[1], n[2:])):
        at = bisect.bisect_left(starts, one[2])
        before, after = kept[at - 1 : at] if at else [], kept[at : at + 1]
        if all(o[3] <= one[2] for o in before) and all(o[2] >= one[3] for o in after):
            kept.insert(at, one)
            starts.insert(at, one[2])
    return kept


def _digest_bits(candidates: DataFrame) -> np.ndarray:
    """A bit table of the digests; at most _BITS / 64 numbers come to the driver."""
    place = F.pmod(F.xxhash64("digest"), F.lit(_BITS))
    rows = candidates.select(place.alias("place")).groupBy((F.col("place") / 64).cast("int").alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    found = rows.agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(_BITS // 64, dtype=np.int64)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return table


def _holding(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """The texts whose digest may be in the table."""
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(2).to_numpy()
            fit = (sent.value[place >> 6] >> (place & 63)) & 1 == 1
            yield batch.filter(pa.array(fit)).select(["digest", "text"])

    placed = texts.withColumn("place", F.pmod(F.xxhash64("digest"), F.lit(_BITS)))
    return placed.mapInArrow(run, "digest string, text string")


def _verified(texts: DataFrame, candidates: DataFrame, known: list[Template], least: float) -> DataFrame:
    """(digest, label, exact, first, last, similarity) of the candidates that hold on the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            rows = []
            for digest, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                found, notices = words(text), []
                for span in spans:
                    template, start = known[span["t"]], span["first"]
                    part = found[start : span["last"]]
                    if template.exact:
                        if tuple(part) == template.words:
                            rows.append((digest, template.label, True, start, span["last"], 1.0))
                        continue
                    share, a, b = agreement(part, template.words)
                    if share >= least:
                        notices.append((share, len(template.words), start + a, start + b, template.label))
                for share, _, a, b, named in best_apart(notices):
                    rows.append((digest, named, False, a, b, share))
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(columns, kinds)],
                ["digest", "label", "exact", "first", "last", "similarity"],
            )

    spans = candidates.groupBy("digest").agg(F.collect_list(F.struct("t", "first", "last")).alias("spans"))
    holding = _holding(texts, _digest_bits(candidates))
    single = holding.groupBy("digest").agg(F.first("text").alias("text"))  # one of equal texts
    return single.join(spans, "digest").mapInArrow(
        run, "digest string, label string, exact boolean, first long, last long, similarity double"
    )


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        F.md5("text").alias("digest"), "text"
    )


def scan(
    docs: DataFrame, known: list[Template] | None = None, least: float = 0.8, text_col: str = "text"
) -> DataFrame:
    """(digest, label, exact, first, last, similarity): the verified spans of every distinct text.

    ``digest`` is the MD5 of the text, ``first`` to ``last`` are words from 0, the last excluded.
    """
    known = known or templates()
    texts = _texts(docs, text_col)
    candidates = stored(_candidates(texts, known), "candidates")
    return _verified(texts, candidates, known, least)


def label(
    docs: DataFrame,
    known: list[Template] | None = None,
    least: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per document.

    ``score`` is the greatest similarity of a span, 0 without one; a phrase counts 1.
    """
    spans = stored(scan(docs, known, least, text_col), "spans")
    base = F.when(F.col("exact"), F.col("first"))
    named = lambda value: F.array_join(F.array_sort(F.collect_set(value)), ",")
    found = spans.groupBy("digest").agg(
        F.count(base).alias("n_base"),
        F.min(base).alias("first_word"),
        F.max(base).alias("last_word"),
        named(F.when(F.col("exact"), F.col("label"))).alias("base_labels"),
        named("label").alias("labels"),
        F.max("similarity").alias("score"),
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    runs = F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.md5(text).alias("digest"),
        F.regexp_count(text, runs).cast("long").alias("n_words"),
    )
    return rows.join(found, "digest", "left").select(
        "doc_id", "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
