"""Phrase mining: best-first branch-and-bound growth of word sequences, per language.

Within a piece of text, a phrase of count ``a`` that cuts into parts of counts ``l`` and ``r``
scores ``floor(1000000 * a * a / (l * r))`` at the cut, and its lowest cut counts. Phrases grow from
prefixes:

1. Words are counted. A word counted less than ``least`` times is in no candidate.
2. Pairs of such words are counted, each with how often a word follows it in the piece. All of them
   are needed, since a pair is a part of a longer phrase's cut whatever its own score.
3. A pair ``uv`` that is followed ``c`` times has no extension above ``floor(1000000 * c / f(u))``,
   as ``a <= c`` and ``a <= r``. The frontier of a language, ordered by this bound, is expanded
   down to a score ``t``, together with the triples that could drop a pair that scores ``t`` or
   more. Then everything from ``t`` on is known: every triple that scores as much, and which pairs
   survive. When ``limit`` phrases survive there, ties with the last included, the language is
   settled; if not, ``t`` falls to the score of a pair ``WIDER`` times further down. A language
   whose pairs are all expanded is settled too.

Prefixes reach the tasks as bit tables of a fixed size, ``BITS`` bits each: a table that has
become full lets more phrases be counted than needed, which changes no result, since every count
is of exact strings and candidates are found by joins.

Edge cases: a null text has no words; a null language is ``und``, together with documents that say
so; a text of more than ``_WORDS`` words is read in stretches that overlap by the words around a
cut; rows that repeat an id are counted each; an empty table, or one without candidates, gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplecast.llm.common import running, stored
from ripplecast.llm.words import mix

BITS = 1 << 24
#: The first threshold lies at this many pairs for a wanted phrase, and moves on by WIDER.
FIRST, WIDER = 2, 4
_BYTES, _WORDS = 4 << 20, 1 << 19

#: Characters that end a piece, and those between the words of a piece.
_SEPARATORS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATES = np.zeros(256, dtype=bool)
_SEPARATES[list(_SEPARATORS)] = True
_INSIDE = ~_SEPARATES
_INSIDE[list(_BLANKS)] = False


class Stretch:
    """The words of a stretch of text, coded by their place among its distinct words.

    ``joined[i]`` says whether word ``i + 1`` follows word ``i`` in the same piece. Phrases count
    when their last word lies from ``first`` to ``last``; words outside are only context.
    """

    def __init__(self, data: np.ndarray, first: int = 0, after: int = 0):
        edge = np.diff(np.concatenate([[False], _INSIDE[data], [False]]).view(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.searchsorted(np.flatnonzero(_SEPARATES[data]), starts)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[_INSIDE[data]]])]
        coded = pa.Array.from_buffers(pa.string(), len(starts), buffers).dictionary_encode()
        self.words = coded.dictionary
        self.codes = coded.indices.to_numpy().astype(np.int64)
        self.joined = piece[1:] == piece[:-1]
        self.first, self.last = first, len(starts) - after

    def hashes(self, seed: int) -> np.ndarray:
        """A hash for every distinct word."""
        return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words.to_pylist()], dtype=np.uint64)

    def places(self, size: int) -> np.ndarray:
        """Where phrases of ``size`` words begin."""
        count = max(0, len(self.codes) - size + 1)
        whole = np.ones(count, dtype=bool)
        for k in range(size - 1):
            whole &= self.joined[k : k + count]
        whole[: max(0, self.first - size + 1)] = False
        whole[max(0, self.last - size + 1) :] = False
        return np.flatnonzero(whole)

    def counted(self, size: int, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct phrases that begin at the places, how often, and how often a word follows."""
        key = np.zeros(len(at), dtype=np.int64)
        for k in range(size):
            key = key * len(self.words) + self.codes[at + k]
        follows = np.append(self.joined, False)[at + size - 1]
        found, times = np.unique(key * 2 + follows, return_counts=True)
        phrase = found >> 1
        fresh = np.flatnonzero(np.diff(phrase, prepend=-1))
        total = np.add.reduceat(times, fresh) if len(fresh) else times
        followed = np.add.reduceat(times * (found & 1), fresh) if len(fresh) else times
        phrase, parts = phrase[fresh], []
        for _ in range(size):
            parts.insert(0, self.words.take(pa.array(phrase % len(self.words))))
            phrase = phrase // len(self.words)
        return pc.binary_join_element_wise(*parts, " "), total, followed


def _stretches(texts: list[bytes]) -> Iterator[Stretch]:
    """Short texts together; a long one in stretches with two words before and one after."""
    short = [t for t in texts if len(t) <= _BYTES]
    if short:
        yield Stretch(np.frombuffer(b"\n".join(short) + b"\n", dtype=np.uint8))
    for text in texts:
        if len(text) > _BYTES:
            data = np.frombuffer(text, dtype=np.uint8)
            inside = _INSIDE[data]
            starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
            for at in range(0, len(starts), _WORDS):
                before, stop = min(at, 2), at + _WORDS
                end = starts[stop + 1] if stop + 1 < len(starts) else len(data)
                yield Stretch(data[starts[at - before] : end], before, int(stop < len(starts)))


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang) >> 1


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _bits(table: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a hash in a bit table."""
    size = np.uint64(64 * len(table))
    return hashed % size, (hashed >> np.uint64(32)) % size


def _has(table: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashed), dtype=bool)
    for place in _bits(table, hashed):
        found &= (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found


def _bit_table(phrases: DataFrame) -> np.ndarray:
    """The table of (lang, phrase) rows of one or two words; BITS / 64 numbers come to the driver."""
    numbers = BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seeds = np.zeros(numbers, dtype=np.uint64), {}
        for batch in batches:
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in seeds:
                    seeds[lang] = (_seed(lang), [])
                seed, held = seeds[lang]
                held.append([xxhash.xxh3_64_intdigest(w, seed) for w in phrase.split(" ")])
            for _, held in seeds.values():
                for size in {len(h) for h in held}:
                    own = np.array([h for h in held if len(h) == size], dtype=np.uint64)
                    for place in _bits(table, own[:, 0] if size == 1 else _pair(own[:, 0], own[:, 1])):
                        bit = np.uint64(1) << (place & np.uint64(63))
                        np.bitwise_or.at(table, place >> np.uint64(6), bit)
                held.clear()
        kept = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept.astype(np.int32)), pa.array(table[kept].view(np.int64))], ["at", "bits"]
        )

    rows = phrases.select("lang", "phrase").mapInArrow(run, "at int, bits long")
    found = rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(numbers, dtype=np.uint64)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def _counted(texts: DataFrame, size: int, least: int, **tables: np.ndarray | list) -> DataFrame:
    """(lang, phrase, n, c): phrases of ``size`` words found ``least`` times, c times with a word after.

    ``words`` admits the words of pairs. ``pairs`` admits the two pairs of a triple, of which the
    first is in ``grown`` or the second in ``open``; triples that ``earlier`` tables admit were
    counted before.
    """
    sent = texts.sparkSession.sparkContext.broadcast(tables)

    def admitted(stretch: Stretch, seed: int) -> np.ndarray:
        at, known = stretch.places(size), sent.value
        if size == 1:
            return at
        hashed = stretch.hashes(seed)
        if size == 2:
            fit = _has(known["words"], hashed)[stretch.codes] if len(hashed) else np.zeros(0, dtype=bool)
            return at[fit[at] & fit[at + 1]]
        own = hashed[stretch.codes]
        left, right = _pair(own[at], own[at + 1]), _pair(own[at + 1], own[at + 2])
        fit = _has(known["pairs"], left) & _has(known["pairs"], right)
        at, left, right = at[fit], left[fit], right[fit]
        fit = _has(known["grown"], left) | _has(known["open"], right)
        for grown, opened in known["earlier"]:
            fit &= ~(_has(grown, left) | _has(opened, right))
        return at[fit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bytes_held = defaultdict(list), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                for stretch in _stretches(own):
                    at = admitted(stretch, _seed(lang))
                    if len(at):
                        phrase, n, c = stretch.counted(size, at)
                        named = pa.array([lang]).take(pa.array(np.zeros(len(n), dtype=np.int8)))
                        yield pa.RecordBatch.from_arrays(
                            [named, phrase, pa.array(n), pa.array(c)], ["lang", "phrase", "n", "c"]
                        )
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_buffer().to_pybytes()
                held[lang].append(data)
                bytes_held += len(data)
                if bytes_held >= _BYTES:
                    yield from flush()
                    bytes_held = 0
        yield from flush()

    rows = texts.mapInArrow(run, "lang string, phrase string, n long, c long")
    found = rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    return found.where(F.col("n") >= least)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in 38 digits: counts up to 10 ** 15."""
    wide = [c.cast("decimal(15,0)") for c in (a, left, right)]
    return F.call_function("div", wide[0] * wide[0] * F.lit(1_000_000).cast("decimal(7,0)"), wide[1] * wide[2])


def _joined(rows: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """Add the count of the phrase in column ``part``, and drop rows whose part has none."""
    known = counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("n").alias(name))
    return rows.join(known, (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_phrase"))).drop(
        "_lang", "_phrase"
    )


def _scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, bound)."""
    split = pairs.withColumns({"_u": F.split_part("phrase", F.lit(" "), F.lit(1)),
                               "_v": F.split_part("phrase", F.lit(" "), F.lit(2))})
    known = _joined(_joined(split, words, "_u", "l"), words, "_v", "r")
    return known.select(
        "lang", "phrase", F.col("n").alias("a"), "l", "r",
        _score(F.col("n"), F.col("l"), F.col("r")).alias("score"),
        F.expr("(c * 1000000bd) div l").alias("bound"), "c",
    )


def _scored_triples(triples: DataFrame, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, _uv, _vx): the lower of two cuts, the first of equals."""
    part = [F.split_part("phrase", F.lit(" "), F.lit(k)) for k in (1, 2, 3)]
    split = triples.select(
        "lang", "phrase", F.col("n").alias("a"), part[0].alias("_u"), part[2].alias("_x"),
        F.concat_ws(" ", part[0], part[1]).alias("_uv"), F.concat_ws(" ", part[1], part[2]).alias("_vx"),
    )
    counts = pairs.select("lang", "phrase", F.col("a").alias("n"))
    known = _joined(_joined(split, words, "_u", "l1"), counts, "_vx", "r1")
    known = _joined(_joined(known, counts, "_uv", "l2"), words, "_x", "r2")
    known = known.withColumns(
        {"s1": _score(F.col("a"), F.col("l1"), F.col("r1")), "s2": _score(F.col("a"), F.col("l2"), F.col("r2"))}
    )
    first = F.col("s1") <= F.col("s2")
    return known.select(
        "lang", "phrase", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.least("s1", "s2").alias("score"), "_uv", "_vx",
    )


def _thresholds(pairs: DataFrame, langs: DataFrame, place: int) -> DataFrame:
    """(lang, t): the score of each language's pair at the place, 0 where it has fewer.

    A language has at most 1,000,001 scores, so its sorted group is bounded.
    """
    down = Window.partitionBy("lang").orderBy(F.col("score").desc())
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    sums = pairs.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("m"))
    sums = sums.withColumn("_upto", F.sum("m").over(upto))
    at = sums.groupBy("lang").agg(F.max(F.when(F.col("_upto") >= place, F.col("score"))).alias("t"))
    return langs.join(at, "lang", "left").select("lang", F.coalesce("t", F.lit(0)).cast("long").alias("t"))


def _survivors(pairs: DataFrame, triples: DataFrame, cuts: DataFrame, drop_share: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of what is not part of a longer candidate, from the cut on."""
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    parts = triples.select("lang", F.explode(F.array("_uv", "_vx")).alias("phrase"), "a")
    longer = parts.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    alone = pairs.join(longer, ["lang", "phrase"], "left").where(
        F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * drop_share)
    )
    both = alone.select(columns).unionByName(triples.select(columns))
    return both.join(cuts, "lang").where("score >= t").select(columns)


def mine(
    docs: DataFrame,
    least: int = 10,
    limit: int = 2000,
    drop_share: int = 50,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two and three words.

    ``n`` is the words of the language. A pair goes when a candidate that holds it has at least
    ``drop_share`` per cent of its count.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    counts = stored(_counted(texts, 1, 1), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    words = counts.where(F.col("n") >= least)
    pairs = _counted(texts, 2, least, words=_bit_table(words))
    pairs = stored(_scored_pairs(pairs, words), "pairs")
    langs = pairs.select("lang").distinct()

    every, earlier, place = _bit_table(pairs), [], limit * FIRST
    triples, settled, unsettled = None, None, langs
    while True:
        cuts = stored(_thresholds(pairs, unsettled, place), "cuts")
        reached = pairs.join(cuts, "lang").where((F.col("bound") >= F.col("t")) | (F.col("score") >= F.col("t")))
        grown = _bit_table(reached.where(F.col("c") >= least))
        opened = _bit_table(reached.where(F.col("score") >= F.col("t")))
        found = _counted(texts, 3, least, pairs=every, grown=grown, open=opened, earlier=earlier)
        fresh = stored(_scored_triples(found, pairs, words), "triples")
        triples = fresh if triples is None else triples.unionByName(fresh)
        earlier = [*earlier, (grown, opened)]
        now = _survivors(pairs, triples, cuts, drop_share)
        done = cuts.join(now.groupBy("lang").agg(F.count(F.lit(1)).alias("m")), "lang", "left").where(
            (F.col("t") == 0) | (F.col("m") >= limit)
        )
        done = stored(done.select("lang", "t"), "settled")
        settled = done if settled is None else settled.unionByName(done)
        unsettled = cuts.join(done, "lang", "left_anti").select("lang")
        if unsettled.isEmpty():
            break
        place *= WIDER

    best = _survivors(pairs, triples, settled, drop_share)
    best = best.withColumns({"_score": -F.col("score"), "_a": -F.col("a")})
    ranked = running(best, ["_score", "_a", "phrase"], {"_before": F.lit(1).cast("long")}, by=["lang"])
    ranked = ranked.where(F.col("_before") < limit).join(totals, "lang")
    return ranked.select(
        "lang", (F.col("_before") + 1).alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )
