"""Vector codes, phrases and licenses against plain versions, and their edge cases."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from ripplecast.llm import licenses, phrases, queries, vector_codes
from tests.llm import brute

# ---------------------------------------------------------------- vector codes


def test_nearest_is_argmin_over_the_trie():
    draw = np.random.default_rng(2)
    for far in (5, 3000, 1 << 40):
        parts = np.unique(draw.integers(-far, far, (300, 4)), axis=0)
        entries = draw.integers(-far, far, (16, 4))
        chosen, error = vector_codes.nearest(parts, entries)
        square = ((parts.astype(object)[:, None] - entries.astype(object)[None]) ** 2).sum(axis=2)
        assert chosen.tolist() == square.argmin(axis=1).tolist() and list(error) == list(square.min(axis=1))


def test_nearest_walks_wide_levels(monkeypatch):
    monkeypatch.setattr(vector_codes, "_WIDE", 3)
    draw = np.random.default_rng(4)
    parts = np.unique(draw.integers(-3, 3, (400, 5)), axis=0)
    entries = draw.integers(-3, 3, (7, 5))
    square = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert vector_codes.nearest(parts, entries)[0].tolist() == square.argmin(axis=1).tolist()


def test_vector_codes_of_a_table(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    want, books = brute.vector_codes([(r["vec_id"], r["embedding"]) for r in table])
    rows = queries.op11_trie_vector_codes(spark, folder).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in rows) == sorted(want)
    digest = vector_codes.Codebooks(books, 4096).sha256()
    assert {r["codebooks_sha256"] for r in rows} == {digest}
    labels, sums = {r["vec_id"]: r["label"] for r in table}, {}
    for i, _, error in want:
        sums[labels[i]] = sums.get(labels[i], 0) + error
    assert all(r["label_error"] == sums[labels[r["vec_id"]]] for r in rows)


def test_vector_codes_of_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(i, [i * 0.01 + k * 0.1 for k in range(11)], i % 3 or None) for i in range(40)]
    rows += [(None, [0.5] * 11, 1), (3, [0.03 + k * 0.1 for k in range(11)], None), (3, [-7.0] * 11, 9)]
    rows += [(50, [1e6] * 11, 9), (51, [-0.00001] * 11, 9)]
    bad = [(60, None, 1), (61, [nan] * 11, 1), (62, [inf] * 11, 1), (63, [0.1, None, *[0.2] * 9], 1)]
    short = [(70, [0.5] * 8, 9), (71, [], None)]
    made = spark.createDataFrame(rows + bad + short, "vec_id long, embedding array<double>, label int")
    found = vector_codes.compress(made.selectExpr("*", "'x' as code", "1 as p", "'y' as error")).collect()
    want, _ = brute.vector_codes([(i, v) for i, v, _ in rows])
    want += [(i, None, None) for i, _, _ in short]
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in found), key=repr) == sorted(want, key=repr)
    assert vector_codes.compress(made.limit(0)).count() == 0
    assert vector_codes.compress(made.where("vec_id > 59 and vec_id < 70")).count() == 0
    alone = vector_codes.compress(made.where("vec_id = 71")).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in alone] == [("00" * 8, 0, 0)]
    huge = spark.createDataFrame([(1, [0.0] * 8, 1), (2, [1e300] * 8, 1)], made.schema)
    far = [(k, [1e300 * (-1) ** (k % 2)] * 8, 1) for k in range(20)]
    assert vector_codes.compress(huge).count() == 2
    assert all(r["error"] <= (1 << 63) - 1 for r in vector_codes.compress(spark.createDataFrame(far, made.schema)).collect())


# ---------------------------------------------------------------- phrases


def _phrase_rows(found):
    return {(r["lang"], r["rank"]): tuple(r[c] for c in ("phrase", "a", "l", "r", "n", "score")) for r in found.collect()}


def test_phrases_of_a_table(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    found = _phrase_rows(queries.op12_best_first_phrases(spark, folder))
    assert found == brute.phrases([(r["text"], r["lang"]) for r in rows]) and found


@pytest.fixture(scope="module")
def babble(spark):
    """Few words, so that phrases share words, tie, and drop one another at many thresholds."""
    draw, rows = random.Random(5), []
    for _ in range(300):
        known = [f"w{int(draw.paretovariate(0.7))}" for _ in range(60)]
        known = [w if draw.random() < 0.9 else w + draw.choice(".,;\n") for w in known]
        rows.append((" ".join(known), draw.choice(["a", "b", None])))
    rows += [("set phrase here, " * 30, "a"), ("Set  Phrase\there! other set phrase", "a")]
    return rows


@pytest.mark.parametrize(("limit", "first", "wider"), [(2000, 2, 4), (15, 1, 2), (40, 1, 2), (3, 1, 2)])
def test_phrases_settle_over_rounds(spark, babble, monkeypatch, limit, first, wider):
    monkeypatch.setattr(phrases, "FIRST", first)
    monkeypatch.setattr(phrases, "WIDER", wider)
    made = spark.createDataFrame(babble, "text string, lang string")
    assert _phrase_rows(phrases.mine(made, limit=limit)) == brute.phrases(babble, limit=limit)


def test_full_bit_tables_change_nothing(spark, babble, monkeypatch):
    monkeypatch.setattr(phrases, "BITS", 64)
    made = spark.createDataFrame(babble, "text string, lang string")
    assert _phrase_rows(phrases.mine(made, limit=20)) == brute.phrases(babble, limit=20)


def test_phrases_of_odd_rows(spark, odd, rows_of):
    rows = [(i, t, s) for i, t, s in odd] + [(1, "x", "und"), (1, "é b " * 12, None), (1, "é b " * 12, "und")]
    made = rows_of(rows, "doc_id long, text string, lang string").selectExpr("*", "'q' as phrase", "1 as n", "2 as t")
    assert _phrase_rows(phrases.mine(made)) == brute.phrases([(t, s) for _, t, s in rows])
    assert phrases.mine(made.limit(0)).count() == 0
    assert phrases.mine(made.where("text = 'x'")).count() == 0


def test_long_texts_in_stretches(spark, monkeypatch):
    draw = random.Random(8)
    text = " ".join(f"w{draw.randint(0, 6)}" + draw.choice(["", "", "", "."]) for _ in range(2000))
    whole = phrases.Stretch(np.frombuffer(text.encode(), np.uint8))
    monkeypatch.setattr(phrases, "_BYTES", 100)
    monkeypatch.setattr(phrases, "_WORDS", 37)
    for size in (1, 2, 3):
        def counts(stretch):
            return {p: (n, c) for p, n, c in zip(*(x.tolist() for x in map(pa.array, stretch.counted(size, stretch.places(size)))))}

        summed = {}
        for stretch in phrases._stretches([text.encode()]):
            for p, (n, c) in counts(stretch).items():
                old = summed.get(p, (0, 0))
                summed[p] = (old[0] + n, old[1] + c)
        assert summed == counts(whole)


# ---------------------------------------------------------------- licenses


def test_base_licenses_of_a_table(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op13_diagonal_licenses(spark, folder).collect()
    assert len(rows) == len(texts) and any(r["n_base"] for r in rows)
    for r in rows:
        found, places = brute.base_licenses(texts[r["doc_id"]])
        starts = [p for p, _ in places]
        assert (r["n_words"], r["n_base"]) == (len(found), len(places))
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == bool(r["labels"])


def _changed(text, draw, every):
    """The text with a word in ``every`` added, left out or replaced."""
    made = []
    for k, word in enumerate(text.split()):
        if k % every == every - 1:
            made += draw.choice([[], ["zzz"], [word, "zzz"]])
        else:
            made.append(word)
    return " ".join(made)


def test_notices_survive_changes(spark):
    draw, rows, want = random.Random(1), [], {}
    noise = lambda n: " ".join(f"n{draw.randint(0, 99)}" for _ in range(n))
    for label, notice in licenses.NOTICES.items():
        for every in (10**6, 9)[: 1 + (len(notice) > 150)]:  # a changed word of a short one may be its point
            text = f"{noise(draw.randint(0, 300))}\n# {_changed(notice, draw, every)} {noise(draw.randint(0, 300))}"
            want[len(rows)] = label
            rows.append((len(rows), text))
    rows.append((len(rows), "permission is hereby granted to use copy and modify, and the software is here " * 3))
    rows.append((len(rows), " ".join(reversed(licenses.NOTICES["mit"].split()))))
    found = licenses.label(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        base = set(r["base_labels"].split(","))
        assert set(r["labels"].split(",")) - base - {""} == {want.get(r["doc_id"])} - base - {None}, r
    spans = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("not exact")
    assert spans.where("similarity < 0.8").count() == 0 and spans.count() == len(want)


def test_licenses_of_odd_rows(spark, odd, rows_of):
    rows = odd + [(20, "Released UNDER the-MIT-license", "a"), (20, "CC BY-NC; cc by nc", "a"),
                  (21, "cc by nc " * 3000, "b"), (21, "cc by nc " * 3000, "b"), (22, "cc by", "a"),
                  (23, "w " * 9000 + "apache license, version 2.0", None)]
    made = rows_of(rows).selectExpr("*", "'d' as digest", "1 as t", "'l' as label", "2 as first")
    found = licenses.label(made).collect()
    got = sorted((repr(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found)
    want = []
    for i, text, _ in rows:
        words, places = brute.base_licenses(text)
        starts = [p for p, _ in places]
        labels = ",".join(sorted({x for _, x in places}))
        want.append((repr(i), len(words), len(places), min(starts, default=None), max(starts, default=None), labels))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert licenses.label(made.limit(0)).count() == 0


def test_best_of_overlapping_notices():
    one, two = (1.0, 14, 0, 14, "cc-by-nc"), (1.0, 13, 0, 14, "cc-by")
    apart, worse = (0.9, 5, 20, 25, "isc"), (0.8, 9, 24, 33, "bsd")
    assert sorted(licenses.best_apart([two, worse, one, apart])) == sorted([one, apart])
