"""Nulls, empty, repeated and very long rows, empty tables, clashing columns; laws of the methods."""

import base64
import gzip
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from ripplecast.llm import bpe, embedding, exact_dedup, minhash, mixing, queries, secret_scan, sharding
from ripplecast.llm import token_files, toxicity, warc
from ripplecast.llm.tokens import codec
from ripplecast.session import scratch_path
from tests.llm import brute

VOCABULARY = public_tokenizers.path(queries.VOCABULARY)


@pytest.fixture(scope="module")
def docs(rows_of, odd):
    return rows_of(odd)


@pytest.fixture(scope="module")
def none(rows_of):
    return rows_of([])


def test_shards(docs, none, odd):
    tree = sharding.Tree.regular(3, 2, 4)
    rows = sharding.place(docs, tree, tree.grown()).collect()
    assert len(rows) == len(odd)
    assert sorted(r["size"] for r in rows) == sorted(8 + len((t or "").encode()) for _, t, _ in odd)
    assert sharding.place(none, tree).count() == 0


def test_tree_moves_only_where_weights_change(spark):
    keys, tree = spark.range(20_000), sharding.Tree.regular(3, 2, 4)
    shards = lambda t: [r[0] for r in keys.select(sharding.shard_of(keys["id"], t)).collect()]
    before, grown = shards(tree), shards(tree.grown())
    assert {b for a, b in zip(before, grown) if a != b} == {24}
    heavier = shards(tree.reweighted(5, 3.0, keep_total=True))
    moved = {(a, b) for a, b in zip(before, heavier) if a != b}
    assert moved and all({a, b} <= {4, 5, 6, 7} for a, b in moved)
    assert max(before.count(s) for s in range(24)) < 1.2 * 20_000 / 24


def test_archive(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (2, "u", "same"), (3, "é\r\nx", None), (4, "u", ""), (None, "u", "ü")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as sha256")
    read = warc.read_archive(spark, warc.write_archive(pages))
    found = sorted(map(tuple, warc.parsed(read).collect()), key=repr)
    digest = lambda text: brute.sha1_base32(text.encode())
    assert found == sorted(
        [(1, 4, digest("same"), "response", None), (2, 4, digest("same"), "revisit", 1),
         (2, 4, digest("same"), "revisit", 1), (3, 0, digest(""), "response", None),
         (4, 0, digest(""), "revisit", 3), (None, 2, digest("ü"), "response", None)], key=repr)
    record = read.where("page_id = 1").first()["record"]
    head, rest = record.split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\nsame\r\n\r\n")
    assert int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"]) == len(rest) - 4
    assert warc.read_archive(spark, warc.write_archive(pages.limit(0))).count() == 0


def test_bpe(docs, none, odd):
    want = Tokenizer.from_file(VOCABULARY)
    rows = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY).collect()
    found = sorted((repr(r["doc_id"]), codec(VOCABULARY).ids(r["ids"]).tolist(), r["text"]) for r in rows)
    expected = [(repr(i), want.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _ in odd]
    assert found == sorted(expected)
    assert bpe.encode(none, VOCABULARY).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_codec_gives_the_librarys_ids(name, odd):
    coder = codec(public_tokenizers.path(name))
    assert (coder.ranks is not None) == (name == "byte_bpe_50k.json")
    draw = np.random.default_rng(4)
    marks = list("ab'sZé日ñ  \n\t.,!?0٣\xa0\x1c\u2028") + ["'ll", " <|endoftext|> ", "  \n ", "😀", "e\u0301"]
    texts = [t or "" for _, t, _ in odd] + ["".join(draw.choice(marks, 60)) for _ in range(400)]
    assert coder.encode(texts) == coder.library(texts)


def test_shared_chunks_agree(rows_of):
    random = np.random.default_rng(3)
    passage = " ".join("".join(random.choice(list("abcdeé"), 5)) for _ in range(3000))
    rows = [(i, "x" * i + passage[i * 7 :] + " end" * i, "s") for i in range(8)]
    found = bpe.encode(rows_of(rows), VOCABULARY).collect()
    want = Tokenizer.from_file(VOCABULARY)
    assert len(found) == 8
    for r in found:
        ids = want.encode(rows[r["doc_id"]][1], add_special_tokens=False).ids
        assert codec(VOCABULARY).ids(r["ids"]).tolist() == ids


def test_token_files(spark, docs, none, odd):
    rows = token_files.read_archive(spark, token_files.write_archive(docs, VOCABULARY)).collect()
    assert len(rows) == len(odd)
    rows.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows[:-1]]]).tolist()
    assert token_files.read_archive(spark, token_files.write_archive(none, VOCABULARY)).count() == 0


def test_packing():
    random = np.random.default_rng(1)
    counts = random.integers(0, 9, 200)
    ranks = (2 ** (random.random(counts.sum()) * 32)).astype(np.uint32)
    packed = token_files.pack(ranks, counts)
    control, data = (b"".join(p[i] for p in packed) for i in (0, 1))
    assert (token_files.unpack(control, data, counts) == ranks).all()


def test_vectors_of_any_size(spark):
    """Cosines do not depend on the length of a vector, however large or small."""
    far = [(i, [scale * x for x in (3.0, 4.0, 0.0)], 1) for i, scale in enumerate((1.0, 1e200, 1e-200, 1e-320))]
    rows = far + [(9, [0.0, 0.0, 0.0], 1), (10, [float("inf"), 1.0, 0.0], 1), (11, [1e308, -1e308, 0.0], 1)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding.link(made).collect()}
    assert {i: found[i] for i in (0, 1, 2)} == {0: (3, 0), 1: (3, 0), 2: (3, 0)}
    assert found[9] == (0, 9) and found[10] == (0, 10) and found[11] == (0, 11)


def test_toxicity_learns_as_a_plain_learner(spark):
    """FTRL-proximal one document and one feature at a time gives the same weights."""
    draw = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(90):
        toxic = int(draw.random() < 0.4)
        words = list(draw.choice(["calm", "sun", "tree", "walk", "road"], 8))
        if toxic and draw.random() < 0.9:
            words[draw.integers(8)] = draw.choice(["vile", "foul"])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows + [(0, "zzz repeats an id")], "doc_id long, text string")
    how = {"passes": 2, "alpha": 0.5, "beta": 1.0, "l1": 0.3, "l2": 0.01, "least_docs": 3, "toxic_weight": 1.5}
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), **how)

    order = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "xxhash64(doc_id) as h").collect()}
    held = [(order[i], y, toxicity.features([text.encode()])[0]) for (i, text), (_, y) in zip(rows, labels)]
    held.sort(key=lambda one: (one[0], one[1], one[2].tobytes()))
    seen = {}
    for _, _, at in held:
        for f in at.tolist():
            seen[f] = seen.get(f, 0) + 1
    z, n, bias = {}, {}, "bias"

    def weight(f):
        size, l1, l2 = z.get(f, 0.0), 0.0 if f == bias else how["l1"], 1e-6 if f == bias else how["l2"]
        if abs(size) <= l1:
            return 0.0
        rate = (how["beta"] + n.get(f, 0.0) ** 0.5) / how["alpha"] + l2
        return (np.sign(size) * l1 - size) / rate

    for turn in range(how["passes"]):
        for place in np.random.default_rng(turn).permutation(len(held)):
            _, y, at = held[place]
            own = [f for f in at.tolist() if seen[f] >= how["least_docs"]] + [bias]
            w = {f: weight(f) for f in own}
            slope = (1 / (1 + np.exp(-sum(w.values()))) - y) * (how["toxic_weight"] if y else 1.0)
            for f in own:
                before = n.get(f, 0.0)
                n[f] = before + slope * slope
                z[f] = z.get(f, 0.0) + slope - (n[f] ** 0.5 - before**0.5) / how["alpha"] * w[f]
    want = {f: weight(f) for f in z if f != bias and weight(f)}
    assert model.bias == pytest.approx(weight(bias), abs=1e-9)
    assert dict(zip(model.places.tolist(), model.values.tolist())) == pytest.approx(want, abs=1e-9)
    assert len(want) > 4


def test_secret_layers():
    text = 'é token="abcdefgh" '
    inner = "password: hunter2hunter2"
    hidden = {
        "url": inner.replace(":", "%3A"),
        "unicode": inner.replace(":", "\\u003a"),
        "base64": base64.b64encode(inner.encode()).decode(),
        "packed": base64.b64encode(gzip.compress(inner.encode())).decode(),
        "twice": base64.b64encode(base64.b64encode(inner.encode())).decode(),
        "mixed": base64.b64encode(inner.replace(":", "%3A").encode()).decode().replace("=", "%3D"),
    }
    for name, code in hidden.items():
        found, layers, refused = secret_scan.scan_text(text + code + " z")
        start = len(text)
        assert layers > 1 and not refused, name
        assert (2, 0, 17, "") in found, name
        assert any(a == start and start < b <= start + len(code) for a, _, b, path in found if path), name
    assert secret_scan.scan_text("") == ([], 1, 0)
    bomb = base64.b64encode(gzip.compress(b"a" * 10_000)).decode()
    assert secret_scan.scan_text(bomb, most=1000, unpacked=2000)[2] >= 1


@pytest.mark.parametrize("odd", ["\xa0", "\u3000", "\u200d", "\ufeff", "\f", "\u2028", "\x00"])
def test_secret_layers_of_any_text(odd):
    """One character that does not print hides neither the layer nor what is nested in it."""
    secret = "password: hunter2hunter2"
    nested = base64.b64encode(secret.encode()).decode()
    for inner in (f"{secret} é {odd} z", f"{nested} é {odd} z"):
        for raw in (inner.encode(), gzip.compress(inner.encode()), zlib.compress(inner.encode(), 1)):
            found, _, refused = secret_scan.scan_text("a " + base64.b64encode(raw).decode() + " z")
            assert [(a, k) for a, k, _, _ in found] == [(2, 0)] and not refused


def test_secret_layers_of_packed_bytes():
    code = base64.b64encode(gzip.compress(b"\xff\x00 password: hunter2hunter2 \xe9")).decode()
    assert secret_scan.scan_text(f"a {code} z")[0] == [(2, 0, 2 + len(code), "base64")]
    code = base64.b64encode(b"\xff\xfe password: hunter2hunter2 \xff").decode()
    assert [x[:2] for x in secret_scan.scan_text(code)[0]] == [(4, 0)]
    noise = base64.b64encode(np.random.default_rng(1).bytes(30_000)).decode()
    assert secret_scan.scan_text(noise)[0] == []


def test_secret_layers_around_bad_bytes():
    """One byte that is no UTF-8 hides nothing of its run."""
    secret = "token=abcdefgh12345678"
    url = "%E9" + "".join(f"%{b:02x}" for b in secret.encode())
    escapes = "\\ud800" + "".join(f"\\u{ord(c):04x}" for c in secret)
    code = base64.b64encode(b"\xff\xc3 " + secret.encode() + b" \x80").decode()
    for text, width in ((url, 3), (escapes, 6)):
        assert (width, 0, width * (1 + len(secret))) in {x[:3] for x in secret_scan.scan_text(text)[0]}
    for before in ("", "key_", "a/"):
        assert any(x[1] == 0 for x in secret_scan.scan_text(f"a {before}{code} z")[0]), before


def test_secret_layers_of_all_members():
    secret = b"password: hunter2hunter2"
    small = zlib.compressobj(9, zlib.DEFLATED, 9)
    raws = {
        "gzip": gzip.compress(b"first ") + gzip.compress(secret),
        "zlib": zlib.compress(b"first ") + zlib.compress(secret),
        "zstandard": zstandard.compress(b"first ") + zstandard.compress(secret),
        "small window": small.compress(b"first " + secret) + small.flush(),
        "cut": gzip.compress(b"first " + secret + b" " + bytes(range(256)) * 8)[:-6],
    }
    for name, raw in raws.items():
        code = base64.b64encode(raw).decode()
        assert secret_scan.scan_text(f"a {code} z")[0] == [(2, 0, 2 + len(code), "base64")], name


def test_secret_layers_of_large_data():
    """Data beyond a layer's size are read in windows, also nested ones."""
    secret = b" password: hunter2hunter2 "
    for place in (0, 9_990, 49_000):
        data = b"x" * place + secret + b"y" * (50_000 - place)
        nested = base64.b64encode(gzip.compress(base64.b64encode(gzip.compress(data)))).decode()
        for code in (base64.b64encode(gzip.compress(data)).decode(), nested):
            found, _, refused = secret_scan.scan_text(f"a {code} z", most=10_000)
            assert [x[:3] for x in found] == [(2, 0, 2 + len(code))] and not refused


def test_secret_layers_cost_what_is_decoded():
    secret = "password: hunter2hunter2"
    url = lambda t: "".join(f"%{b:02X}" for b in t.encode())
    escaped = lambda t: "".join(f"\\u{ord(c):04x}" for c in t)
    code = lambda t: base64.b64encode(t.encode()).decode()
    nested = " ".join(f(g(secret)) for f in (url, escaped, code) for g in (url, escaped, code))
    text = "prose and more prose, " * 64_000 + nested
    started = time.process_time()
    found = secret_scan.scan_text(text)[0]
    assert time.process_time() - started < 4
    begins = [m.start() + 22 * 64_000 for m in re.finditer(r"\S+", nested)]
    for a, b in zip(begins, [*begins[1:], len(text) + 1]):
        assert any(a <= x[0] and x[2] < b and x[1] == 0 for x in found)


def test_secret_layers_of_random_nestings():
    """Secrets in random stacks of encodings among prose are found where the outermost run stands."""
    draw = np.random.default_rng(9)
    steps = [
        lambda t: "".join(f"%{b:02x}" for b in t.encode()),
        lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
        lambda t: base64.b64encode(t.encode()).decode(),
        lambda t: base64.b64encode(gzip.compress(t.encode())).decode(),
        lambda t: base64.b64encode(zlib.compress(t.encode())).decode(),
    ]
    for _ in range(60):
        text, want = "", []
        for _ in range(draw.integers(1, 4)):
            inner = f"secret={''.join(draw.choice(list('abcdefgh'), 12))} ok"
            for step in draw.choice(len(steps), draw.integers(1, 4)):
                inner = steps[step](inner)
            text += "some words, "
            want.append((len(text), len(text) + len(inner)))
            text += inner + " . "
        found = [x for x in secret_scan.scan_text(text)[0] if x[3]]
        for a, b in want:
            assert any(a <= x[0] and x[2] <= b and x[1] == 0 for x in found), text
        assert all(any(a <= x[0] and x[2] <= b for a, b in want) for x in found)


@pytest.mark.parametrize("width, end", [(64, "\n"), (76, "\r\n"), (64, "\n  ")])
def test_secret_layers_of_wrapped_runs(width, end):
    """Secrets and characters across a wrap, packed data of many lines, what stands around them."""
    random = np.random.default_rng(4)
    noise = " ".join(map(str, random.integers(0, 1 << 60, 90)))
    inner = "é" * 23 + "x password: hunter2hunter2 " + noise + " secret=abcdefgh12345678 ü"
    for raw in (inner.encode(), gzip.compress(inner.encode()), zlib.compress(inner.encode())):
        code = base64.b64encode(raw).decode()
        lines = [code[i : i + width] for i in range(0, len(code), width)]
        for before, after in (("é ", " z"), ("-----BEGIN A CERTIFICATE-----\n", "\n-----END A CERTIFICATE-----"),
                              ("internationalisations\n", "\nword"), ("key_", "\n")):
            text = before + end.join(lines) + after
            place = [i for i, c in enumerate(text) if len(before) <= i < len(text) - len(after) and c not in " \r\n"]
            want = set()
            for secret in ("password: hunter2hunter2", "secret=abcdefgh12345678"):
                a, b = (len(x.encode()) for x in (inner[: inner.index(secret)], inner[: inner.index(secret)] + secret))
                if raw == inner.encode():
                    want.add((place[a * 4 // 3], 0, place[-(-b * 4 // 3) - 1] + 1))
                else:
                    want.add((len(before), 0, len(text) - len(after)))
            assert want <= {x[:3] for x in secret_scan.scan_text(text)[0]}, (before, raw[:2])


def test_secret_layers_of_joined_and_listed_runs():
    secret = "password: hunter2hunter2"
    code = base64.b64encode(secret.encode()).decode()
    for before in ("path/", "some/path-of_the/", "key_", "Pz8/", "x-y-"):
        for raw in (secret.encode(), gzip.compress(secret.encode())):
            joined = base64.b64encode(raw).decode()
            spans = {x[:3] for x in secret_scan.scan_text(f"{before}{joined} z")[0]}
            assert any(a in (len(before), 0) and b == len(before + joined) for a, _, b in spans), before
    spans = {x[:3] for x in secret_scan.scan_text(f"{code}\n{code}\n{code}")[0]}
    assert {(i * (len(code) + 1), 0, i * (len(code) + 1) + len(code)) for i in range(3)} <= spans


def test_secret_layers_of_long_noise():
    """Runs without an end in sight take time that grows with their length."""
    code = base64.b64encode(b"???" * 60_000 + b"\xff").decode()
    lines = "\n".join(code[i : i + 64] for i in range(0, len(code), 64))
    for text in (code, lines, "x" * 200_000):
        secret_scan.scan_text(text)


def test_secret_scan_rows(docs, none, odd):
    assert secret_scan.digests(secret_scan.scan(docs)).count() == len(odd)
    assert secret_scan.scan(none).count() == 0


def test_exact(spark, docs, none, odd):
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "index")).open()
    rows = exact_dedup.deduplicate(docs, index).collect()
    assert len(rows) == len(odd)
    keep = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in rows if r["doc_id"] is not None}
    assert keep[1] == keep[2] == keep[3] == (3, 4) and keep[4] == (4, 1)
    assert keep[6] == keep[7] == (7, 3)
    again = exact_dedup.deduplicate(docs, index).collect()
    assert not any(r["kept"] for r in again) and index.rows().count() == len({r["text_sha256"] for r in rows})
    assert exact_dedup.deduplicate(none, index).count() == 0
    fresh = exact_dedup.DigestIndex(spark, scratch_path(spark, "index")).open()
    kept = exact_dedup.keep_one(docs, fresh)
    assert kept.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(map(repr, [3, 4, 5, 7, 8, 9, 10, None]))


def test_near(docs, none, odd):
    rows = minhash.link(docs, width=2).collect()
    assert len(rows) == len(odd)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["n_shingles"] == 0 and by[2]["kept"] and by[5]["component_id"] == 4
    assert by[7]["component_id"] == 6 and by[9]["n_shingles"] == 1
    assert minhash.link(none).count() == 0
    assert minhash.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("block", [2048, 7])
def test_a_group_whose_copies_lie_about_the_threshold(rows_of, monkeypatch, block):
    """No copy is the original: many pairs are links, many are not, some copies link with none."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    draw = np.random.default_rng(21)
    original = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(140):
        words = list(original)
        for at in draw.choice(90, draw.integers(2, 14), replace=False):
            words[at] = f"x{i}-{at}"
        rows.append((i, " ".join(words), "s"))
    found = minhash.link(rows_of(rows), width=2, rounds=1).collect()
    want = brute.near({i: t for i, t, _ in rows}, 2)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert 1 < len({c for _, c in want.values()}) < 140


def test_one_document_of_a_group_stays(rows_of):
    """Also where ids are null or repeat with another text."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, f"{text} a{i}", "s") for i in range(3)] + [(5, f"{text.upper()} b c{i}", "s") for i in range(2)]
    rows += [(9, "quite another text of its own", "s"), (None, "", "s"), (None, "", "s"), (9, "quite another text of its own", "s")]
    kept = minhash.keep_one(rows_of(rows)).collect()
    assert len(kept) == 1 + 4 and sum(r["doc_id"] == 9 for r in kept) == 2
    far = [(None, f"{text} {i}", "s") for i in range(3)] + [(7, f"v{text} {i}".replace(" w", " v"), "s") for i in range(3)]
    assert sorted(r["doc_id"] or 0 for r in minhash.keep_one(rows_of(far)).collect()) == [0, 7]


def test_near_copies_in_chains(rows_of):
    """Groups in which most pairs, but not all, are similar enough; templates below the threshold."""
    random = np.random.default_rng(5)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(150):
        words = list(base)
        for at in random.choice(120, int(random.integers(1, 9)), replace=False):
            words[at] = f"x{random.integers(10_000)}"
        rows.append((i, " ".join(words), "s"))
    for i in range(150, 190):
        rows.append((i, " ".join([*base[:90], *[f"y{i}_{k}" for k in range(40)]]), "s"))
    want = brute.near({i: t for i, t, _ in rows}, 2)
    found = minhash.link(rows_of(rows), width=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want


def test_vectors(spark):
    random = np.random.default_rng(2)
    base = random.standard_normal(16)
    rows = [(i, (base + random.standard_normal(16) * 0.05).tolist(), 1) for i in range(1200)]
    rows += [(2000, base.tolist(), None), (2001, None, 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1),
             (2004, [None, *base.tolist()[1:]], 1), (2005, [], 1), (2006, base.tolist()[:8], 1),
             (2007, rows[0][1], 1), (2008, rows[0][1], 2), (None, rows[0][1], 1)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as class")
    found = embedding.link(made).collect()
    assert len(found) == len(rows)
    known = [r for r in rows if r[0] is not None]
    fit = np.array([r[1] for r in known[:1200]] + [rows[0][1]] * 2)
    unit = fit / np.linalg.norm(fit, axis=1, keepdims=True)
    counts = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    by = {r["vec_id"]: r for r in found if r["vec_id"] is not None}
    assert [by[i]["n_links"] for i in range(1200)] == counts[:1200].tolist()
    assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in (*range(2000, 2007), 2008))
    assert embedding.link(made.limit(0)).count() == 0


def test_toxicity(spark, docs, none, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scores = [r["p"] for r in toxicity.with_score(docs, model, "p").collect()]
    assert len(scores) == len(odd) and all(0 <= s <= 1 for s in scores)
    assert toxicity.keep_clean(none, toxicity.fit(none, labels.limit(0))).count() == 0
    assert toxicity.keep_clean(docs, toxicity.Model()).columns == docs.columns


def test_mix(docs, none, odd):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(odd)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(none).count() == 0
    assert mixing.drawn(docs).columns == docs.columns


def test_stages_on_odd_rows(spark, docs, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() > 0
