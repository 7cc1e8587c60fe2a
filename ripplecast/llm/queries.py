"""The named queries of the operators and the SQL for their results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplecast.llm import bpe, embedding, exact_dedup, licenses, minhash, mixing, phrases, secret_scan
from ripplecast.llm import sharding, token_files, toxicity, vector_codes, warc
from ripplecast.llm.common import table
from ripplecast.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards: three regions of two racks of four shards."""
    tree = sharding.Tree.regular(3, 2, 4)
    return sharding.place(table(spark, sf_dir, "documents"), tree, tree.grown())


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = warc.write_archive(pages, least_bytes=0)
    return warc.parsed(warc.read_archive(spark, path), dict(pages.dtypes)["page_id"])


def op3_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path(VOCABULARY)
    path = token_files.write_archive(table(spark, sf_dir, "documents"), vocabulary, end_id=0)
    return token_files.id_digests(token_files.read_archive(spark, path))


def op5_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def op6_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "index")).open()
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"), index)


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.link(table(spark, sf_dir, "documents"), width=2, per_cent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_p_stable_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.link(table(spark, sf_dir, "embeddings"), least=0.98)


def op9_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.with_score(docs.select("doc_id", "text"), model, "score")
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op10_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op11_trie_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_best_first_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.label(table(spark, sf_dir, "documents"))


QUERIES = {
    name: function
    for name, function in dict(globals()).items()
    if name.startswith("op") and callable(function)
}

_WARC = """
WITH p AS (
  SELECT page_id, COALESCE(html, '') AS body, sha1(COALESCE(html, '')) AS h FROM pages
), f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(p.h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT)
      >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (h)
"""

_EXACT = r"""
WITH d AS (
  SELECT doc_id, COALESCE(text, '') AS body,
    sha256(regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), f AS (
  SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY length(body) DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY h) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM f
"""



def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """One table of assignments and one of codebooks a round; lists are taken apart into rows."""
    steps = []
    for turn in range(rounds + 1):
        steps.append(f"""
a{turn} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, dist * {entries} + e) AS e, min(dist) AS dist FROM (
    SELECT x.vec_id, x.p, b.e, CAST(sum((x.v - b.v) * (x.v - b.v)) AS BIGINT) AS dist
    FROM x JOIN b{turn} b ON x.p = b.p AND x.k = b.k GROUP BY x.vec_id, x.p, b.e
  ) GROUP BY vec_id, p)""")
        if turn < rounds:
            steps.append(f"""
b{turn + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.k, COALESCE(m.v, b.v) AS v FROM b{turn} b LEFT JOIN (
    SELECT p, e, k, (s - ((s % n) + n) % n) // n AS v FROM (
      SELECT x.p, a.e, x.k, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n
      FROM x JOIN a{turn} a ON x.vec_id = a.vec_id AND x.p = a.p GROUP BY x.p, a.e, x.k)
  ) m ON b.p = m.p AND b.e = m.e AND b.k = m.k)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding AS q, len(embedding) // {parts} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), flat AS (
  SELECT vec_id, w, unnest(range(0, len(q))) AS i, unnest(q) AS c FROM kept
), x AS MATERIALIZED (
  SELECT vec_id, i // w AS p, i % w AS k, CAST(floor(CAST(c AS DOUBLE) * 4096) AS BIGINT) AS v FROM flat
), b0 AS MATERIALIZED (
  SELECT x.p, s.e, x.k, x.v FROM x
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) s ON x.vec_id = s.vec_id
  WHERE s.e < {entries}
), {",".join(steps)},
c AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code,
    CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
)
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY kept.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, k)) FROM b{rounds}) AS codebooks_sha256
FROM c JOIN kept USING (vec_id)
"""

_PHRASES = r"""
WITH pieces AS (
  SELECT doc, lang, unnest(range(1, len(cut) + 1)) AS p, unnest(cut) AS piece FROM (
    SELECT row_number() OVER () AS doc, COALESCE(lang, 'und') AS lang,
      string_split_regex(translate(COALESCE(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS cut FROM documents)
), worded AS (
  SELECT doc, lang, p, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM (
    SELECT doc, lang, p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces)
), grams AS (
  SELECT lang, w AS w1, lead(w) OVER follow AS w2, lead(w, 2) OVER follow AS w3 FROM worded
  WINDOW follow AS (PARTITION BY doc, p ORDER BY i)
), named AS (
  SELECT lang, 1 AS m, w1 AS phrase FROM grams
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM grams WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM grams WHERE w3 IS NOT NULL
), f AS MATERIALIZED (
  SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS a FROM named GROUP BY lang, m, phrase
), n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.m, c.phrase, c.a, k,
    array_to_string(string_split(c.phrase, ' ')[1 : k], ' ') AS head,
    array_to_string(string_split(c.phrase, ' ')[k + 1 :], ' ') AS tail
  FROM f c, (VALUES (1), (2)) cut(k) WHERE c.m > 1 AND k < c.m AND c.a >= 10
), scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, x.a AS l, y.a AS r, 1000000 * c.a * c.a // (x.a * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head AND x.m = c.k
    JOIN f y ON y.lang = c.lang AND y.phrase = c.tail AND y.m = c.m - c.k
), best AS MATERIALIZED (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), parts AS (
  SELECT lang, a, array_to_string(string_split(phrase, ' ')[s : s + 1], ' ') AS part
  FROM best, (VALUES (1), (2)) starts(s) WHERE m = 3
), gone AS (
  SELECT DISTINCT b.lang, b.phrase FROM best b
  JOIN parts p ON b.lang = p.lang AND b.phrase = p.part WHERE b.m = 2 AND 100 * p.a >= 50 * b.a
), ranked AS (
  SELECT lang, phrase, a, l, r, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best ANTI JOIN gone USING (lang, phrase)
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n,
  CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


ORACLE = {
    "op2_warc_archive": _WARC,
    "op6_digest_index": _EXACT,
    "op12_best_first_phrases": _PHRASES,
    "op11_trie_vector_codes": _vector_codes(),
}
