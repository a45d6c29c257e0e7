"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import (
    bpe_automaton,
    html_extraction,
    jaccard_join,
    licenses,
    merkle_manifest,
    mixing,
    near_vectors,
    projection_forest,
    suffix_dedup,
    token_counts,
    toxicity,
    warc,
    whitening,
)
from marquee.plans.lineage import materialize

COUNT_TOKENIZER = "byte_bpe_50k.json"
ENCODE_TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(documents).select(
        F.col("_doc.doc_id").cast("bigint").alias("doc_id"),
        "n_bytes",
        "n_removed",
        "n_spans",
        "kept_sha256",
    )


@query
def op2_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = read(spark, sf_dir, "embeddings")
    return projection_forest.nearest(embeddings, F.col("vec_id") % 20 == 0)


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(read(spark, sf_dir, "documents"))


ORACLE["op4_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^ 	-
]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    END) AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n_a, b.n AS n_b, count(*) AS joint
  FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * joint >= 90 * (n_a + n_b - joint)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles,
  (SELECT min(b) FROM reach WHERE reach.a = sets.doc_id) AS component_id
FROM sets
"""


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE["op6_warc"] = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
originals AS (
  SELECT h, max(page_id) AS original FROM payloads WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM payloads p LEFT JOIN originals o ON p.h = o.h
"""


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(COUNT_TOKENIZER)
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), path)


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.account(read(spark, sf_dir, "documents"))


ORACLE["op8_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]
      [((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM named
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
rated AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('0:' || doc_id::VARCHAR), 1, 13))::BIGINT
      / 4503599627370496.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""


@query
def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(ENCODE_TOKENIZER)
    encoded = bpe_automaton.encode_documents(read(spark, sf_dir, "documents"), path)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.link_vectors(read(spark, sf_dir, "embeddings"))


ORACLE["op10_near_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
least_id AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, l.component_id,
  e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least_id l ON l.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""


@query
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(read(spark, sf_dir, "pages"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.audit(read(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        merkle_manifest.proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        "verified",
    )


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    columns = ("doc_id", "source", "lang", "n_chars", text)
    return f"sha256({' || '.join(map(_field, columns))})"


ORACLE["op13_merkle_manifest"] = f"""
WITH RECURSIVE digits AS (
  SELECT *, row_number() OVER () AS rid, doc_id::VARCHAR AS d FROM documents),
leaves AS (
  SELECT rid, doc_id, source, {_leaf("text")} AS leaf, {_leaf("replace(text, chr(10), '')")} AS bare,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, length(d) + 1), lambda i: ascii(d[i])::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda i: 0::BIGINT)),
        lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) AS crc
  FROM digits),
placed AS (
  SELECT rid, doc_id, leaf, CASE WHEN crc % 2 = 0 THEN bare ELSE leaf END AS now,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaves),
low AS (
  SELECT src, 0 AS level, pos AS i, leaf AS h, count(*) OVER (PARTITION BY src) AS n FROM placed
  UNION ALL
  SELECT src, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3)
  FROM low WHERE n > 1 GROUP BY src, level, i // 3),
subroots AS (SELECT src, h FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, src AS i, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3)
  FROM high WHERE n > 1 GROUP BY level, i // 3),
nodes AS (SELECT src, level, i, h, n FROM low UNION ALL SELECT -1, level, i, h, n FROM high),
sides AS (
  SELECT a.src, a.level, a.i,
    coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before,
    coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
  FROM nodes a JOIN nodes b ON a.src = b.src AND a.level = b.level AND a.i // 3 = b.i // 3
  WHERE a.n > 1 GROUP BY ALL),
climb AS (
  SELECT rid, src, src AS place, 0 AS level, pos AS i, '' AS proof, now AS h FROM placed
  UNION ALL
  SELECT c.rid, c.src, c.place, c.level + 1, c.i // 3, c.proof || s.before || s.after,
    sha256(s.before || c.h || s.after)
  FROM climb c JOIN sides s ON c.place = s.src AND c.level = s.level AND c.i = s.i),
arrived AS (
  SELECT rid, src, proof, h FROM climb
  WHERE NOT EXISTS (FROM sides s WHERE s.src = place AND s.level = climb.level AND s.i = climb.i)),
rise AS (
  SELECT rid, 0 AS level, src AS i, proof, h FROM arrived
  UNION ALL
  SELECT c.rid, c.level + 1, c.i // 3, c.proof || s.before || s.after,
    sha256(s.before || c.h || s.after)
  FROM rise c JOIN sides s ON s.src = -1 AND c.level = s.level AND c.i = s.i),
top AS (
  SELECT rid, proof, h FROM rise WHERE level = (SELECT max(level) FROM high)),
whole AS (SELECT h AS root FROM high WHERE n = 1)
SELECT doc_id, leaf, subroots.h AS subroot, root, sha256(proof) AS proof_sha256, top.h AS folded_root,
  top.h = root AS verified
FROM placed JOIN subroots ON placed.src = subroots.src JOIN top ON placed.rid = top.rid, whole
"""
