"""The registered queries of this subpackage, and their SQL where SQL can say what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import line_dedup as lines
from lodestar.llm import mixing
from lodestar.llm.embedding_dedup import embedding_dedup
from lodestar.llm.fingerprint import fingerprints
from lodestar.llm.hard_negatives import hard_negatives
from lodestar.llm.int_vectors import usable, whole
from lodestar.llm.ngram_join import ngram_join
from lodestar.llm.packing import pack
from lodestar.llm.pii import find_pii
from lodestar.llm.quality import held_out, score, train
from lodestar.llm.secrets import find_secrets
from lodestar.llm.suffix_dedup import suffix_dedup
from lodestar.llm.tables import read
from lodestar.llm.warc import warc_round_trip
from lodestar.llm.whitening import whiten


def vocabulary() -> str:
    """The path, outside the repository, of the vocabulary that packing counts by; found only when it is asked for."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")



def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read(spark, sf_dir, "embeddings"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), mixing.label_weights(read(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out()))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "n_spans", F.sha2("base", 256).alias("base_sha256"), "spans")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_added", F.sha2("base", 256).alias("base_sha256"), "spans")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").where(usable("embedding")).select(F.col("vec_id").alias("id"), moved.alias("label"), whole("embedding").alias("x"))
    return hard_negatives(rows, anchors=F.col("id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_embedding_dedup, op2_ngram_join, op3_mixing, op4_warc, op5_suffix_dedup, op6_line_dedup, op7_packing, op8_quality, op9_fingerprints, op10_pii, op11_whitening, op12_secrets, op13_hard_negatives)
    return {f.__name__: f for f in found}


#: All pairs of equal label; DuckDB walks the links of each vector.
OP1_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
  FROM embeddings WHERE label IS NOT NULL AND sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comps AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM links l WHERE l.a = c.vec_id)::BIGINT AS n_links, c.component_id, c.component_id = c.vec_id AS kept FROM comps c
"""

OP2_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS k FROM rows a JOIN rows b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM common WHERE 100 * k >= 75 * (n + m - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.component_id FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON s.doc_id = r.a
"""

OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS owner FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN owner <> page_id THEN owner END AS refers_to FROM o
"""


#: Every anchor against every row; scores are sums of whole numbers, exact in double precision.
OP13_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.id % 50 = 0 AND (a.id <> b.id OR a.label <> b.label)
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1_SQL, "op2_ngram_join": OP2_SQL, "op3_mixing": mixing.SQL, "op4_warc": OP4_SQL, "op6_line_dedup": lines.SQL, "op13_hard_negatives": OP13_SQL}
