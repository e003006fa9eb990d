"""The registered queries over the driver's tables, each beside the SQL that must return the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.hashing import content_hash, shard_of, virtual_shard
from lodestar.functions.text import clean, label_prompt, sentence_pattern
from lodestar.functions.vectors import as_doubles, clamped, frames, norm, normalized, pooled, rescaled, softmax
from lodestar.functions.mojibake import repaired
from lodestar.functions.tags import promoted, tag, variant_of, with_tags
from lodestar.operators import dedup_cache, encoders, listwise, ltr, store
from lodestar.operators.boxes import suppressed
from lodestar.operators.byte_pairs import byte_pair_ids, byte_pair_texts
from lodestar.operators.images import prepared
from lodestar.operators.index import InvertedFile, apply_delta, classify_delta, last_wins, mark_deleted, search_live, status, update_known, upsert
from lodestar.operators.knn import fill_embedding, hydrate, knn_join, merge_shards
from lodestar.operators.neighbour_graph import NeighbourGraph
from lodestar.operators.product_lists import ProductLists
from lodestar.operators.projection_forest import ProjectionForest
from lodestar.operators.rankers import simple_rank
from lodestar.operators.sentencizer import sentencize
from lodestar.operators.spectra import power_spectra
from lodestar.operators.traversal import children, has_text, roots, traverse
from lodestar.operators.widened import widened
from lodestar.plans.compound import SearchStore
from lodestar.session import load
from lodestar.sources.dump import dump_rows, load_vectors
from lodestar.sources.scratch import Scratch
from lodestar.sources.versioned import VersionedTable
from lodestar.streaming.content_cache import cached
from lodestar.streaming.dedup import drop_seen

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
K = 10


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def r6(c: str | Column) -> Column:
    """Rounded to six places, and never minus zero."""
    return F.round(c, 6) + F.lit(0.0)


#: Every component counts for its place, so a digest tells any two vectors apart that differ beyond rounding.
_WEIGHED = "round(list_sum(list_transform(v, lambda x, i: x::DOUBLE * i)), 6) + 0.0"


def _weighed(col: str) -> Column:
    return r6(F.aggregate(F.transform(F.col(col).cast("array<double>"), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x))


# --- vector search: every row whose id is divisible by 50 is a query, all rows are searched -------------------------

_DOT, _NORM_A, _NORM_B = "list_dot_product(q.v, x.v)", "sqrt(list_dot_product(q.v, q.v))", "sqrt(list_dot_product(x.v, x.v))"
_COS = f"{_DOT} / ({_NORM_A} * {_NORM_B})"
_SQUARED = f"greatest(0.0, list_dot_product(q.v, q.v) + list_dot_product(x.v, x.v) - 2 * {_DOT})"


def _knn_sql(raw: str, score: str, order: str, where: str = "true", k: int = K) -> str:
    return f"""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, x.vec_id AS match_id, {raw} AS raw FROM v q, v x WHERE q.vec_id % 50 = 0 AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) {order}, match_id) AS rank FROM p)
SELECT query_id, match_id, rank::INTEGER AS rank, round({score}, 6) + 0.0 AS score FROM r WHERE rank <= {k}"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("id") % 50 == 0)


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "match_id", "rank", r6("score").alias("score"))


_ANGULAR = "sqrt(greatest(0.0, 2 * (1 - raw)))"
for _name, _metric, _distance, _flavour, _raw, _score, _order in (
    ("knn_cosine_distance", "cosine", True, "squared", _COS, "1 - raw", "DESC"),
    ("knn_cosine_similarity", "cosine", False, "squared", _COS, "raw", "DESC"),
    ("knn_inner_product_distance", "inner_product", True, "squared", _DOT, "1 - raw", "DESC"),
    ("knn_inner_product", "inner_product", False, "squared", _DOT, "raw", "DESC"),
    ("knn_euclidean_sq", "euclidean", True, "squared", _SQUARED, "raw", "ASC"),
    ("knn_euclidean_sim", "euclidean", False, "squared", _SQUARED, "1 / (1 + raw)", "ASC"),
    ("knn_angular", "cosine", True, "rooted", _COS, _ANGULAR, "DESC"),
    ("knn_angular_similarity", "cosine", False, "rooted", _COS, f"1 - {_ANGULAR}", "DESC"),
    ("knn_euclidean_rooted", "euclidean", True, "rooted", _SQUARED, "sqrt(raw)", "ASC"),
    ("knn_euclidean_rooted_sim", "euclidean", False, "rooted", _SQUARED, "1 / (1 + sqrt(raw))", "ASC"),
):
    # rooting magnifies the last digits of a distance of nearly zero, so those scores are rounded before the root
    if _flavour == "rooted":
        _score = _score.replace("raw", "round(raw, 9)")

    def _search(spark: SparkSession, sf_dir: str, metric: str = _metric, distance: bool = _distance, flavour: str = _flavour) -> DataFrame:
        v = _vectors(spark, sf_dir)
        if flavour == "rooted":
            from lodestar.functions.vectors import score_of

            found = knn_join(_asked(v), v, K, metric, distance, flavour)
            return _shown(found.withColumn("score", score_of(F.round("raw", 9), metric, distance, flavour)))
        return _shown(knn_join(_asked(v), v, K, metric, distance, flavour))

    register(_name, _knn_sql(_raw, _score, _order))(_search)


@register("knn_with_tombstones", _knn_sql(_COS, "1 - raw", "DESC", "x.label <> 3"))
def knn_with_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    index = mark_deleted(v.withColumn("is_deleted", F.lit(False)), v.where("label = 3"))
    return _shown(search_live(_asked(v), index, K))


@register("knn_sharded_merge", _knn_sql(_COS, "1 - raw", "DESC"))
def knn_sharded_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).withColumn("shard", shard_of(virtual_shard(F.col("id")), 3))
    return _shown(merge_shards([knn_join(_asked(v), v.where(F.col("shard") == s), K) for s in range(3)], K))


@register(
    "knn_hydrated",
    f"SELECT m.*, d.lang, d.source, d.n_chars FROM ({_knn_sql(_COS, '1 - raw', 'DESC')}) m LEFT JOIN documents d ON m.match_id = d.doc_id",
)
def knn_hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return hydrate(_shown(knn_join(_asked(v), v, K)), load(spark, sf_dir, "documents"), columns=["lang", "source", "n_chars"])


@register("ivf_search")
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    ivf = InvertedFile("cosine", cells=16, nprobe=10).train(v)
    return _shown(ivf.search(_asked(v), ivf.lists(v), K)).withColumn("query_id", F.col("query_id").cast("long")).withColumn("match_id", F.col("match_id").cast("long"))


@register("pq_search")
def pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    index = ProductLists("cosine").train(v)
    lists = Scratch(spark).keep(index.lists(v))
    return _shown(widened(lambda q, n: index.search(q, lists, v, K, shortlist=n), _asked(v), v, K, index.shortlist))


@register("graph_search")
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    graph = NeighbourGraph("cosine").build(v)
    return _shown(widened(lambda q, n: graph.search(q, K, beam=n), _asked(v), v, K, graph.beam))


@register("forest_search")
def forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    forest = ProjectionForest("cosine", trees=8, probes=6).build(v)
    return _shown(widened(lambda q, n: forest.search(q, K, probes=n), _asked(v), v, K, forest.probes))


@register(
    "ann_recall",
    f"SELECT i.method, m.query_id, m.match_id AS best_id, {K}::BIGINT AS n_found, true AS recalled FROM (VALUES ('forest'), ('graph'), ('lists')) i(method), ({_knn_sql(_COS, '1 - raw', 'DESC')}) m WHERE m.rank = 1",
)
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each approximate index and query its best match, how many it found, and whether nine tenths of all exact matches were found."""
    v = _vectors(spark, sf_dir)
    scratch = Scratch(spark)
    exact = scratch.keep(knn_join(_asked(v), v, K).select("query_id", "match_id", F.lit(True).alias("true")))
    found = [scratch.keep(f(spark, sf_dir).withColumn("method", F.lit(name))) for name, f in (("forest", forest_search), ("graph", graph_search), ("lists", pq_search))]
    both = found[0].unionByName(found[1]).unionByName(found[2]).join(exact, ["query_id", "match_id"], "left")
    by_query = both.groupBy("method", "query_id").agg(F.min_by("match_id", "rank").alias("best_id"), F.count("*").alias("n_found"), F.count("true").alias("hits"))
    share = by_query.groupBy("method").agg((F.sum("hits") >= 0.9 * K * F.count("*")).alias("recalled"))
    return by_query.join(share, "method").select("method", "query_id", "best_id", "n_found", "recalled")


@register("fill_embedding", f"SELECT d.doc_id, e.embedding IS NOT NULL AS known, {_WEIGHED.replace('(v,', '(e.embedding,')} AS weighed FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    out = fill_embedding(docs, _vectors(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.col("embedding").isNotNull().alias("known"), _weighed("embedding").alias("weighed"))


@register("index_status", "SELECT sum((label <> 3)::INT)::BIGINT AS count_active, count(*) AS count_indexed, sum((label = 3)::INT)::BIGINT AS count_deleted FROM embeddings")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return status(mark_deleted(v.withColumn("is_deleted", F.lit(False)), v.where("label = 3")))


@register("normalize_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) + 0.0 AS total, 1.0::DOUBLE AS norm FROM embeddings")
def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings").withColumn("u", normalized(as_doubles(F.col("embedding"))))
    return v.select("vec_id", r6(F.aggregate("u", F.lit(0.0), lambda s, x: s + x)).alias("total"), r6(norm(F.col("u"))).alias("norm"))


@register("pool_by_label", "SELECT label, pos - 1 AS pos, round(avg(x::DOUBLE), 6) + 0.0 AS mean, min(x)::DOUBLE AS low, max(x)::DOUBLE AS high FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL")
def pool_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).withColumn("pos", F.col("pos").cast("long"))
    x = F.col("x").cast("double")
    return rows.groupBy("label", "pos").agg(r6(F.avg(x)).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"))


# --- ranking parents by their chunks' matches: the label is the parent ----------------------------------------------

for _ranking, _how, _order in (("min", "min", "ASC"), ("max", "max", "DESC"), ("mean_min", "avg", "ASC"), ("mean_max", "avg", "DESC")):

    def _rank(spark: SparkSession, sf_dir: str, ranking: str = _ranking) -> DataFrame:
        v = _vectors(spark, sf_dir)
        found = knn_join(_asked(v), v, 30)
        chunks = hydrate(found, v, store_key="id", columns=["label"]).withColumnRenamed("label", "parent_id")
        return simple_rank(chunks, ranking).select("query_id", "parent_id", r6("score").alias("score"), "rank")

    register(
        f"rank_{_ranking}",
        f"""WITH m AS ({_knn_sql(_COS, "1 - raw", "DESC", k=30).replace("round(1 - raw, 6) + 0.0 AS score", "1 - raw AS score")}),
g AS (SELECT m.query_id, e.label AS parent_id, {_how}(m.score) AS score FROM m JOIN embeddings e ON m.match_id = e.vec_id GROUP BY ALL)
SELECT query_id, parent_id, round(score, 6) + 0.0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) {_order}, parent_id)::INTEGER AS rank FROM g""",
    )(_rank)


# --- the content cache ----------------------------------------------------------------------------------------------


@register("doc_cache_first_wins", "SELECT min(doc_id) AS doc_id, sha256('text:' || coalesce(text, '') || ';') AS hash FROM documents GROUP BY coalesce(text, '')")
def doc_cache_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_cache.first_wins(load(spark, sf_dir, "documents"), ("text",), "doc_id").select("doc_id", content_hash("text").alias("hash"))


@register("doc_cache_two_fields", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY coalesce(lang, ''), coalesce(source, '')")
def doc_cache_two_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_cache.first_wins(load(spark, sf_dir, "documents"), ("lang", "source"), "doc_id").select("doc_id")


@register("doc_cache_against_benchmark", "SELECT min(doc_id) AS doc_id FROM documents WHERE coalesce(text, '') NOT IN (SELECT coalesce(text, '') FROM benchmark) GROUP BY coalesce(text, '')")
def doc_cache_against_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = load(spark, sf_dir, "benchmark").select(content_hash("text").alias("hash"))
    return dedup_cache.first_wins(load(spark, sf_dir, "documents"), ("text",), "doc_id", known).select("doc_id")


@register("doc_cache_counts", "SELECT count(*) AS ids_count, count(DISTINCT coalesce(text, '')) AS hashes_count FROM documents")
def doc_cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_cache.counts(*dedup_cache.entries(load(spark, sf_dir, "documents"), ("text",), "doc_id", "doc_id"))


@register(
    "doc_cache_after_delete",
    "SELECT count(*) AS ids_count, (SELECT count(*) FROM (SELECT DISTINCT text FROM documents EXCEPT SELECT text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)) AS hashes_count "
    "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def doc_cache_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, hashes = dedup_cache.entries(load(spark, sf_dir, "documents"), ("text",), "doc_id", "doc_id")
    return dedup_cache.counts(*dedup_cache.delete(ids, hashes, load(spark, sf_dir, "labels").where("toxic = 1"), "doc_id"))


@register(
    "doc_cache_after_update",
    """WITH old AS (SELECT doc_id, text FROM documents), new AS (SELECT doc_id, 'toxic ' || toxic AS text FROM documents JOIN labels USING (doc_id)),
h AS (SELECT DISTINCT text FROM old EXCEPT (SELECT o.text FROM old o JOIN new USING (doc_id) UNION SELECT text FROM new))
SELECT (SELECT count(*) FROM old) AS ids_count, (SELECT count(*) FROM h) + (SELECT count(DISTINCT text) FROM new) AS hashes_count""",
)
def doc_cache_after_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    ids, hashes = dedup_cache.entries(docs, ("text",), "doc_id", "doc_id")
    changes = load(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("toxic "), "toxic").alias("text"))
    return dedup_cache.counts(*dedup_cache.update(ids, hashes, changes, ("text",), "doc_id", "doc_id"))


# --- sentences ------------------------------------------------------------------------------------------------------


def _sentence_sql(pattern: str, max_len: int, weight: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
WITH s AS (SELECT doc_id, length(text) AS n, CASE WHEN len(regexp_extract_all(text, '{p}')) = 0 THEN [text] ELSE regexp_extract_all(text, '{p}') END AS found FROM documents WHERE length(text) > 0),
u AS (SELECT doc_id, n, unnest(found) AS raw, generate_subscripts(found, 1) - 1 AS "offset" FROM s),
t AS (SELECT doc_id, n, "offset"::INTEGER AS "offset", substr(regexp_replace(regexp_replace(regexp_replace(raw, '\\n+', ' ', 'g'), '^\\s+', ''), '\\s+$', ''), 1, {max_len}) AS sentence FROM u)
SELECT doc_id, "offset", sentence, round({weight}, 6) + 0.0 AS weight FROM t WHERE length(sentence) > 1"""


for _name, _marks, _max, _uniform in (("sentencize", None, 512, True), ("sentencize_dot_only", (".",), 512, True), ("sentencize_max_len", None, 40, True), ("sentence_weight", None, 512, False)):

    def _sentences(spark: SparkSession, sf_dir: str, marks: tuple[str, ...] | None = _marks, longest: int = _max, uniform: bool = _uniform) -> DataFrame:
        return sentencize(load(spark, sf_dir, "documents"), max_len=longest, marks=marks, uniform_weight=uniform, positions=False).select("doc_id", "offset", "sentence", r6("weight").alias("weight"))

    register(_name, _sentence_sql(sentence_pattern(_marks) if _marks else sentence_pattern(), _max, "1.0::DOUBLE" if _uniform else "length(sentence)::DOUBLE / n"))(_sentences)


@register(
    "clean_pages",
    "SELECT page_id, sha256(lower(trim(regexp_replace(" + "replace(" * 14 + "regexp_replace(html, '<[^>]*>', ' ', 'g')" + "".join(f", '{a}', '{b}')" for a, b in 2 * (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&"))) + ", '\\s+', ' ', 'g')))) AS text_sha256 FROM pages",
)
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = clean(F.regexp_replace("html", "<[^>]*>", " "))
    return load(spark, sf_dir, "pages").select("page_id", F.sha2(text, 256).alias("text_sha256"))


# --- keyed stores ---------------------------------------------------------------------------------------------------


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text", "source")


@register("store_add_ignore", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'old' ELSE 'new' END AS origin FROM documents")
def store_add_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    old = docs.where("lang = 'en'").select("doc_id", F.lit("old").alias("origin"))
    return store.add(old, docs.select("doc_id", F.lit("new").alias("origin")), "ignore")


@register("store_add_abort", "SELECT doc_id, 'old' AS origin FROM documents WHERE lang = 'en'")
def store_add_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    old = docs.where("lang = 'en'").select("doc_id", F.lit("old").alias("origin"))
    return store.add(old, docs.select("doc_id", F.lit("new").alias("origin")), "abort")


@register("store_upsert", "SELECT d.doc_id, coalesce('quality ' || l.quality, d.source) AS source FROM documents d LEFT JOIN labels l USING (doc_id)")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = load(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("quality "), "quality").alias("source"))
    return store.add(load(spark, sf_dir, "documents").select("doc_id", "source"), new, "replace")


_UPDATED = "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'quality ' || l.quality END AS source, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 2 END AS written FROM documents d LEFT JOIN labels l USING (doc_id)"


@register("store_update_existing", _UPDATED)
def store_update_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = store.as_rows(load(spark, sf_dir, "documents").select("doc_id", "source"), now=F.lit(1))
    changes = load(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("quality "), "quality").alias("source"))
    return store.update(old, changes, now=F.lit(2)).select("doc_id", "source", F.col("updated_at").alias("written"))


@register("store_soft_delete", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_deleted FROM documents")
def store_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.soft_delete(store.as_rows(_texts(spark, sf_dir)), load(spark, sf_dir, "labels").where("toxic = 1")).select("doc_id", "is_deleted")


@register("store_prune", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def store_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.prune(store.soft_delete(store.as_rows(_texts(spark, sf_dir)), load(spark, sf_dir, "labels").where("toxic = 1"))).select("doc_id", "source")


@register("store_hard_delete", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def store_hard_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.hard_delete(_texts(spark, sf_dir), load(spark, sf_dir, "labels").where("quality = 0")).select("doc_id")


@register("store_lookup", "SELECT v.vec_id AS doc_id, d.text IS NOT NULL AS found, coalesce(d.source, 'none') AS source FROM embeddings v LEFT JOIN documents d ON v.vec_id = d.doc_id AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.soft_delete(store.as_rows(_texts(spark, sf_dir)), load(spark, sf_dir, "labels").where("toxic = 1"))
    asked = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("none").alias("source"))
    return store.lookup(asked, rows).select("doc_id", F.col("text").isNotNull().alias("found"), "source")


@register("store_status", "SELECT count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS total_docs, count(*) AS total_rows FROM documents")
def store_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.soft_delete(store.as_rows(_texts(spark, sf_dir)), load(spark, sf_dir, "labels").where("toxic = 1"))
    return store.status(rows).select("total_docs", "total_rows")


#: The store of users: each one's latest event; a user whose latest event is a purchase counts as deleted.
_USERS = "SELECT user_id AS doc_id, max_by(value, event_id) AS value, max_by(ts, event_id) AS updated_at, max_by(event_type, event_id) = 'purchase' AS is_deleted FROM events"


def _users(events: DataFrame) -> DataFrame:
    rows = events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), F.array("value").alias("embedding"), F.col("ts").alias("updated_at"), (F.col("event_type") == "purchase").alias("is_deleted"))
    return last_wins(rows, "doc_id")


@register("store_last_wins", f"{_USERS} GROUP BY user_id")
def store_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _users(load(spark, sf_dir, "events")).select("doc_id", F.col("embedding")[0].alias("value"), "updated_at", "is_deleted")


_HALF = "(SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"


def _middle(events: DataFrame) -> DataFrame:
    return events.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("middle"))


@register("store_delta_since", f"SELECT doc_id, updated_at, is_deleted FROM ({_USERS} GROUP BY user_id) WHERE updated_at > {_HALF}")
def store_delta_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    rows = _users(events).withColumn("shard", virtual_shard(F.col("doc_id")))
    since = F.lit(_middle(events).first()["middle"]).cast("timestamp_ntz")
    return store.delta_since(rows, since).select("doc_id", "updated_at", "is_deleted")


_INDEX = f"index_ AS (SELECT * FROM ({_USERS} WHERE ts <= {_HALF} GROUP BY user_id) WHERE NOT is_deleted), delta AS ({_USERS} WHERE ts > {_HALF} GROUP BY user_id)"


def _index_and_delta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = load(spark, sf_dir, "events")
    middle = F.lit(_middle(events).first()["middle"]).cast("timestamp_ntz")
    cols = ("doc_id", "embedding", "updated_at")
    return _users(events.where(F.col("ts") <= middle)).where("not is_deleted").select(*cols), _users(events.where(F.col("ts") > middle)).select(*cols, "is_deleted")


@register(
    "delta_classify",
    f"WITH {_INDEX} SELECT d.doc_id, CASE WHEN i.doc_id IS NOT NULL THEN CASE WHEN d.is_deleted THEN 'remove' ELSE 'replace' END WHEN d.is_deleted THEN 'skip' ELSE 'add' END AS action FROM delta d LEFT JOIN index_ i ON d.doc_id = i.doc_id",
)
def delta_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_delta(*_index_and_delta(spark, sf_dir), "doc_id").select("doc_id", "action")


@register("delta_apply", f"WITH {_INDEX} SELECT doc_id, value, updated_at FROM index_ WHERE doc_id NOT IN (SELECT doc_id FROM delta) UNION ALL SELECT doc_id, value, updated_at FROM delta WHERE NOT is_deleted")
def delta_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_delta(*_index_and_delta(spark, sf_dir), "doc_id").select("doc_id", F.col("embedding")[0].alias("value"), "updated_at")


_VSHARD = "('0x' || right(sha256(doc_id::VARCHAR), 2))::INTEGER % 128"


@register("vshard_assignment", f"SELECT doc_id, {_VSHARD} AS virtual_shard, least({_VSHARD} // 25, 4)::INTEGER AS shard FROM documents")
def vshard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = virtual_shard(F.col("doc_id"))
    return load(spark, sf_dir, "documents").select("doc_id", v.alias("virtual_shard"), shard_of(v, 5).alias("shard"))


@register("shard_ranges", f"SELECT least({_VSHARD} // 18, 6)::INTEGER AS shard, min({_VSHARD}) AS first, max({_VSHARD}) AS last, count(*) AS docs FROM documents GROUP BY 1")
def shard_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "documents").select(virtual_shard(F.col("doc_id")).alias("v"))
    return v.groupBy(shard_of(F.col("v"), 7).alias("shard")).agg(F.min("v").alias("first"), F.max("v").alias("last"), F.count("*").alias("docs"))


# --- a store and the index that follows it: every vector is a document; label 3 is deleted later, label 5 changed ------


def _following(spark: SparkSession, sf_dir: str) -> tuple[SearchStore, DataFrame]:
    found = SearchStore(spark, _shared_dir(spark))
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    found.index(rows, now=datetime(2024, 1, 1))
    return found, rows


def _changed(found: SearchStore, rows: DataFrame) -> None:
    found.delete(rows.where("label = 3"), now=datetime(2024, 1, 2))
    found.update(rows.where("label = 5").withColumn("embedding", F.transform("embedding", lambda x: -x)), now=datetime(2024, 1, 3))


def _indexed(found: SearchStore) -> DataFrame:
    return found.index_table.read().select("doc_id", _weighed("embedding").alias("weighed"))


_FIRST = f"{_WEIGHED.replace('(v,', '(embedding,')} AS weighed"
_NEW_FIRST = f"CASE WHEN label = 5 THEN -1 ELSE 1 END * ({_WEIGHED.replace('(v,', '(embedding,')}) + 0.0 AS weighed"


@register("store_sync_delta", f"SELECT vec_id AS doc_id, {_NEW_FIRST} FROM embeddings WHERE label <> 3")
def store_sync_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rows = _following(spark, sf_dir)
    found.sync()
    _changed(found, rows)
    found.sync()
    return _indexed(found)


@register("store_sync_snapshot", f"SELECT vec_id AS doc_id, {_FIRST} FROM embeddings")
def store_sync_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rows = _following(spark, sf_dir)
    found.snapshot()
    _changed(found, rows)
    found.sync()
    return _indexed(found)


@register("store_sync_snapshot_delta", f"SELECT vec_id AS doc_id, {_NEW_FIRST} FROM embeddings WHERE label <> 3")
def store_sync_snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rows = _following(spark, sf_dir)
    found.snapshot()
    _changed(found, rows)
    found.sync(use_delta=True)
    return _indexed(found)


@register("store_snapshot_scan", "SELECT vec_id AS doc_id, label = 3 AS is_deleted, CASE WHEN label = 3 THEN 2 WHEN label = 5 THEN 3 ELSE 1 END AS day FROM embeddings")
def store_snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rows = _following(spark, sf_dir)
    _changed(found, rows)
    found.snapshot()
    found.clear()
    return store.scan(found.snapshots.read(), include_docs=False, filter_deleted=False).select("doc_id", "is_deleted", F.dayofmonth("updated_at").alias("day"))


@register("store_compound_status", "SELECT count(*) FILTER (WHERE label <> 3) AS total_docs, count(*) AS active_docs, 3 AS day FROM embeddings")
def store_compound_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rows = _following(spark, sf_dir)
    found.sync()
    _changed(found, rows)
    return found.status().select("total_docs", "active_docs", F.dayofmonth("last_updated").alias("day"))


_VECTOR_VSHARD = "('0x' || right(sha256(vec_id::VARCHAR), 2))::INTEGER % 128"


@register("store_dump_reload", f"SELECT vec_id AS doc_id, least({_VECTOR_VSHARD} // 42, 2)::INTEGER AS shard, {_NEW_FIRST} FROM embeddings WHERE label <> 3")
def store_dump_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rows = _following(spark, sf_dir)
    _changed(found, rows)
    path = _shared_dir(spark)
    found.dump(path, 3, include_docs=False)
    parts = [load_vectors(spark, path, k).withColumn("shard", F.lit(k)) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("doc_id", "shard", _weighed("embedding").alias("weighed"))


@register("store_dump_rows", f"SELECT vec_id AS doc_id, {_NEW_FIRST}, label FROM embeddings WHERE label <> 3")
def store_dump_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rows = _following(spark, sf_dir)
    _changed(found, rows)
    return dump_rows(found.data.read()).select("doc_id", _weighed("embedding").alias("weighed"), "doc.label")


@register("store_restore", "SELECT vec_id AS doc_id, label, false AS is_deleted FROM embeddings WHERE label <> 3")
def store_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rows = _following(spark, sf_dir)
    _changed(found, rows)
    path = _shared_dir(spark)
    found.dump(path, 4)
    copy = SearchStore(spark, _shared_dir(spark))
    copy.index(rows.where("label = 3"))
    copy.restore(path)
    return copy.data.read().select("doc_id", "label", "is_deleted")


@register("store_scan_shards", f"SELECT vec_id AS doc_id FROM embeddings WHERE label <> 3 AND {_VECTOR_VSHARD} IN (0, 7, 63, 127)")
def store_scan_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, rows = _following(spark, sf_dir)
    _changed(found, rows)
    return store.scan(found.data.read(), include_docs=False, shards=[0, 7, 63, 127], check_embedding=True).select("doc_id")


@register("store_add_first_of_id", "SELECT user_id AS doc_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def store_add_first_of_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_id")
    return store.add(rows.limit(0), rows, "ignore", "event_id")


@register("store_replace_last_of_id", "SELECT user_id AS doc_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def store_replace_last_of_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_id")
    return store.add(rows.where("event_id % 3 = 0").groupBy("doc_id").agg(F.min("event_id").alias("event_id")), rows, "replace", "event_id")


@register("store_update_insert", "SELECT doc_id, coalesce('quality ' || l.quality, d.source) AS source FROM (SELECT * FROM documents WHERE lang = 'en') d FULL JOIN labels l USING (doc_id)")
def store_update_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = store.as_rows(load(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source"), now=F.lit(1))
    changes = load(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("quality "), "quality").alias("source"))
    return store.update(old, changes, "insert", now=F.lit(2)).select("doc_id", "source")


for _name, _op, _known in (("index_upsert", upsert, ""), ("index_update_known", update_known, " WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")):

    def _put(spark: SparkSession, sf_dir: str, op: Callable[..., DataFrame] = _op) -> DataFrame:
        events = load(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", "value", "event_type")
        index = last_wins(events.where("event_type = 'purchase'"), "id", "event_id").select("id", "event_id", "value")
        return op(index, events.select("id", "event_id", "value"), order="event_id")

    register(_name, f"SELECT user_id AS id, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events{_known} GROUP BY user_id")(_put)


@register("doc_cache_kept", "SELECT count(*) AS ids_count, count(DISTINCT coalesce(text, '')) AS hashes_count FROM documents")
def doc_cache_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache written to tables in two appends by half of the ids, and read again."""
    ids, hashes = dedup_cache.entries(load(spark, sf_dir, "documents"), ("text",), "doc_id", "doc_id")
    kept = [VersionedTable(spark, f"{_shared_dir(spark)}/{name}") for name in ("ids", "hashes")]
    for table, rows in zip(kept, (ids, hashes), strict=True):
        for half in (0, 1):
            table.append(rows.where(F.pmod(F.xxhash64("hash"), F.lit(2)) == half))
    return dedup_cache.counts(*(t.read() for t in kept))


# --- arrays: a vector as 8 tokens of 8 numbers, and as numbers ------------------------------------------------------

_TOKENS = "list_transform(range(0, 8), lambda t: list_transform(range(1, 9), lambda i: embedding[t * 8 + i]::DOUBLE))"


@register(
    "pooled_tokens",
    f"SELECT vec_id, pos - 1 AS pos, round(avg(x), 6) + 0.0 AS mean, min(x) AS low, max(x) AS high, max(CASE WHEN t = 1 THEN x END) AS cls FROM "
    f"(SELECT vec_id, t, unnest(token) AS x, generate_subscripts(token, 1) AS pos FROM (SELECT vec_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS t FROM (SELECT vec_id, {_TOKENS} AS tokens FROM embeddings))) GROUP BY ALL",
)
def pooled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(as_doubles(F.col("embedding")), t * 8 + 1, F.lit(8)))
    rows = load(spark, sf_dir, "embeddings").select("vec_id", tokens.alias("tokens"))
    out = rows.select("vec_id", F.posexplode(F.arrays_zip(*[pooled(F.col("tokens"), how).alias(how) for how in ("mean", "min", "max", "cls")])).alias("pos", "p"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), r6("p.mean").alias("mean"), F.col("p.min").alias("low"), F.col("p.max").alias("high"), F.col("p.cls").alias("cls"))


@register(
    "vector_numbers",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, round(exp(v[1] - list_max(v)) / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) + 0.0 AS share, round(list_sum(list_transform(v, lambda x: least(greatest(x, -0.1), 0.1))), 6) + 0.0 AS clamped,
round((v[1] - list_min(v)) / (list_max(v) - list_min(v)) * 2 - 1, 6) + 0.0 AS scaled, 5 AS frames, round(v[49], 6) + 0.0 AS last_frame FROM v""",
)
def vector_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = as_doubles(F.col("embedding"))
    cut = frames(v, 16, 12)
    return load(spark, sf_dir, "embeddings").select(
        "vec_id", r6(softmax(v)[0]).alias("share"), r6(F.aggregate(clamped(v, -0.1, 0.1), F.lit(0.0), lambda s, x: s + x)).alias("clamped"),
        r6(rescaled(v, -1.0, 1.0)[0]).alias("scaled"), F.size(cut).alias("frames"), r6(F.element_at(cut, -1)[0]).alias("last_frame"),
    )


@register("knn_with_vector", f"SELECT m.*, {_WEIGHED.replace('(v,', '(e.embedding,')} AS weighed FROM ({_knn_sql(_COS, '1 - raw', 'DESC')}) m JOIN embeddings e ON m.match_id = e.vec_id")
def knn_with_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    found = hydrate(_shown(knn_join(_asked(v), v, K)), v, store_key="id", columns=["embedding"])
    return found.select("query_id", "match_id", "rank", "score", _weighed("embedding").alias("weighed"))


@register("label_prompts", "SELECT lang, 'a text from ' || string_agg(DISTINCT source, ', ' ORDER BY source) || '.' AS prompt FROM documents GROUP BY lang")
def label_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("labels"))
    return labels.select("lang", label_prompt(F.col("labels"), "a text from {}.").alias("prompt"))


# --- nested documents: a conversation is a root, a turn its chunk, a sentence a chunk of that ------------------------


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = load(spark, sf_dir, "conversations").withColumn("turn_id", F.concat_ws(":", "conv_id", "turn"))
    top = roots(talk.select("conv_id").distinct(), "conv_id").withColumn("text", F.lit(None).cast("string"))
    turns = children(top, talk.select(F.col("conv_id").alias("parent_id"), F.col("turn_id").alias("doc_id"), F.col("turn").alias("ord"), "text"), columns=("text",))
    parts = sentencize(talk, "turn_id", positions=False).select(F.col("turn_id").alias("parent_id"), F.concat_ws(":", "turn_id", "offset").alias("doc_id"), F.col("offset").alias("ord"), F.col("sentence").alias("text"))
    return top.unionByName(turns).unionByName(children(turns, parts, columns=("text",)))


_CHUNKS = _sentence_sql(sentence_pattern(), 512, "1.0").replace("doc_id", "turn_id").replace("FROM documents", "FROM (SELECT conv_id || ':' || turn AS turn_id, text FROM conversations)")


@register(
    "traverse_paths",
    f"""SELECT DISTINCT conv_id::VARCHAR AS root_id, conv_id::VARCHAR AS doc_id, '' AS path FROM conversations
UNION ALL SELECT split_part(turn_id, ':', 1) AS root_id, turn_id || ':' || "offset" AS doc_id, 'cc' AS path FROM ({_CHUNKS})""",
)
def traverse_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse(_nodes(spark, sf_dir), ["cc", "r"]).select("root_id", "doc_id", "path")


@register("filter_has_text", "SELECT conv_id || ':' || turn AS doc_id, length(text) AS n FROM conversations WHERE length(text) > 0")
def filter_has_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return has_text(traverse(_nodes(spark, sf_dir), "@c")).select("doc_id", F.char_length("text").cast("long").alias("n"))


# --- learning to rank: an order is a query, its lines are the matches ------------------------------------------------

_FEATURES = ["query_o_totalprice", "match_l_quantity", "match_l_extendedprice", "match_l_discount"]


def _ltr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "query_id")
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("match_id"), "l_quantity", "l_extendedprice", "l_discount")
    return ltr.features(orders, lines, ("o_totalprice",), ("l_quantity", "l_extendedprice", "l_discount"))


@register(
    "ltr_features",
    """SELECT l_orderkey AS query_id, l_linenumber AS match_id, count(*) OVER (PARTITION BY l_orderkey) AS group_size, o_totalprice::DOUBLE AS query_o_totalprice,
l_quantity::DOUBLE AS match_l_quantity, l_extendedprice::DOUBLE AS match_l_extendedprice, l_discount::DOUBLE AS match_l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def ltr_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ltr_rows(spark, sf_dir).select("query_id", "match_id", "group_size", *_FEATURES)


@register("ltr_rank")
def ltr_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ltr_rows(spark, sf_dir).withColumn("relevance", 10 - F.least(F.lit(10.0), F.col("match_l_extendedprice") / 10_000))
    return ltr.TreeRanker(_FEATURES).train(rows).rank(rows).select("query_id", "match_id", r6("score").alias("score"), "rank")


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines, one for each number, with grades 0 to 4 by quantity."""
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("match_id"))
    rows = rows.agg(F.max("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("price"), F.max("l_discount").alias("discount"), F.max("l_tax").alias("tax"))
    return rows.withColumns({"relevance": F.floor((F.col("quantity") - 1) / 10).cast("int"), "score": 10 * F.col("discount")})


@register(
    "ltr_lambdas",
    """WITH r AS (SELECT l_orderkey AS q, l_linenumber AS m, floor((max(l_quantity) - 1) / 10) AS l, 10 * max(l_discount) AS s FROM lineitem GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, m) AS k, CASE WHEN k <= 3 THEN 1 / log2(1 + k) ELSE 0 END AS d FROM r),
i AS (SELECT q, sum((2 ** l - 1) / log2(1 + j)) AS ideal FROM (SELECT q, l, row_number() OVER (PARTITION BY q ORDER BY l DESC) AS j FROM r) WHERE j <= 3 GROUP BY q),
p AS (SELECT a.q, a.m, sign(a.l - b.l) AS way, abs(2 ** a.l - 2 ** b.l) * abs(a.d - b.d) / ideal AS w, 1 / (1 + exp(sign(a.l - b.l) * (a.s - b.s))) AS p
  FROM d a JOIN d b ON a.q = b.q AND a.l <> b.l AND least(a.k, b.k) <= 3 JOIN i ON i.q = a.q)
SELECT r.q AS query_id, r.m AS match_id, round(coalesce(sum(way * p * w), 0), 6) + 0.0 AS pull, round(coalesce(sum(p * (1 - p) * w), 0), 6) + 0.0 AS bend FROM r LEFT JOIN p ON r.q = p.q AND r.m = p.m GROUP BY ALL""",
)
def ltr_lambdas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What listwise loss over the first three lines of each order has to say of an order by discount."""
    return listwise.lambdas(_graded(spark, sf_dir), top=3).select("query_id", "match_id", r6("lambda").alias("pull"), r6("hessian").alias("bend"))


@register("ltr_listwise")
def ltr_listwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of even number teach an order of lines by price, discount and tax; all are ranked."""
    rows = Scratch(spark).keep(_graded(spark, sf_dir).drop("score"))
    ranker = listwise.ListwiseRanker(["price", "discount", "tax"], trees=3, top=5).train(rows.where("query_id % 2 = 0"))
    return ranker.rank(rows).select("query_id", "match_id", r6("score").alias("score"), "rank")


# --- encoders -------------------------------------------------------------------------------------------------------


@register("encode_hash_projection")
def encode_hash_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoders.encode(load(spark, sf_dir, "documents").select("doc_id", "text"), encoders.hash_projection(64), "text")
    return out.select("doc_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5) + F.lit(0.0)).alias("embedding"))


@register("tfidf_encode")
def tfidf_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoders.tfidf(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size(F.filter("embedding", lambda x: x["weight"] != 0)).alias("terms"))


# --- streams --------------------------------------------------------------------------------------------------------


def _shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='spark-lodestar-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


@register("stream_doc_cache", "SELECT DISTINCT sha256('text:' || coalesce(text, '') || ';') AS hash FROM documents")
def stream_doc_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream through the cache: the contents that come out, each once."""
    shape = load(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(shape).parquet(f"{sf_dir}/documents.parque[t]")  # as a pattern, a single file will do
    out = _shared_dir(spark)
    kept = drop_seen(stream.select("text"), ("text",)).select(content_hash("text").alias("hash"))
    kept.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("hash string").parquet(f"{out}/rows")


_H, _U = "sha256('content:' || coalesce(html, '') || ';')", "sha256('content:' || coalesce(url, '') || ';')"


@register(
    "stream_cache_changes",
    f"""WITH steps AS (
  SELECT page_id AS ord, {_H} AS hash, 'claim' AS step, 1 AS turn FROM pages
  UNION ALL SELECT 1000000000 + page_id, {_H}, 'release', 0 FROM pages WHERE page_id % 5 = 0
  UNION ALL SELECT 1000000000 + page_id, {_U}, 'own', 1 FROM pages WHERE page_id % 5 = 0
  UNION ALL SELECT 2000000000 + page_id, CASE WHEN page_id % 5 = 0 THEN {_U} ELSE {_H} END, 'release', 0 FROM pages WHERE page_id % 7 = 0
  UNION ALL SELECT 3000000000 + page_id, {_H}, 'claim', 1 FROM pages WHERE page_id % 3 = 0)
SELECT ord, hash, coalesce(before, 'release') = 'release' AS kept FROM (SELECT *, lag(step) OVER (PARTITION BY hash ORDER BY ord, turn) AS before FROM steps) WHERE step = 'claim'""",
)
def stream_cache_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a stream of events: all are indexed, a fifth changes to its url, a seventh goes, a third comes again under another id; unknown ids change nothing."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    event = lambda op, doc, turn, content, share: pages.where(F.col("page_id") % share == 0).select(F.lit(op).alias("op"), F.concat(F.lit(doc), F.col("page_id").cast("string")).alias("id"), (F.lit(turn * 10**9) + F.col("page_id")).alias("ord"), F.col(content).alias("content"))
    events = event("index", "", 0, "html", 1)
    for more in (event("update", "", 1, "url", 5), event("delete", "", 2, "html", 7), event("index", "again", 3, "html", 3), event("update", "unknown", 4, "html", 11)):
        events = events.unionByName(more)
    folder = _shared_dir(spark)
    events.write.parquet(f"{folder}/in")
    out = cached(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), ("content",))
    out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows").where("step = 'claim'").select("ord", "hash", "kept")


# --- media: a vector's 64 values as a signal, a box, or an image of 8 x 8 pixels -------------------------------------


@register(
    "audio_spectra",
    """WITH s AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
p AS (SELECT vec_id, k, b, sum((0.5 - 0.5 * cos(2 * pi() * n / 20)) * x * cos(2 * pi() * b * n / 20)) AS re, sum((0.5 - 0.5 * cos(2 * pi() * n / 20)) * x * sin(2 * pi() * b * n / 20)) AS im
  FROM s, range(5) f(k), range(20) g(n), range(11) h(b) WHERE i = 12 * k + n - 2 GROUP BY ALL)
SELECT vec_id, k::INTEGER AS frame, round(sum((re * re + im * im) * (b + 1)), 6) + 0.0 AS weighed, round(max(10 * log10(greatest(re * re + im * im, 1e-10))), 4) + 0.0 AS peak FROM p GROUP BY vec_id, k""",
)
def audio_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 20 samples every 12, the signal padded to whole frames on both sides: powers, weighed by frequency, and the loudest in decibels."""
    rows = power_spectra(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 20, 12)
    frames_ = rows.select("vec_id", F.posexplode("spectrum").alias("frame", "power"))
    peak = 10 * F.log10(F.greatest(F.array_max("power"), F.lit(1e-10)))
    return frames_.select("vec_id", "frame", _weighed("power").alias("weighed"), (F.round(peak, 4) + F.lit(0.0)).alias("peak"))


_SHARED = "greatest(0.0, least(o.x2, r.s.x2) - greatest(o.x1, r.s.x1)) * greatest(0.0, least(o.y2, r.s.y2) - greatest(o.y1, r.s.y1))"


@register(
    "boxes_suppressed",
    f"""WITH RECURSIVE b AS (
  SELECT vec_id, vec_id // 100 AS image, label, 100 * (embedding[1]::DOUBLE + 0.5) AS x1, 100 * (embedding[2]::DOUBLE + 0.5) AS y1, 20 + 100 * abs(embedding[3]::DOUBLE) AS w, 20 + 100 * abs(embedding[4]::DOUBLE) AS h, abs(embedding[5]::DOUBLE) AS score FROM embeddings
), r AS (
  SELECT image, label, {{'id': vec_id, 'x1': x1, 'y1': y1, 'x2': x1 + w, 'y2': y1 + h}} AS s, row_number() OVER (PARTITION BY image, label ORDER BY score DESC, vec_id) AS k FROM b WHERE score >= 0.02
), g AS (
  SELECT image, label, k, [s] AS kept FROM r WHERE k = 1
  UNION ALL
  SELECT g.image, g.label, r.k, CASE WHEN len(list_filter(g.kept, lambda o: {_SHARED} / ((o.x2 - o.x1) * (o.y2 - o.y1) + (r.s.x2 - r.s.x1) * (r.s.y2 - r.s.y1) - {_SHARED}) > 0.45)) = 0 THEN list_append(g.kept, r.s) ELSE g.kept END
  FROM g JOIN r ON g.image = r.image AND g.label = r.label AND r.k = g.k + 1
), e AS (SELECT image, label, max(k) AS k FROM r GROUP BY ALL)
SELECT image, label, unnest(kept).id AS vec_id FROM g JOIN e USING (image, label, k)""",
)
def boxes_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector as a detection in an image that a hundred share: those that no better one of their label covers."""
    v = lambda k: F.col("embedding")[k].cast("double")
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 100).alias("image"), "label", (100 * (v(0) + 0.5)).alias("x1"), (100 * (v(1) + 0.5)).alias("y1"), F.abs(v(2)).alias("w"), F.abs(v(3)).alias("h"), F.abs(v(4)).alias("score"))
    rows = rows.withColumns({"x2": F.col("x1") + (20 + 100 * F.col("w")), "y2": F.col("y1") + (20 + 100 * F.col("h"))})
    return suppressed(rows, 0.45, 0.02, id_col="vec_id").select("image", "label", "vec_id")


@register(
    "image_prepared",
    """WITH w AS (SELECT i, j, CASE WHEN x < 1 THEN 1.5 * x ** 3 - 2.5 * x ** 2 + 1 WHEN x < 2 THEN -0.5 * (x ** 3 - 5 * x ** 2 + 8 * x - 4) ELSE 0 END AS w FROM (SELECT i, j, abs((j + 0.5 - (i + 0.5) * 2) / 2) AS x FROM range(4) a(i), range(8) b(j))),
u AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM w),
p AS (SELECT vec_id, r.i AS r, c.i AS c, sum(r.w * c.w * embedding[r.j * 8 + c.j + 1]::DOUBLE) AS v FROM embeddings, u r, u c WHERE r.i IN (1, 2) AND c.i IN (1, 2) GROUP BY ALL)
SELECT vec_id, round(sum(((v - 0.1) / 0.5)::FLOAT::DOUBLE * (2 * r + c - 2)), 6) + 0.0 AS weighed FROM p GROUP BY vec_id""",
)
def image_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of 8 x 8 pixels brought to 4 x 4 by cubic convolution, its middle cut out and normalised."""
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.struct(F.array(F.lit(8), F.lit(8), F.lit(1)).alias("shape"), F.col("embedding").alias("data")).alias("blob"))
    return prepared(rows, 4, 2, (0.1,), (0.5,), scale=1.0).select("vec_id", _weighed("blob.data").alias("weighed"))


@register(
    "tags_promoted",
    """SELECT doc_id, lang AS tag_lang, n_chars::DOUBLE AS tag_n_chars, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN doc_id::VARCHAR ELSE 'no ' || doc_id END AS tag_mixed,
CASE WHEN doc_id % 3 = 1 THEN doc_id::DOUBLE END AS as_number, source AS origin, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars + 1 END AS longer FROM documents""",
)
def tags_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of mixed types as variants: common ones as columns, one read as a feature, one written and one removed."""
    docs = load(spark, sf_dir, "documents")
    mixed = F.when(F.col("doc_id") % 3 == 1, F.col("doc_id").cast("string")).when(F.col("doc_id") % 3 == 2, F.concat(F.lit('"no '), "doc_id", F.lit('"')))
    text = F.concat(F.lit('{"lang":"'), "lang", F.lit('","n_chars":'), F.col("n_chars").cast("string"), F.coalesce(F.concat(F.lit(',"mixed":'), mixed), F.lit("")), F.lit("}"))
    rows = docs.select("doc_id", "source", "n_chars", variant_of(text).alias("tags"))
    rows = promoted(rows, "tags", 0.5).withColumn("tags", with_tags(F.col("tags"), origin=F.col("source"), longer=F.when(F.col("doc_id") % 5 != 0, F.col("n_chars") + 1)))
    return rows.select("doc_id", "tag_lang", "tag_n_chars", "tag_mixed", tag(F.col("tags"), "mixed").alias("as_number"), tag(F.col("tags"), "origin", "string").alias("origin"), tag(F.col("tags"), "longer", "bigint").alias("longer"))


@register("mojibake_repaired", "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def mojibake_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even number read by the wrong table, those divisible by four twice, then all repaired: what comes out are the texts as they were."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    wrong = lambda t: F.decode(F.encode(t, "UTF-8"), "ISO-8859-1")
    text = F.when(F.col("doc_id") % 4 == 0, wrong(wrong(F.col("text")))).when(F.col("doc_id") % 2 == 0, wrong(F.col("text"))).otherwise(F.col("text"))
    return docs.select("doc_id", F.sha2(repaired(text), 256).alias("text_sha256"))


@register("byte_pair_round_trip")
def byte_pair_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations as ids of a public vocabulary, and back; and the window of 77 that a text model takes."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = byte_pair_ids(load(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), path)
    rows = byte_pair_ids(byte_pair_texts(rows, path), path, "decoded", 77, cut=True, out_col="window")
    return rows.select("conv_id", "turn", F.size("ids").alias("n_ids"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2(F.array_join("window", " "), 256).alias("window_sha256"))
