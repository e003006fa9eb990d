"""Lines that many documents share, dropped from all but one of them; DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.tables import split_column, text_or_empty

LEAST_CHARS, LEAST_DOCS = 20, 3
#: A key's documents are counted in so many groups, and what is to be dropped is looked up in so many copies: a line in every document is nobody's burden.
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, text_hash, dropped): for texts that lose lines, 64-bit words of a bitmap by their number.

    Bit k of word w is set if line 64 w + k goes; words without a set bit are left out, and so are documents that
    keep every line. Only hashes, ids and positions are shuffled. Documents are told apart by (doc_id, xxhash64 of
    the text); keys by two 64-bit hashes.
    """
    text = text_or_empty()
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.transform(F.split(text, "\n", -1), line_key)).alias("pos", "key"))
    lines = lines.where(F.char_length("key") >= least_chars).select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"))
    # how many documents hold a key, and the largest of them: within salts first, then the salts of a key side by side
    # in a hash range, the largest document first
    held = lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    ranged = held.repartitionByRange("h1", "h2")
    by_key = Window.partitionBy("h1", "h2")
    firsts = ranged.withColumn("rank", F.row_number().over(by_key.orderBy(F.desc("last")))).withColumn("docs", F.sum("n").over(by_key))
    shared = firsts.where((F.col("rank") == 1) & (F.col("docs") >= least_docs)).select("h1", "h2", F.col("last").alias("keeper"))
    copies = shared.select("h1", "h2", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    gone = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(copies, ["h1", "h2", "salt"]).where("doc_id <> keeper")
    words = gone.groupBy("doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def line_dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The columns of docs with `text` cut to the lines that stay, and n_lines, n_dropped and the bitmap `dropped`.

    A line's key is the line without blanks at its ends and with A-Z in lower case. Keys of at least `least_chars`
    code points in at least `least_docs` documents go everywhere but in the largest doc_id that holds them. A null
    text is an empty one, of one empty line. Documents without an id count for no key and keep every line; rows that
    repeat an id are one document. The added columns replace columns of the same names.
    """
    id_, hash_, marked = (split_column(docs, c) for c in ("marked_id", "marked_hash", "marked"))
    marks = keep_bitmaps(docs, least_chars, least_docs).toDF(id_, hash_, marked)
    text = text_or_empty()
    lines = F.split(text, "\n", -1)
    joined = docs.join(marks, (F.col("doc_id") == F.col(id_)) & (F.xxhash64(text) == F.col(hash_)), "left")
    stays = F.expr(f"filter(split(coalesce(cast(text as string), ''), '\\n', -1), (line, i) -> getbit(coalesce({marked}[cast(i div 64 as int)], 0L), i % 64) = 0)")
    n_dropped = F.aggregate(F.map_values(marked), F.lit(0).cast("long"), lambda n, bits: n + F.bit_count(bits))
    return joined.select(
        *[F.col(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped", "dropped")],
        F.when(F.col(marked).isNull(), text).otherwise(F.concat_ws("\n", stays)).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0)).cast("long").alias("n_dropped"),
        F.col(marked).alias("dropped"),
    )


SQL = """
WITH lines AS (
  SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.rid, k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key AND k.doc_id IS NOT NULL
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
FROM marked GROUP BY rid
"""
