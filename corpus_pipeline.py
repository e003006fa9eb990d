"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of `documents`. run() writes what a stage returns to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import line_dedup as lines
from lodestar.llm import mixing
from lodestar.llm import quality as marks
from lodestar.llm.ngram_join import ngram_join
from lodestar.llm.packing import pack
from lodestar.llm.queries import vocabulary
from lodestar.llm.tables import Saved, maybe_among, read, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier scores under 0.5; it learns from the labels of documents not held out."""
    small_batches(spark)
    model = marks.train(docs, read(spark, sf_dir, "labels").where(~marks.held_out()))
    plain = docs.select(*COLUMNS)
    return marks.score(plain, model).where("score >= 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that three documents or more share from all but one of them."""
    return lines.line_dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest id, and of rows that repeat an id the least text; rows without an id stay."""
    small_batches(spark)
    saved, plain = Saved(spark), docs.select(*COLUMNS)
    found = saved.save(ngram_join(plain).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component"), F.count("*").alias("rows")).where("doc_id <> component or rows > 1"))
    # only texts of ids that may be among the found are shuffled
    rows = maybe_among(plain, F.col("doc_id"), found.select(F.col("doc_id").alias("key")), "met")
    met = rows.where("met").join(found, "doc_id", "left").where("component is null or component = doc_id")
    least = met.groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("order"), "text", "lang", "source", "n_chars")).alias("row"))
    return rows.where("not met").select(*COLUMNS).unionByName(least.select("doc_id", "row.text", "row.lang", "row.source", "row.n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps, cuts or drops documents as the mix takes them: a row for each whole use, and a text cut after the words taken for a use in part."""
    taken = mixing.mix(docs, mixing.label_weights(read(spark, sf_dir, "labels")), carry=COLUMNS).where("taken > 0")
    uses = taken.select("row", "size", (F.col("taken") % F.col("size")).alias("rest"), F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))).alias("use"), F.floor(F.col("taken") / F.col("size")).alias("whole"))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("use") <= F.col("whole"), F.col("row.text")).otherwise(F.concat_ws("", F.slice(words, F.lit(1), F.col("rest").cast("int"))))
    return uses.withColumn("cut", text).select("row.doc_id", F.col("cut").alias("text"), "row.lang", "row.source", F.char_length("cut").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document into sequences of at most 4096 tokens."""
    small_batches(spark)
    return pack(docs, vocabulary())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix", mix), ("packing", packing)]

#: SQL can express neither the classifier nor the tokenizer; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = Saved(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, saved.save(stage(spark, docs, sf_dir))
        saved.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
