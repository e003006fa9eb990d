"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.tables import Saved, text_or_empty

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
TOTAL, MOST = 1.5, 2.0
#: A source's keys are cut into so many ranges; prefix sums run over ranges, and within one range of each source.
RANGES = 4096
#: Sampling weights by labels.quality: good documents are drawn before others, unlabelled ones in between.
QUALITY = {1: 2.0, 0: 0.5, None: 1.0}

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, none above `most` times its size.

    Filling is by level: sorted by what each unit of weight can hold, a source is full if the level at which it
    fills leaves enough for those after it. One row for each source passes through one task, no row for a document.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("level", F.col("cap") / F.col("w"))
    by_level = Window.partitionBy(F.lit(0)).orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    s = s.withColumn("goal", F.lit(total) * F.sum("source_size").over(every))
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)) + F.col("level") * F.sum("w").over(rest) <= F.col("goal"))
    left = F.col("goal") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    open_ = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(every)
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", left * F.col("w") / open_)))
    return s.select("source", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: (doc_id, source, size, source_size, target, taken), and under `row` the input columns named in carry.

    Sizes are counted in words. A source takes its documents whole as often as its target holds its size, then the
    documents with the smallest keys -ln(u) / quality until the words left are used up, the last of them in part;
    u comes from a digest of id and text, so reruns agree. quality has (doc_id, weight), a row for an id. `taken` counts words, repeats included. A null or blank
    text has size 0 and takes 0; a null source is one source of its own, last in order; equal rows tie without
    effect on what the source takes; a null or non-positive quality counts as 1; an empty table gives none.

    Prefix sums are taken over RANGES sums for each source and then within the one range where the words run out, so
    a source with a third of all documents is spread over all tasks.
    """
    saved = Saved(docs.sparkSession)
    text = text_or_empty(text_col)
    draw = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text))
    u = (F.conv(F.substring("draw", 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    # rows with equal marks are equal in all that is carried
    marks = [F.xxhash64(F.lit(k), *[y for c in carry for y in (F.col(c).isNull(), F.col(c))]).alias(f"mark{k}") for k in (1, 2)] if carry else []
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), draw.alias("draw"), *marks)
    if quality is not None:
        weight = quality.select(F.col("doc_id").alias("weighted_id"), F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0).alias("weight"))
        base = base.join(weight, F.col("doc_id") == F.col("weighted_id"), "left").drop("weighted_id")
    else:
        base = base.withColumn("weight", F.lit(1.0))
    base = base.withColumn("key", -F.log(u) / F.coalesce("weight", F.lit(1.0))).drop("weight")
    base = base.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    base = saved.save(base.withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * RANGES).cast("int")))

    ranges = saved.save(base.groupBy("name", "range").agg(F.sum("size").alias("range_size"), F.first("source").alias("source")))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, total, most)
    targets = targets.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("words", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    upto = Window.partitionBy("name").orderBy("range")
    spans = ranges.drop("source").withColumn("before", F.sum("range_size").over(upto) - F.col("range_size")).join(targets, "name")
    rows = base.join(spans, ["name", "range"])
    inside = (F.col("before") < F.col("words")) & (F.col("before") + F.col("range_size") > F.col("words"))
    sums = Window.partitionBy("name", "range").orderBy("key", "draw", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.where(inside).withColumn("used", F.col("before") + F.sum("size").over(sums) - F.col("size"))
    cut = cut.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("words") - F.col("used"))))
    whole = rows.where(~inside).withColumn("used", F.col("before")).withColumn("part", F.when(F.col("before") + F.col("range_size") <= F.col("words"), F.col("size")).otherwise(0))
    out = cut.unionByName(whole)
    out = out.withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))
    if not carry:
        return out.select("doc_id", "source", "size", "source_size", "target", "taken")
    # carried columns are shuffled once, to meet what was decided about them; equal rows are one row and a count here
    decided = out.groupBy("mark1", "mark2", "doc_id", "source", "size", "source_size", "target", "taken").agg(F.count("*").alias("times"))
    carried = docs.select(F.struct(*carry).alias("row"), *marks).groupBy("mark1", "mark2").agg(F.first("row").alias("row"))
    met = carried.join(decided, ["mark1", "mark2"])
    return met.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("doc_id", "source", "size", "source_size", "target", "taken", "row")


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from labels (doc_id, quality); of several labels of an id the highest counts."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return marks.select("doc_id", F.when(F.col("quality") == 1, QUALITY[1]).when(F.col("quality") == 0, QUALITY[0]).otherwise(QUALITY[None]).alias("weight"))


SQL = """
WITH base AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5(coalesce(d.doc_id::VARCHAR, '') || ':' || coalesce(d.text, '')) AS draw,
    CASE WHEN l.quality = 1 THEN 2.0::DOUBLE WHEN l.quality = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS q
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id) l ON d.doc_id = l.doc_id
), keyed AS (
  SELECT *, -ln((('0x' || substr(draw, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / q AS key FROM base
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
    [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
    1.5::DOUBLE * (sum(sum(size)) OVER ())::DOUBLE AS goal
  FROM base GROUP BY source
), levels AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + cap / w * sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= goal AS filled
  FROM sources
), targets AS (
  SELECT source, source_size, CASE WHEN filled THEN cap ELSE least(cap,
    (goal - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN filled THEN 0 ELSE w END) OVER ()) END AS target
  FROM levels
), plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets
), sums AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, floor(p.target - p.epochs * p.source_size)::BIGINT AS words,
    (sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.draw, k.doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size)::BIGINT AS used
  FROM keyed k JOIN plans p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, words - used)))::BIGINT AS taken FROM sums
"""
