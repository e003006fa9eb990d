"""Overlapping detections: of boxes of one image and label that overlap, the best stays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.sources.scratch import Scratch

SIDES = ("x1", "y1", "x2", "y2")


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two structs of SIDES; boxes without area overlap with none."""
    side = lambda low, high: F.greatest(F.lit(0.0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))
    area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    both = side("x1", "x2") * side("y1", "y2")
    return F.when(both > 0, both / (area(a) + area(b) - both)).otherwise(0.0)


def pairs_that_overlap(boxes: DataFrame, least: float) -> DataFrame:
    """(a, b, with ids, better): pairs of boxes of one image and label with an overlap over `least`.

    Boxes that overlap so much are alike in either side to a factor of 1 / least, so a box meets others in the cells of a
    grid as coarse as itself, and as the larger ones it may overlap with: never all boxes of an image.
    """
    steps = math.ceil(math.log2(1 / least))
    longest = F.greatest(F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1"))
    level = F.floor(F.log2(longest)).cast("int")
    rows = boxes.where((F.col("box.x2") > F.col("box.x1")) & (F.col("box.y2") > F.col("box.y1"))).withColumn("own", level)
    rows = rows.withColumn("level", F.explode(F.sequence(F.col("own"), F.col("own") + steps))).withColumn("cell", F.pow(F.lit(2.0), F.col("level")))
    at = lambda side: F.floor(F.col(f"box.{side}") / F.col("cell"))
    rows = rows.withColumn("gx", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("gy", F.explode(F.sequence(at("y1"), at("y2"))))
    keys = ["image", "label", "level", "gx", "gy"]
    a, b = (rows.select(*keys, F.col("id").alias(f"{x}_id"), F.col("score").alias(f"{x}_score"), F.col("box").alias(x), F.col("own").alias(f"{x}_own")) for x in ("a", "b"))
    met = a.join(b, keys).where(F.col("level") == F.greatest("a_own", "b_own"))
    better = (F.col("a_score") > F.col("b_score")) | ((F.col("a_score") == F.col("b_score")) & (F.col("a_id") < F.col("b_id")))
    return met.where(better & (overlap(F.col("a"), F.col("b")) > least)).select(F.col("a_id").alias("better"), F.col("b_id").alias("worse")).distinct()


def suppressed(boxes: DataFrame, most: float | Column = 0.45, confidence: float | Column = 0.0, id_col: str = "box_id", image_col: str = "image", label_col: str = "label", score_col: str = "score") -> DataFrame:
    """The boxes (id, image, label, x1, y1, x2, y2, score, ...) that stay: best first, each drops those of its image and label that overlap with it by more than `most`.

    Scores under `confidence`, which may be a column that each request sets, are left out first; ties go by id, and ids must not repeat. A box with a null
    side, score, image or label is left out; one without area overlaps with none. Rounds take all boxes that no better undecided one
    overlaps with at once, which gives what going through them in order gives; there are as many as the longest chain of boxes that drop each other.
    """
    scratch = Scratch(boxes.sparkSession)
    threshold = confidence if isinstance(confidence, Column) else F.lit(confidence)
    whole = boxes.where(F.col(score_col).isNotNull() & F.col(image_col).isNotNull() & F.col(label_col).isNotNull() & (F.col(score_col) >= threshold))
    whole = whole.where(" and ".join(f"{s} is not null" for s in SIDES))
    if isinstance(most, Column) or not 0 < most < 1:
        raise ValueError("most must be a number between 0 and 1")
    slim = scratch.keep(whole.select(F.col(id_col).alias("id"), F.col(image_col).alias("image"), F.col(label_col).alias("label"), F.col(score_col).alias("score"), F.struct(*[F.col(s).cast("double").alias(s) for s in SIDES]).alias("box")))
    edges = scratch.keep(pairs_that_overlap(slim, most))
    gone = edges.select(F.col("worse").alias("id")).limit(0)
    while not edges.isEmpty():
        # the best of their surroundings stay, and drop the others; edges of dropped boxes count no more
        first = edges.select(F.col("better").alias("id")).distinct().join(edges.select(F.col("worse").alias("id")), "id", "left_anti")
        dropped = scratch.keep(edges.join(first.withColumnRenamed("id", "better"), "better", "left_semi").select(F.col("worse").alias("id")).distinct())
        gone = gone.unionByName(dropped)
        rest = edges.join(dropped.withColumnRenamed("id", "better"), "better", "left_anti").join(dropped.withColumnRenamed("id", "worse"), "worse", "left_anti")
        after = scratch.keep(rest.select("better", "worse"))
        scratch.drop(edges)
        edges = after
    return whole.join(gone.withColumnRenamed("id", "_gone"), F.col(id_col) == F.col("_gone"), "left_anti")
