"""Documents, their chunks and their matches as one flat table of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a node: the root it hangs from, itself, its parent, the path from the root ('' for roots), its place among siblings.
KEYS = ("root_id", "doc_id", "parent_id", "path", "ord")


def roots(docs: DataFrame, id_col: str = "doc_id", columns: tuple[str, ...] = ()) -> DataFrame:
    i = F.col(id_col).cast("string")
    return docs.select(i.alias("root_id"), i.alias("doc_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("path"), F.lit(0).alias("ord"), *columns)


def children(nodes: DataFrame, parts: DataFrame, step: str = "c", columns: tuple[str, ...] = ()) -> DataFrame:
    """Nodes for parts (parent_id, doc_id, ord, ...), one step down from their parents in nodes."""
    if step not in ("c", "m"):
        raise ValueError("a step is c for chunks or m for matches")
    up = nodes.select(F.col("doc_id").alias("parent_id"), "root_id", F.concat("path", F.lit(step)).alias("path"))
    return parts.withColumn("parent_id", F.col("parent_id").cast("string")).join(up, "parent_id").select("root_id", F.col("doc_id").cast("string").alias("doc_id"), "parent_id", "path", F.col("ord").cast("int").alias("ord"), *columns)


def parse_paths(paths: str | list[str] | tuple[str, ...]) -> list[str]:
    """'r', 'c', '@r,c', ['cc', 'r'], ... as node paths; other letters raise ValueError."""
    listed = paths.lstrip("@").split(",") if isinstance(paths, str) else list(paths)
    out = []
    for p in listed:
        p = p.strip().removeprefix("r")
        if set(p) - set("cm"):
            raise ValueError(f"traversal path {p!r}")
        out.append(p)
    return out


def traverse(nodes: DataFrame, paths: str | list[str] | tuple[str, ...]) -> DataFrame:
    """The nodes at the paths, a filter on one column; a path named twice counts once."""
    return nodes.where(F.col("path").isin(parse_paths(paths)))


def has_text(nodes: DataFrame, text_col: str = "text") -> DataFrame:
    return nodes.where(F.char_length(text_col) > 0)


def nested(parent: DataFrame, parts: DataFrame, name: str = "chunks", key: str = "doc_id", parent_key: str = "parent_id") -> DataFrame:
    """parent with an array of its parts in their order."""
    cols = [c for c in parts.columns if c not in (parent_key, "ord")]
    arrays = parts.groupBy(F.col(parent_key).alias("_parent")).agg(F.array_sort(F.collect_list(F.struct("ord", *cols))).alias(name))
    return parent.join(arrays, F.col(key) == F.col("_parent"), "left").drop("_parent")
