"""Ranking of parent documents by their chunks' matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The aggregate of each ranking, and whether its order is descending.
RANKINGS = {"min": ("min", False), "max": ("max", True), "mean_min": ("avg", False), "mean_max": ("avg", True)}


def simple_rank(matches: DataFrame, ranking: str = "min", query: str = "query_id", parent: str = "parent_id", score: str = "score", places: int = 9) -> DataFrame:
    """(query, parent, score, rank) of chunk matches (query, parent, score), aggregated by query and parent.

    min and mean_min rank ascending, max and mean_max descending; scores that agree to `places` places are ordered by
    parent. Matches without a score are passed over.
    """
    if ranking not in RANKINGS:
        raise ValueError(f"ranking must be one of {tuple(RANKINGS)}, not {ranking!r}")
    how, descending = RANKINGS[ranking]
    rows = matches.where(F.col(score).isNotNull()).groupBy(query, parent).agg(getattr(F, how)(score).alias("score"))
    key = F.round("score", places)
    order = Window.partitionBy(query).orderBy(key.desc() if descending else key.asc(), parent)
    return rows.withColumn("rank", F.row_number().over(order))
