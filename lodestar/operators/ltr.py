"""Learning to rank: features of queries and matches side by side, and boosted trees over them."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def features(queries: DataFrame, matches: DataFrame, query_features: tuple[str, ...], match_features: tuple[str, ...], key: str = "query_id", query_first: bool = True) -> DataFrame:
    """Each match with its query's features, prefixed query_ and match_, in the model's column order; and its group's size.

    A feature that a row lacks is null. group_size counts the query's matches.
    """
    q = queries.select(key, *[F.col(c).cast("double").alias(f"query_{c}") for c in query_features])
    sizes = matches.groupBy(key).agg(F.count("*").alias("group_size"))
    named = matches.select("*", *[F.col(c).cast("double").alias(f"match_{c}") for c in match_features])
    both = named.join(q, key).join(sizes, key)
    cols = [f"query_{c}" for c in query_features], [f"match_{c}" for c in match_features]
    order = cols[0] + cols[1] if query_first else cols[1] + cols[0]
    return both.select(*[c for c in matches.columns if c not in order], "group_size", *order)


#: What a missing feature counts as, in training and in ranking alike: less than any other.
MISSING = -1e12


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with `features`, a vector of the columns in their order, MISSING where one is null or not a number; ValueError if rows lack a column."""
    lacking = [c for c in columns if c not in rows.columns]
    if lacking:
        raise ValueError(f"features {lacking} are missing")
    known = {f"_feature{k}": F.when(F.isnan(x := F.col(c).cast("double")) | x.isNull(), MISSING).otherwise(x) for k, c in enumerate(columns)}
    return VectorAssembler(inputCols=list(known), outputCol="features").transform(rows.withColumns(known)).drop(*known)


class TreeRanker:
    """Gradient-boosted regression trees on relevance, pointwise; ListwiseRanker has the objective of whole lists.

    train() may be called again to replace the trees, or with onto=True to add trees that correct those there are;
    rank() before it raises ValueError, or with strict=False returns the matches in the order of their ids. Rows that
    lack a feature are trained on and ranked with MISSING for it.
    """

    def __init__(self, columns: list[str], label: str = "relevance", weight: str | None = None, trees: int = 5, depth: int = 5, seed: int = 0):
        self.columns, self.label, self.weight = columns, label, weight
        self.estimator = GBTRegressor(featuresCol="features", labelCol="_label", maxIter=trees, maxDepth=depth, seed=seed, minInstancesPerNode=1)
        if weight:
            self.estimator = self.estimator.setWeightCol("_weight")
        self.models: list[GBTRegressionModel] = []

    def _scored(self, assembled: DataFrame) -> DataFrame:
        """The sum of all models' predictions as `score`."""
        total = F.lit(0.0)
        for k, model in enumerate(self.models):
            assembled = model.copy({model.predictionCol: f"_score{k}"}).transform(assembled)
            total = total + F.col(f"_score{k}")
        return assembled.withColumn("score", total).drop(*[f"_score{k}" for k in range(len(self.models))])

    def train(self, rows: DataFrame, onto: bool = False) -> TreeRanker:
        rows = assembled(rows.where(F.col(self.label).isNotNull()).withColumn("_label", F.col(self.label).cast("double")), self.columns)
        if self.weight:
            rows = rows.withColumn("_weight", F.col(self.weight).cast("double"))
        if onto and self.models:
            rows = self._scored(rows.drop("score")).withColumn("_label", F.col("_label") - F.col("score")).drop("score")
        model = self.estimator.fit(rows)
        if model.numFeatures != len(self.columns):
            raise ValueError("the model's features don't match the columns")
        self.models = [*self.models, model] if onto else [model]
        return self

    def rank(self, rows: DataFrame, key: str = "query_id", match: str = "match_id", strict: bool = True) -> DataFrame:
        """rows with `score` and `rank`, best first in each query, ties by match."""
        if not self.models:
            if strict:
                raise ValueError("train() comes first")
            return rows.withColumn("score", F.lit(None).cast("double")).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(match)))
        scored = self._scored(assembled(rows, self.columns)).drop("features")
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), match)))

    def save(self, path: str) -> None:
        if not self.models:
            raise ValueError("train() comes first")
        PipelineModel(self.models).write().overwrite().save(path)

    def load(self, path: str) -> TreeRanker:
        models = PipelineModel.load(path).stages
        for model in models:
            if model.numFeatures != len(self.columns):
                raise ValueError(f"the model has {model.numFeatures} features, not {len(self.columns)}")
        self.models = models
        return self


def filled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with missing features set to the column's mean."""
    return Imputer(inputCols=columns, outputCols=columns).fit(rows).transform(rows)
