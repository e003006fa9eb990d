"""Listwise boosting: trees that follow the gradient of a truncated NDCG over each query's list.

Each round turns the current order of a query's rows into a pull on every row, from all pairs of unlike labels of which one
row stands among the first `top`; a tree is fitted to the pulls as a Newton step, and leaf values are sums of pulls over
sums of curvature. A pair needs only the query's first rows, so no task ever holds a list.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.ltr import assembled
from lodestar.sources.scratch import Scratch

#: Rows of one list that share a key; longer lists are spread over several.
PART_ROWS = 50_000


def _gain(label: Column) -> Column:
    return F.pow(F.lit(2.0), label) - 1


def _discount(rank: Column) -> Column:
    return 1 / F.log2(1 + rank)


def _first_rows(rows: DataFrame, query: str, order: list[Column], top: int) -> DataFrame:
    """rows with `_rank`, cut to the first `top` of each query; Spark cuts before it shuffles, too."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("_rank") <= top)


def ideal_dcg(rows: DataFrame, query: str, label: str, top: int) -> DataFrame:
    """(query, ideal): the greatest DCG that the first `top` rows of each query's list can have."""
    best = _first_rows(rows.select(query, F.col(label).cast("double").alias("_label")).where("_label is not null"), query, [F.desc("_label")], top)
    return best.groupBy(query).agg(F.sum(_gain(F.col("_label")) * _discount(F.col("_rank"))).alias("ideal"))


def ndcg(ranked: DataFrame, top: int, query: str = "query_id", label: str = "relevance", rank: str = "rank") -> float:
    """The mean over queries of DCG by `rank` over the ideal one, first `top` rows; queries whose labels are all zero or null don't count."""
    got = ranked.where(F.col(rank) <= top).groupBy(query).agg(F.sum(F.coalesce(_gain(F.col(label).cast("double")), F.lit(0.0)) * _discount(F.col(rank))).alias("dcg"))
    found = ideal_dcg(ranked, query, label, top).where("ideal > 0").join(got, query, "left").agg(F.avg(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"))).first()[0]
    return float("nan") if found is None else found


def lambdas(rows: DataFrame, top: int = 30, sigma: float = 1.0, query: str = "query_id", match: str = "match_id", label: str = "relevance", score: str = "score") -> DataFrame:
    """rows with `lambda`, the pull that listwise loss has on a row's score, and `hessian`, its curvature.

    Of rows i and j of one query, i with the greater label and one of them among the first `top` by score (ties by match), i is
    pulled up and j down by sigma * p * d: p is 1 / (1 + exp(sigma (s_i - s_j))), d what the NDCG of the first `top` rows changes by if they trade
    places. The curvature is sigma^2 * p * (1 - p) * d. Rows with a null label have neither, and
    queries whose labels are alike have zeros. Rows of a query are told apart by match, which must not repeat.
    """
    sized = rows.withColumns({"_label": F.col(label).cast("double"), "_score": F.coalesce(F.col(score).cast("double"), F.lit(0.0))}).where("_label is not null")
    parts = sized.groupBy(query).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_parts"))
    first = _first_rows(sized.select(query, match, "_label", "_score"), query, [F.desc("_score"), F.col(match)], top)
    entry = F.struct(F.col("_rank").alias("rank"), F.col(match).alias("match"), F.col("_score").alias("score"), _gain(F.col("_label")).alias("gain"), F.col("_label").alias("label"))
    lists = first.groupBy(query).agg(F.array_sort(F.collect_list(entry)).alias("_top")).join(ideal_dcg(sized, query, "_label", top), query).join(parts, query)
    spread = lists.select(query, "_top", "ideal", "_parts", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    dealt = sized.join(parts, query).withColumn("_part", F.pmod(F.xxhash64(match), F.col("_parts")).cast("int")).drop("_parts")
    met = dealt.join(spread.drop("_parts"), [query, "_part"])
    # the discount of a row is that of its place among the first, or nothing
    place = F.get(F.filter("_top", lambda t: t["match"] == F.col(match)), F.lit(0))["rank"]
    met = met.withColumn("_place", place).withColumn("_own", F.coalesce(_discount(F.col("_place")), F.lit(0.0)))

    def pair(t: Column) -> Column:
        sign = F.signum(F.col("_label") - t["label"])
        change = F.abs(_gain(F.col("_label")) - t["gain"]) * F.abs(F.col("_own") - _discount(t["rank"])) / F.col("ideal")
        p = 1 / (1 + F.exp(sigma * sign * (F.col("_score") - t["score"])))
        weight = F.when((sign == 0) | (F.col("ideal") <= 0), 0.0).otherwise(change)
        return F.struct((sign * sigma * p * weight).alias("pull"), (sigma * sigma * p * (1 - p) * weight).alias("bend"))

    met = met.withColumn("_pairs", F.transform("_top", pair))
    total = lambda f: F.aggregate("_pairs", F.lit(0.0), lambda s, x: s + x[f])
    # what rows further down do to the first ones, summed by place
    down = met.where("_place is null").select(query, F.posexplode("_pairs").alias("_at", "_x"))
    down = down.groupBy(query, (F.col("_at") + 1).alias("_place")).agg(F.sum(-F.col("_x.pull")).alias("_pull"), F.sum("_x.bend").alias("_bend"))
    out = met.withColumns({"lambda": total("pull"), "hessian": total("bend")}).join(down, [query, "_place"], "left")
    out = out.withColumns({"lambda": F.col("lambda") + F.coalesce("_pull", F.lit(0.0)), "hessian": F.col("hessian") + F.coalesce("_bend", F.lit(0.0))})
    return out.select(*rows.columns, "lambda", "hessian")


class ListwiseRanker:
    """Boosted trees on lambdas(); train() replaces the trees or, with onto=True, adds to them.

    rank() before train() raises ValueError. Features that a row lacks are trained on and ranked alike, less than any other.
    """

    def __init__(self, columns: list[str], label: str = "relevance", trees: int = 10, depth: int = 4, rate: float = 0.3, top: int = 30, sigma: float = 1.0, ridge: float = 1e-3, least: int = 1, seed: int = 0):
        self.columns, self.label, self.trees, self.rate, self.top, self.sigma, self.ridge = columns, label, trees, rate, top, sigma, ridge
        self.estimator = DecisionTreeRegressor(featuresCol="features", labelCol="_target", weightCol="hessian", maxDepth=depth, leafCol="_leaf", predictionCol="_prediction", minInstancesPerNode=least, seed=seed)
        self.models: list[tuple[DecisionTreeRegressionModel, dict[int, float]]] = []

    def _step(self, rows: DataFrame, model: DecisionTreeRegressionModel, values: dict[int, float]) -> DataFrame:
        """rows with `score` raised by what the model's leaf is worth."""
        worth = F.create_map(*[F.lit(x) for leaf, value in values.items() for x in (float(leaf), float(value))])
        placed = model.transform(rows)
        return placed.withColumn("score", F.col("score") + F.coalesce(F.element_at(worth, F.col("_leaf")), F.lit(0.0))).drop("_leaf", "_prediction")

    def train(self, rows: DataFrame, query: str = "query_id", match: str = "match_id", onto: bool = False) -> ListwiseRanker:
        if not onto:
            self.models = []
        scratch = Scratch(rows.sparkSession)
        known = assembled(rows.where(F.col(self.label).isNotNull()), self.columns).select(query, match, F.col(self.label).cast("double").alias(self.label), "features").withColumn("score", F.lit(0.0))
        for model, values in self.models:
            known = self._step(known, model, values)
        known = scratch.keep(known)
        for _ in range(self.trees):
            pulled = scratch.keep(lambdas(known, self.top, self.sigma, query, match, self.label).withColumn("_target", F.try_divide("lambda", "hessian")))
            usable = pulled.where("hessian > 0")
            if usable.isEmpty():  # every pair is settled, or there is none
                scratch.drop(pulled)
                break
            model = self.estimator.fit(usable)
            if model.numFeatures != len(self.columns):
                raise ValueError("the model's features don't match the columns")
            sums = model.transform(usable).groupBy("_leaf").agg((F.sum("lambda") / (F.sum("hessian") + self.ridge)).alias("step")).collect()  # leaves of one tree
            values = {int(r["_leaf"]): self.rate * r["step"] for r in sums}
            self.models.append((model, values))
            after = scratch.keep(self._step(pulled.drop("lambda", "hessian", "_target"), model, values).select(*known.columns))
            scratch.drop(known, pulled)
            known = after
        return self

    def rank(self, rows: DataFrame, query: str = "query_id", match: str = "match_id") -> DataFrame:
        """rows with `score` and `rank`, best first in each query, ties by match."""
        if not self.models:
            raise ValueError("train() comes first")
        scored = assembled(rows.drop("score"), self.columns).withColumn("score", F.lit(0.0))
        for model, values in self.models:
            scored = self._step(scored, model, values)
        return scored.drop("features").withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), match)))

    def save(self, path: str) -> None:
        if not self.models:
            raise ValueError("train() comes first")
        PipelineModel([m for m, _ in self.models]).write().overwrite().save(f"{path}/trees")
        spark = SparkSession.active()
        said = [(k, json.dumps({str(leaf): v for leaf, v in values.items()})) for k, (_, values) in enumerate(self.models)]
        spark.createDataFrame(said, "tree int, leaves string").coalesce(1).write.mode("overwrite").parquet(f"{path}/leaves")

    def load(self, path: str) -> ListwiseRanker:
        trees = PipelineModel.load(f"{path}/trees").stages
        rows = SparkSession.active().read.parquet(f"{path}/leaves").orderBy("tree").collect()  # one row a tree
        for tree in trees:
            if tree.numFeatures != len(self.columns):
                raise ValueError(f"the model has {tree.numFeatures} features, not {len(self.columns)}")
        self.models = [(t, {int(k): v for k, v in json.loads(r["leaves"]).items()}) for t, r in zip(trees, rows, strict=True)]
        return self
