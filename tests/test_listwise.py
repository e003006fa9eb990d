import math
import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import listwise
from lodestar.operators.listwise import ListwiseRanker, lambdas, ndcg
from lodestar.operators.ltr import TreeRanker


def brute(rows, top, sigma=1.0):
    """{(query, match): (pull, curvature)} by plain pairs; rows (query, match, label, score)."""
    out = {}
    for q in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == q and r[2] is not None), key=lambda r: (-(r[3] or 0.0), r[1]))
        ideal = sum((2.0**x - 1) / math.log2(k + 2) for k, x in enumerate(sorted((r[2] for r in own), reverse=True)[:top]))
        for r in own:
            out[r[:2]] = [0.0, 0.0]
        for i, a in enumerate(own):
            for j, b in enumerate(own[:i]):
                if a[2] == b[2] or min(i, j) >= top or not ideal:
                    continue
                d = lambda k: 1 / math.log2(k + 2) if k < top else 0.0
                change = abs(2.0 ** a[2] - 2.0 ** b[2]) * abs(d(i) - d(j)) / ideal
                up, down = (a, b) if a[2] > b[2] else (b, a)
                p = 1 / (1 + math.exp(sigma * ((up[3] or 0.0) - (down[3] or 0.0))))
                for r, sign in ((up, 1), (down, -1)):
                    out[r[:2]][0] += sign * sigma * p * change
                    out[r[:2]][1] += sigma**2 * p * (1 - p) * change
    return out


@pytest.mark.parametrize("top", (1, 4, 50))
def test_lambdas_against_plain_pairs(spark, top, monkeypatch):
    monkeypatch.setattr(listwise, "PART_ROWS", 7)  # lists of several parts
    rng = random.Random(top)
    rows = [(q, m, rng.choice([0, 0, 1, 2, 4, None]), rng.choice([None, 0.5, round(rng.uniform(-3, 3), 2)])) for q in range(6) for m in range(rng.choice([1, 2, 25]))]
    rows += [(90, m, 3, float(m)) for m in range(4)] + [(91, m, 0, float(m)) for m in range(4)]  # labels alike, and all zero
    df = spark.createDataFrame([(*r, "x") for r in rows], "query_id int, match_id int, relevance int, score double, _note string")
    got = {(r.query_id, r.match_id): (r["lambda"], r["hessian"]) for r in lambdas(df, top, 1.3).collect()}
    want = brute(rows, top, 1.3)
    assert got.keys() == want.keys()
    assert all(math.isclose(a, b, abs_tol=1e-9) for k in got for a, b in zip(got[k], want[k], strict=True))
    assert lambdas(df.limit(0)).count() == 0


def market(spark, seed, queries=60):
    """Lists whose labels lie around a level that only the list has: its order follows one feature, its level another."""
    rng = random.Random(seed)
    rows = []
    for q in range(queries):
        level = rng.choice([0, 20])
        for m in range(12):
            a = rng.random()
            good = a + 0.15 * rng.gauss(0, 1)
            rows.append((q, m, float(level), a + level, rng.random(), good))
        own = sorted(rows[-12:], key=lambda r: r[5])
        rows[-12:] = [(*r[:5], own.index(r) // 3) for r in rows[-12:]]
    return spark.createDataFrame(rows, "query_id int, match_id int, level double, a double, noise double, relevance int")


def test_held_out_lists_are_better_than_pointwise(spark, tmp_path):
    learn, held = market(spark, 1).cache(), market(spark, 2, 40).cache()
    columns = ["level", "a", "noise"]
    lists = ListwiseRanker(columns, trees=6, depth=3).train(learn)
    points = TreeRanker(columns, trees=6, depth=3).train(learn)
    score = {name: ndcg(r.rank(held), 5) for name, r in (("lists", lists), ("points", points))}
    by_chance = ndcg(held.withColumn("rank", F.col("match_id") + 1), 5)
    assert score["lists"] > score["points"] > by_chance and score["lists"] > 0.8
    lists.save(f"file://{tmp_path}/m")
    again = ListwiseRanker(columns).load(f"file://{tmp_path}/m")
    plain = lambda r: sorted((x.query_id, x.match_id, x["rank"], round(x.score, 9)) for x in r.rank(held).collect())
    assert plain(again) == plain(lists)
    more = ListwiseRanker(columns, trees=2, depth=3).load(f"file://{tmp_path}/m").train(learn, onto=True)
    assert len(more.models) == 8 and ndcg(more.rank(learn), 5) >= ndcg(lists.rank(learn), 5) - 0.01
    with pytest.raises(ValueError):
        ListwiseRanker(["a"]).load(f"file://{tmp_path}/m")


def test_prices_decide(spark):
    """Models of cheap-first and dear-first lists put four offers in the order of their prices, a missing one last or first."""
    offers = [("3", 100.0), ("4", 200.0), ("2", 300.0), ("1", 400.0)]
    rng = random.Random(0)
    for sign in (1, -1):
        rows = [(q, str(m), price, 4 - k if sign > 0 else k + 1) for q in range(25) for k, (m, price) in enumerate((m, base + rng.uniform(-40, 40)) for m, base in enumerate((100, 200, 300, 400)))]
        ranker = ListwiseRanker(["price"], trees=8, depth=3).train(spark.createDataFrame(rows, "query_id int, match_id string, price double, relevance int"))
        asked = spark.createDataFrame([(1, m, p) for m, p in offers], "query_id int, match_id string, price double")
        found = [r.match_id for r in ranker.rank(asked).orderBy("rank").collect()]
        assert found == [m for m, _ in (offers if sign > 0 else offers[::-1])]


def test_odd_lists(spark):
    kind = "query_id int, match_id int, a double, relevance int"
    alike = spark.createDataFrame([(1, 1, 0.5, 2), (1, 2, 0.7, 2), (2, 1, None, 0)], kind)
    assert ListwiseRanker(["a"]).train(alike).models == []  # nothing to learn
    with pytest.raises(ValueError):
        ListwiseRanker(["a"]).rank(alike)
    with pytest.raises(ValueError, match="missing"):
        ListwiseRanker(["b"]).train(alike)
    rows = spark.createDataFrame([(q, m, None if m == 0 else float(m), m) for q in range(9) for m in range(4)], kind)
    ranker = ListwiseRanker(["a"], trees=3).train(rows)
    assert [r.match_id for r in ranker.rank(rows.where("query_id = 3")).orderBy("rank").collect()] == [3, 2, 1, 0]
    assert ranker.rank(rows.limit(0)).count() == 0
    assert math.isnan(ndcg(ranker.rank(rows).withColumn("relevance", F.lit(0)), 3))
    assert ndcg(ranker.rank(rows), 3) == pytest.approx(1.0)
