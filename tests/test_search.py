import numpy as np
import pytest

from lodestar.operators import index as ix
from lodestar.operators import knn
from lodestar.operators.knn import fill_embedding, hydrate, knn_join, merge_shards

SCHEMA = "id string, embedding array<double>"


def frame(spark, rows):
    return spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in rows], SCHEMA)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.match_id, round(r.score, 6)))
    return out


def test_known_small(spark):
    docs = frame(spark, [(k, [10.0 ** (k - 4)] * 3) for k in range(4, 8)])
    got = found(knn_join(docs, docs, 2, "euclidean"))
    assert {q: [m for m, _ in v] for q, v in got.items()} == {"4": ["4", "5"], "5": ["5", "4"], "6": ["6", "5"], "7": ["7", "6"]}


def test_five_points_and_squared_distance(spark):
    docs = frame(spark, zip("abcde", ([x] * 10 for x in (1.1, 2, 4, 7, 11)), strict=True))
    got = found(knn_join(docs, docs, 5, "euclidean"))
    assert {q: "".join(m for m, _ in v) for q, v in got.items()} == {"a": "abcde", "b": "bacde", "c": "cbade", "d": "dceba", "e": "edcba"}
    assert all(v[0][1] == 0.0 for v in got.values())
    two = frame(spark, [("a", [1] * 10), ("b", [2] * 10)])
    assert found(knn_join(two, two, 2, "euclidean"))["a"][1] == ("b", 10.0)


def test_known_big(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(5, 10, (2000, 64))
    for k in range(0, 2000, 200):
        x[k] = k
    docs = frame(spark, [(10000 + k, v) for k, v in enumerate(x)])
    q = frame(spark, [(k, x[k]) for k in range(0, 2000, 200)])
    assert {a: v[0][0] for a, v in found(knn_join(q, docs, 1, "euclidean")).items()} == {str(k): str(10000 + k) for k in range(0, 2000, 200)}


@pytest.mark.parametrize("metric", ["cosine", "inner_product", "euclidean"])
@pytest.mark.parametrize("distance", [True, False])
@pytest.mark.parametrize("flavour", ["squared", "rooted"])
def test_metrics_against_numpy_over_many_blocks(spark, monkeypatch, metric, distance, flavour):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    monkeypatch.setattr(knn, "INDEX_BLOCK", 50)
    rng = np.random.default_rng(500)
    x, q = rng.standard_normal((300, 10)), rng.standard_normal((20, 10))
    got = found(knn_join(frame(spark, enumerate(q)), frame(spark, enumerate(x)), 5, metric, distance, flavour))
    ip = q @ x.T
    cos = ip / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None]
    d2 = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    if metric == "euclidean":
        d = np.sqrt(d2) if flavour == "rooted" else d2
        want = d if distance else 1 / (1 + d)
    elif metric == "cosine" and flavour == "rooted":
        angle = np.sqrt(2 * (1 - cos))
        want = angle if distance else 1 - angle
    else:
        raw = cos if metric == "cosine" else ip
        want = 1 - raw if distance else raw
    for k in range(20):
        order = np.argsort(want[k] if distance else -want[k], kind="stable")[:5]
        assert [m for m, _ in got[str(k)]] == [str(j) for j in order]
        assert np.allclose([s for _, s in got[str(k)]], want[k][order], atol=1e-5)


def test_zero_vectors_nulls_and_dimensions(spark):
    docs = frame(spark, [("a", [0, 0]), ("b", [1, 0])])
    assert found(knn_join(docs, docs, 2))["a"][0][1] == 1.0
    odd = spark.createDataFrame([("x", None), (None, [1.0, 2.0]), ("y", [3.0, 4.0])], SCHEMA)
    assert set(found(knn_join(docs, odd, 3))) == {"a", "b"}
    with pytest.raises(Exception, match="components"):
        knn_join(docs, frame(spark, [("z", [1, 2, 3])]), 1).collect()
    with pytest.raises(ValueError):
        knn_join(docs, docs, 1, "l2")
    with pytest.raises(ValueError):
        ix.check_dimension(frame(spark, [("a", [1]), ("b", [1, 2])]))
    assert ix.check_dimension(docs) == 2


def test_tombstones_status_and_readding(spark):
    index = frame(spark, [("a", [1] * 3), ("b", [2] * 3)]).selectExpr("*", "false as is_deleted")
    gone = ix.mark_deleted(index, frame(spark, [("a", [1]), ("c", [1])]))
    assert tuple(ix.status(gone).first()) == (1, 2, 1)
    assert [m for m, _ in found(ix.search_live(frame(spark, [("q", [1] * 3)]), gone, 5))["q"]] == ["b"]
    back = ix.upsert(gone, frame(spark, [("a", [9] * 3)]).selectExpr("*", "false as is_deleted"))
    assert tuple(ix.status(back).first()) == (2, 2, 0)
    known = ix.update_known(gone, frame(spark, [("b", [7] * 3), ("z", [7] * 3)]).selectExpr("*", "false as is_deleted"))
    assert {r.id: r.embedding[0] for r in known.collect()} == {"a": 1.0, "b": 7.0}


def test_delta_log(spark):
    index = spark.createDataFrame([("0", [1.0], 1), ("1", [1.0], 1)], "id string, embedding array<double>, updated_at int")
    kind = "id string, embedding array<double>, updated_at int, is_deleted boolean"

    def ids(df):
        return sorted(r.id for r in df.collect())

    step = ix.apply_delta(index, spark.createDataFrame([(str(k), [2.0], 2, False) for k in range(2, 6)], kind))
    assert ids(step) == list("012345")
    step = ix.apply_delta(step, spark.createDataFrame([("2", [2.0], 3, True), ("3", None, 3, False), ("9", None, 3, True)], kind))
    assert ids(step) == list("0145")
    step = ix.apply_delta(step, spark.createDataFrame([("4", [5.0], 4, False), ("4", [4.0], 3, True)], kind))
    assert ids(step) == list("0145") and {r.id: r.embedding[0] for r in step.collect()}["4"] == 5.0
    assert ids(ix.apply_delta(step, spark.createDataFrame([("2", [1.0], 5, False), ("3", [1.0], 5, False)], kind))) == list("012345")


def test_shards_merge_to_the_whole(spark):
    rng = np.random.default_rng(1)
    docs = frame(spark, enumerate(rng.standard_normal((90, 6))))
    q = frame(spark, enumerate(rng.standard_normal((4, 6))))
    parts = [knn_join(q, docs.where(f"id % 3 = {s}"), 10) for s in range(3)]
    assert found(merge_shards(parts, 10)) == found(knn_join(q, docs, 10))
    assert merge_shards(parts, None).count() == 4 * 30


def test_hydrate_and_fill(spark):
    docs = frame(spark, [("1", [1, 0]), ("2", [0, 1])])
    store = spark.createDataFrame([("1", "one")], "doc_id string, text string")
    got = {(r.query_id, r.match_id): r.text for r in hydrate(knn_join(docs, docs, 2), store).collect()}
    assert got == {("1", "1"): "one", ("1", "2"): None, ("2", "1"): "one", ("2", "2"): None}
    asked = spark.createDataFrame([("1",), ("20",)], "id string")
    assert {r.id: r.embedding for r in fill_embedding(asked, docs).collect()} == {"1": [1.0, 0.0], "20": None}


def test_inverted_file(spark, monkeypatch):
    monkeypatch.setattr(ix, "LIST_BLOCK", 40)
    monkeypatch.setattr(ix, "PROBE_BLOCK", 5)
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((8, 12)) * 4
    x = centers[rng.integers(0, 8, 400)] + rng.standard_normal((400, 12))
    docs, q = frame(spark, enumerate(x)), frame(spark, [(k, x[k]) for k in range(0, 400, 20)])
    ivf = ix.InvertedFile("euclidean", cells=8, nprobe=8).train(docs)
    lists = ivf.lists(docs)
    assert lists.count() == 400
    exact = knn_join(q, docs, 10, "euclidean")
    assert found(ivf.search(q, lists, 10)) == found(exact)
    assert ix.recall(ivf.search(q, lists, 10, nprobe=3), exact) >= 0.9
    with pytest.raises(ValueError):
        ix.InvertedFile().centers()
