import hashlib
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.hashing import content_hash, shard_bounds, shard_of, virtual_shard
from lodestar.functions.text import SENTENCE_MARKS, clean, label_prompt
from lodestar.functions import vectors
from lodestar.functions.vectors import pooled
from lodestar.operators import dedup_cache, encoders, ltr, rankers, segmenters, store, traversal
from lodestar.operators import index as index_ops
from lodestar.operators.sentencizer import sentencize
from lodestar.plans.compound import SearchStore
from lodestar.sources import audio, dump
from lodestar.sources.versioned import VersionedTable
from lodestar.streaming.dedup import drop_seen, into_store
from lodestar.streaming.sync import compact, follow, live

T0 = datetime(2024, 1, 1)


# --- cache


def test_cache_counts_through_update_and_delete(spark):
    docs = spark.createDataFrame([(1, "content", 1), (2, "content", 2), (3, "content", 3), (4, "content2", 4)], "id int, content string, ord int")
    ids, hashes = dedup_cache.entries(docs, ("content",))
    assert tuple(dedup_cache.counts(ids, hashes).first()) == (4, 2)
    new = spark.createDataFrame([(k, f"new{k}", k) for k in range(1, 6)], "id int, content string, ord int")
    ids, hashes = dedup_cache.update(ids, hashes, new, ("content",))
    assert tuple(dedup_cache.counts(ids, hashes).first()) == (4, 4)
    ids, hashes = dedup_cache.delete(ids, hashes, new)
    assert tuple(dedup_cache.counts(ids, hashes).first()) == (0, 0)


def test_first_wins_and_missing_fields(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, None), (6, None)], "id int, text string")
    assert sorted(r.id for r in dedup_cache.first_wins(docs, ("text",), "id").collect()) == [1, 2, 5]
    cached = docs.where("id = 2").select(content_hash("text").alias("hash"))
    assert sorted(r.id for r in dedup_cache.first_wins(docs, ("text",), "id", cached).collect()) == [1, 5]
    assert docs.select(content_hash("text")).first()[0] == hashlib.sha256(b"text:a;").hexdigest()


# --- sentences


def plain_sentences(text, marks=SENTENCE_MARKS, min_len=1, max_len=512):
    """A scan over characters: blanks, a run without marks that ends in no blank, then marks."""
    found, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and (text[end] not in marks or (text[end].isspace() and not text[at:end].strip())):
            end += 1
        last = end
        while last > at and text[last - 1].isspace():
            last -= 1
        if not text[at:last].strip():  # no run from here
            at = end + 1
            continue
        stop = last
        while stop < len(text) and text[stop] in marks:
            stop += 1
        found.append((at, stop))
        at = stop
    found = found or [(0, len(text))]
    cut = lambda a, b: "".join(" " if c == "\n" else c for k, c in enumerate(text[a:b]) if not (c == "\n" and k and text[a + k - 1] == "\n")).strip()[:max_len]
    rows = [(k, cut(a, b), a, b) for k, (a, b) in enumerate(found)]
    return [r for r in rows if len(r[1]) > min_len]


@pytest.mark.parametrize("marks", [None, (".",), ("]", "-", "^")])
def test_sentences_against_plain_patterns(spark, marks):
    texts = ["Rain. Again! Why? Fog", "...", "", None, " one\n\ntwo.  x. yes", "no marks", "a^b]c-d", "é. ü!? ¿sí", "\n\n.\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in sentencize(docs, marks=marks).collect():
        got.setdefault(r.doc_id, []).append((r.offset, r.sentence, r.start, r.end))
    want = {k: plain_sentences(t, marks or SENTENCE_MARKS) for k, t in enumerate(texts) if t}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_sentence_options(spark):
    docs = spark.createDataFrame([(1, "Rain. Again! Why? Fog")], "doc_id int, text string")
    assert [r.sentence for r in sentencize(docs).orderBy("offset").collect()] == ["Rain.", "Again!", "Why?", "Fog"]
    assert sentencize(docs, marks=(".",)).count() == 2
    assert [r.sentence for r in sentencize(docs, max_len=3, marks=(".",)).orderBy("offset").collect()] == ["Rai", "Aga"]
    assert sentencize(docs, uniform_weight=False).where("sentence = 'Fog'").first().weight == pytest.approx(3 / 21)


# --- rankers


def test_simple_rankers(spark):
    m = spark.createDataFrame([("q", "1", 0.1), ("q", "2", 0.3), ("q", "1", 0.2), ("q", "2", 0.5), ("q", "3", None)], "query_id string, parent_id string, score double")
    want = {"min": [("1", 0.1), ("2", 0.3)], "max": [("2", 0.5), ("1", 0.2)], "mean_min": [("1", 0.15), ("2", 0.4)], "mean_max": [("2", 0.4), ("1", 0.15)]}
    for ranking, rows in want.items():
        assert [(r.parent_id, round(r.score, 6)) for r in rankers.simple_rank(m, ranking).orderBy("rank").collect()] == rows
    with pytest.raises(ValueError):
        rankers.simple_rank(m, "median")


def test_tree_ranker_prefers_low_prices(spark, tmp_path):
    rows = [(q, m, 100.0 + (q * 37 + m * 11) % 400, 0.0) for q in range(200) for m in range(4)]
    train = spark.createDataFrame([(q, m, p, 10.0 - p / 50) for q, m, p, _ in rows], "query_id int, match_id int, match_price double, relevance double")
    ranker = ltr.TreeRanker(["match_price"])
    test = spark.createDataFrame([(1, "1", 405.0), (1, "2", 305.0), (1, "3", 96.0), (1, "4", 200.0)], "query_id int, match_id string, match_price double")
    with pytest.raises(ValueError):
        ranker.rank(test)
    assert ranker.rank(test, strict=False).count() == 4
    order = [r.match_id for r in ranker.train(train).rank(test).orderBy("rank").collect()]
    assert order == ["3", "4", "2", "1"]
    ranker.save(f"file://{tmp_path}/m")
    assert [r.match_id for r in ltr.TreeRanker(["match_price"]).load(f"file://{tmp_path}/m").rank(test).orderBy("rank").collect()] == order
    lacking = spark.createDataFrame([(1, "1", 405.0), (1, "2", None), (1, "3", float("nan"))], "query_id int, match_id string, match_price double")
    both = ltr.TreeRanker(["match_price"], trees=1, depth=2).train(train)
    miss = lambda: both.rank(train).agg(F.avg((F.col("score") - F.col("relevance")) ** 2)).first()[0]
    first = miss()
    both.train(train, onto=True)
    assert miss() < 0.8 * first and len(both.models) == 2
    both.save(f"file://{tmp_path}/m2")
    again = {r.match_id: r.score for r in ltr.TreeRanker(["match_price"]).load(f"file://{tmp_path}/m2").rank(lacking).collect()}
    assert again == {r.match_id: r.score for r in both.rank(lacking).collect()} and again["2"] == again["3"]
    with pytest.raises(ValueError):
        ltr.TreeRanker(["a", "b"]).load(f"file://{tmp_path}/m")


# --- nodes


def test_traversal(spark):
    docs = spark.createDataFrame([("1", "root")], "doc_id string, text string")
    top = traversal.roots(docs, columns=("text",))
    c = traversal.children(top, spark.createDataFrame([("1", f"1{k}", k, f"c{k}") for k in (1, 2, 3)], "parent_id string, doc_id string, ord int, text string"), columns=("text",))
    cc = traversal.children(c, spark.createDataFrame([("11", f"11{k}", k, "") for k in (1, 2)], "parent_id string, doc_id string, ord int, text string"), columns=("text",))
    nodes = top.unionByName(c).unionByName(cc)
    count = lambda p: traversal.traverse(nodes, p).count()
    assert [count("r"), count("@c"), count("cc"), count(["cc", "r"]), count("@r,c")] == [1, 3, 2, 3, 4]
    assert traversal.has_text(nodes).count() == 4
    assert [x.doc_id for x in traversal.nested(top, c.select("parent_id", "doc_id", "ord")).first().chunks] == ["11", "12", "13"]
    with pytest.raises(ValueError):
        traversal.parse_paths("rx")


# --- stores


def docs(spark, ids, text="t"):
    return spark.createDataFrame([(str(i), [float(i), 1.0], f"{text}{i}") for i in ids], "doc_id string, embedding array<double>, text string")


def test_conflicts_and_updates(spark):
    base = store.as_rows(docs(spark, range(3)), now=T0)
    new = store.as_rows(docs(spark, (2, 3), "n"), now=T0)
    ids = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    assert ids(store.add(base, new, "abort")) == ids(base)
    assert ids(store.add(base, new, "ignore")) == [("0", "t0"), ("1", "t1"), ("2", "t2"), ("3", "n3")]
    assert ids(store.add(base, new, "replace")) == [("0", "t0"), ("1", "t1"), ("2", "n2"), ("3", "n3")]
    with pytest.raises(store.DuplicateIdError):
        store.add(base, new, "error")
    gone = store.soft_delete(base, docs(spark, (1, 2, 9)), T0 + timedelta(1))
    assert {r.doc_id: r.is_deleted for r in gone.collect()} == {"0": False, "1": True, "2": True}
    back = store.update(gone, docs(spark, (2, 7), "u"), now=T0 + timedelta(2))
    assert {r.doc_id: (r.text, r.is_deleted) for r in back.collect()} == {"0": ("t0", False), "1": ("t1", True), "2": ("u2", False)}
    assert store.update(gone, docs(spark, (2, 7), "u"), "insert").count() == 4
    assert store.prune(back).count() == 2 and store.hard_delete(back, docs(spark, (0,))).count() == 2 and store.clear(back).count() == 0
    assert {r.doc_id: r.is_deleted for r in store.delta_since(back, T0).collect()} == {"1": True, "2": False}
    assert store.delta_since(back, T0 + timedelta(1)).count() == 1 and store.delta_since(back, T0, filter_deleted=True).count() == 1
    assert tuple(store.status(back).first()) == (2, 3, T0 + timedelta(2))
    asked = spark.createDataFrame([("0", "own"), ("1", "own"), ("x", "own")], "doc_id string, text string")
    got = {r.doc_id: (r.text, r.embedding) for r in store.lookup(asked, back).collect()}
    assert got == {"0": ("t0", [0.0, 1.0]), "1": ("own", None), "x": ("own", None)}
    assert "embedding" not in store.lookup(asked, back, with_embedding=False).columns
    assert store.scan(back, include_docs=False, check_embedding=True, limit=1).count() == 1


def test_ids_that_repeat_within_a_batch(spark):
    base = store.as_rows(docs(spark, (1, 2)), now=T0)
    twice = spark.createDataFrame([("2", "old", 1), ("3", "first", 1), ("3", "last", 2)], "doc_id string, text string, ord int").withColumn("embedding", F.array(F.lit(0.0)))
    new = store.as_rows(twice, now=T0)
    ids = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    only = new.where("doc_id = '3'")
    assert ids(store.add(base, only, "abort", "ord")) == ids(base)
    with pytest.raises(store.DuplicateIdError):
        store.add(base, only, "error")
    assert ids(store.add(base, new, "ignore", "ord")) == [("1", "t1"), ("2", "t2"), ("3", "first")]
    assert ids(store.add(base, new, "replace", "ord")) == [("1", "t1"), ("2", "old"), ("3", "last")]
    assert ids(store.update(base, twice, "insert", T0, "ord")) == [("1", "t1"), ("2", "old"), ("3", "last")]
    at = lambda df: sorted((r.id, r.text) for r in df.collect())
    known, more = base.select(F.col("doc_id").alias("id"), "text"), twice.withColumnRenamed("doc_id", "id").select("id", "text", "ord")
    assert at(index_ops.upsert(known, more, order="ord")) == [("1", "t1"), ("2", "old"), ("3", "last")]
    assert at(index_ops.update_known(known, more, order="ord")) == [("1", "t1"), ("2", "old")]
    with pytest.raises(ValueError):
        index_ops.check_same_dimension(base, twice)


def test_trained_cells_are_kept(spark, tmp_path):
    s = SearchStore(spark, f"file://{tmp_path}/s", "euclidean")
    s.index(docs(spark, range(60)), now=T0)
    s.sync()
    s.train(f"file://{tmp_path}/m", cells=4, nprobe=4)
    q = spark.createDataFrame([("q", [7.0, 1.0])], "id string, embedding array<double>")
    got = s.search_trained(q, 3, s.load(f"file://{tmp_path}/m")).orderBy("rank").collect()
    assert [r.match_id for r in got] == ["7", "6", "8"]
    with pytest.raises(ValueError):
        SearchStore(spark, f"file://{tmp_path}/s").load(f"file://{tmp_path}/m")


def test_shard_0_trains_once_and_models_are_there_at_the_start(spark, tmp_path):
    path, model = f"file://{tmp_path}/s", f"file://{tmp_path}/m"
    s = SearchStore(spark, path, "euclidean", model=model)
    s.index(docs(spark, range(60)), now=T0)
    s.sync()
    q = spark.createDataFrame([("q", [7.0, 1.0])], "id string, embedding array<double>")
    assert s.trained is None
    with pytest.raises(ValueError, match="comes first"):
        s.search_trained(q, 3)
    first = s.train(model, cells=4, nprobe=4)
    with pytest.raises(ValueError, match="force"):
        s.train(model, cells=3)
    assert len(s.train(model, cells=3, nprobe=3, force=True).centers()) == 3 and len(first.centers()) == 4
    again = SearchStore(spark, path, "euclidean", model=model)
    assert [r.match_id for r in again.search_trained(q, 3).orderBy("rank").collect()] == ["7", "6", "8"]
    with pytest.raises(ValueError, match="shard 0"):
        SearchStore(spark, path, "euclidean", shard_id=1, total_shards=2).train(model, force=True)


def test_masked_pooling(spark):
    from lodestar.functions.vectors import pooled

    rows = [(1, [[1.0, 4.0], [3.0, 0.0], [9.0, 9.0]], [1, 1, 0]), (2, [[5.0, 6.0]], [0]), (3, [[1.0, 1.0], [2.0, 8.0]], [0, 1])]
    df = spark.createDataFrame(rows, "id int, tokens array<array<double>>, mask array<int>")
    got = {r.id: r[1:] for r in df.select("id", *[pooled(F.col("tokens"), how, F.col("mask")) for how in ("mean", "min", "max", "cls")]).collect()}
    assert got == {1: ([2.0, 2.0], [1.0, 0.0], [3.0, 4.0], [1.0, 4.0]), 2: (None,) * 4, 3: ([2.0, 8.0],) * 4}


def test_shards(spark):
    ids = [f"aa{k}" for k in range(60)]
    for m in (44, 128):
        got = spark.createDataFrame([(i,) for i in ids], "i string").select("i", virtual_shard(F.col("i"), m).alias("v")).collect()
        assert all(r.v == int(hashlib.sha256(r.i.encode()).hexdigest(), 16) % m for r in got)
    assert [list(range(*shard_bounds(s, 3, 5))) for s in range(3)] == [[0], [1], [2, 3, 4]]
    assert list(range(*shard_bounds(0, 1, 5))) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        shard_bounds(1, 1, 5)
    got = spark.range(5).select("id", shard_of(F.col("id"), 3, 5).alias("s")).collect()
    assert {r.id: r.s for r in got} == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2}


def test_versions_and_dumps(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.versions() == []
    table.write(spark.range(3))
    table.write(table.read().where("id > 0"))
    assert table.read().count() == 2 and table.read(1).count() == 3
    table.vacuum()
    assert table.versions() == [2]
    with pytest.raises(ValueError):
        table.read(1)
    (tmp_path / "t" / "commit-9-s99").touch()
    with pytest.raises(ValueError):
        table.check_schema()

    rows = store.soft_delete(store.as_rows(docs(spark, range(100))), docs(spark, range(10)))
    path = f"file://{tmp_path}/dump"
    dump.export(rows, path, 7)
    assert dump.load_docs(spark, path).count() == 90
    assert sum(dump.load_vectors(spark, path, s).count() for s in range(7)) == 90
    placed = dump.by_position(store.prune(rows), 7).groupBy("dump_shard").count().collect()
    assert sorted((r.dump_shard, r["count"]) for r in placed) == [(s, 12) for s in range(6)] + [(6, 18)]
    with pytest.raises(ValueError):
        dump.export(rows, path, 0)


def test_search_store_syncs(spark, tmp_path):
    s = SearchStore(spark, f"file://{tmp_path}/s")
    s.index(docs(spark, range(1, 9)), now=T0)
    s.sync()
    q = spark.createDataFrame([("q", [1.0, 1.0])], "id string, embedding array<double>")
    first = s.search(q, 3).orderBy("rank").collect()
    assert [(r.match_id, r.text) for r in first][0] == ("1", "t1")
    s.delete(docs(spark, (1,)), now=T0 + timedelta(1))
    s.index(docs(spark, (20,)), now=T0 + timedelta(1))
    assert "1" in [r.match_id for r in s.search(q, 10).collect()]  # the index follows at sync()
    s.sync()
    assert sorted(int(r.match_id) for r in s.search(q, 20, with_docs=False).collect()) == [*range(2, 9), 20]
    assert tuple(s.status().first())[:2] == (8, 8)
    s.snapshot()
    s.update(docs(spark, (3,), "new"), now=T0 + timedelta(3))
    s.delete(docs(spark, (4,)), now=T0 + timedelta(3))
    s.sync()
    assert s.status().first().active_docs == 8
    s.sync(use_delta=True)
    assert s.status().first().active_docs == 7
    s.prune()
    s.dump(f"file://{tmp_path}/d", 3)
    copy = SearchStore(spark, f"file://{tmp_path}/copy")
    copy.index(docs(spark, (99,)))
    copy.restore(f"file://{tmp_path}/d")
    assert copy.status().first().total_docs == 7
    assert {r.doc_id: r.text for r in copy.lookup(spark.createDataFrame([("3",)], "doc_id string")).collect()} == {"3": "new3"}
    s.clear()
    assert s.status().first().total_docs in (0, None)


# --- encoders and segmenters


def test_encode_batches_and_filters(spark):
    df = spark.createDataFrame([(1, "Tom cooks green soup"), (2, ""), (3, None), (4, "Tom cooks soup")], "id int, text string")
    for size in (1, 3):
        got = {r.id: r.embedding for r in encoders.encode(df, encoders.hash_projection(32), "text", batch_size=size).collect()}
        assert got[2] is None and got[3] is None and len(got[1]) == 32
        assert np.dot(got[1], got[4]) > 0.5
    grid = spark.createDataFrame([(1, {"shape": [2, 2, 3], "data": [1.0] * 12})], "id int, blob struct<shape:array<int>,data:array<float>>")
    assert len(encoders.encode(grid.withColumn("b", F.col("blob")), encoders.pooled_grid(8), "b").first().embedding) == 8
    with pytest.raises(NotImplementedError):
        encoders.pooled_grid(8, "median")


def test_tfidf_and_word_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, "Tom cooks green soup"), (2, "Tom cooks soup"), (3, "Birds sing"), (4, None)], "id int, text string")
    model = encoders.fit_tfidf(df)
    encoders.save_model(model, f"file://{tmp_path}/m")
    v = {r.id: r.embedding for r in encoders.encode_with(encoders.load_model(f"file://{tmp_path}/m"), df).collect()}
    assert v[1].numNonzeros() == 4 and set(v) == {1, 2, 3}
    assert v[1].dot(v[2]) > 0.1 and v[1].dot(v[3]) == 0
    wv = encoders.encode_with(encoders.fit_word_vectors(df, dims=8, least=1), df, dense=True).collect()
    assert all(len(r.embedding) == 8 for r in wv)


def test_tfidf_counts_every_word(spark, tmp_path):
    import math

    from lodestar.catalog import QUERIES

    many = " ".join(f"w{k}" for k in range(6000))
    texts = [(1, many), (2, "Caf\u00e9 na\u00efve caf\u00e9"), (3, "both caf\u00e9"), (3, "both caf\u00e9"), (4, None), (5, ""), (6, "..."), (7, "\u65e5\u672c_1 x")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.terms) for r in QUERIES["tfidf_encode"](spark, f"file://{tmp_path}").collect())
    assert got == [(1, 6000), (2, 2), (3, 2), (3, 2), (6, 0), (7, 2)]
    own = {r.doc_id: {t.word: t.weight for t in r.embedding} for r in encoders.tfidf(df).collect()}
    a, b = 2 * math.log(7 / 4), math.log(7 / 2)
    assert own[2].keys() == {"caf\u00e9", "na\u00efve"} and abs(own[2]["caf\u00e9"] - a / math.hypot(a, b)) < 1e-12
    hashed = encoders.encode_with(encoders.fit_tfidf(df), df).where("doc_id = 2").first().embedding
    assert sorted(hashed.values.round(9)) == sorted(round(x, 9) for x in own[2].values())


def test_tfidf_of_words_that_are_not_sent(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.3, 40) if k < 1 << 30) for _ in range(150)]
    texts += [texts[0]] * 30 + ["rare\u00e9 RARE\u00c9", "?", None]
    df = spark.createDataFrame([(k, t, "r") for k, t in enumerate(texts)], "doc_id long, text string, _rare string").repartition(3)
    weights = lambda: {r.doc_id: [(t.word, round(t.weight, 12)) for t in r.embedding] for r in encoders.tfidf(df).collect()}
    every = weights()
    assert len(every) == 182 and all(sum(w * w for _, w in v) == pytest.approx(1) and [w for w, _ in v] == sorted({w for w, _ in v}) for v in every.values() if v)
    assert encoders.tfidf(df).columns == ["doc_id", "text", "_rare", "embedding"]
    shuffled = lambda: encoders.tfidf(df)._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert not shuffled()  # a small vocabulary goes to all tasks, and nothing is shuffled but its counts
    for sent in (20, 0):
        monkeypatch.setattr(encoders, "SENT", sent)
        assert weights() == every and shuffled()


def test_pooling_and_text_functions(spark):
    row = spark.createDataFrame([([[1.0, 4.0], [3.0, 2.0]],)], "t array<array<double>>")
    assert [row.select(pooled(F.col("t"), h)).first()[0] for h in ("mean", "min", "max", "cls")] == [[2.0, 3.0], [1.0, 2.0], [3.0, 4.0], [1.0, 4.0]]
    with pytest.raises(NotImplementedError):
        pooled(F.col("t"), "sum")
    t = spark.createDataFrame([("  A &amp;lt; B\n\nC ", ["x", "y"])], "s string, l array<string>")
    e = spark.createDataFrame([("caf&#233; &#x1F600;&#0; &#xD800; &amp;#38; 1 &#12", )], "s string")
    assert e.select(clean(F.col("s"))).first()[0] == "caf\u00e9 \U0001F600&#0; &#xd800; & 1 &#12"
    n = spark.createDataFrame([([1.0, 3.0, 2.0],)], "v array<double>").select(vectors.softmax(F.col("v")), vectors.clamped(F.col("v"), 1.5, 2.5), vectors.rescaled(F.col("v"), 0.0, 1.0), vectors.decibels(F.col("v")), vectors.frames(F.col("v"), 2, 1)).first()
    x = np.exp([1.0, 3.0, 2.0])
    assert np.allclose(n[0], x / x.sum()) and n[1] == [1.5, 2.5, 2.0] and n[2] == [0.0, 1.0, 0.5] and np.allclose(n[3], 10 * np.log10([1, 3, 2])) and n[4] == [[1.0, 3.0], [3.0, 2.0]]
    assert tuple(t.select(clean(F.col("s")), label_prompt(F.col("l"), "a photo of {}.")).first()) == ("a < b c", "a photo of x, y.")


def test_detections_and_speech(spark, tmp_path):
    image = {"shape": [4, 4, 1], "data": [float(k) for k in range(16)]}
    df = spark.createDataFrame([("a", image), ("b", None)], "doc_id string, blob struct<shape:array<int>,data:array<float>>")
    model = lambda: lambda x: [((0, 1, 2, 3), "cat", 0.9), ((2, 2, 4, 4), "dog", 0.4), ((0, 0, 1, 1), "dot", 0.3)]
    got = segmenters.detect(df, model, 0.4).collect()
    assert [(r.label, r.location, r.blob.data) for r in got] == [("cat", [0, 1], [1.0, 2.0, 5.0, 6.0]), ("dog", [2, 2], [10.0, 11.0, 14.0, 15.0])]

    rate = 8000
    wave = np.concatenate([np.zeros(rate), np.sin(np.arange(rate) / 5) * 0.5, np.zeros(rate)])
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.wav").write_bytes(audio.encode_wave(wave, rate))
    found = segmenters.speech(audio.read_waves(spark, f"file://{tmp_path}/w")).collect()
    assert len(found) == 1 and abs(found[0].location[0] - 16000) <= 500 and abs(found[0].location[1] - 32000) <= 500
    kept = audio.write_waves(spark.createDataFrame(found), f"file://{tmp_path}/chunks", 16_000).collect()
    back = audio.read_waves(spark, f"file://{tmp_path}/chunks").collect()
    assert [r.path.rsplit("/", 1)[1] for r in kept] == [r.doc_id.rsplit("/", 1)[1] for r in back] and len(back[0].wave[0]) == len(found[0].wave) and np.allclose(back[0].wave[0], found[0].wave, atol=1e-4)
    import io
    import wave as waves

    raw = io.BytesIO()
    with waves.open(raw, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(3)
        f.setframerate(rate)
        f.writeframes(b"".join(int(v).to_bytes(3, "little", signed=True) for v in (0, 1 << 22, -(1 << 23))))
    assert audio.decode_wave(raw.getvalue())[0].tolist() == [[0.0, 0.5, -1.0]]
    bad = spark.createDataFrame([("z", [[0.0]], 0)], "doc_id string, wave array<array<float>>, sample_rate int")
    with pytest.raises(Exception, match="sample rate"):
        segmenters.speech(bad).collect()


# --- streams


def test_streams(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, text string")
    rows.write.parquet(src)
    read = lambda: spark.readStream.schema(rows.schema).parquet(src)
    drop_seen(read(), ("text",)).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("seen").count() == 2
    table, cache = VersionedTable(spark, f"file://{tmp_path}/t"), VersionedTable(spark, f"file://{tmp_path}/h")
    run = lambda: into_store(read(), table, cache, ("text",), "id").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    run()
    assert sorted(r.id for r in table.read().collect()) == [1, 2]
    spark.createDataFrame([(4, "b"), (5, "c")], "id int, text string").write.mode("append").parquet(src)
    run()
    assert sorted(r.id for r in table.read().collect()) == [1, 2, 5]


def test_index_follows_a_stream(spark, tmp_path):
    src, kind = f"file://{tmp_path}/in", "id string, embedding array<double>, updated_at int, is_deleted boolean"
    spark.createDataFrame([("a", [1.0], 1, False), ("b", [1.0], 1, False)], kind).write.parquet(src)
    index = VersionedTable(spark, f"file://{tmp_path}/i")
    run = lambda: follow(spark.readStream.schema(kind).parquet(src), index).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    run()
    spark.createDataFrame([("a", [9.0], 0, False), ("b", None, 2, True), ("c", [3.0], 2, False)], kind).write.mode("append").parquet(src)
    run()
    assert {r.id: r.embedding[0] for r in live(index).collect()} == {"a": 1.0, "c": 3.0}
    compact(index)
    spark.createDataFrame([("b", [7.0], 1, False), ("c", [4.0], 3, False)], kind).write.mode("append").parquet(src)  # b's change is older than its deletion
    run()
    assert {r.id: r.embedding[0] for r in live(index).collect()} == {"a": 1.0, "c": 4.0}
