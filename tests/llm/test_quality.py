import zlib

import numpy as np
import pyarrow as pa

from lodestar.llm.queries import op8_quality
from lodestar.llm import quality as op
from lodestar.llm.quality import DIMS, FEATURES, NONZERO, Network, features, held_out, index_vectors, score, tokens, train
from lodestar.llm.textbytes import chunks


def test_held_out_accuracy_on_the_driver_tables(spark, sample):
    import duckdb

    sf = sample.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in op8_quality(spark, sf).collect()}
    marks = duckdb.sql(f"SELECT doc_id, quality FROM read_parquet('{sf}/labels.parquet')").fetchall()
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in rows)
    held = [(rows[i], q) for i, q in marks if rows[i].held_out]
    assert np.mean([r.predicted == q for r, q in held]) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())


def test_labels_of_held_out_rows_have_no_effect(spark, documents):
    rows = [(k, ("calm prose of many words " if k % 2 else "SHOUT!! SHOUT!! BUY!! ") * (5 + k % 7)) for k in range(300)]
    docs = documents(rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, quality int")
    wrong = spark.createDataFrame([(k, (k + (zlib.crc32(str(k).encode()) % 3 == 1)) % 2) for k in range(300)], "doc_id long, quality int")
    scores = [{r.doc_id: r.score for r in score(docs, train(docs, x.where(~held_out()))).collect()} for x in (labels, wrong)]
    assert scores[0] == scores[1]
    assert np.mean([(s >= 0.5) == k % 2 for k, s in scores[0].items()]) > 0.97


def test_odd_rows_keep_their_columns(spark, documents):
    docs = documents([(1, None), (2, ""), (None, "word"), (4, "long " * 200_000), (4, "x")]).withColumnRenamed("row", "score")
    model = train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    got = score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r["_score"] <= 1 and r["score"] == "r" for r in got)
    assert score(docs.where("doc_id = 9"), model).count() == 0


def test_temperature_is_positive_and_scores_follow_labels():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 5))
    y = (x[:, 0] + 0.3 * rng.standard_normal(600) > 0).astype(float)
    net = Network().fit(x, y)
    assert net.temperature > 0 and net.score(x)[y == 1].mean() > 0.8 > 0.2 > net.score(x)[y == 0].mean()


def test_word_vectors_come_from_documents_without_labels_too(spark, documents):
    texts = ["calm prose of many words", "SHOUT!! BUY!!", "zebra crossing quagga zebra", "okapi zebra", None]
    table, _ = train(documents(list(enumerate(texts))), spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int"))
    table = table.value
    index, total = index_vectors().astype(float), np.zeros(table.shape)
    for text in texts:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        words = tokens(raw, np.array([0, len(raw)]))[0].tolist()
        for i, x in enumerate(words):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(words):
                    total[x] += index[words[j]]
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-6)
    total += index / np.sqrt(NONZERO)
    assert np.allclose(table, total / np.linalg.norm(total, axis=1, keepdims=True), atol=1e-5)


def _features(table, texts):
    return np.vstack([features(table, flat, offsets) for _, flat, offsets in chunks(pa.array(texts, pa.string()))])


def test_pooled_vectors_against_plain_loops(monkeypatch):
    rng = np.random.default_rng(4)
    table = rng.standard_normal((op.ROWS, DIMS))
    table = (table / np.linalg.norm(table, axis=1, keepdims=True)).astype(np.float32)
    texts = ["one two\tTHREE three\nthree four  five", "", None, "alone", "\x0b \x0c", "né née né né", "a b c d e f g h i"]
    raw = np.frombuffer("one two\tTHREE three\nthree four  five".encode(), np.uint8)
    words = tokens(raw, np.array([0, len(raw)]))[0].tolist()
    assert len(words) == 7 and words[3] == words[4] != words[2]
    want = np.zeros((len(texts), FEATURES))
    for k, text in enumerate(texts):
        vectors = []
        for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").split(" "):
            if w:
                b = np.frombuffer(w.encode(), np.uint8)
                vectors.append(table[tokens(b, np.array([0, len(b)]))[0][0]].astype(float))
        if vectors:
            mean = sum(vectors) / len(vectors)
            cosines = [float(p @ q) for p, q in zip(vectors, vectors[1:])]
            near = [np.mean(cosines), np.std(cosines), np.mean([c > 0.999 for c in cosines])] if cosines else [0, 0, 0]
            want[k] = [*mean, *mean / np.linalg.norm(mean), np.linalg.norm(mean), *near]
    assert np.allclose(_features(table, texts), want, atol=1e-5)
    monkeypatch.setattr(op, "PIECE", 2)
    assert np.allclose(_features(table, texts), want, atol=1e-5)


def test_temperature_has_the_least_loss_on_rows_kept_from_training():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 4))
    y = (x[:, 0] + rng.standard_normal(400) > 0).astype(float)
    net = Network().fit(x, y, seed=9)
    kept = np.random.default_rng(9).permutation(400)[:80]
    z = net.logits(x[kept])

    def loss(t):
        p = np.clip(1 / (1 + np.exp(-z / t)), 1e-6, 1 - 1e-6)
        return -sum(np.log(p) if q else np.log(1 - p) for p, q in zip(p, y[kept]))

    grid = np.geomspace(0.25, 8, 41)
    assert np.isclose(net.temperature, grid[np.argmin([loss(t) for t in grid])])


def test_labels_that_are_null_or_repeat(spark, documents):
    docs = documents([(k, ("calm prose " if k % 2 else "BUY!! NOW!! ") * 6) for k in range(60)])
    plain = [(k, k % 2) for k in range(60)]
    odd = plain + [(None, 1), (3, None), (5, 7), (4, 0), (2, 0), (2, 0), (999, 1)]
    a, b = (sorted(score(docs, train(docs, spark.createDataFrame(x, "doc_id long, quality int"))).select("doc_id", "score").collect()) for x in (plain, odd))
    assert a == b
