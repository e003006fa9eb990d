from collections import Counter

import pyarrow as pa
import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline as pipe  # noqa: E402
from lodestar.llm.packing import WordTokenizer  # noqa: E402
from lodestar.llm.queries import vocabulary  # noqa: E402
from tests.llm.test_line_dedup import brute as lines_brute  # noqa: E402
from tests.llm.test_mixing import words  # noqa: E402
from tests.llm.test_ngram_join import brute as groups_brute  # noqa: E402


def test_each_stage_on_what_the_one_before_kept(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    columns, at = docs.columns, {"documents": docs.collect()}
    for name, stage in pipe.STAGES[:-1]:
        out = stage(spark, docs, sample)
        assert out.columns == columns
        at[name] = out.collect()
        docs = spark.createDataFrame(at[name], docs.schema)
    assert [n for n, _ in pipe.STAGES] == ["quality", "line_dedup", "near_duplicates", "mix", "packing"]

    kept = {r.doc_id for r in at["quality"]}
    marks = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sample}/labels.parquet").collect()]
    assert sum((i in kept) == (q == 1) for i, q in marks) >= 0.9 * len(marks)
    assert all(r in at["documents"] for r in at["quality"])

    want = {(i, sha) for i, _, _, sha in lines_brute([(r.doc_id, r.text) for r in at["quality"]])}
    import hashlib

    assert {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in at["line_dedup"]} == want
    assert all(r.n_chars == len(r.text) for r in at["line_dedup"])

    keep = {i for i, _, c in groups_brute([(r.doc_id, r.text) for r in at["line_dedup"]]) if i == c}
    assert Counter(r.doc_id for r in at["near_duplicates"]) == Counter(keep)

    texts = {r.doc_id: r.text for r in at["near_duplicates"]}
    uses = Counter(r.doc_id for r in at["mix"])
    assert max(uses.values()) <= 3 and all(texts[r.doc_id].startswith(r.text) for r in at["mix"])
    total = sum(map(words, texts.values()))
    assert abs(sum(words(r.text) for r in at["mix"]) - 1.5 * total) <= len({r.source for r in at["mix"]}) + 1

    packed = pipe.STAGES[-1][1](spark, docs, sample).collect()
    ids = Counter()
    for r in packed:
        ids[r.doc_id] += r.length
    tokenizer, want = WordTokenizer(vocabulary()), Counter()
    for r in at["mix"]:
        want[r.doc_id] += len(tokenizer.ids(r.text)) // 4 + 1
    assert ids == want


def test_stages_take_nulls_repeats_and_empty_tables(spark, sample, documents):
    rows = [(1, None), (2, ""), (None, "a b c d e f"), (3, "same words here for all"), (3, "same words here for all"), (3, "other words"), (4, "Same words here for all", None)]
    docs = documents(rows)
    for _, stage in pipe.STAGES:
        assert stage(spark, docs, sample).count() >= 1
        assert stage(spark, docs.where("doc_id = 99"), sample).count() == 0
    left = pipe.near_duplicates(spark, docs, sample).collect()
    assert Counter(r.doc_id for r in left) == {1: 1, 2: 1, None: 1, 3: 1}


@pytest.mark.parametrize("stage", ["quality", "near_duplicates", "packing"])
def test_workers_get_texts_in_small_batches(spark, sample, documents, stage):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    getattr(pipe, stage)(spark, documents([(1, "a b"), (2, None)]), sample)
    rows = spark.range(300).coalesce(1).selectExpr("id", "repeat('a', 100000) as text")  # 30 MB, and one row above the limit
    rows = rows.union(spark.range(1).selectExpr("id", "repeat('a', 4000000) as text"))
    got = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]}) for b in batches), "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 301
    assert max(r.bytes for r in got if r.rows > 1) < 4_000_000 < max(r.bytes for r in got) < 5_000_000
    spark.conf.set(limit, "1000")
    getattr(pipe, stage)(spark, documents([(1, "a b")]), sample)
    assert spark.conf.get(limit) == "1000"
    spark.conf.unset(limit)


def test_places_of_pieces_need_no_python_workers(spark, sample, documents, monkeypatch):
    def parallelize(*_):
        raise AssertionError("rows by way of an RDD")

    docs = documents([(k, "some words " * k) for k in range(50)])
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", parallelize)
    assert len({r.doc_id for r in pipe.packing(spark, docs, sample).collect()}) == 50
