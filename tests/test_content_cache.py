import hashlib
import random
import time

from lodestar.streaming.content_cache import cached

KIND = "op string, id string, ord long, content string"


def plain(events):
    """The cache as two dictionaries that see one event after another: which index events are kept, and what is left."""
    ids, hashes, kept = {}, {}, {}
    for op, doc, at, content in sorted(events, key=lambda e: e[2]):
        h = hashlib.sha256(f"content:{content or ''};".encode()).hexdigest()
        if op == "index":
            kept[at] = h not in hashes
            ids[doc] = h
            hashes.setdefault(h, doc)
        elif doc in ids:
            hashes.pop(ids[doc], None)
            ids[doc] = h
            if op == "update":
                hashes[h] = doc
            else:
                del ids[doc]
    return kept, ids, hashes


class Run:
    """A query over files that are added one batch at a time, started anew for each."""

    def __init__(self, spark, path, **options):
        self.spark, self.path, self.options, self.n = spark, path, options, 0

    def batch(self, events):
        self.spark.createDataFrame(events, KIND).repartition(2).write.mode("append").parquet(f"file://{self.path}/in")
        stream = self.spark.readStream.schema(KIND).parquet(f"file://{self.path}/in")
        out = cached(stream, ("content",), **self.options).writeStream.format("parquet").option("path", f"file://{self.path}/out")
        q = out.option("checkpointLocation", f"file://{self.path}/c").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return self

    def kept(self):
        rows = self.spark.read.parquet(f"file://{self.path}/out").where("step = 'claim'").collect()
        return {r.ord: r.kept for r in rows}


def test_index_update_delete_over_batches_and_restarts(spark, tmp_path):
    """Four documents of two contents; all change; all go; contents are new again afterwards."""
    run = Run(spark, tmp_path)
    first = [("index", str(k), k, c) for k, c in ((1, "content"), (2, "content"), (3, "content"), (4, "content2"))]
    assert run.batch(first).kept() == {1: True, 2: False, 3: False, 4: True}
    update = [("update", str(k), 10 + k, f"new{k}") for k in range(1, 6)]  # 5 is unknown
    probe = [("index", "9", 20, "new2"), ("index", "9", 21, "new5"), ("index", "8", 22, "content")]
    assert run.batch(update + probe).kept() == plain(first + update + probe)[0]
    gone = [("delete", str(k), 30 + k, None) for k in range(1, 7)]
    again = [("index", "1", 40, "new2"), ("index", "2", 41, "new3"), (None, "2", 42, "x"), ("index", None, 43, "y"), ("drop", "2", 44, "z")]
    assert run.batch(gone + again).kept() == plain(first + update + probe + gone + again[:2])[0]


def test_any_events_in_any_batches(spark, tmp_path):
    rng = random.Random(5)
    events = [(rng.choice(("index", "index", "update", "delete")), f"d{rng.randrange(12)}", at, rng.choice(["a", "b", "c", "", None, f"x{rng.randrange(9)}"])) for at in range(160)]
    run = Run(spark, tmp_path)
    for a in range(0, 160, 80):
        run.batch(rng.sample(events[a : a + 80], 80))
    assert run.kept() == plain(events)[0]


def test_contents_are_forgotten_after_a_while(spark, tmp_path):
    run = Run(spark, tmp_path, expires_ms=3000)
    run.batch([("index", "1", 1, "a")])
    time.sleep(3.5)
    assert run.batch([("index", "2", 2, "a"), ("index", "3", 3, "a")]).kept() == {1: True, 2: True, 3: False}
