import math
import re

from pyspark.sql import functions as F

from lodestar.llm.mixing import mix

WEIGHTS = (3, 1, 2)


def targets(sizes):
    """The contract's words: share by weight, stop at twice the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return full
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] >= 2 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_taken(documents):
    rows = [(k, "w " * (1 + k % 17), f"s{k % 5}") for k in range(400)] + [(1000 + k, "x " * 900, "big") for k in range(3)] + [(2000, None, None), (2001, "a b\x0bc", None), (2002, "", "blank"), (5, "w", "s0"), (5, "w", "s0"), (None, "q q", "s1")]
    got = mix(documents(rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert t == math.floor(want[s] + 1e-9) or t == math.floor(want[s] - 1e-9)
    again = mix(documents(rows[::-1])).collect()
    key = lambda r: repr((r.doc_id, r.source, r.size, r.taken))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_better_documents_come_first(documents):
    rows = [(k, f"{k} b c d", "a" if k % 4 else "b") for k in range(3000)]
    docs = documents(rows)
    got = mix(docs, docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0).alias("weight"))).where("taken % size = 0").collect()
    # in source a, a third of the documents are even; the share of each kind that is used once more than the rest
    part = [r for r in got if r.source == "a"]
    low = min(r.taken // r.size for r in part)
    share = [sum(r.taken // r.size > low for r in part if r.doc_id % 2 == k) / sum(r.doc_id % 2 == k for r in part) for k in (0, 1)]
    assert share[0] > 1.5 * share[1]


def test_empty_and_wordless(documents):
    assert mix(documents([(1, "a")]).where("doc_id = 2")).count() == 0
    assert [(r.size, r.target, r.taken) for r in mix(documents([(1, None), (2, " ")])).collect()] == [(0, 0.0, 0)] * 2
