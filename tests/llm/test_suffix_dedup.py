import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import suffix_dedup as op
from lodestar.llm.suffix_dedup import interleave, suffix_dedup


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def got(docs, **kw):
    return sorted((tuple(r)[:5] for r in suffix_dedup(docs, **kw).collect()), key=repr)


def corpus(seed, n, size):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abé \n") for _ in range(rng.randint(20, 400))) for _ in range(12)]
    rows = []
    for k in range(n):
        parts = [rng.choice(pool)[rng.randrange(20) :] if rng.random() < 0.4 else "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, size))) for _ in range(rng.randint(0, 6))]
        rows.append((k, "".join(parts)))
    return rows


def test_contract_lengths(documents):
    rows = corpus(1, 80, 300)
    rng = random.Random(2)
    passage = "".join(rng.choice("xyz é") for _ in range(390))
    for k, extra in enumerate(("", "q" * 3, "q" * 30, "r" * 40)):
        rows.append((200 + k, passage + extra + "tail %d" % k))
    assert got(documents(rows)) == brute(rows, 400)


def test_short_strings_against_brute_force(documents):
    for seed, length, reach in ((3, 40, 12), (4, 32, 25), (5, 64, 1)):
        rows = corpus(seed, 60, 120)
        assert got(documents(rows), length=length, reach=reach) == brute(rows, length)


def test_anchors_must_lie_in_the_string(documents):
    with pytest.raises(ValueError):
        suffix_dedup(documents([(1, "a")]), length=25, reach=24)


def test_odd_rows(documents):
    rows = [(1, None), (2, ""), (3, "a" * 2000), (4, "ab" * 450), (5, "z" * 399), (6, "z" * 399), (7, "y" * 400), (7, "y" * 400), (None, "w" * 401 + "!"), (None, "v" + "w" * 401), (8, "one " * 300)]
    assert got(documents(rows)) == brute(rows, 400)


def test_empty_table(documents):
    assert suffix_dedup(documents([(1, "a")]).where("doc_id = 2")).count() == 0


def suffixes(strings):
    """(suffix, shard order) of plain strings of symbols in order, and the symbol before each."""
    rows = sorted((tuple(x[k:]), n, k) for n, x in enumerate(strings) for k in range(len(x) + 1))
    return rows, [strings[n][k - 1] if k else None for _, n, k in rows]


@pytest.mark.parametrize("seed", range(4))
def test_interleave_merges_transforms_without_the_strings(seed):
    """Only the shards' symbols go in; order, common prefixes and steps come out as sorting all suffixes gives them."""
    rng = random.Random(seed)
    width = rng.choice((1, 2, 5))
    shards = [[[rng.randrange(3) for _ in range(width)] for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 5))]
    rows, symbols, of = [], [], []
    for s, strings in enumerate(shards):
        own, before = suffixes(strings)
        rows += [x[0] for x in own]
        symbols += [0 if x is None else x + 1 for x in before]
        of += [s] * len(own)
    order, common, after = interleave(np.array(of), np.array(symbols))
    merged = [rows[k] for k in order]
    assert merged == sorted(rows) and sorted(order.tolist()) == list(range(len(rows)))
    assert all(a < b for s in range(len(shards)) for a, b in zip([k for k in order if of[k] == s], [k for k in order if of[k] == s][1:], strict=False))
    for k in range(1, len(merged)):
        a, b = merged[k - 1], merged[k]
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common[k] == same or (a == b and common[k] == len(rows))
    assert all((after[k] == -1 and not x) or merged[after[k]] == x[1:] for k, x in enumerate(merged))


def test_a_shard_sorts_its_own_suffixes():
    rng = random.Random(3)
    strings = [[rng.choice((b"a", b"b", b"c\0d")) for _ in range(4)] for _ in range(30)]
    got = op.transform(np.array(strings, f"S{op.BLOCK}"))
    assert [(tuple(strings[k // 5][k % 5 :]), k // 5) for k in got] == [(x, n) for x, n, _ in suffixes(strings)[0]]


def test_hot_cores_shards_and_ranges(documents, monkeypatch):
    """A passage and copies shared by more documents than a range may hold, over several shards."""
    monkeypatch.setattr(op, "SHARD", 7)
    rows = corpus(7, 60, 120)
    for hot in (3, 12, 1 << 16):
        monkeypatch.setattr(op, "HOT", hot)
        assert got(documents(rows), length=40, reach=12) == brute(rows, 40)


def test_very_long_text(documents):
    """Longer than a chunk; a passage repeats at its far end and in another document."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    long_ = " ".join(rng.choice(words) for _ in range(260_000))
    rows = [(1, long_), (2, "x" + long_[-900:-100] + "y"), (3, "clean")]
    n = len(long_)
    assert n > op.PIECE
    want = [(1, n, 800, 1, hashlib.sha256((long_[:-900] + long_[-100:]).encode()).hexdigest()), (2, 802, 800, 1, hashlib.sha256(b"xy").hexdigest()), (3, 5, 0, 0, hashlib.sha256(b"clean").hexdigest())]
    assert got(documents(rows)) == want


def test_every_document_of_a_driver_table(spark, sample):
    """All windows of all documents, by digest: an independent count of what goes."""
    docs = spark.read.parquet(f"{sample.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    seen = Counter(hash(t[k : k + 400]) for _, t in rows for k in range(len(t) - 399))
    want = {}
    for i, t in rows:
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - 399):
            if seen[hash(t[k : k + 400])] > 1:
                gone[k] += 1
                gone[k + 400] -= 1
        want[i] = int((np.cumsum(gone)[:-1] > 0).sum())
    assert {r.doc_id: r.n_removed for r in op.suffix_dedup(docs).collect()} == want


def test_keys_of_intervals_and_bytes_before_do_not_meet(documents):
    """Many short intervals of one core beside many bytes before it, none of which repeat together."""
    core = "".join(random.Random(5).choice("klmnop") for _ in range(29))
    rows = [(k, "%s%s%s" % (chr(97 + k % 26) * 5 + chr(65 + k // 26), core, "%c%c" % (33 + k % 60, 48 + k // 60) * 6)) for k in range(600)]
    assert got(documents(rows), length=40, reach=12) == brute(rows, 40)


def test_hashes_that_repeat_over_batches():
    """However rows sorted by h are cut into batches: known ones pass, single ones pass if their h has another, hot ones are named once."""
    import pyarrow as pa

    rng = random.Random(8)
    rows = sorted((rng.randrange(12), rng.choice((0, 1, 1, 1, 3)), k) for k in range(60))
    rows = [(h, n, None if n == 3 else k) for h, n, k in rows if h != 5] + [(20, 1, 99), (30, 1, 100)]
    total = Counter()
    for h, n, _ in rows:
        total[h] += n
    want = Counter((h, k) for h, n, k in rows if n == 0 or (n == 1 and total[h] > 1)) + Counter((h, None) for h, t in total.items() if t > 6)
    for cut in (1, 2, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64())], ["h", "n", "doc_id", "text_hash"]) for part in (rows[a : a + cut] for a in range(0, len(rows), cut))]
        assert Counter((h, k) for b in op._several(6)(iter(batches)) for h, k in zip(b.column("h").to_pylist(), b.column("doc_id").to_pylist(), strict=True)) == want


def test_shared_cores_tell_of_passages_that_stay(documents):
    """Passages of 380 bytes, shorter than the strings that go, hold an anchor with its 273 bytes nearly always."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, shared = [], set()
    for k in range(60):
        passage = text(80)[:380]
        for d in (0, 1):
            rows.append((10 * k + d, f"{text(40)} {passage} {text(40)}"))
            shared.add(10 * k + d)
        rows.append((10 * k + 2, text(160)))
    found = {r.doc_id: (r.n_removed, r.n_shared_cores) for r in suffix_dedup(documents(rows)).collect()}
    assert all(n == 0 for n, _ in found.values())
    assert sum(found[i][1] > 0 for i in shared) >= 0.9 * len(shared) and all(found[i][1] == 0 for i in found.keys() - shared)


def test_shared_words_tell_of_passages_of_over_fifty_words(documents):
    """By plain Python: words in runs of 51 that another document holds too, whatever their bytes, and none that a document repeats by itself."""
    rng = random.Random(6)
    words = [f"{rng.choice('abcde')}{k}" for k in range(900)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [text(n) for n in (50, 51, 60, 130)]
    rows = [(k, " ".join(text(k % 70) + passages[k % 4] + text(k % 9))) for k in range(40)]
    rows += [(50, " ".join(["x"] * 51)), (51, "\t".join(["x"] * 51)), (52, " ".join(passages[1][:40] + passages[3][40:]))]
    rows += [(53, " ".join(2 * (own := text(70)))), (54, None), (55, ""), (None, " ".join(passages[2])), (56, " ".join(w.upper() for w in passages[3]))]
    rows += [(57, " ".join(own := text(80))), (57, " ".join(own))]  # a repeated row is one document
    runs = {}
    for i, t in set(rows):
        w = (t or "").split()
        for k in range(len(w) - 50):
            runs.setdefault(tuple(w[k : k + 51]), set()).add((i, t))
    want = []
    for i, t in rows:
        w = (t or "").split()
        held = {x for k in range(len(w) - 50) if len(runs[tuple(w[k : k + 51])]) > 1 for x in range(k, k + 51)}
        want.append((i, len(held)))
    got = [(r.doc_id, r.n_shared_words) for r in suffix_dedup(documents(rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(n > 0 for _, n in want) > 30
