import random
import re

from lodestar.llm import ngram_join as op

LOWER = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if None not in (i, j) and s and t and 100 * len(s & t) >= 75 * len(s | t):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=repr)


def got(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op.ngram_join(docs).collect()), key=repr)


def corpus(seed, n, vocabulary=3000):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    passage = [rng.choice(words) for _ in range(60)]
    rows, last = [], []
    for k in range(n):
        kind = rng.random()
        if kind < 0.5 and last:
            w = list(rng.choice(last))
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.choice((2, 6, 40, 150)))]
            if kind > 0.8:
                w = passage + w
        last.append(w)
        rows.append((k, " ".join(w)))
    return rows


def test_against_brute_force(documents):
    rows = corpus(5, 260)
    assert got(documents(rows)) == brute(rows)


def test_hot_group_of_near_copies_over_many_tiles(documents, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 16)
    rng = random.Random(8)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(80)] = f"x{rng.randrange(500)}"
        rows.append((k, " ".join(w + ["tail"] * (k % 3))))
    assert got(documents(rows)) == brute(rows)


def test_nulls_blanks_repeats_and_case(documents):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (None, "one two"), (7, "a b c d e f g h"), (7, "a b c d e f g h"), (8, "A b c d e f g h"), (9, "É b c d e"), (10, "é b c d e"), (11, "x " * 30_000), (12, "x " * 20_000)]
    assert got(documents(rows)) == brute(rows)


def test_an_id_with_two_texts_joins_both(documents):
    rows = [(1, "a b c d e f"), (2, "p q r s t u"), (3, "a b c d e f"), (3, "p q r s t u")]
    assert {(r[0], r[2]) for r in got(documents(rows))} == {(1, 1), (2, 1), (3, 1)}


def test_empty_table(documents, spark):
    assert op.ngram_join(documents([(1, "a")]).where("doc_id = 2")).count() == 0


def test_prefix_and_signature_bounds():
    for n in range(1, 400):
        assert op.prefix_length(n) == n - (3 * n + 3) // 4 + 1


def test_sizes_in_digests_allow_every_link():
    import numpy as np

    size = lambda n: op.digest(np.arange(n, dtype=np.uint64))[0]
    for n in [*range(1, 300), 3_000, 300_000]:
        for m in {n, -(-3 * n // 4)}:
            assert op._sized(np.array([size(n)]), np.array([size(m)])).all()
    assert not op._sized(np.array([size(1000)]), np.array([size(500)])).any()


def test_links_are_written_before_their_components(documents, monkeypatch):
    """A task that found links and joined them at once would hold two Python workers."""
    plans, search = [], op.components
    monkeypatch.setattr(op, "components", lambda edges: plans.append(edges._jdf.queryExecution().executedPlan().toString()) or search(edges))
    rows = corpus(3, 60)
    assert got(documents(rows)) == brute(rows)
    assert len(plans) == 2 and not any("MapInArrow" in p for p in plans)


def test_frequent_hashes_are_found_without_copies():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(4)
    h = np.concatenate([rng.integers(0, 2**63, 1 << 20, dtype=np.uint64), np.repeat(np.arange(900, dtype=np.uint64), np.arange(900) % 6)])
    rng.shuffle(h)
    found, n = np.unique(h, return_counts=True)
    found, n = found[n >= op.OFTEN], n[n >= op.OFTEN]
    tracemalloc.start()
    got = op._frequent_rows(h)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[0] == found).all() and (got[1] == n).all() and peak < h.nbytes / 2
    for k in range(4):
        assert len(op._frequent_rows(np.zeros(k, np.uint64))[0]) == (k >= op.OFTEN)
