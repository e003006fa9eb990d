import hashlib
import random

from pyspark.sql import functions as F

from lodestar.llm.line_dedup import line_dedup

LOWER = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows):
    held = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 20:
                    held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (i is not None and len(held.get(key(x), ())) >= 3 and max(held[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(docs):
    rows = line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_against_brute_force(documents):
    rng = random.Random(4)
    pool = [f"{c} shared line number {k:03d}" for k, c in enumerate("aéÉbZ" * 8)]
    rows = [(k, "\n".join(rng.choice(["", "short", "\t" + rng.choice(pool).upper() + "\r", rng.choice(pool), rng.choice(pool) + " " * 5, f"own line of document {k}"]) for _ in range(rng.randint(0, 150)))) for k in range(90)]
    assert got(documents(rows)) == brute(rows)


def test_odd_rows(documents):
    line = "x" * 20
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, line), (5, line), (5, line + "\nb"), (6, f"{line}\n{line}"), (None, line), (7, "é" * 20), (8, "é" * 20), (9, "é" * 20 + "\x0b"), (10, "y" * 19), (11, "y" * 19), (12, "y" * 19), (13, "\n".join([line] * 3000))]
    assert got(documents(rows)) == brute(rows)


def test_two_documents_are_not_enough_and_empty_table(documents):
    line = "z" * 30
    docs = documents([(1, line), (2, line)])
    assert line_dedup(docs).agg(F.sum("n_dropped")).first()[0] == 0
    assert line_dedup(docs.where("doc_id = 3")).count() == 0
