import hashlib
import random

import pytest

from lodestar.llm import fingerprint as op


def brute(rows):
    """Contract columns for rows with distinct ids."""
    order = sorted(((i if i is not None else -(2**63), t or "", i) for i, t in rows), key=lambda r: (-r[0], r[1]))
    out = []
    for k, (_, t, i) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(t)
        edited = t[: n - n // 2] + nxt[: n // 2]
        f, e, g = (op.fingerprint(x.encode()) for x in (t, edited, nxt))
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), f, e, op.likeness(f, e), op.likeness(f, g)))
    return sorted(out, key=repr)


def got(docs):
    return sorted((tuple(r) for r in op.fingerprints(docs).collect()), key=repr)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_every_row_meets_the_next(documents):
    rng = random.Random(2)
    rows = [(7 * k, prose(rng, rng.choice((0, 3, 50, 900)))) for k in range(150)]
    assert got(documents(rows)) == brute(rows)


def test_odd_rows(documents):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "a" * 100_000), (5, "same"), (5, "same"), (5, "other"), (9, "é🙂x")]
    assert got(documents(rows)) == brute(rows)
    assert got(documents([(1, "only one here")])) == brute([(1, "only one here")])
    assert got(documents([(1, "a")]).where("doc_id = 2")) == []


def plain_fingerprint(text):
    """The same rule, a byte at a time."""
    powers, inverse = op.powers(len(text) + 1)
    data = [int(x) for x in op.prefix_sums(op.np.frombuffer(text, op.np.uint8))] if text else [0]
    def span(a, b):
        return int(op.span_hash(op.np.array(data, op.np.uint64), op.np.array([a]), op.np.array([b]))[0])
    def roll(k):  # noqa: E306
        x = (data[k + 1] - data[max(0, k - 6)]) * int(inverse[max(0, k - 6)]) % 2**64
        return ((x ^ (x >> 29)) * 0x9E3779B97F4A7C15 % 2**64) >> 33
    block = 3
    while block * 64 < len(text):
        block *= 2
    def sign(b, most):  # noqa: E306
        out, start = "", 0
        for k in range(len(text)):
            if roll(k) % b == b - 1 and len(out) < most - 1:
                out += op.ALPHABET[span(start, k + 1) % 64]
                start = k + 1
        return out + (op.ALPHABET[span(start, len(text)) % 64] if start < len(text) else "")
    while block > 3 and sum(roll(k) % block == block - 1 for k in range(len(text))) + 1 < 32:
        block //= 2
    return f"{block}:{sign(block, 64)}:{sign(2 * block, 32)}"


@pytest.mark.parametrize("n", [0, 1, 6, 7, 8, 150, 800, 3000])
def test_fingerprint_by_the_byte(n):
    text = prose(random.Random(n), n).encode()[:n]
    assert op.fingerprint(text) == plain_fingerprint(text)


def test_edit_likeness_against_dynamic_programming():
    rng = random.Random(5)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(3, 40))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
        runs = {a[k : k + 3] for k in range(len(a) - 2)} & {b[k : k + 3] for k in range(len(b) - 2)}
        want = 1 - row[-1] / (len(a) + len(b)) if runs else 0.0
        assert abs(op.edit_likeness(a, b) - want) < 1e-12


def test_halves_are_nearer_than_strangers():
    rng = random.Random(9)
    near = far = 0
    for _ in range(80):
        a, b = prose(rng, 400), prose(rng, 400)
        f, e, g = (op.fingerprint(x.encode()) for x in (a, a[: len(a) - len(a) // 2] + b[: len(a) // 2], b))
        near += op.likeness(f, e) > 0.25
        far += op.likeness(f, g) > 0.25
    assert near >= 72 and far <= 4
