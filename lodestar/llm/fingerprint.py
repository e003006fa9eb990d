"""Context-triggered piecewise hashing (Kornblum 2006): signatures of chunks that the text itself delimits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.textbytes import powers, prefix_sums, span_hash

#: Bytes of the rolling window, the smallest block size, and the characters of the two signatures at most.
ROLL, SMALLEST, LONG, SHORT = 7, 3, 64, 32
#: Signatures without a common run of so many characters count as unrelated.
RUN = 3
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CHARS = np.frombuffer(ALPHABET.encode(), np.uint8)
#: Id ranges whose documents are laid side by side in one task.
MOST_BUCKETS = 4096


def _signature(sums: np.ndarray, n: int, cuts: np.ndarray, most: int) -> str:
    """One character for each chunk; the last takes what is left, the chunks beyond `most` too."""
    ends = cuts[: most - 1]
    if not len(ends) or ends[-1] < n:
        ends = np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1]])
    return _CHARS[(span_hash(sums, starts, ends) & np.uint64(63)).astype(np.int64)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    """block:signature:signature at twice the block. The block is the smallest of 3, 6, 12, ... with n / block <= 64 chunks
    expected, halved while the signature comes out shorter than 32; an empty text gives "3::"."""
    n = len(text)
    if not n:
        return f"{SMALLEST}::"
    data = np.frombuffer(text, np.uint8)
    sums = prefix_sums(data)
    _, down = powers(n + 1)
    roll = np.empty(n, np.uint64)
    k = min(ROLL, n)
    roll[k - 1 :] = (sums[k:] - sums[: n - k + 1]) * down[: n - k + 1]
    roll[: k - 1] = sums[1:k]
    roll = ((roll ^ (roll >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    block = SMALLEST
    while block * LONG < n:
        block *= 2
    while True:
        cuts = np.flatnonzero(roll % np.uint64(block) == np.uint64(block - 1))
        if len(cuts) + 1 >= SHORT or block == SMALLEST:
            break
        block //= 2
    coarse = cuts[roll[cuts] % np.uint64(2 * block) == np.uint64(2 * block - 1)]
    return f"{block}:{_signature(sums, n, cuts + 1, LONG)}:{_signature(sums, n, coarse + 1, SHORT)}"


def edit_likeness(a: str, b: str) -> float:
    """1 - d / (len(a) + len(b)), d counting insertions and deletions; 0 without a common run of RUN characters."""
    if a == b:
        return 1.0
    if not {a[i : i + RUN] for i in range(len(a) - RUN + 1)} & {b[i : i + RUN] for i in range(len(b) - RUN + 1)}:
        return 0.0
    full = (1 << len(a)) - 1
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    v = full
    for c in b:  # the bit-parallel longest common subsequence: zeros of v
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    common = len(a) - v.bit_count()
    return 2 * common / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """Of two fingerprints, 0 to 1: 1 if equal, 0 if the block sizes are more than a factor of 2 apart."""
    if x == y:
        return 1.0
    (b, s, t), (c, u, v) = x.split(":"), y.split(":")
    b, c = int(b), int(c)
    if b == c:
        return max(edit_likeness(s, u), edit_likeness(t, v) if min(len(t), len(v)) >= RUN else 0.0)
    if b == 2 * c:
        return edit_likeness(s, v)
    if c == 2 * b:
        return edit_likeness(t, u)
    return 0.0


def _rank(col: pa.Array) -> np.ndarray:
    return col.fill_null(-(2**63)).to_numpy(zero_copy_only=False)


def _in_buckets(bounds: np.ndarray, heads: dict[int, int]):
    """Adds to every row its bucket, and copies each bucket's first rows to the end of the bucket before it."""
    order = sorted(heads)
    before = {b: order[(k + 1) % len(order)] for k, b in enumerate(order)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _rank(batch.column("doc_id"))
            bucket = np.searchsorted(bounds, ids, "right")
            head = np.flatnonzero([heads[b] == i for b, i in zip(bucket.tolist(), ids.tolist(), strict=True)])
            for rows, where, tail in ((np.arange(len(ids)), bucket, False), (head, np.array([before[b] for b in bucket[head].tolist()], np.int64), True)):
                if len(rows):
                    part = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(np.full(len(rows), tail)), pa.array(ids[rows]), part.column("doc_id"), part.column("text")], ["bucket", "tail", "place", "doc_id", "text"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket, tail, descending id and text: each row with the one after it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None  # (bucket, tail, doc_id, text, its fingerprint)
    rows: list[tuple] = []
    for batch in batches:
        for bucket, tail, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")), strict=True):
            if held is not None and (held[0] != bucket or held[1]):
                held = None if held[0] != bucket else held
            if held is not None and held[1]:
                continue  # of several tails the first counts
            own = fingerprint(text.encode())
            if held is not None:
                _, _, i, t, f = held
                n = len(t)
                edited = (t[: n - n // 2] + text[: n // 2]).encode()
                e = fingerprint(edited)
                rows.append((i, n, hashlib.sha256(edited).hexdigest(), f, e, likeness(f, e), likeness(f, own)))
            held = (bucket, tail, doc_id, text, own)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows = []


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row for each input row.

    The edited text has the last floor(n / 2) code points replaced by the first as many, or all, of the next document
    in descending doc_id; the first follows the last. Rows that share an id come in order of their texts, rows
    without one last. A null text is empty; a single document is its own next; an empty table gives none.

    Documents are dealt once, by id range, with the first of each range copied to the range before it, and a task
    holds two of them at a time. Range bounds are quantiles; they and the first ids are MOST_BUCKETS rows at most.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = min(MOST_BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n).alias("q")).first()["q"] if n > 1 else None
    bounds = np.unique(np.array(cuts or [], np.int64))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _rank(batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, ids, "right").astype(np.int32)), pa.array(ids)], ["bucket", "place"])

    heads = {r["bucket"]: r["head"] for r in rows.select("doc_id").mapInArrow(firsts, "bucket int, place long").groupBy("bucket").agg(F.max("place").alias("head")).collect()}
    dealt = rows.mapInArrow(_in_buckets(bounds, heads), "bucket int, tail boolean, place long, doc_id long, text string").repartition("bucket")
    dealt = dealt.sortWithinPartitions("bucket", "tail", F.desc("place"), "text")
    return dealt.mapInArrow(_neighbours, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
