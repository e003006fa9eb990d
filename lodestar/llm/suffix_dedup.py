"""Repeated byte strings of `length` bytes or more, from Burrows-Wheeler transforms that shards make and tasks merge.

A transform of every suffix of a corpus isn't needed: a string of `length` bytes that occurs twice holds, in both
places, the same anchor, the position of the least hashed 8-gram in its first REACH positions. So

1. every document names its anchors and hashes the length - REACH + 1 bytes from each on, the core; anchors whose hash
   occurs once lie in no repeated string and go no further than these numbers, and a chunk of documents sends a hash once;
2. for the others, a shard (what a task reads at a time) writes a window as a string of symbols: the core's digest, then
   the bytes after the core in blocks. It sorts the suffixes of its own strings and sends their Burrows-Wheeler
   transform, by ranges of the hash, with the bytes before each anchor;
3. the transforms of one range are merged by iterative interleave refinement: the interleave starts as the shards side by
   side, and a round deals it out anew by the transforms' symbols, stably, so that it is right for one more symbol.
   The round in which two neighbours part is their common prefix. No suffix is compared, no string sorted;
4. an anchor with j bytes before it repeats if its interval of common prefix length - j holds a suffix with the same j
   bytes before it. The repeated j of an anchor cover one run of bytes; runs are merged by document;
5. a core that more than HOT anchors hash to is no task's: its windows send a digest of each of their strings of
   `length` bytes, and those that an aggregate counts twice are repeated.

Passages are told of likewise, by words: a run of WORDS words that two documents share has the same anchor in both, the
least hashed of its runs of WORD_GRAM words. Anchors whose words several documents hold go on, and only for those
the digests of all runs of WORDS words around them are counted by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.streams import groups
from lodestar.llm.tables import Saved, maybe_among, text_or_empty
from lodestar.llm.textbytes import chunks, mix, prefix_sums, span_hash, word_hashes

LENGTH = 400
#: Positions at a string's start of which one is its anchor.
REACH = 128
GRAM = 8
#: Bytes of documents handled at once, and windows of a shard.
PIECE = 1 << 20
SHARD = 1 << 16
#: Bytes of a symbol.
BLOCK = 32
#: Anchors of one core that a range may hold, and ranges for each shuffle partition.
HOT, RANGES = 1 << 16, 4
#: Windows that a task remembers having sent.
REMEMBERED = 1 << 18
#: Words of a passage, and of its anchor.
WORDS, WORD_GRAM = 51, 12


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of `width`: blocks' running minima from both ends."""
    n = len(v) - width + 1
    full = -(-len(v) // width) * width
    w = np.full(full, np.iinfo(v.dtype).max, v.dtype)
    w[: len(v)] = v
    w = w.reshape(-1, width)
    ahead = np.minimum.accumulate(w, axis=1).ravel()
    behind = np.minimum.accumulate(w[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(flat: np.ndarray, offsets: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, anchor, first start, last start) for each run of string starts with one anchor; all by offset in flat."""
    n = len(flat)
    if n < length:
        return (np.empty(0, np.int64),) * 4
    grams = np.zeros(n, np.uint64)
    for k in range(GRAM):  # the 8 bytes from each position on; past the end, zeros
        grams[: n - k] |= flat[k:].astype(np.uint64) << np.uint64(8 * k)
    order = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    least = _sliding_least((order << np.uint64(32)) | np.arange(n, dtype=np.uint64), reach)
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ok = np.zeros(n + 1, np.int64)
    sizes = np.diff(offsets)
    long_ = np.flatnonzero(sizes >= length)
    ok[offsets[long_]] += 1
    ok[offsets[long_] + sizes[long_] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(ok)[:n] > 0)
    at = at[starts]
    doc = np.searchsorted(offsets, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return doc[first], at[first], starts[first], starts[last]


def _named(length: int, reach: int):
    """(route, h, n, doc_id, text_hash): by chunk of documents each hash once, with n anchors that have it, and where n is 1 its document.

    A hash that a chunk has oftener is known to repeat, so its documents, with n 0, go where they like.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, flat, offsets in chunks(batch.column("text"), PIECE):
                doc, at, _, _ = anchors(flat, offsets, length, reach)
                if not len(doc):
                    continue
                h = span_hash(prefix_sums(flat), at, at + length - reach + 1).view(np.int64)
                order = np.argsort(h, kind="stable")
                h, doc = h[order], doc[order]
                begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                n = np.diff(np.append(begins, len(h)))
                known = np.repeat(n > 1, n)
                known[1:] &= (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])  # once for each document
                take = np.concatenate([doc[begins], doc[known]]) + first
                single = np.concatenate([n == 1, np.ones(int(known.sum()), bool)])
                ids, texts = (batch.column(c).take(pa.array(take)) for c in ("doc_id", "text_hash"))
                own = mix(ids.to_numpy().view(np.uint64) ^ texts.to_numpy().view(np.uint64)).view(np.int64)
                rows = np.concatenate([h[begins], h[known]])
                route = np.where(np.arange(len(rows)) < len(begins), rows, own)
                none = pa.array(~single)
                yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(rows), pa.array(np.concatenate([n, np.zeros(len(rows) - len(n), np.int64)])), pc.if_else(none, None, ids), pc.if_else(none, None, texts)], ["route", "h", "n", "doc_id", "text_hash"])

    return run


def _several(hot_size: int):
    """(h, doc_id, text_hash) of rows of _named, sorted by h, whose h is known to repeat or repeats here; and h alone of one that more than hot_size anchors have."""
    names = ["h", "doc_id", "text_hash"]

    def hot(values: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(values):
            yield pa.RecordBatch.from_arrays([pa.array(values), *[pa.nulls(len(values), pa.int64())] * 2], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the one anchor so far of the last h
        last, before = None, 0  # the last h, and its anchors in rows gone by
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            h, n = rows.column("h").to_numpy(), rows.column("n").to_numpy()
            begins = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1])
            total = np.add.reduceat(n, begins)
            if last is not None and h[0] == last:
                total[0] += before
            elif before > hot_size:
                yield from hot(np.array([last]))
            yield from hot(h[begins[:-1]][total[:-1] > hot_size])
            size = np.diff(np.append(begins, len(h)))
            keep = (n == 0) | ((n == 1) & np.repeat(total > 1, size))
            open_ = np.zeros(len(h), bool)
            open_[begins[-1] :] = (n[begins[-1] :] == 1) & (total[-1] == 1)
            held = rows.filter(pa.array(open_)) if open_.any() else None
            last, before = h[-1], int(total[-1]) - int(open_.any())
            if keep.any():
                yield from rows.select(names).filter(pa.array(keep)).combine_chunks().to_batches()
        if before > hot_size:
            yield from hot(np.array([last]))

    return run


class Windows:
    """What surrounds the named anchors of a chunk of documents; lists and arrays have one entry for each anchor."""

    def __init__(self, batch: pa.RecordBatch, length: int, reach: int, hot: bool, chunk: tuple[int, np.ndarray, np.ndarray]):
        first, flat, offsets = chunk
        doc, at, begin, last = anchors(flat, offsets, length, reach)
        core = length - reach + 1
        h = span_hash(prefix_sums(flat), at, at + core).view(np.int64) if len(at) else np.empty(0, np.int64)
        keep = np.zeros(len(h), bool)
        cuts, wanted = np.searchsorted(doc, np.arange(len(offsets))), batch.column("hot" if hot else "cold")
        for k in range(len(offsets) - 1):
            if cuts[k] < cuts[k + 1]:
                keep[cuts[k] : cuts[k + 1]] = np.isin(h[cuts[k] : cuts[k + 1]], wanted[first + k].values.to_numpy())
        doc, at, begin, last, self.h = (x[keep] for x in (doc, at, begin, last, h))
        self.raw, self.at, self.row, self.anchor = flat.tobytes(), at, first + doc, at - offsets[doc]
        #: Least and most bytes before the anchor with which a string may start, and bytes after the core.
        self.low, self.high = at - last, at - begin
        stop = np.minimum(at + length, offsets[doc + 1])
        self.right = [self.raw[a:b] for a, b in zip((at + core).tolist(), stop.tolist(), strict=True)]
        self.before = [self.raw[a:b] for a, b in zip(begin.tolist(), at.tolist(), strict=True)]
        self.core = [hashlib.blake2b(self.raw[a : a + core], digest_size=16).digest() for a in at.tolist()]
        self.key = [hashlib.blake2b(b"%d,%d,%d," % (lo, hi, len(r)) + b + c + r, digest_size=16).digest() for lo, hi, b, c, r in zip(self.low.tolist(), self.high.tolist(), self.before, self.core, self.right, strict=True)]


def _windows(batches: Iterator[pa.RecordBatch], length: int, reach: int, hot: bool) -> Iterator[tuple[pa.RecordBatch, Windows]]:
    for batch in batches:
        for chunk in chunks(batch.column("text"), PIECE):
            found = Windows(batch, length, reach, hot, chunk)
            if len(found.h):
                yield batch, found


def _new(sent: dict[bytes, int], keys: list[bytes]) -> list[int]:
    """Of the windows with these keys those to be sent: the first two of a key tell all that more would."""
    if len(sent) > REMEMBERED:
        sent.clear()
    out = []
    for k, key in enumerate(keys):
        n = sent.get(key, 0)
        if n < 2:
            sent[key] = n + 1
            out.append(k)
    return out


def _places(length: int, reach: int, hot: bool):
    """(k1, k2, doc_id, text_hash, anchor) of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, w in _windows(batches, length, reach, hot):
            keys = np.frombuffer(b"".join(w.key), np.int64).reshape(-1, 2)
            rows = pa.array(w.row)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(w.anchor)], ["k1", "k2", "doc_id", "text_hash", "anchor"])

    return run


def _strings(length: int, reach: int):
    """(s1, s2, k1, k2, j) of every string of `length` bytes that starts j bytes before a hot anchor: a digest of the string, and the window's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}
        for _, w in _windows(batches, length, reach, True):
            for k in _new(sent, w.key):
                js = range(int(w.low[k]), int(w.high[k]) + 1)
                at = int(w.at[k])
                digests = np.frombuffer(b"".join(hashlib.blake2b(w.raw[at - j : at - j + length], digest_size=16).digest() for j in js), np.int64).reshape(-1, 2)
                key = np.frombuffer(w.key[k], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), *(pa.array(np.full(len(js), x)) for x in key), pa.array(np.array(js, np.int32))], ["s1", "s2", "k1", "k2", "j"])

    return run


def transform(blocks: np.ndarray) -> np.ndarray:
    """The order of the suffixes of strings, the rows of blocks, as numbers string * (blocks + 1) + start; an empty suffix comes first, equal ones by string.

    Ranks by the first symbol are refined by the rank of what follows until every symbol has had its say.
    """
    m, b = blocks.shape
    symbol = np.zeros((m, b + 1), np.int64)
    symbol[:, :b] = np.unique(blocks.ravel(), return_inverse=True)[1].reshape(m, b) + 1
    rank = np.zeros((m, b + 1), np.int64)
    for _ in range(b):
        after = np.hstack([rank[:, 1:], np.zeros((m, 1), np.int64)])
        rank = np.unique((symbol * (m * (b + 1) + 1) + after).ravel(), return_inverse=True)[1].reshape(m, b + 1)
    return np.argsort(rank.ravel(), kind="stable")


def _transforms(length: int, reach: int, ranges: int, shard_size: int):
    """By shard and range of hashes: the Burrows-Wheeler transform of its windows' strings.

    `first` tells of each suffix in order whether it is a whole string, which nothing precedes; `symbols` has the
    symbols before the others. What else is known of the windows comes in the order of their whole strings.
    """
    b = 1 + -(-(reach - 1) // BLOCK)

    def shard(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h = np.array([w[0] for w in held], np.int64)
        blocks = np.frombuffer(b"".join(core.ljust(BLOCK, b"\0") + right.ljust(BLOCK * (b - 1), b"\0") for _, _, _, _, core, right, _ in held), f"S{BLOCK}").reshape(-1, b)
        order = transform(blocks)
        string, start = order // (b + 1), order % (b + 1)
        part = ((h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % ranges
        by = np.argsort(part[string], kind="stable")
        string, start = string[by], start[by]
        edges = np.flatnonzero(np.diff(part[string], prepend=-1, append=-1))
        raw = blocks.view(np.uint8).reshape(-1, b, BLOCK)
        rows = []
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            own, t = string[x:y], start[x:y]
            whole = own[t == 0]
            windows = [held[k] for k in whole.tolist()]
            numbers = np.array([(w[1], w[2], len(w[5]), len(w[3])) for w in windows], "<i4")
            rows.append((int(part[own[0]]), (t == 0).tobytes(), raw[own[t > 0], t[t > 0] - 1].tobytes(), numbers.tobytes(), b"".join(w[3] for w in windows), b"".join(w[6] for w in windows)))
        types = (pa.int32(), *[pa.binary()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["part", "first", "symbols", "numbers", "before", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, int] = {}
        held: list[tuple] = []
        for _, w in _windows(batches, length, reach, False):
            low, high, h = w.low.tolist(), w.high.tolist(), w.h.tolist()
            held += [(h[k], low[k], high[k], w.before[k], w.core[k], w.right[k], w.key[k]) for k in _new(sent, w.key)]
            if len(held) >= shard_size:
                yield from shard(held)
                held = []
        if held:
            yield from shard(held)

    return run


def interleave(shards: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges transforms: (order, common, after) of their suffixes.

    Rows are suffixes, shard after shard and in each shard's order; symbols has the rank of the symbol before each, 0
    for none. `order` has the rows as merged, `common` the symbols that each shares with the one before it (of equal
    ones, the number of rows), `after` the place of the suffix one symbol shorter, -1 for an empty one.

    A round reads the symbols in the order of the interleave and deals the rows out by them, stably: rows that agreed in
    k symbols then agree in k + 1, and a shard's rows keep their order, so the interleave need only say whose turn it
    is. Empty suffixes stay in front. A boundary that a round brings lies after as many symbols as rounds went before.
    """
    n = len(shards)
    empty = int((symbols == 0).sum())  # a string has one whole suffix and one empty one
    heads = shards[symbols == 0]
    order = np.arange(n)
    interval, common, settled = np.zeros(n, np.int64), np.full(n, n, np.int64), 0
    for done in range(n + 1):
        read = symbols[order]
        source = np.flatnonzero(read)
        source = source[np.argsort(read[source], kind="stable")]
        turn = np.concatenate([heads, shards[order[source]]])
        start = np.zeros(n, bool)
        start[0] = True
        if len(source):
            start[empty] = True
            s, k = read[source], interval[source]
            start[empty + 1 :] = (s[1:] != s[:-1]) | (k[1:] != k[:-1])
        common[start & (common == n)] = done
        by = np.argsort(turn, kind="stable")
        order = np.empty(n, np.int64)
        order[by] = np.arange(n)
        interval = np.cumsum(start)
        if interval[-1] == settled:
            break
        settled = interval[-1]
    common[0] = 0
    return order, common, np.concatenate([np.full(empty, -1), source])


def merge(parts: pa.Table, length: int, reach: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """The windows of transforms in the order of their strings: (numbers, common, before, keys). `common` has the bytes after the core that a window shares with the one before it, -1 for another core."""
    width, b = reach - 1, 1 + -(-(reach - 1) // BLOCK)
    columns = {c: parts.column(c).to_pylist() for c in ("first", "symbols", "numbers", "before", "keys")}
    first = np.frombuffer(b"".join(columns["first"]), bool)
    shards = np.repeat(np.arange(len(columns["first"])), [len(x) for x in columns["first"]])
    table, ranks = np.unique(np.frombuffer(b"".join(columns["symbols"]), f"S{BLOCK}"), return_inverse=True)
    symbols = np.zeros(len(first), np.int64)
    symbols[~first] = ranks + 1
    numbers = np.frombuffer(b"".join(columns["numbers"]), "<i4").reshape(-1, 4)
    keys = np.frombuffer(b"".join(columns["keys"]), np.int64).reshape(-1, 2)
    raw = b"".join(columns["before"])
    ends = np.cumsum(numbers[:, 3], dtype=np.int64)

    order, shared, after = interleave(shards, symbols)
    places = np.flatnonzero(first[order])
    window = (np.cumsum(first) - 1)[order[places]]  # whole suffixes are numbered as windows are listed
    symbols_shared = np.minimum.reduceat(shared[: places[-1] + 1], np.concatenate([[0], places[:-1] + 1]))
    # the symbol in which neighbours part, byte by byte: from a whole suffix it is as many steps away as they share
    bytes_of = table.astype(f"S{BLOCK}").view(np.uint8).reshape(-1, BLOCK)
    lead = np.empty(len(first), np.int64)  # the symbol that a suffix starts with, by its place
    lead[after >= 0] = symbols[order][after[after >= 0]] - 1
    common = np.full(len(places), width, np.int64)
    common[symbols_shared == 0] = -1
    for t in range(1, b):
        some = np.flatnonzero(symbols_shared == t)
        x, y = places[some], places[some - 1]
        for _ in range(t):
            x, y = after[x], after[y]
        differ = bytes_of[lead[x]] != bytes_of[lead[y]]
        common[some] = np.minimum(width, BLOCK * (t - 1) + differ.argmax(axis=1))
    before = [raw[e - n : e] for e, n in zip(ends[window].tolist(), numbers[window, 3].tolist(), strict=True)]
    return numbers[window], common, before, keys[window]


def _repeats(length: int, reach: int):
    """(k1, k2, least, most): the fewest and most bytes before the anchor with which a window has a repeated string."""

    def of(parts: pa.Table) -> pa.RecordBatch | None:
        numbers, common, before, keys = merge(parts, length, reach)
        low, high, size, had = numbers.T.astype(np.int64)
        n = len(low)
        back = np.frombuffer(b"".join(x[::-1].ljust(reach, b"\0") for x in before), np.uint8).reshape(n, reach).astype(np.uint64)
        least, most = np.full(n, reach), np.full(n, -1)
        left = np.zeros(n, np.uint64)
        for j in range(int(high.max()) + 1):
            if j:
                left = mix(left * np.uint64(257) + back[:, j - 1] + np.uint64(1))
            own = np.flatnonzero((low <= j) & (j <= high) & (size >= reach - 1 - j) & (had >= j))
            if not len(own):
                continue
            interval = np.cumsum(common < reach - 1 - j)[own].astype(np.uint64)
            key = mix(left[own] * np.uint64(0x9E3779B97F4A7C15) + interval)
            by = np.argsort(key, kind="stable")
            k = key[by]
            twice = np.zeros(len(k), bool)
            twice[1:] |= k[1:] == k[:-1]
            twice[:-1] |= k[1:] == k[:-1]
            hit = own[by[twice]]
            least[hit] = np.minimum(least[hit], j)
            most[hit] = j
        found = np.flatnonzero(most >= 0)
        if not len(found):
            return None
        _, one = np.unique(keys[found], axis=0, return_index=True)
        found = found[one]
        return pa.RecordBatch.from_arrays([pa.array(keys[found, 0]), pa.array(keys[found, 1]), pa.array(least[found].astype(np.int32)), pa.array(most[found].astype(np.int32))], ["k1", "k2", "least", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in groups(batches, ["part"]):
            if (out := of(parts)) is not None:
                yield out

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc_id, text, runs in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("runs").to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            spans: list[list[int]] = []
            for r in sorted(runs or [], key=lambda r: (r["start"], r["end"])):
                if spans and r["start"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r["end"])
                else:
                    spans.append([r["start"], r["end"]])
            at, kept = 0, []
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            for col, v in zip(out, (doc_id, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)] + [pc.coalesce(batch.column(c), pa.scalar(0, pa.int64())) for c in ("cores", "shared_words")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_cores", "n_shared_words"])


def repeated_runs(docs: DataFrame, saved: Saved, length: int = LENGTH, reach: int = REACH) -> DataFrame:
    """(doc_id, text_hash, cores, runs) of documents that hold a core found elsewhere too: how many such cores, and the byte runs, which may overlap, that repeated strings cover; null for none."""
    keys = ["doc_id", "text_hash"]
    named = docs.mapInArrow(_named(length, reach), "route long, h long, n long, doc_id long, text_hash long")
    wanted = saved.save(named.repartition("route").sortWithinPartitions("h").mapInArrow(_several(HOT), "h long, doc_id long, text_hash long"))
    hot = wanted.where("doc_id is null").select("h")
    rows = wanted.where("doc_id is not null")
    rows = rows.withColumn("hot", F.lit(False)) if hot.isEmpty() else rows.join(hot.withColumn("hot", F.lit(True)), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    by_doc = saved.save(rows.groupBy(*keys).agg(F.collect_set(F.when(~F.col("hot"), F.col("h"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("hot")))
    saved.drop(wanted)
    texts = maybe_among(docs, F.xxhash64(*keys), by_doc.select(F.xxhash64(*keys).alias("key")), "met").where("met").drop("met")
    held = texts.join(by_doc, keys).select(*keys, "text", "cold", "hot")
    ranges = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = held.mapInArrow(_transforms(length, reach, ranges, SHARD), "part int, first binary, symbols binary, numbers binary, before binary, keys binary")
    found = found.repartition("part").sortWithinPartitions("part").mapInArrow(_repeats(length, reach), "k1 long, k2 long, least int, most int")
    places = "k1 long, k2 long, doc_id long, text_hash long, anchor long"
    met = held.mapInArrow(_places(length, reach, False), places).join(found, ["k1", "k2"])
    hot = held.where(F.size("hot") > 0)
    strings = hot.mapInArrow(_strings(length, reach), "s1 long, s2 long, k1 long, k2 long, j int")
    twice = strings.join(strings.groupBy("s1", "s2").count().where("count > 1").select("s1", "s2"), ["s1", "s2"]).groupBy("k1", "k2").agg(F.min("j").alias("least"), F.max("j").alias("most"))
    met = met.unionByName(hot.mapInArrow(_places(length, reach, True), places).join(twice, ["k1", "k2"]))
    run = F.struct((F.col("anchor") - F.col("most")).alias("start"), (F.col("anchor") + length - F.col("least")).alias("end"))
    runs = met.groupBy(*keys).agg(F.collect_set(run).alias("runs"))
    return by_doc.select(*keys, (F.size("cold") + F.size("hot")).cast("long").alias("cores")).join(runs, keys, "left")


def passage_runs(flat: np.ndarray, offsets: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, hash, hash of the anchor) of every run of `words` words of each text, as written."""
    h, counts = word_hashes(flat, offsets, lower=False)
    if len(h) < words:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    at = np.concatenate([[0], np.cumsum(counts)])
    n = len(h) - words + 1
    doc = np.searchsorted(at, np.arange(n), "right") - 1
    own = np.flatnonzero(np.arange(n) + words <= at[doc + 1])
    grams, runs = _rolled(h, gram), _rolled(h, words)
    return doc[own], own - at[doc[own]], runs[own], _sliding_least(grams, words - gram + 1)[own]


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width numbers: runs of a power of two are made of two halves, others of two that overlap."""
    power, out = 1, h
    while 2 * power <= width:
        out, power = mix(out[:-power] * _FIRST + out[power:]), 2 * power
    rest = width - power
    return mix(out[: len(out) - rest] * _FIRST + out[rest:]) if rest else out


_FIRST = np.uint64(0xD6E8FEB86659FD93)


def _anchored(words: int, gram: int):
    """(h, doc_id, text_hash): each anchor of a row once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, flat, offsets in chunks(batch.column("text"), PIECE):
                doc, _, _, h = passage_runs(flat, offsets, words, gram)
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                rows = pa.array(doc[new] + first)
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), batch.column("doc_id").take(rows), batch.column("text_hash").take(rows)], ["h", "doc_id", "text_hash"])

    return run


def _runs_of(words: int, gram: int):
    """(p, doc_id, text_hash, at): hashes of the runs of words whose anchor is among a row's `anchors`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, flat, offsets in chunks(batch.column("text"), PIECE):
                doc, at, p, h = passage_runs(flat, offsets, words, gram)
                keep, cuts = np.zeros(len(doc), bool), np.searchsorted(doc, np.arange(len(offsets)))
                for k in range(len(offsets) - 1):
                    if cuts[k] < cuts[k + 1]:
                        keep[cuts[k] : cuts[k + 1]] = np.isin(h[cuts[k] : cuts[k + 1]].view(np.int64), batch.column("anchors")[first + k].values.to_numpy())
                rows = pa.array(doc[keep] + first)
                yield pa.RecordBatch.from_arrays([pa.array(p[keep].view(np.int64)), batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(at[keep])], ["p", "doc_id", "text_hash", "at"])

    return run


def _several_documents(rows: DataFrame, key: str) -> DataFrame:
    """The values of key that rows with different doc_id or, of one id, different texts have."""
    own = F.xxhash64("doc_id", "text_hash")
    return rows.groupBy(key).agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low <> high").select(key)


def shared_words(docs: DataFrame, saved: Saved, words: int = WORDS, gram: int = WORD_GRAM) -> DataFrame:
    """(doc_id, text_hash, shared_words): how many words of a document lie in runs of `words` words or more that another document holds too; documents without any are left out."""
    keys = ["doc_id", "text_hash"]
    # rows that repeat id and text are one document here
    anchored = saved.save(docs.mapInArrow(_anchored(words, gram), "h long, doc_id long, text_hash long"))
    by_doc = saved.save(anchored.join(_several_documents(anchored, "h"), "h").groupBy(*keys).agg(F.collect_set("h").alias("anchors")))
    saved.drop(anchored)
    texts = maybe_among(docs, F.xxhash64(*keys), by_doc.select(F.xxhash64(*keys).alias("key")), "met").where("met").drop("met").dropDuplicates(keys)
    runs = saved.save(texts.join(by_doc, keys).select(*keys, "text", "anchors").mapInArrow(_runs_of(words, gram), "p long, doc_id long, text_hash long, at long"))
    saved.drop(by_doc)
    found = runs.join(_several_documents(runs, "p"), "p")
    # a run adds the words that the one before it leaves
    ahead = F.col("at") - F.lag("at").over(Window.partitionBy(*keys).orderBy("at"))
    out = saved.save(found.select(*keys, "at").withColumn("added", F.least(F.coalesce(ahead, F.lit(words)), F.lit(words))).groupBy(*keys).agg(F.sum("added").cast("long").alias("shared_words")))
    saved.drop(runs)
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, reach: int = REACH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_cores, n_shared_words), one row for each input row.

    Texts are UTF-8 bytes, null an empty one. A byte goes if a string of `length` bytes over it starts anywhere else
    too, in the same document or another; strings are judged on the input and end with their document. Rows that
    repeat id and text repeat each other's strings. A null id is carried along. An empty table gives none.

    n_shared_cores counts the different strings of length - reach + 1 bytes from an anchor on that are found elsewhere
    too. n_shared_words counts the words [^\\x20\\x09-\\x0D]+ that lie in runs of WORDS or more that a document with another id
    or text holds too. It tells of passages that may be shorter than `length` bytes, which stay. Hashes have 64 bits.
    """
    if not 1 <= reach <= length - GRAM + 1:
        raise ValueError("reach must leave room for a gram in the string")
    saved = Saved(docs.sparkSession)
    text = text_or_empty(text_col)
    # ids are for joining: null becomes an id of its own
    rows = docs.select(F.col(id_col).cast("long").alias("own_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    passages = shared_words(rows.drop("own_id"), saved)
    runs = saved.save(repeated_runs(rows.drop("own_id"), saved, length, reach).join(passages, ["doc_id", "text_hash"], "full"))
    # texts that surely lose nothing aren't shuffled
    marked = maybe_among(rows, F.xxhash64("doc_id", "text_hash"), runs.select(F.xxhash64("doc_id", "text_hash").alias("key")), "met")
    cut = marked.where("met").join(runs, ["doc_id", "text_hash"], "left").select("own_id", "text", "cores", "shared_words", "runs")
    whole = marked.where("not met").select("own_id", "text", *(F.lit(None).cast("long").alias(c) for c in ("cores", "shared_words")), F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))
    return cut.unionByName(whole).withColumnRenamed("own_id", "doc_id").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_cores long, n_shared_words long")
