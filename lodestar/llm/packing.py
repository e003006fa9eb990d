"""Best-fit packing of tokenised documents into sequences: a configuration linear program over the length histogram.

Documents are tokenised and cut where they are; what is packed is the histogram of piece lengths, at most `capacity`
numbers whatever the corpus. Multiplicative weights price patterns by a knapsack dynamic program, bounded by the pieces
that are left, and patterns are taken in whole uses until the pieces run out; best fit in order of decreasing length
packs the few that no pattern takes, and pieces look up their place by length and rank.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.tables import Saved

CAPACITY = 4096
END_ID = 1
#: The step of the weights, what a length of a whole sequence is worth above its share, and how far below the best pattern's worth one may be taken.
ETA, LONG, NEAR = 0.1, 0.5, 0.3
#: The numbers of slots(), by name.
_PLACE = ("rank", "n", "sequence", "each", "offset")
#: Parts of texts of which a task remembers the ids, and the characters of the longest one that it remembers.
REMEMBERED, LONG_PART = 1 << 18, 64
#: Bytes of texts that are tokenised at once; one longer text is a run of its own.
RUN_BYTES = 1 << 22
#: Groups in which the pieces of one length are ranked.
SALTS = 256
_NOT_PLAIN = "[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]"
#: The vocabulary's units but for runs of letters, which stand between these and blanks; and all, in its order of preference: fixed values.
_LETTERS = "a-z\xdf-\xf6\xf8-\xff"
_MARKS = f"'(?:s|t|re|ve|m|ll|d)|[0-9]|[^ \t\n\r\x0b\x0c0-9{_LETTERS}]+"
_UNITS = f"[{_LETTERS}]+|{_MARKS}"
#: How byte-level vocabularies write bytes: printable ones as themselves, the others as code points from 256 on.
_SHOWN = (*range(33, 127), *range(161, 173), *range(174, 256))
_BYTE_CHARS = dict(zip((b for b in range(256) if b not in _SHOWN), range(256, 512), strict=False))


class WordTokenizer:
    """Ids of texts from the ids of their parts, which are remembered: this vocabulary's rules never reach across them.

    Many texts are split at once by Arrow, which also numbers their distinct parts, so only those are looked up. In texts
    of ASCII and Latin-1 letters parts are the runs that the vocabulary's own pattern takes for units, in lower case; in
    others they are what stands between ASCII blanks. Plain parts go straight to the vocabulary's model.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = self.whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        self.model = whole.model
        # in whole the strings of added tokens are text, in the vocabulary's ids they are one id each
        self.unchanged = lru_cache(1)(lambda: Tokenizer.from_file(path))
        added = sorted({t.content for t in whole.get_added_tokens_decoder().values()}, key=len, reverse=True)
        self.holds_added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE).search
        self.not_plain, self.units = re.compile(_NOT_PLAIN).search, re.compile(_UNITS).findall
        self.known: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        """Ids of a part, remembered unless it is long: such parts seldom come again and would fill the memory."""
        if self.not_plain(part):
            out = _packed(self.whole.encode(part, add_special_tokens=False).ids)
        else:
            out = _packed([t.id for unit in self.units(part.lower()) for t in self.model.tokenize(unit.encode().decode("latin-1").translate(_BYTE_CHARS))])
        if len(part) <= LONG_PART:
            self.known[part] = out
        return out

    def contract_ids(self, text: str) -> bytes:
        """The unchanged tokenizer's ids of a text, which may hold added tokens, as ids() gives them."""
        return next(self.all_contract_ids(pa.array([text], pa.string())))

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text in which the strings of added tokens are plain text."""
        return next(self.all_ids(pa.array([text], pa.string())))

    def all_contract_ids(self, texts: pa.Array) -> Iterator[bytes]:
        """contract_ids() of each text; null counts as empty."""
        strings = texts.to_numpy(zero_copy_only=False)
        held = {k: text for k, text in enumerate(strings) if text and self.holds_added(text)}
        if held:
            strings[list(held)] = None
            texts = pa.array(strings, texts.type)  # if_else() of a null and a slice of texts gives wrong ones
        for k, ids in enumerate(self.all_ids(texts)):
            yield _packed(self.unchanged().encode(held[k], add_special_tokens=False).ids) if k in held else ids

    def all_ids(self, texts: pa.Array) -> Iterator[bytes]:
        """ids() of each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        apart = pc.replace_substring_regex(pc.utf8_lower(texts), _MARKS, r" \0 ")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, _NOT_PLAIN), texts, apart))
        parts = split.flatten().dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = [ids if (ids := self.known.get(part)) is not None else self.part(part) for part in parts.dictionary.to_numpy(zero_copy_only=False)]
        flat, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = parts.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        shift = (np.cumsum(sizes) - sizes)[at] - ends[:-1]  # from an id's place in the texts to its place in flat
        ids = flat[np.repeat(shift, sizes[at]) + np.arange(ends[-1])]
        bounds = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
        for a, b in pairwise(bounds.tolist()):
            yield ids[a:b].tobytes()


@lru_cache(2)
def worker_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer, with what it remembers, for all tasks of a Python worker."""
    return WordTokenizer(path)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _runs(texts: pa.Array) -> Iterator[pa.Array]:
    """All texts in slices of about RUN_BYTES, at least one text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    i = 0
    while i < len(texts):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + RUN_BYTES, "right")))
        yield texts.slice(i, j - i)
        i = j


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        tokenizer = worker_tokenizer(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            every = (ids + end for texts in _runs(batch.column("text")) for ids in tokenizer.all_contract_ids(texts))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), every, strict=True):
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    for col, v in zip(out, (doc_id, k, a // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def knapsack(lengths: np.ndarray, price: np.ndarray, copies: np.ndarray, capacity: int) -> tuple[np.ndarray, Callable[[int], dict[int, int]]]:
    """The highest price of any multiset of lengths by room, no length oftener than its copies; and, for a room, that multiset by place."""
    items: list[tuple[int, int, int]] = []  # place, times, length of all: copies in powers of two
    for k, (x, n) in enumerate(zip(lengths.tolist(), copies.tolist(), strict=True)):
        t = 1
        while n > 0:
            items.append((k, min(t, n), x * min(t, n)))
            n, t = n - t, 2 * t
    worth, took = np.zeros(capacity + 1), np.zeros((len(items), capacity // 8 + 1), np.uint8)  # a bit for each item and room
    row = np.zeros(capacity + 1, bool)
    for i, (k, t, size) in enumerate(items):
        if size <= capacity:
            got = worth[: capacity + 1 - size] + t * price[k]
            row[:size] = False
            np.greater(got, worth[size:], out=row[size:])
            took[i] = np.packbits(row)
            np.maximum(got, worth[size:], out=worth[size:])

    def taken(room: int) -> dict[int, int]:
        out: dict[int, int] = defaultdict(int)
        i = len(items)
        while room > 0 and len(at := np.flatnonzero(took[:i, room >> 3] & (128 >> (room & 7)))):
            i = int(at[-1])
            out[items[i][0]] += items[i][1]
            room -= items[i][2]
        return dict(out)

    return worth, taken


def best_pattern(lengths: np.ndarray, price: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths of at most `capacity` in total that has the highest price."""
    _, taken = knapsack(lengths, price, capacity // lengths, capacity)
    return {int(lengths[k]): n for k, n in taken(capacity).items()}


def configuration_lp(histogram: dict[int, int], capacity: int, patterns: int | None = None) -> list[tuple[int, dict[int, int]]]:
    """Whole uses of patterns by multiplicative weights, until every piece is covered or `patterns` are found.

    A length's price is its share of a sequence, more for a long one, which fits in fewer places, times a weight that
    falls as the length is covered, so one that lags is worth most. A round's program gives the best pattern and
    the best ones that hold each length; those that lie NEAR it are taken, best first, as often as the pieces left allow,
    so each runs short of a length and rounding takes nothing away.
    """
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[int(x)] for x in lengths], np.int64)
    left, found = need.copy(), []
    while left.any() and (patterns is None or len(found) < patterns):
        live = np.flatnonzero(left)
        x = lengths[live]
        price = x / capacity * (1 + LONG * x / capacity) * np.exp(-ETA * (1 - left[live] / need[live]))
        worth, taken = knapsack(x, price, np.minimum(left[live], capacity // x), capacity)
        holding = price + worth[capacity - x]
        near = [k for k in np.argsort(-holding, kind="stable").tolist() if holding[k] >= (1 - NEAR) * worth[capacity]]
        for k in (None, *near):
            if k is not None and not left[live[k]]:
                continue
            pattern = taken(capacity if k is None else capacity - int(x[k]))
            if k is not None:
                pattern[k] = pattern.get(k, 0) + 1
            at, many = live[list(pattern)], np.array(list(pattern.values()), np.int64)
            use = int((left[at] // many).min())
            if use:
                left[at] -= use * many
                found.append((use, dict(zip(lengths[at].tolist(), many.tolist(), strict=True))))
    return found if patterns is None else found[:patterns]


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY, patterns: int | None = None) -> list[tuple[int, tuple[int, ...]]]:
    """(how many sequences, the lengths in each) that use up the histogram.

    The last patterns found, of what is left over, may be poor, so all are kept or only the first of them, with best fit for the
    rest; the fewest sequences win, the most patterns among equals.
    """
    found = configuration_lp(histogram, capacity, patterns) if histogram else []
    tries = (_rounded(histogram, capacity, found[: len(found) * k // 20]) for k in (20, 19, 18, 15, 10, 5, 0))
    return min(tries, key=lambda packed: sum(times for times, _ in packed))


def _rounded(histogram: dict[int, int], capacity: int, found: list[tuple[int, dict[int, int]]]) -> list[tuple[int, tuple[int, ...]]]:
    left = dict(histogram)
    out: list[tuple[int, tuple[int, ...]]] = []
    open_bins: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for use, pattern in found:
        times = min(use, *(left[x] // k for x, k in pattern.items()))
        if times > 0:
            for x, k in pattern.items():
                left[x] -= k * times
            items = tuple(x for x, k in sorted(pattern.items(), reverse=True) for _ in range(k))
            open_bins[capacity - sum(items)].append((times, items))
    rooms = sorted(r for r in open_bins if r)
    for x in sorted((x for x, n in left.items() if n), reverse=True):
        n = left[x]
        while n:
            k = bisect_left(rooms, x)
            if k == len(rooms):  # nothing open holds it: new sequences with as many of this length as fit
                each = min(n, capacity // x)
                times = n // each
                put, room, items = times, capacity - each * x, (x,) * each
                n -= times * each
            else:
                room = rooms[k]
                times, items = open_bins[room].pop()
                each = min(room // x, n)
                put = min(times, n // each)
                if put < times:
                    open_bins[room].append((times - put, items))
                elif not open_bins[room]:
                    rooms.pop(k)
                n -= put * each
                room, items = room - each * x, items + (x,) * each
            if room and not open_bins[room]:
                insort(rooms, room)
            open_bins[room].append((put, items))
    for groups in open_bins.values():
        out += groups
    return out


def slots(packed: list[tuple[int, tuple[int, ...]]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """By length: (first rank, ranks, sequence of the first, ranks in one sequence, offset of the first in it)."""
    out: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
    next_rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for times, items in packed:
        offset, i = 0, 0
        while i < len(items):
            x, each = items[i], 1
            while i + each < len(items) and items[i + each] == x:
                each += 1
            out[x].append((next_rank[x], times * each, sequence, each, offset))
            next_rank[x] += times * each
            offset += each * x
            i += each
        sequence += times
    return out


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and the closing id, cut at `capacity`."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(vocabulary, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece.

    A null or blank text has the closing id alone; null and repeated ids are packed like any others; an empty table
    gives none. Pieces of one length are ranked within SALTS groups whose sizes are summed first, so a length that
    most pieces have is no single task's. The histogram and the places, at most a few for each length, are all that
    the driver sees.
    """
    spark = docs.sparkSession
    saved = Saved(spark)
    pieces = saved.save(tokenized_pieces(docs, vocabulary, capacity))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)))
    counts = saved.save(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_length = slots(pack_histogram(histogram, capacity))
    places = pa.array([[dict(zip(_PLACE, map(int, p), strict=True)) for p in ps] for ps in by_length.values()], pa.list_(pa.struct([(c, pa.int64()) for c in _PLACE])))
    # as Arrow: a list of rows would go through Python workers of a second daemon on the executors
    table = spark.createDataFrame(pa.table({"length": pa.array(list(by_length), pa.int64()), "places": places}))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("inner", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inner"))
    placed = ranked.join(F.broadcast(table), "length").withColumn("place", F.element_at(F.filter("places", lambda p: (p["rank"] <= F.col("rank")) & (F.col("rank") < p["rank"] + p["n"])), 1))
    nth = F.col("rank") - F.col("place.rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("place.sequence") + F.floor(nth / F.col("place.each"))).cast("long").alias("sequence_id"),
        (F.col("place.offset") + nth % F.col("place.each") * F.col("length")).cast("long").alias("offset"),
    )
