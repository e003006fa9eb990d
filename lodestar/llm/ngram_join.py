"""Documents whose sets of word 5-grams have a Jaccard similarity of 0.75 or more, exactly and without all pairs.

1. profile: every document becomes a sorted set of 64-bit shingle hashes, of which a row keeps the size, a 128-bit
   digest (documents with one digest are one class) and a bitmap signature. Shingles that many documents hold come
   out of the same pass as a list of at most FREQUENT; any list is right, a good one keeps common passages out of 3.
2. prefixes: linked sets share one of their first n - ceil(0.75 n) + 1 shingles in any order common to all. The
   order is: shingles off the list by hash, then those on it.
3. candidates: classes meeting at a shingle of up to SMALL classes give pairs, if their sizes allow a link, and kept if
   the signatures do. Those meeting at a shingle of more form a group, which is cut into size bands, bands into blocks of
   BLOCK sets, and tiles are pairs of blocks of one band or two adjacent ones. In a tile bit counts bound the overlap
   of every pair from above; a forest of the pairs that may link comes out. The components of all candidates are
   clusters, and every link is within one.
4. links: clusters are cut into tiles likewise. In a tile, bit counts come first again, then sorted arrays are
   intersected; pairs that links already join are passed over. What comes out is a forest of exact links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.graph import components
from lodestar.llm.streams import groups
from lodestar.llm.tables import Saved, maybe_among
from lodestar.llm.textbytes import chunks, shingle_sets

WIDTH = 5
#: The similarity as a fraction: 3/4.
NUM, DEN = 3, 4
FREQUENT = 1 << 18
#: A shingle is reported as frequent by a chunk of documents of which so many distinct ones hold it.
OFTEN = 3
#: Hashes of documents that are held before the frequent ones of them are reported.
HELD = 1 << 21
SMALL = 24
#: Words of 64 bits in the shortest signature.
SIGNATURE_WORDS = 16
BLOCK = 512

_PROFILE = "kind tinyint, doc_id long, n int, d1 long, d2 long, sig array<long>"


def signature(s: np.ndarray) -> np.ndarray:
    """A bitmap with the bit of every hash set: the shortest power of two of bits, 1024 at least, that is twice the set's size.

    The longer of two signatures folds onto the shorter, half over half, as if it had been made with as many bits.
    """
    words = SIGNATURE_WORDS
    while words * 64 < 2 * len(s):
        words *= 2
    bits = np.zeros(words * 64, np.uint8)
    bits[((s >> np.uint64(20)) % np.uint64(words * 64)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set; the lowest 8 of the first 64 say its size, in steps of a third of the ratio that links allow."""
    d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return int(d[0]) & ~255 | min(255, int(3 * math.log(len(s)) / math.log(DEN / NUM))), int(d[1])


def _sized(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sizes in digests allow a link: at most three steps apart, and one for rounding."""
    return np.abs((a & 255) - (b & 255)) <= 4


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def _frequent_rows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that h has OFTEN or oftener, and how often. Sorts h itself: most occur once, so no copy of it is made."""
    h.sort()
    often = np.unique(h[: max(0, len(h) - OFTEN + 1)][h[OFTEN - 1 :] == h[: max(0, len(h) - OFTEN + 1)]])
    return often, np.searchsorted(h, often, "right") - np.searchsorted(h, often)


class _Held:
    """Shingle hashes of different sets, in one array of HELD that grows for what the last chunk of documents has above it."""

    def __init__(self):
        self.seen: set[tuple[int, int]] = set()
        self.hashes, self.n = np.empty(HELD, np.uint64), 0

    def add(self, d: tuple[int, int], s: np.ndarray) -> None:
        if d in self.seen:
            return
        self.seen.add(d)
        if self.n + len(s) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes[: self.n], np.empty(len(s) + HELD // 4, np.uint64)])
        self.hashes[self.n : self.n + len(s)] = s
        self.n += len(s)

    def frequent(self) -> pa.RecordBatch:
        return _heavy_batch(*_frequent_rows(self.hashes[: self.n]))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Held()
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        out: list[list] = [[], [], [], [], [], []]
        for first, flat, offsets in chunks(batch.column("text")):
            for k, s in enumerate(shingle_sets(flat, offsets, WIDTH)):
                d = digest(s) if len(s) else (None, None)
                if len(s):
                    held.add(d, s)
                for col, v in zip(out, (0, ids[first + k], len(s), *d, signature(s) if len(s) else None), strict=True):
                    col.append(v)
            if held.n >= HELD:
                yield held.frequent()
                held = _Held()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int8(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["kind", "doc_id", "n", "d1", "d2", "sig"])
    yield held.frequent()


def _heavy_batch(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(h), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int8)), none, pa.array(n.astype(np.int32)), pa.array(h.view(np.int64)), none, pa.nulls(len(h), pa.list_(pa.int64()))], ["kind", "doc_id", "n", "d1", "d2", "sig"])


def _prefixes(frequent: np.ndarray):
    frequent = np.sort(frequent.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # classes that this task has sent, as far as it remembers
        for batch in batches:
            for _, flat, offsets in chunks(batch.column("text")):
                keys, owners = [], []
                if len(seen) > 1 << 17:
                    seen = set()
                for s in shingle_sets(flat, offsets, WIDTH):
                    if not len(s) or (d := digest(s)) in seen:
                        continue
                    seen.add(d)
                    p = prefix_length(len(s))
                    if len(frequent):
                        at = np.searchsorted(frequent, s)
                        listed = frequent[np.minimum(at, len(frequent) - 1)] == s
                        first = s[~listed][:p]
                        if len(first) < p:
                            first = np.concatenate([first, s[listed][: p - len(first)]])
                    else:
                        first = s[:p]
                    keys.append(first)
                    owners.append(np.full(len(first), d[0], np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners))], ["key", "cls"])

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes at keys of up to SMALL classes; at others, members of a group named by its least. Rows come sorted by (key, cls)."""
    key, members, star = None, [], False  # of the run that may go on in the next batch

    def pairs(ms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        a, b = [], []
        for size in {len(m) for m in ms}:
            m = np.stack([x for x in ms if len(x) == size])
            i, j = np.triu_indices(size, 1)
            a.append(m[:, i].ravel())
            b.append(m[:, j].ravel())
        x, y = np.concatenate(a), np.concatenate(b)
        ok = _sized(x, y)
        return x[ok], y[ok]

    def batch_of(a: list, b: list, s: list) -> pa.RecordBatch:
        rows = np.unique(np.stack([np.concatenate(a), np.concatenate(b), np.concatenate(s).astype(np.int64)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(bool))], ["a", "b", "star"])

    for batch in batches:
        k = batch.column("key").to_numpy()
        c = batch.column("cls").to_numpy()
        if not len(k):
            continue
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        k, c = k[new], c[new]
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        begins = np.concatenate([[0], cuts])
        ends = np.concatenate([cuts, [len(k)]])
        a, b, s, small = [], [], [], []
        # runs of one class that neither continue nor may go on need no work
        wanted = np.flatnonzero((ends - begins > 1) | (begins == 0) | (ends == len(k)))
        for r in wanted:
            m = c[begins[r] : ends[r]]
            if key is not None and k[begins[r]] == key and r == 0:
                m = m[1:] if len(m) and len(members) and m[0] == members[-1] else m
                members = members + m.tolist() if not star else [members[0], *m.tolist()]
            else:
                if key is not None and not star and len(members) > 1:
                    small.append(np.array(members, np.int64))
                key, members, star = k[begins[r]], m.tolist(), False
            if len(members) > SMALL or star:
                star = True
                rest = np.array(members, np.int64)
                if len(rest):
                    a.append(np.full(len(rest), members[0], np.int64))
                    b.append(rest)
                    s.append(np.ones(len(rest), bool))
                members = members[:1]
        if small:
            x, y = pairs(small)
            a.append(x)
            b.append(y)
            s.append(np.zeros(len(x), bool))
        if a:
            yield batch_of(a, b, s)
    if key is not None and not star and len(members) > 1:
        x, y = pairs([np.array(members, np.int64)])
        yield batch_of([x], [y], [np.zeros(len(x), bool)])


def _linked(m: int, n: int, both: int) -> bool:
    return DEN * both >= NUM * (m + n - both)


class _Signatures:
    """The signatures of a tile by length, for bounds on overlaps: linked sets have equal lengths or a factor of two between them."""

    def __init__(self, n: np.ndarray, sigs: list[np.ndarray]):
        self.n, self.sigs = n, [x.view(np.uint64) for x in sigs]
        self.size = np.array([len(x) for x in sigs])
        self.row = np.zeros(len(sigs), np.int64)
        self.stack = {}
        for w in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == w)
            self.row[at] = np.arange(len(at))
            self.stack[w] = np.stack([self.sigs[k] for k in at])

    def able(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of others, none larger than set i, whose overlap with it may suffice, by the bits in which signatures differ."""
        own, w, kept = self.sigs[i], int(self.size[i]), []
        for sig, words in ((own, w), (own[: w // 2] | own[w // 2 :], w // 2)):
            some = others[self.size[others] == words]
            if len(some):
                apart = np.bitwise_count(self.stack[words][self.row[some]] ^ sig).sum(axis=1).astype(np.int64)
                most = (self.n[some] + self.n[i] - apart) // 2
                kept.append(some[DEN * most >= NUM * (self.n[some] + self.n[i] - most)])
        return np.sort(np.concatenate(kept)) if kept else others[:0]


def _tile_forest(who: list[int], n: np.ndarray, sigs: list[np.ndarray], side: np.ndarray, cross: bool, linked) -> pa.RecordBatch | None:
    """A forest of the pairs that linked(i, j) accepts; rows come in order of n, and pairs already joined are passed over."""
    comp, bounds = np.arange(len(who)), _Signatures(n, sigs)
    a, b = [], []
    for i in range(1, len(who)):
        others = np.arange(int(np.searchsorted(n, -(-NUM * n[i] // DEN))), i)
        others = others[comp[others] != comp[i]]
        if cross:
            others = others[side[others] != side[i]]
        if len(others):
            others = bounds.able(i, others)
        while len(others := others[comp[others] != comp[i]]):
            j, others = others[0], others[1:]
            if linked(i, j):
                a.append(who[i])
                b.append(who[j])
                comp[comp == comp[i]] = comp[j]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None


def _candidate_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tile in groups(batches, ["cluster", "left", "right"]):
        n, rep = tile.column("n").to_numpy().astype(np.int64), tile.column("rep").to_numpy()
        order = np.lexsort((rep, n))
        sig = tile.column("sig").combine_chunks()
        sigs = [sig[k].values.to_numpy() for k in order.tolist()]
        side = np.array(tile.column("own").to_pylist())[order]
        out = _tile_forest(rep[order].tolist(), n[order], sigs, side, tile.column("left")[0] != tile.column("right")[0], lambda i, j: True)
        if out is not None:
            yield out


def _link_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tile in groups(batches, ["cluster", "left", "right"]):
        ids, own = tile.column("rep").to_pylist(), tile.column("own").to_pylist()
        want = list(zip(tile.column("d1").to_pylist(), tile.column("d2").to_pylist(), strict=True))
        sets, who, side = [], [], []
        for first, flat, offsets in chunks(tile.column("text")):
            for k, s in enumerate(shingle_sets(flat, offsets, WIDTH)):
                if digest(s) == want[first + k]:  # else another text under this id
                    sets.append(s)
                    who.append(ids[first + k])
                    side.append(own[first + k])
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), who[i]))
        sets, who, side = [sets[i] for i in order], [who[i] for i in order], np.array([side[i] for i in order])
        if len(sets) < 2:
            continue
        n = np.array([len(s) for s in sets])
        linked = lambda i, j: _linked(n[i], n[j], len(np.intersect1d(sets[i], sets[j], assume_unique=True)))  # noqa: B023, E731
        out = _tile_forest(who, n, [signature(s) for s in sets], side, tile.column("left")[0] != tile.column("right")[0], linked)
        if out is not None:
            yield out


def _spread(members: DataFrame) -> DataFrame:
    """members (cluster, rep, n, ...) once for each tile of its cluster: with own, its block, and left and right, the tile's.

    Sets whose sizes allow a link are in one size band or in adjacent ones. A cluster of up to BLOCK sets is one tile.
    """
    members = members.withColumn("band", F.floor(F.log("n") / F.log(F.lit(DEN / NUM)) - 1e-9).cast("int"))
    sizes = members.groupBy("cluster", "band").agg(F.count("*").alias("m"))
    sizes = sizes.groupBy("cluster").agg(F.sum("m").alias("all"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("m") / BLOCK).cast("int")))).alias("blocks"))
    members = members.join(sizes.where("all > 1"), "cluster")
    spot = lambda b, s: F.concat(F.lpad(b.cast("string"), 6, "0"), F.lit("."), F.lpad(s.cast("string"), 9, "0"))
    own = spot(F.col("band"), F.pmod(F.xxhash64("rep"), F.element_at("blocks", F.col("band"))))
    near = F.flatten(F.transform(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1), lambda b: F.when(F.element_at("blocks", b).isNotNull(), F.transform(F.sequence(F.lit(0), F.element_at("blocks", b) - 1), lambda s: spot(b, s))).otherwise(F.array().cast("array<string>"))))
    members = members.withColumn("own", F.when(F.col("all") <= BLOCK, "all").otherwise(own)).withColumn("near", F.when(F.col("all") <= BLOCK, F.array(F.lit("all"))).otherwise(near)).drop("band", "all", "blocks")
    return members.withColumn("other", F.explode("near")).withColumn("left", F.least("own", "other")).withColumn("right", F.greatest("own", "other")).drop("near", "other")


_TILE = ("cluster", "left", "right")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each input row.

    Words are runs of other than ASCII blanks, A-Z in lower case. A set with fewer than five words is its whole
    sequence; a null, empty or blank text has the empty set and links with nothing. component_id is the smallest
    doc_id that links reach, itself included. Equal sets link. A row whose id is null is returned with a null
    component and links with nothing; rows that repeat an id are one node with the links of all their texts.
    Hashes have 64 bits, so two different shingles of one compared pair are taken for one with probability 2**-64.
    """
    spark = docs.sparkSession
    saved = Saved(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = saved.save(docs.mapInArrow(_profile, _PROFILE))
    profile = table.where("kind = 0").drop("kind")
    listed = table.where("kind = 1").groupBy("d1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d1").limit(FREQUENT)
    frequent = listed.select("d1").toArrow().column("d1").to_numpy()  # FREQUENT numbers at most
    classes = saved.save(profile.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")))

    rows = docs.where("doc_id is not null").select("text").mapInArrow(_prefixes(frequent), "key long, cls long")
    met = saved.save(rows.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(_meetings, "a long, b long, star boolean").distinct())
    one = classes.select(F.col("d1").alias("a"), F.col("rep").alias("rep_a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    two = classes.select(F.col("d1").alias("b"), F.col("rep").alias("rep_b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    # of signatures that may link the longer one folds onto the shorter, once at most
    fold = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda p, q: p.bitwiseOR(q))).otherwise(x)
    differ = F.zip_with(fold(F.col("sig_a"), F.col("sig_b")), fold(F.col("sig_b"), F.col("sig_a")), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.aggregate(differ, F.lit(0), lambda t, x: t + x)
    most = F.floor((F.col("n_a") + F.col("n_b") - apart) / 2)
    sized = DEN * F.least("n_a", "n_b") >= NUM * F.greatest("n_a", "n_b")
    able = F.when(sized, DEN * most >= NUM * (F.col("n_a") + F.col("n_b") - most)).otherwise(False)
    pairs = met.where("not star").join(one, "a").join(two, "b").where(able).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    grouped = met.where("star").join(two, "b").select(F.col("a").alias("cluster"), F.col("rep_b").alias("rep"), F.col("n_b").alias("n"), F.col("sig_b").alias("sig"))
    grouped = _spread(grouped).select(*_TILE, "own", "rep", "n", "sig").repartition(*_TILE).sortWithinPartitions(*_TILE)
    edges = pairs.unionByName(grouped.mapInArrow(_candidate_tiles, "a long, b long"))
    # written first: a task that also joined its links into stars would run two Python workers
    edges = saved.save(edges)
    clusters = saved.save(components(edges).withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster"))
    saved.drop(met)
    saved.drop(edges)

    # texts of documents in no cluster aren't shuffled
    texts = maybe_among(docs, F.col("doc_id"), clusters.select(F.col("rep").alias("key")), "met").where("met").drop("met")
    members = _spread(clusters.join(classes.select("rep", "d1", "d2", "n"), "rep"))
    tiles = texts.join(members.withColumnRenamed("rep", "doc_id"), "doc_id").withColumnRenamed("doc_id", "rep")
    tiles = tiles.select(*_TILE, "own", "rep", "d1", "d2", "text").repartition(*_TILE).sortWithinPartitions(*_TILE)
    links = tiles.mapInArrow(_link_tiles, "a long, b long")

    # an id with several texts joins their classes
    rows = profile.where("doc_id is not null").select("doc_id", "n", "d1", "d2")
    marks = F.struct(F.coalesce("d1", F.lit(0)), F.coalesce("d2", F.lit(0)))
    several = rows.groupBy("doc_id").agg(F.min(marks).alias("low"), F.max(marks).alias("high")).where("low <> high").select("doc_id")
    split = rows.where("n > 0").join(several, "doc_id").join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    edges = saved.save(links.unionByName(split))
    comp = components(edges)
    saved.drop(clusters)
    saved.drop(edges)
    by_class = saved.save(classes.select("d1", "d2", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("component")))
    out = lambda df: df.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    own = profile.select("doc_id", "n", "d1", "d2")
    bare = own.where("n = 0").join(comp, F.col("doc_id") == F.col("node"), "left")
    return out(own.where("n > 0").join(by_class, ["d1", "d2"], "left")).unionByName(out(bare))
