"""WARC archives: a writer with one gzip member a record, and a splittable reader.

Files are opened through pyarrow's file systems, named by URI, so that tasks reach the shared store themselves.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.tables import maybe_among, scratch_path, text_or_empty

MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive that a reading task owns.
SPLIT = 4 << 20
TASKS = 100_000
#: Compressed bytes after which a task goes on in another archive.
ARCHIVE = 1 << 30
READ = 1 << 18
#: Payloads of fewer bytes are never deduplicated.
LEAST_BYTES = 1000
#: Keys that the rows of one repeated digest are spread over.
SALTS = 16
_PAGE = "urn:x-page:"


def with_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id, url, html) as (page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to).

    Of records with equal payloads of at least `least_bytes` bytes the one with the largest page_id is the response
    and others revisit it; rows that repeat that id are responses too, and so is a row without an id. Digests are
    aggregated before the shuffle and only those that repeat are joined back.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(text_or_empty("html"), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    owners = rows.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest"]
    rows = maybe_among(rows, F.xxhash64("payload_digest"), owners.select(F.xxhash64("payload_digest").alias("key")), "met")
    spread = owners.select("payload_digest", "owner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = rows.where("met").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(spread, ["payload_digest", "salt"], "left")
    met = met.withColumn("refers_to", F.when(F.col("owner") != F.col("page_id"), F.col("owner")))
    rows = met.select(*names, "refers_to").unionByName(rows.where("not met").select(*names, F.lit(None).cast("long").alias("refers_to")))
    return rows.select(*names, F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit has the HTTP head and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    clean = "".join(c for c in url or "" if c > " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_PAGE}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {clean}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{_PAGE}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_archives(records: DataFrame, folder: str, archive: int = ARCHIVE) -> DataFrame:
    """Writes archives of about `archive` bytes at most and returns (path, bytes, records) of each.

    A task writes under a name of its own attempt and then moves the file to a name by partition and number, so a
    repeated task leaves whole archives, one of each name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        store.create_dir(root, recursive=True)
        draft = f"{root}/.{task.partitionId():05d}-{task.taskAttemptId()}"
        out, number, size, n = None, 0, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            name = f"part-{task.partitionId():05d}-{number:05d}.warc.gz"
            store.move(draft, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([n])], ["path", "bytes", "records"])

        for batch in batches:
            for row in batch.to_pylist():
                out = out or store.open_output_stream(draft, compression=None)
                member = record(row["page_id"], row["url"], row["payload"], row["payload_bytes"], row["payload_digest"], row["record_type"], row["refers_to"])
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= archive:
                    yield close()
                    out, number, size, n = None, number + 1, 0, 0
        if out:
            yield close()

    return records.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to").mapInArrow(run, "path string, bytes long, records long")


class DamagedArchiveError(ValueError):
    """Bytes where a record should be that aren't one."""


class _Window:
    """Bytes of a file by offset, read in pieces as they are asked for."""

    def __init__(self, file: pa.NativeFile, size: int, at: int):
        self.file, self.size, self.at, self.data = file, size, at, bytearray()

    def more(self) -> bool:
        end = self.at + len(self.data)
        if end >= self.size:
            return False
        self.file.seek(end)
        piece = self.file.read(min(READ, self.size - end))
        self.data += piece
        return bool(piece)

    def forget(self, offset: int) -> None:
        if offset - self.at > READ:
            del self.data[: offset - self.at]
            self.at = offset


def _member(window: _Window, at: int, head_only: bool = False) -> tuple[bytes, int] | None:
    """The gzip member at an offset and where it ends; None if its head doesn't decode to WARC/. DamagedArchiveError if it does and the rest can't be decoded or is cut off."""
    probe, head, fed = zlib.decompressobj(31), b"", at - window.at
    while len(head) < 5:  # five bytes first: a record damaged further on still has its head
        if probe.eof or (fed >= len(window.data) and not window.more()):
            return None
        try:
            head += probe.decompress(window.data[fed : fed + READ], 5 - len(head))
        except zlib.error:
            return None
        fed = min(fed + READ, len(window.data))
    if head != b"WARC/" or head_only:
        return (b"", at) if head == b"WARC/" else None
    z, out, fed = zlib.decompressobj(31), bytearray(), at - window.at
    while not z.eof:
        if fed >= len(window.data) and not window.more():
            raise DamagedArchiveError(f"the record at {at} is cut off")
        try:
            out += z.decompress(window.data[fed : fed + READ])
        except zlib.error as e:
            raise DamagedArchiveError(f"the record at {at} is damaged: {e}") from e
        fed = min(fed + READ, len(window.data))
    return bytes(out), window.at + fed - len(z.unused_data)


def members(store: fs.FileSystem, path: str, size: int, start: int, end: int, gapless: bool = False) -> Iterator[bytes]:
    """The decompressed records whose gzip member starts in [start, end): sought by magic and taken for one if its head decodes to WARC/.

    A record whose head is whole and whose rest is damaged or cut off raises DamagedArchiveError. Bytes that are no record are
    passed over, unless the archive is `gapless`: then it begins with a record and each has to begin where the one before ends,
    and the one after a range's last, whose owner may find nothing there, is looked at too. Whatever is damaged is then some
    reader's error, heads as well.
    """
    with store.open_input_file(path) as file:
        window, at = _Window(file, size, start), start
        known = gapless and start == 0
        while at < end:
            if not known:
                found = window.data.find(MAGIC, at - window.at)
                if found < 0:
                    at = max(at, window.at + len(window.data) - len(MAGIC) + 1)
                    window.forget(at)
                    if not window.more():
                        return
                    continue
                at = window.at + found
                if at >= end:
                    return
            window.forget(at)
            found = _member(window, at)
            if found is None:
                if known:
                    raise DamagedArchiveError(f"{path} has no record at {at}")
                at += 1
                continue
            yield found[0]
            at, known = found[1], gapless
        if known and at < size and _member(window, at, head_only=True) is None:
            raise DamagedArchiveError(f"{path} has no record at {at}")


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); a stored payload is measured and digested anew."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix(_PAGE)) else None
    kind = fields["WARC-Type"]
    size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return number(fields["WARC-Record-ID"]), size, digest, kind, number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None


def read_archives(spark: SparkSession, archives: DataFrame, split: int = SPLIT, gapless: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records in archives (path, bytes), `gapless` as those that write_archives() makes; DamagedArchiveError rather than a record less.

    A task takes one range of `split` bytes, or a few where there are more ranges than TASKS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                rows = []
                for raw in members(store, path, row["bytes"], row["start"], min(row["start"] + split, row["bytes"]), gapless):
                    rows.append(parse(raw))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    n = archives.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    return ranges.repartition(min(int(n), TASKS)).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads the archives back: one row for each page.

    A null html is an empty payload, a null url an empty one; a null page_id comes back null. Every payload of a
    response is checked against its digest while it is read.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark)
    listing = f"{folder}-listing"
    write_archives(with_types(pages), folder if "://" in folder else f"file://{folder}").write.parquet(listing)
    return read_archives(spark, spark.read.parquet(listing))
