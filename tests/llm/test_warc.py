import gzip
import hashlib

import pyarrow.fs as fs
import pytest

from lodestar.llm import warc

SCHEMA = "page_id long, url string, html string, owner string"


def brute(rows):
    by = {}
    for i, _, h, _ in rows:
        p = (h or "").encode()
        if i is not None and len(p) >= 1000:
            by[p] = max(by.get(p, i), i)
    out = []
    for i, _, h, _ in rows:
        p = (h or "").encode()
        owner = by.get(p) if i is not None else None
        revisit = owner is not None and owner != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", owner if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = [(k, f"http://x/{k}", f"page {k % 7} " * (k % 13 * 30), "o") for k in range(150)]
    rows += [(500, None, None, None), (501, "http://y z", "é" * 600, None), (502, "", "é" * 600, None), (None, "u", "é" * 600, None), (503, "u", "\x1f\x8b\x08" * 2000, None), (503, "u", "\x1f\x8b\x08" * 2000, None), (504, "u", "z" * 3_000_000, None)]
    got = warc.warc_round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_empty_table(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_split_owns_what_starts_in_it(tmp_path, monkeypatch):
    """However small the splits, and with false magic between members, each record is read once."""
    monkeypatch.setattr(warc, "READ", 64)
    parts = [warc.record(k, "u", (b"text %d " % k) * 40, 40 * len(b"text %d " % k), hashlib.sha1((b"text %d " % k) * 40).hexdigest(), "response", None) for k in range(30)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(parts))
    assert gzip.decompress(path.read_bytes()).count(b"WARC/1.1") == 30
    noisy = tmp_path / "b.warc.gz"
    noisy.write_bytes(b"\x1f\x8b\x08junk" + parts[0] + gzip.compress(b"no record") + parts[1] + b"\x1f\x8b\x08")
    store = fs.LocalFileSystem()
    for size in (17, 100, 4096):
        raw = [r for a in range(0, path.stat().st_size, size) for r in warc.members(store, str(path), path.stat().st_size, a, min(a + size, path.stat().st_size))]
        assert [warc.parse(r)[0] for r in raw] == list(range(30))
        raw = [r for a in range(0, noisy.stat().st_size, size) for r in warc.members(store, str(noisy), noisy.stat().st_size, a, min(a + size, noisy.stat().st_size))]
        assert [warc.parse(r)[0] for r in raw] == [0, 1]


def test_ranges_are_read_by_several_tasks_and_archives_roll_over(spark, tmp_path):
    rows = [(k, f"http://x/{k}", hashlib.sha256(b"%d" % k).hexdigest() * 40, None) for k in range(120)]
    records = warc.with_types(spark.createDataFrame(rows, SCHEMA)).coalesce(2)
    listing = spark.createDataFrame(warc.write_archives(records, f"file://{tmp_path}/w", archive=2000).collect())
    assert listing.count() > 10 and sum(r.records for r in listing.collect()) == 120
    assert all((tmp_path / "w" / r.path.rsplit("/", 1)[1]).stat().st_size == r.bytes for r in listing.collect())
    one = spark.createDataFrame(warc.write_archives(records.coalesce(1), f"file://{tmp_path}/v").collect())
    assert one.count() == 1
    read = warc.read_archives(spark, one, split=900)
    assert read.rdd.getNumPartitions() > 8
    assert sorted(r.page_id for r in read.collect()) == list(range(120))


def archive(n=20):
    parts = []
    for k in range(n):
        payload = hashlib.sha256(b"%d" % k).hexdigest().encode() * 30
        parts.append(warc.record(k, "u", payload, len(payload), hashlib.sha1(payload).hexdigest(), "response", None))
    return parts


def read_back(path, split, gapless=True):
    size = path.stat().st_size
    return [warc.parse(r)[0] for a in range(0, size, split) for r in warc.members(fs.LocalFileSystem(), str(path), size, a, min(a + split, size), gapless)]


def test_damage_and_cuts_are_errors_wherever_they_are(tmp_path):
    """A flipped byte anywhere in a record, its head and its checksum included, and any cut, whatever the ranges."""
    parts = archive()
    whole, at = b"".join(parts), sum(map(len, parts[:7]))
    path = tmp_path / "a.warc.gz"
    for split in (150, 1000, 1 << 20):
        path.write_bytes(whole)
        assert read_back(path, split) == list(range(20))
        for offset in (0, 2, 11, 15, len(parts[7]) // 2, len(parts[7]) - 6, len(parts[7]) - 2):
            bad = bytearray(whole)
            bad[at + offset] ^= 0x41
            path.write_bytes(bytes(bad))
            with pytest.raises(ValueError):
                read_back(path, split)
        for kept in (len(whole) - 3, len(whole) - len(parts[19]) + 12, len(whole) - len(parts[19]) + 2, 40):
            path.write_bytes(whole[:kept])
            with pytest.raises(ValueError):
                read_back(path, split)
    # an archive of others, with bytes between its records: still no record with a whole head is lost silently
    bad = bytearray(whole)
    bad[at + len(parts[7]) // 2] ^= 0x41
    path.write_bytes(bytes(bad))
    with pytest.raises(warc.DamagedArchiveError, match="damaged"):
        read_back(path, 1000, gapless=False)
    path.write_bytes(whole[:-9])
    with pytest.raises(warc.DamagedArchiveError, match="cut off"):
        read_back(path, 1000, gapless=False)


def test_a_damaged_archive_fails_the_job(spark, tmp_path):
    parts = archive(5)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts[:3]) + parts[3][:-20] + parts[4])
    listing = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", (tmp_path / "a.warc.gz").stat().st_size)], "path string, bytes long")
    with pytest.raises(Exception, match="DamagedArchiveError|damaged"):
        warc.read_archives(spark, listing, split=100).collect()


def test_a_third_of_all_pages_is_one(spark):
    rows = [(k, "u", "hot page " * 200 if k % 3 == 0 else f"page {k} " * 200, None) for k in range(300)]
    got = warc.warc_round_trip(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
