from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar.operators.index import last_wins
from lodestar.plans.compound import SearchStore
from lodestar.sources import versioned
from lodestar.sources.versioned import ConcurrentWriteError, VersionedTable

T0 = datetime(2024, 1, 1)


def rows(spark, ids, text="t"):
    return spark.createDataFrame([(k, f"{text}{k}", k % 3) for k in ids], "id long, text string, part int")


def content(table, version=None):
    return {r.id: r.text for r in table.read(version).collect()}


def written(path):
    """Bytes of rows below a path."""
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_two_writers_cant_clobber_each_other(spark, tmp_path):
    first, second = (VersionedTable(spark, f"file://{tmp_path}/t", "id") for _ in range(2))
    first.write(rows(spark, range(3)))
    base = second._latest()  # the second writer looks, and then the first is faster
    first.append(rows(spark, range(100, 105)))
    want = content(first)
    for step in (lambda: second.write(rows(spark, [900]), base=base), lambda: second.change(rows(spark, [0], "lost"), base=base), lambda: second.append(rows(spark, [900]), base=base), lambda: second.change(gone=rows(spark, [1]), base=base)):
        with pytest.raises(ConcurrentWriteError):
            step()
        assert content(first) == content(second) == want
    # nothing of the refused writers is left behind, and appends that looked at nothing go through
    assert len([p for p in (tmp_path / "t").iterdir() if p.name[:3] in ("_v=", "_d=")]) == 2
    assert content(VersionedTable(spark, f"file://{tmp_path}/t"), second.append(rows(spark, [900]))) == want | {900: "t900"}


def test_a_number_claimed_in_between_is_not_taken(spark, tmp_path, monkeypatch):
    table, other = (VersionedTable(spark, f"file://{tmp_path}/t", "id") for _ in range(2))
    table.write(rows(spark, range(3)))
    looked = VersionedTable.described
    raced = []

    def slow(self, n):
        if self is table and not raced:
            raced.append(other.append(rows(spark, [50])))  # after the check, before the commit
        return looked(self, n)

    monkeypatch.setattr(VersionedTable, "described", slow)
    with pytest.raises(ConcurrentWriteError):
        table.change(rows(spark, [0], "lost"))
    raced.clear()
    table.append(rows(spark, [60]))
    assert content(table) == {k: f"t{k}" for k in (0, 1, 2, 50, 60)} and content(other) == content(table)


def test_a_writer_that_died_is_passed_over(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "id")
    table.write(rows(spark, range(3)))
    (tmp_path / "t" / f"commit-2-s{versioned.SCHEMA_VERSION}").touch()  # claimed, and never written
    assert table.versions() == [1]
    assert table.change(rows(spark, [1], "new")) == 3
    assert content(table) == {0: "t0", 1: "new1", 2: "t2"}


def test_changes_merge_when_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned, "COMPACT_AT", 99)
    table = VersionedTable(spark, f"file://{tmp_path}/t", "id")
    with pytest.raises(ValueError):
        table.change(rows(spark, [1]))
    model = {k: f"t{k}" for k in range(50)}
    table.write(rows(spark, range(50)), "part")
    states = {1: dict(model)}
    for step in range(6):
        new, gone = range(step * 5, step * 5 + 7), [step, 40 + step, 1000]
        n = table.change(rows(spark, new, f"s{step}-"), rows(spark, gone), "part")
        model = {k: v for k, v in model.items() if k not in gone} | {k: f"s{step}-{k}" for k in new}
        states[n] = dict(model)
        if step == 3:
            n = table.append(rows(spark, [2000 + step]), "part")
            model[2000 + step] = f"t{2000 + step}"
            states[n] = dict(model)
    # a key that is replaced and deleted by one change is replaced: a change counts against folders before it
    assert all(content(table, n) == want for n, want in states.items())
    assert table.read().count() == len(model)
    n = table.compact("part")
    assert content(table) == model and len(table.folders(n)) == 1
    table.vacuum()
    assert content(table) == model and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("_")]) == 1
    assert table.change(gone=rows(spark, [])) == n + 1 and content(table) == model
    nulls = spark.createDataFrame([(None, "x", 1)], "id long, text string, part int")
    table.append(nulls, "part")
    table.change(gone=nulls)  # a null key is no key
    assert table.read().where("id is null").count() == 1


def test_changes_compact_by_themselves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned, "COMPACT_AT", 3)
    table = VersionedTable(spark, f"file://{tmp_path}/t", "id")
    table.write(rows(spark, range(9)))
    for k in range(7):
        table.change(rows(spark, [k], "n"))
        assert len(table.folders()) <= 3
    assert content(table) == {k: f"{'n' if k < 7 else 't'}{k}" for k in range(9)}


def test_folders_no_commit_names_are_left_for_a_while(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "id")
    table.write(rows(spark, range(3)))
    table._put(rows(spark, [7]), "_v", None)  # a writer on its way to a commit
    table.vacuum()
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("_v=")]) == 2
    table.vacuum(grace=-1)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("_v=")]) == 1 and table.read().count() == 3


def docs(spark, ids, text="t"):
    return spark.createDataFrame([(f"{k}", [float(k), 1.0], f"{text}{k} " + "padding" * 20) for k in ids], "doc_id string, embedding array<double>, text string")


def test_a_change_of_one_row_writes_in_proportion(spark, tmp_path):
    s = SearchStore(spark, f"file://{tmp_path}/s")
    s.index(docs(spark, range(4000)), now=T0)
    s.sync()
    whole, indexed = written(tmp_path / "s" / "data"), written(tmp_path / "s" / "index")
    s.update(docs(spark, [7], "new"), now=T0 + timedelta(1))
    s.delete(docs(spark, [8]), now=T0 + timedelta(1))
    s.delete(docs(spark, [9]), soft=False)
    s.index(docs(spark, [9000]), now=T0 + timedelta(1))
    s.index(docs(spark, [10], "put"), on_conflict="replace", now=T0 + timedelta(1))
    s.sync()
    assert written(tmp_path / "s" / "data") < 1.2 * whole and written(tmp_path / "s" / "index") < 1.2 * indexed
    got = {r.doc_id: r.text.split()[0] for r in s.data.read().where("not is_deleted").collect()}
    assert got == {str(k): f"t{k}" for k in range(4000) if k not in (8, 9)} | {"7": "new7", "10": "put10", "9000": "t9000"}
    assert {r.doc_id for r in s.index_table.read().collect()} == set(got) | {"9"}  # a hard deletion leaves no change to follow
    with pytest.raises(ValueError, match="components"):
        s.update(spark.createDataFrame([("7", [1.0])], "doc_id string, embedding array<double>"))


def test_store_changes_are_made_anew_when_another_is_faster(spark, tmp_path, monkeypatch):
    s, other = (SearchStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    s.index(docs(spark, range(5)), now=T0)
    read, raced = VersionedTable.read, []

    def slow(self, version=None):
        if self is s.data and not raced:
            raced.append(1)
            other.update(docs(spark, [3], "other"), now=T0)
        return read(self, version)

    monkeypatch.setattr(VersionedTable, "read", slow)
    s.delete(docs(spark, [1]), now=T0)
    got = {r.doc_id: (r.text.split()[0], r.is_deleted) for r in s.data.read().collect()}
    assert raced and got == {"0": ("t0", False), "1": ("t1", True), "2": ("t2", False), "3": ("other3", False), "4": ("t4", False)}


def test_copies_of_the_index_and_snapshots_are_vacuumed(spark, tmp_path):
    s = SearchStore(spark, f"file://{tmp_path}/s")
    s.index(docs(spark, range(20)), now=T0)
    for k in range(4):
        s.snapshot()
        s.sync()
    for name in ("index", "snapshot"):
        assert len([p for p in (tmp_path / "s" / name).iterdir() if p.name.startswith("_v=")]) == 2


def test_equal_times_are_settled_alike_on_every_run(spark):
    some = [("a", 1, [1.0], False), ("a", 1, [3.0], False), ("a", 1, [2.0], False), ("b", 2, None, True), ("b", 2, [9.0], False)]
    for order in (some, some[::-1]):
        df = spark.createDataFrame(order, "id string, at int, embedding array<double>, is_deleted boolean").repartition(5)
        assert sorted(map(tuple, last_wins(df, "id", "at").collect())) == [("a", 1, [3.0], False), ("b", 2, None, True)]
    with_map = spark.createDataFrame([("a", 1, {"x": 1})], "id string, at int, m map<string,int>")
    assert last_wins(with_map, "id", "at").where(F.col("m")["x"] == 1).count() == 1
