"""Upserts with repeated and null keys, and the stored keyed table."""

import pytest

from foliospark.operators import incremental
from foliospark.sources.keyed import Conflict, KeyedTable

SCHEMA = "k string, n int, w string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upsert_gives_one_row_a_key(spark):
    old = spark.createDataFrame([("a", 1, "x"), (None, 0, "old")], SCHEMA)
    new = spark.createDataFrame([("a", 2, None), ("a", 3, "y"), ("b", 5, "z"), ("b", 4, None), (None, 9, "new")], SCHEMA)
    assert rows(incremental.upsert(old, new, ["k"])) == [("a", 3, "y"), ("b", 5, "z"), (None, 0, "old")]
    assert rows(incremental.upsert(old, new, ["k"], order=["w"])) == [("a", 3, "y"), ("b", 5, "z"), (None, 0, "old")]
    assert rows(incremental.upsert(old, new.withColumn("seq", -new.n), ["k"], order=["seq"], keep_old_if_null=True)) == [("a", 2, "y"), ("b", 4, "z"), (None, 0, "old")]
    assert rows(incremental.refused(new, ["k"])) == [(None, 9, "new")]
    only = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(incremental.upsert(only.limit(0), only, ["k"])) == [("a",)]


def test_keyed_table(spark, tmp_path):
    table = KeyedTable.create(spark, f"file:{tmp_path}/t", SCHEMA, ["k"], buckets=8)
    assert table.read().count() == 0
    first = spark.createDataFrame([(f"k{i}", i, "x") for i in range(40)], SCHEMA)
    table.upsert(first)
    before = table.state()["places"]
    assert table.upsert(spark.createDataFrame([("k1", 100, None), ("k1", 101, None), (None, 1, "y")], SCHEMA)) == 2
    after = table.state()["places"]
    assert sum(before[b] != after[b] for b in before) == 1  # one bucket is written anew
    want = sorted([(f"k{i}", i, "x") for i in range(40) if i != 1] + [("k1", 101, None)], key=repr)
    assert rows(table.read()) == want
    table.upsert(first.where("n = 1"), update=["w"])
    assert ("k1", 101, "x") in rows(table.read()) and rows(table.read(version=2)) == want
    assert table.upsert(spark.createDataFrame([(None, 1, "y")], SCHEMA)) == table.upsert(first.limit(0)) == 3
    table.replace(spark.createDataFrame([("new", 7, "x")], SCHEMA), ["w"])
    assert rows(table.read()) == [("new", 7, "x")]
    table.delete(spark.createDataFrame([("new",)], "k string"))
    assert table.read().count() == 0 and table.state()["places"] == {}
    table.vacuum()
    assert table.versions() == [5] and list((tmp_path / "t" / "data").iterdir()) == []


def test_a_change_that_fails_changes_nothing_and_may_be_repeated(spark, tmp_path, monkeypatch):
    table = KeyedTable.create(spark, f"file:{tmp_path}/t", SCHEMA, ["k"], buckets=4)
    table.upsert(spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], SCHEMA))
    change = spark.createDataFrame([("a", 5, "z"), ("c", 3, "w")], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            table.upsert(change)
    assert rows(table.read()) == [("a", 1, "x"), ("b", 2, "y")]
    table.upsert(change)
    table.upsert(change)
    assert rows(table.read()) == [("a", 5, "z"), ("b", 2, "y"), ("c", 3, "w")]
    other = KeyedTable(spark, f"file:{tmp_path}/t")
    with pytest.raises(Conflict):
        other._commit(table.versions()[-1], other.state())
    assert not [f for f in (tmp_path / "t" / "manifests").iterdir() if f.name.startswith("_")]
