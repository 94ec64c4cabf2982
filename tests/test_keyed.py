"""Merges by key: only touched buckets are read and written, versions stay whole, old files go."""

import os

import pytest
from pyspark.sql import functions as F

from reprise.sources import sinks
from reprise.sources.keyed import KeyedTable

DDL = "k string, n int, v string"


@pytest.fixture()
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), ["k"], spark.createDataFrame([], DDL).schema, buckets=16)


@pytest.fixture()
def rows(spark):
    return lambda *v: spark.createDataFrame(list(v), DDL)


def files(root):
    """Data files with their times of change."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(os.path.join(root, "data")) for f in names if f.endswith(".parquet")}


def held(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_merge_rewrites_only_touched_buckets(table, rows, spark):
    every = [(f"key{i}", 1, "x") for i in range(200)]
    assert table.merge(rows(*every), ["n"]).buckets == list(range(16))
    before = files(table.root)
    done = table.merge(rows(("key7", 2, "y"), ("new", 1, "z")), ["n"])
    after = files(table.root)
    assert 1 <= len(done.buckets) <= 2 and len(after) - len(before) == len(done.buckets)
    assert all(after[f] == t for f, t in before.items())
    assert held(table.read()) == sorted([r for r in every if r[0] != "key7"] + [("key7", 2, "y"), ("new", 1, "z")], key=repr)
    assert held(table.read(0)) == sorted(every, key=repr)


def test_a_merge_reads_only_touched_buckets(table, rows, monkeypatch):
    table.merge(rows(*[(f"key{i}", 1, "x") for i in range(200)]), ["n"])
    opened = []
    read = KeyedTable._rows
    monkeypatch.setattr(KeyedTable, "_rows", lambda self, held, schema: opened.append(sorted(held)) or read(self, held, schema))
    done = table.merge(rows(("key3", 5, "w")), ["n"])
    assert opened == [done.buckets] and len(done.buckets) == 1


def test_replayed_versions_and_failed_ones(table, rows, spark):
    table.merge(rows(("a", 1, "x")), ["n"], version=0)
    for _ in range(2):  # the same batch again
        table.merge(rows(("a", 2, "y"), ("b", 1, "z")), ["n"], version=1)
    assert table.versions() == [0, 1] and held(table.read()) == [("a", 2, "y"), ("b", 1, "z")]
    os.makedirs(f"{table.root}/v7")  # a merge that died before its manifest was whole
    assert table.versions() == [0, 1] and held(table.read()) == [("a", 2, "y"), ("b", 1, "z")]


def test_order_ties_and_nulls(table, rows):
    table.merge(rows(("a", 5, "late"), ("a", 1, "early"), (None, 1, "null key"), ("c", None, None)), ["n"])
    table.merge(rows(("a", 3, "older"), (None, 2, "again")), ["n"], newest=True)
    assert held(table.read()) == sorted([("a", 5, "late"), (None, 2, "again"), ("c", None, None)], key=repr)
    table.merge(rows(("a", 3, "older"), ("a", 3, "older")), ["n"])
    assert ("a", 3, "older") in held(table.read())


def test_empty_changes_and_tables(table, rows):
    assert held(table.read()) == []
    assert table.merge(rows(), ["n"]).buckets == [] and held(table.read()) == []
    table.merge(rows(("a", 1, "x")), ["n"])
    assert table.merge(rows(), ["n"]).buckets == [] and held(table.read()) == [("a", 1, "x")]


def test_retention_deletes_what_no_version_names(table, rows):
    table.merge(rows(*[(f"key{i}", 0, "x") for i in range(100)]), ["n"])
    for n in range(1, 8):
        table.merge(rows(("key1", n, "y")), ["n"])
    assert table.versions() == [5, 6, 7]
    parts = files(table.root)
    assert len(parts) == 15 + 3  # fifteen buckets of the first merge, and one bucket of each version that is left
    assert held(table.read()) == sorted([(f"key{i}", 0, "x") for i in range(100) if i != 1] + [("key1", 7, "y")], key=repr)
    assert ("key1", 5, "y") in held(table.read(5))


def test_combining_rule(table, rows):
    smallest = lambda df: df.groupBy("k").agg(F.min("n").alias("n"), F.min("v").alias("v"))
    for batch in (rows(("a", 5, "m"), ("a", 7, "c")), rows(("a", 6, "b"), ("d", 1, "q"))):
        table.merge(batch, ["n"], combine=smallest)
    assert held(table.read()) == [("a", 5, "b"), ("d", 1, "q")]


def test_upsert_helper_reports_buckets(spark, rows, tmp_path):
    root = str(tmp_path / "u")
    first = sinks.write_upsert(rows(*[(f"key{i}", 1, "x") for i in range(500)]), root, ["k"], ["n"], buckets=8)
    assert first == list(range(8)) and len(sinks.write_upsert(rows(("key9", 2, "y")), root, ["k"], ["n"], buckets=8)) == 1
    assert sinks.read_latest(spark, root).where("k = 'key9'").first()["v"] == "y"
