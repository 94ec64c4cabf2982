"""JSON objects read by many tasks: every border at every place."""

import json
import random

import pytest
from pyspark.sql import functions as F

from reprise.sources import json_map, readers, sinks

AWKWARD = ['plain', 'a,b', ',', '"', '\\', '\\"', '","', '", "k": "', '{', '}', '[,]', '', ' x ', 'é,日', '\n,', '\\\\,', '{"a":1,"b":"},{"}']


@pytest.fixture()
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size, indent, separators", [(7, None, None), (16, None, (",", ":")), (61, 1, None), (1000, None, None), (1 << 20, None, None)])
def test_flat_objects(spark, tmp_path, tiny_splits, size, indent, separators):
    rng = random.Random(size)
    for n in range(3):
        pairs = {f"{rng.choice(AWKWARD)}{i}": rng.choice(AWKWARD) for i in range(12 if size < 10 else 40)}
        (tmp_path / f"{n}.json").write_text(json.dumps(pairs, indent=indent, separators=separators, ensure_ascii=n == 1), encoding="utf-8")
    tiny_splits(size)
    got = sorted(tuple(r) for r in readers.read_json_map(spark, str(tmp_path), "string").collect())
    want = sorted(kv for n in range(3) for kv in json.loads((tmp_path / f"{n}.json").read_text(encoding="utf-8")).items())
    assert got == want


@pytest.mark.parametrize("size", [13, 50, 400])
def test_nested_values(spark, tmp_path, tiny_splits, size):
    rng = random.Random(3)
    marks = {f"{i}x{i + 1}": {"falso_positivo": bool(i % 2), "motivo": rng.choice(AWKWARD), "lista": [i, i + 1]} for i in range(30)}
    (tmp_path / "marks.json").write_text("﻿\n " + json.dumps(marks) + "\n", encoding="utf-8")
    tiny_splits(size)
    rows = readers.read_json_map(spark, str(tmp_path), "struct<falso_positivo:boolean,motivo:string,lista:array<int>>", "par_id", "m")
    assert {r.par_id: r.m.asDict() for r in rows.collect()} == marks


def test_empty_objects_and_single_entries(spark, tmp_path):
    for n, body in enumerate(("{}", " { } ", '{"a":"b"}', '{ "c" : "d" }', "")):
        (tmp_path / f"{n}.json").write_text(body)
    assert sorted(tuple(r) for r in readers.read_json_map(spark, str(tmp_path), "string").collect()) == [("a", "b"), ("c", "d")]


def test_a_million_entries_by_many_tasks(spark, tmp_path, tiny_splits):
    path = tmp_path / "big.json"
    with path.open("w") as f:
        f.write("{" + ", ".join(f'"{i:07d}": "c{i % 7}"' for i in range(1_000_000)) + "}")
    tiny_splits(2 << 20)
    rows = readers.read_json_map(spark, str(tmp_path), "string", "k", "v")
    tasks = rows.select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks > 4
    assert rows.agg(F.count(F.lit(1)), F.count_distinct("k"), F.count_if(F.col("v") == "c3")).first()[:] == (1_000_000, 1_000_000, 142_857)


def test_written_objects_are_objects(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}{a}", a) for i, a in enumerate(AWKWARD)], "k string, v string").repartition(3)
    sinks.write_json_map(rows, "k", "v", str(tmp_path / "out"))
    parts = [json.loads(p.read_text(encoding="utf-8")) for p in (tmp_path / "out").glob("*.txt") if p.stat().st_size]
    assert sorted(kv for p in parts for kv in p.items()) == sorted(tuple(r) for r in rows.collect())
    assert sorted(tuple(r) for r in json_map.read_map(spark, str(tmp_path / "out"), "string", "k", "v").collect()) == sorted(tuple(r) for r in rows.collect())


def test_digest_lookup_filters_at_the_scan(spark, tmp_path):
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"), "id")
    wanted = spark.createDataFrame([(F_SHA(i),) for i in (3, 4, 4, 77, 999_999)] + [(None,)], "sha256 string")
    got = readers.rows_with_digests(rows, wanted)
    assert sorted(r.id for r in got.collect()) == [3, 4, 77]
    assert readers.rows_with_digests(rows, wanted.limit(0)).collect() == []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan


def F_SHA(i):  # noqa: N802
    import hashlib
    return hashlib.sha256(str(i).encode()).hexdigest()
