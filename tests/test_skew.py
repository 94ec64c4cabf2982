import itertools
import random
import statistics

from pyspark.sql import functions as F

from reprise.operators import skew


def test_pairs_of_a_hot_key_meet_once(spark):
    rows = [("hot", i) for i in range(60)] + [("a", 1), ("b", 1), ("b", 2)]
    df = spark.createDataFrame(rows, "k string, id int")
    got = skew.within_key_pairs(df, ["k"], "id", [], block=7).select("k", "a.id", F.col("b.id").alias("b")).collect()
    want = [("hot", a, b) for a, b in itertools.combinations(range(60), 2)] + [("b", 1, 2)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_lead_crosses_ranges(spark):
    rng = random.Random(3)
    rows = [(g, p) for g in "xyz" for p in rng.sample(range(500), 40)] + [("w", 5)]
    df = spark.createDataFrame(rows, "g string, p int")
    out = skew.lead_within(df, "g", F.col("p"), [F.col("p")], F.struct("p"), "nx", width=16)
    got = {(r["g"], r["p"]): r["nx"]["p"] if r["nx"] else None for r in out.collect()}
    for g in "wxyz":
        ordered = sorted(p for k, p in rows if k == g)
        assert [got[g, p] for p in ordered] == [*ordered[1:], None]


def test_rank_equals_sorted_position(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4), rng.randrange(3), f"{rng.getrandbits(64):016x}") for _ in range(400)]
    got = skew.ranked(spark.createDataFrame(rows, "x int, y int, d string"), ["x", "y"], "d", "n").collect()
    want = sorted(rows, key=lambda r: (-r[0], -r[1], r[2]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r["n"])] == want
    assert sorted(r["n"] for r in got) == list(range(1, 401))


def test_exact_median(spark):
    rng = random.Random(9)
    rows = [(k, rng.randrange(-50, 50)) for k in "abc" for _ in range(rng.choice((31, 32)))] + [("d", 4), ("d", 5)]
    got = skew.exact_median(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", "m").collect()
    assert {r["k"]: r["m"] for r in got} == {k: statistics.median(v for kk, v in rows if kk == k) for k in "abcd"}



def test_wanted_rows(spark):
    df = spark.createDataFrame([("hot", i % 7) for i in range(50)] + [("a", 1), ("b", 2)], "k string, v int")
    wanted = spark.createDataFrame([("hot",), ("b",)], "k string")
    count = lambda rows: rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = skew.reduce_wanted(df, wanted, "k", count).collect()
    assert len(got) == 8 and {r["k"] for r in got} == {"hot", "b"} and sum(r["n"] for r in got) == 51
    left = skew.unmatched(count(df), wanted.union(wanted), ["k"]).collect()
    assert [tuple(r) for r in left] == [("a", 1, 1)]


def test_across_key_pairs_meet_in_bounded_cells(spark):
    left = spark.createDataFrame([("hot", i) for i in range(2000)] + [("a", 1), ("lone", 5)], "k string, l int")
    right = spark.createDataFrame([("hot", i) for i in range(30)] + [("a", 7), ("a", 8)], "g string, r int")
    edges = spark.createDataFrame([("hot", "hot", 1), ("hot", "a", 2), ("a", "a", 3), ("a", "none", 4)], "k string, g string, w int")
    got = skew.across_key_pairs(edges, left, right, "k", "g", block=100)
    want = edges.join(left, "k").join(right, "g")
    flat = lambda df: sorted(map(tuple, df.select("k", "g", "w", "l", "r").collect()))
    assert flat(got) == flat(want) and len(flat(want)) == 2000 * 30 + 2000 * 2 + 2
