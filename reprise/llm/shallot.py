"""k-means in integers by Shallot search.

Vectors of exactly ``dim`` components, none null or non-finite, become integers floor(scale * x). The first centroids are the k
vectors with the smallest SHA-256 of their id; each round assigns every vector to its nearest centroid (ties: the smaller
number) and replaces each non-empty centroid by the floor of its vectors' mean.

A vector remembers its nearest and second-nearest centroid, an upper bound of the distance to the first and a lower bound of the
distance to all others. When centroids have moved the bounds move with them, and a vector whose bounds still do not meet,
nor half the way to the next centroid, keeps its place unread. Otherwise both remembered centroids are measured; the closer one
is the middle of a ball, whose centroids are visited in order of their distance from it. The ball's radius is the distance to its
middle plus that to the second-nearest centroid so far, and shrinks with the latter. Bounds are floats with a margin; the
centroids that survive them are compared by squared distance in integers, so the result is exactly that of a full search.

On Spark: the integers are stored once, in blocks of one Arrow batch, in a table bucketed by block. Bounds are a table of 24
bytes a vector, bucketed alike, written anew each round; joining the two needs no shuffle. A round sends k x dim partial sums a
block through an aggregation to the driver, which holds k centroids.

Defined cases: an empty table, or one without such vectors, gives no rows; rows that repeat an id are vectors of their own, and
among the first centroids are ordered by their components; rows without an id are clustered and are chosen as first centroids
last; with fewer than k vectors each is a centroid; integers beyond 2^62 count as 2^62, and distances or sums of distances
beyond the largest long as that; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.llm.common import in_small_batches
from reprise.session import materialise, scratch_path

CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
DIM = 64
LARGEST = (1 << 63) - 1
#: Floats may be off by far less than this share.
MARGIN = 1e-9


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    most = float(1 << 62)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x.astype(np.float64)), -most, most).astype(np.int64)


class Centroids:
    """Centroids with their distances from each other, their neighbours by distance, and how far they came."""

    def __init__(self, points: list[list[int]], before: "Centroids | None" = None):
        self.points = points
        self.widest = max((abs(x) for p in points for x in p), default=0)
        self.array = np.array(points, np.int64)
        n = len(points)
        self.apart = np.array([[math.dist(a, b) for b in points] for a in points]).reshape(n, n)
        self.order = np.argsort(self.apart, axis=1, kind="stable")
        for i in range(n):  # itself first, even if another lies in the same place
            row = self.order[i].tolist()
            row.remove(i)
            self.order[i] = [i, *row]
        self.half = np.array([self.apart[i, self.order[i, 1]] / 2 if n > 1 else np.inf for i in range(n)])
        moved = np.array([math.dist(a, b) for a, b in zip(points, before.points)]) if before else np.zeros(n)
        self.moved = moved * (1 + MARGIN)
        far = np.sort(self.moved)
        # The furthest that any centroid but the i-th has moved.
        self.others_moved = np.where(self.moved == far[-1], far[-2] if n > 1 and (self.moved == far[-1]).sum() == 1 else far[-1], far[-1]) if n else far


def squared(x: np.ndarray, centroids: Centroids, rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Squared distances of the rows to a centroid each; as Python integers where a long could overflow."""
    widest = max(centroids.widest, int(np.abs(x).max(initial=0)))
    if x.shape[1] * (2 * widest) ** 2 <= LARGEST:
        apart = x[rows] - centroids.array[numbers]
        return np.einsum("ij,ij->i", apart, apart)
    return ((x[rows].astype(object) - centroids.array[numbers].astype(object)) ** 2).sum(axis=1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Bounds:
    """What the vectors of a block remember."""

    def __init__(self, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.near, self.second, self.upper, self.lower = near, second, upper, lower

    @classmethod
    def unknown(cls, n: int, k: int) -> "Bounds":
        return cls(np.zeros(n, np.int32), np.full(n, min(1, k - 1), np.int32), np.full(n, np.inf), np.zeros(n))

    def bytes(self) -> bytes:
        return b"".join(v.tobytes() for v in (self.near, self.second, self.upper, self.lower))

    @classmethod
    def read(cls, raw: bytes) -> "Bounds":
        n = len(raw) // 24
        number = np.frombuffer(raw, np.int32, 2 * n)
        reach = np.frombuffer(raw, np.float64, 2 * n, 8 * n)
        return cls(number[:n].copy(), number[n:].copy(), reach[:n].copy(), reach[n:].copy())


def assign(x: np.ndarray, centroids: Centroids, bounds: Bounds) -> int:
    """Moves the vectors ``x`` to their nearest centroid; returns how many distances were measured."""
    if len(centroids.points) < 2:
        return 0
    b = bounds
    b.upper += centroids.moved[b.near]
    b.lower -= centroids.others_moved[b.near]
    safe = np.maximum(b.lower, centroids.half[b.near]) * (1 - MARGIN)
    rows = np.flatnonzero(~(b.upper * (1 + MARGIN) < safe))
    first = squared(x, centroids, rows, b.near[rows])
    b.upper[rows] = _root(first)
    left = ~(b.upper[rows] * (1 + MARGIN) < safe[rows])
    measured = len(rows)
    rows, near_d = rows[left], first[left]
    near, second = b.near[rows], b.second[rows]
    second_d = squared(x, centroids, rows, second)
    measured += len(rows)
    known = np.stack([near, second])
    swap = (second_d < near_d) | ((second_d == near_d) & (second < near))
    near, second = np.where(swap, second, near), np.where(swap, near, second)
    near_d, second_d = np.where(swap, second_d, near_d), np.where(swap, near_d, second_d)
    middle, reach = near.copy(), _root(near_d)
    active = np.arange(len(rows))
    for step in range(1, len(centroids.points)):
        number = centroids.order[middle[active], step]
        within = centroids.apart[middle[active], number] * (1 - MARGIN) <= (reach[active] + _root(second_d[active])) * (1 + MARGIN)
        active, number = active[within], number[within]
        new = (number != known[0, active]) & (number != known[1, active])
        at, number = active[new], number[new]
        if not len(at):
            if not len(active):
                break
            continue
        d = squared(x, centroids, rows[at], number)
        measured += len(at)
        nearer = (d < near_d[at]) | ((d == near_d[at]) & (number < near[at]))
        between = ~nearer & ((d < second_d[at]) | ((d == second_d[at]) & (number < second[at])))
        i = at[nearer]
        second[i], second_d[i] = near[i], near_d[i]
        near[i], near_d[i] = number[nearer], d[nearer]
        i = at[between]
        second[i], second_d[i] = number[between], d[between]
    b.near[rows], b.second[rows], b.upper[rows], b.lower[rows] = near, second, _root(near_d), _root(second_d)
    return measured


# ---- on the cluster ----


def _finite(column: str, dim: int) -> F.Column:
    inside = f"forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    return F.coalesce(F.expr(f"size({column}) = {dim} and {inside}"), F.lit(False))


def kept_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    v = F.col(vec_col) if dict(df.dtypes)[vec_col] == "array<float>" else F.col(vec_col).cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(_finite("v", dim))


def _blocks(kept: DataFrame, dim: int, scale: int) -> DataFrame:
    """(block, ids, points): the integers of an Arrow batch in as few bytes each as they need."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
            widest = int(np.abs(x).max())
            raw = x.astype(np.int16 if widest < 1 << 15 else np.int32 if widest < 1 << 31 else np.int64).tobytes()
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("vec_id"))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), ids, pa.array([raw], pa.binary())], names=["block", "ids", "points"])
            block += 1

    return kept.mapInArrow(run, "block long, ids array<long>, points binary")


def _points(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, {2: np.int16, 4: np.int32, 8: np.int64}[len(raw) // (n * dim)]).astype(np.int64).reshape(n, dim)


class _Tables:
    """Tables of the shared folder bucketed by block, known to the session until they are forgotten."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, df: DataFrame, label: str) -> DataFrame:
        name = f"shallot_{label}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "block").option("path", scratch_path(self.spark, f"shallot-{label}")).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def forget(self) -> None:
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")


_SUMS = "array<struct<cluster:int,rows:long,high:array<long>,low:array<long>>>"


def _sums(x: np.ndarray, near: np.ndarray, widest: int) -> list[dict]:
    """Rows and componentwise sums of the block's clusters; a sum is high * 2^32 + low."""
    out = []
    for c in np.unique(near).tolist():
        own = x[near == c]
        total = own.sum(axis=0) if len(own) * max(widest, 1) <= LARGEST else own.astype(object).sum(axis=0)
        out.append({"cluster": c, "rows": len(own), "high": [int(t) >> 32 for t in total], "low": [int(t) & 0xFFFFFFFF for t in total]})
    return out


def _assigned(rows: DataFrame, centroids: Centroids, dim: int) -> DataFrame:
    """(block, bounds, sums) after one assignment; the bounds of the round before may be null."""
    sums = pa.list_(pa.struct([("cluster", pa.int32()), ("rows", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n, points, known in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "points", "bounds"))):
                x = _points(points, n, dim)
                bounds = Bounds.unknown(n, len(centroids.points)) if known is None else Bounds.read(known)
                assign(x, centroids, bounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([bounds.bytes()], pa.binary()),
                     pa.array([_sums(x, bounds.near, int(np.abs(x).max()))], sums)], names=["block", "bounds", "sums"])

    return rows.select("block", F.size("ids").alias("n"), "points", "bounds").mapInArrow(run, f"block long, bounds binary, sums {_SUMS}")


def _new_centroids(bounds: DataFrame, old: Centroids) -> Centroids:
    """Floors of the means, from at most k x dim sums."""
    wide = "decimal(38,0)"
    parts = bounds.select(F.explode("sums").alias("s")).select("s.cluster", "s.rows", F.posexplode(F.arrays_zip("s.high", "s.low")).alias("at", "p"))
    found = parts.groupBy("cluster", "at").agg(
        F.sum("rows").alias("rows"), F.sum(F.col("p.high").cast(wide)).alias("high"), F.sum(F.col("p.low").cast(wide)).alias("low")).collect()
    points = [list(p) for p in old.points]
    for r in found:
        points[r["cluster"]][r["at"]] = ((int(r["high"]) << 32) + int(r["low"])) // r["rows"]
    return Centroids(points, old)


def _distances(rows: DataFrame, centroids: Centroids, dim: int) -> DataFrame:
    """(vec_id, cluster, distance) after the last assignment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (points, known) in enumerate(zip(batch.column("points").to_pylist(), batch.column("bounds").to_pylist())):
                ids = batch.column("ids")[k].values
                x, bounds = _points(points, len(ids), dim), Bounds.unknown(len(ids), len(centroids.points)) if known is None else Bounds.read(known)
                assign(x, centroids, bounds)
                d = squared(x, centroids, np.arange(len(x)), bounds.near)
                yield pa.RecordBatch.from_arrays([ids, pa.array(bounds.near), pa.array([min(int(v), LARGEST) for v in d], pa.int64())],
                                                 names=["vec_id", "cluster", "distance"])

    return rows.select("ids", "points", "bounds").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM,
            scale: int = SCALE, salt: str = "3:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid) of every vector that is kept."""
    spark = df.sparkSession
    kept = kept_vectors(in_small_batches(df), id_col, vec_col, dim)
    rank = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(rank.asc_nulls_last(), "v").limit(k).collect()  # k vectors
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    centroids = Centroids([integers(np.array(r["v"]), scale).tolist() for r in first])
    tables = _Tables(spark)
    # The only shuffle of the vectors.
    points = tables.write(_blocks(kept, dim, scale).repartition(tables.buckets, "block"), "points")
    rows = points.withColumn("bounds", F.lit(None).cast("binary"))
    for _ in range(rounds):
        bounds = tables.write(_assigned(rows, centroids, dim), "bounds")
        centroids = _new_centroids(bounds, centroids)
        rows = points.join(bounds.select("block", "bounds").hint("shuffle_hash"), "block")
    found = materialise(_distances(rows, centroids, dim), "shallot-distances")
    tables.forget()
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    inertia = min(sum(sums.values()), LARGEST)
    # One row per cluster.
    said = spark.createDataFrame(
        [(c, min(sums[c], LARGEST), inertia, hashlib.sha256(",".join(map(str, centroids.points[c])).encode()).hexdigest(), centroids.points[c]) for c in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return found.join(F.broadcast(said), "cluster").select("vec_id", "cluster", "distance", *said.columns[1:])


def sql(k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> str:
    def nearest(n: int) -> str:
        return f"""a{n} as materialized (
  select vec_id, v, c, d from (
    select k.vec_id, k.v, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint d from kept k, c{n} c)
  qualify row_number() over (partition by vec_id order by d, c) = 1)"""

    def mean(n: int) -> str:
        return f"""c{n + 1} as materialized (
  select o.c, coalesce(m.v, o.v) v from c{n} o left join (
    select c, list(q order by i) v from (
      select c, i, ((s - ((s % n) + n) % n) // n)::bigint q from (
        select c, i, sum(x) s, count(*) n from (select c, unnest(v) x, generate_subscripts(v, 1) i from a{n}) group by c, i))
    group by c) m using (c))"""

    steps = ",\n".join(f"{nearest(n)},\n{mean(n)}" for n in range(rounds))
    return f"""
with kept as materialized (
  select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) v from embeddings
  where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dim}),
c0 as materialized (
  select (row_number() over (order by sha256('3:' || vec_id)) - 1)::int c, v from kept qualify c < {k}),
{steps},
{nearest(rounds)}
select vec_id, a.c cluster, d distance, sum(d) over (partition by a.c)::bigint cluster_inertia, sum(d) over ()::bigint inertia,
  sha256(array_to_string(o.v, ',')) centroid_sha256
from a{rounds} a join c{rounds} o on a.c = o.c"""


SQL = sql()
