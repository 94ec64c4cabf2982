"""Nearest neighbours by inner product: one navigable small-world graph per shard, shard results merged.

A shard holds about ``SHARD_ROWS`` vectors of one band of norms (a factor of four), dealt out by a hash of the id. Its graph is
built in one task and stored in the shared folder as flat arrays: the vectors, one row of neighbours for each node on the
ground layer, and the same for the few nodes of each upper layer. Queries are packed in blocks, every block meets every shard
in its own group, and the best of all shards are merged per query. Equal vectors are one node that stands for its smallest ids.

Inner products are searched as distances: each vector gets one more component that lifts all of a shard to the same
length, which keeps the order of inner products. That component is in double precision and, as norms of a shard are alike, does
not drown the others. Scores are computed on the original vectors in double precision.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows without an id, are neither
queries nor candidates; vectors of different lengths are not compared; of rows that repeat an id and a vector one is a
candidate, and the one with the smallest components asks; an empty table gives no rows; extra columns are ignored. Ties go to
the smaller id.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reprise.llm.vectors import matrix, select_vectors
from reprise.session import materialise

SHARD_ROWS = 8192
NEIGHBOURS = 16
BUILD_WIDTH = 64
SEARCH_WIDTH = 96
QUERY_BLOCK = 8192
#: Norms of a band differ by less than 2^BAND.
BAND = 2


class Graph:
    """Layers of neighbours over the rows of ``vectors``; -1 fills unused places."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None, entry: int = 0, levels: np.ndarray | None = None):
        self.raw = vectors
        length = np.einsum("ij,ij->i", vectors, vectors)
        top = float(length.max()) if len(length) else 0.0
        self.x = np.concatenate([vectors, np.sqrt(np.maximum(top - length, 0.0))[:, None]], axis=1)
        if len(length) and length.min() > 0.99 * top:  # single precision tells them apart
            self.x = self.x.astype(np.float32)
        self.layers = layers or []
        self.entry = entry
        self.levels = levels
        self.seen = np.zeros(len(vectors), np.int64)
        self.tick = 0

    def _closest(self, q: np.ndarray, start: list[tuple[float, int]], layer: int, width: int) -> list[tuple[float, int]]:
        """The ``width`` best found from ``start``, as (similarity, node), best first."""
        self.tick += 1
        seen, tick, near = self.seen, self.tick, self.layers[layer]
        todo = [(-s, i) for s, i in start]
        best = list(start)
        seen[[i for _, i in start]] = tick
        heapq.heapify(todo)
        heapq.heapify(best)
        x = self.x
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            around = near[i]
            around = around[around >= 0]
            around = around[seen[around] != tick]
            if not len(around):
                continue
            seen[around] = tick
            sims = x[around] @ q
            if len(best) >= width:
                good = sims > best[0][0]
                around, sims = around[good], sims[good]
            for v, j in zip(sims.tolist(), around.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (v, j))
                    heapq.heappush(todo, (-v, j))
                elif v > best[0][0]:
                    heapq.heapreplace(best, (v, j))
                    heapq.heappush(todo, (-v, j))
        return sorted(best, reverse=True)

    def _spread(self, node: int, found: np.ndarray, most: int) -> np.ndarray:
        """Neighbours in different directions: one is passed over if it is closer to a chosen one than to the node."""
        v = self.x[found]
        to_node, among = v @ self.x[node], v @ v.T
        order = np.argsort(-to_node, kind="stable").tolist()
        chosen: list[int] = []
        worst = np.full(len(found), -np.inf)
        for i in order:
            if to_node[i] > worst[i]:
                chosen.append(i)
                np.maximum(worst, among[i], out=worst)
                if len(chosen) == most:
                    break
        for i in order:  # fill up with the nearest of the others
            if len(chosen) >= most:
                break
            if i not in chosen:
                chosen.append(i)
        return found[chosen]

    def _link(self, layer: int, a: int, b: int) -> None:
        row = self.layers[layer][a]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = b
            return
        kept = self._spread(a, np.append(row, b), max(1, len(row) * 3 // 4))
        row[:] = -1
        row[: len(kept)] = kept

    def build(self, seed: int) -> Graph:
        n = len(self.x)
        rng = np.random.default_rng(seed)
        self.levels = np.minimum((-np.log(1.0 - rng.random(n)) / math.log(NEIGHBOURS)).astype(int), 8) if n else np.zeros(0, int)
        for layer in range(int(self.levels.max(initial=0)) + 1):
            self.layers.append(np.full((n, NEIGHBOURS * (2 if layer == 0 else 1)), -1, np.int32))
        top = -1
        for i in range(n):
            level, q = int(self.levels[i]), self.x[i]
            if top < 0:
                top, self.entry = level, i
                continue
            found = [(float(self.x[self.entry] @ q), self.entry)]
            for layer in range(top, level, -1):
                found = self._closest(q, found, layer, 1)
            for layer in range(min(top, level), -1, -1):
                found = self._closest(q, found, layer, BUILD_WIDTH)
                chosen = self._spread(i, np.array([j for _, j in found]), NEIGHBOURS)
                self.layers[layer][i, : len(chosen)] = chosen
                for j in chosen.tolist():
                    self._link(layer, j, i)
            if level > top:
                top, self.entry = level, i
        return self

    def search(self, query: np.ndarray, width: int) -> np.ndarray:
        """Nodes near to the query by inner product."""
        if not len(self.x):
            return np.empty(0, np.int64)
        q = np.append(query, 0.0).astype(self.x.dtype)
        found = [(float(self.x[self.entry] @ q), self.entry)]
        for layer in range(len(self.layers) - 1, 0, -1):
            found = self._closest(q, found, layer, 1)
        return np.array([i for _, i in self._closest(q, found, 0, width)])

    def flat(self) -> dict[str, bytes]:
        """Ground layer as it is; of the upper layers only the rows of their nodes."""
        upper = [np.concatenate([np.flatnonzero(self.levels >= k)[:, None], layer[self.levels >= k]], axis=1).astype("<i4")
                 for k, layer in enumerate(self.layers) if k]
        return {
            "vectors": self.raw.astype("<f8").tobytes(), "ground": self.layers[0].astype("<i4").tobytes() if self.layers else b"",
            "upper": b"".join(np.array([len(u)], "<i4").tobytes() + u.tobytes() for u in upper),
        }

    @classmethod
    def read(cls, row, dim: int) -> Graph:
        raw = np.frombuffer(row["vectors"], "<f8").reshape(-1, dim)
        layers = [np.frombuffer(row["ground"], "<i4").reshape(len(raw), -1)]
        rest = np.frombuffer(row["upper"], "<i4")
        while len(rest):
            n, rest = int(rest[0]), rest[1:]
            part, rest = rest[: n * (NEIGHBOURS + 1)].reshape(n, -1), rest[n * (NEIGHBOURS + 1):]
            layer = np.full((len(raw), NEIGHBOURS), -1, np.int32)
            layer[part[:, 0]] = part[:, 1:]
            layers.append(layer)
        return cls(raw, layers, int(row["entry"]))


def index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graphs of (vec_id, v, dim), one row per shard, written to the shared folder.

    Of equal vectors the k + 1 smallest ids are candidates: no query has more than k of them among its nearest, whether
    or not it is one itself.
    """
    copies = Window.partitionBy("v").orderBy("vec_id")
    distinct = (
        vectors.dropDuplicates(["vec_id", "v"]).withColumn("place", F.row_number().over(copies)).where(F.col("place") <= k + 1)
        .groupBy("v", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    distinct = materialise(distinct, "hnsw-distinct")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # A norm beyond the largest double counts as that; bands of doubles are 1,050 at most.
    banded = distinct.withColumn("band", F.floor(F.log2(F.least(norm, F.lit(1.7e308))) / BAND).cast("int"))
    # One row per length of vectors and band.
    sizes = banded.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))
    dealt = banded.join(F.broadcast(sizes), ["dim", "band"]).withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0], F.lit(7)), F.col("shards")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        graph = Graph(matrix(pdf["v"].to_numpy())).build(int(pdf["shard"].iloc[0]))
        return pd.DataFrame([{
            "dim": pdf["dim"].iloc[0], "band": pdf["band"].iloc[0], "shard": pdf["shard"].iloc[0], "entry": graph.entry, **graph.flat(),
            "id_counts": [len(i) for i in pdf["ids"]], "ids": np.concatenate(pdf["ids"].tolist()),
        }])

    schema = "dim int, band int, shard int, entry int, vectors binary, ground binary, upper binary, id_counts array<int>, ids array<long>"
    return materialise(
        dealt.select("dim", "band", "shard", "v", "ids", F.col("ids")[0].alias("first")).groupBy("dim", "band", "shard").applyInPandas(build, schema), "hnsw-index")


def search(graphs: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_WIDTH, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for (vec_id, v, dim) rows of ``queries``."""
    # The first has one row per length of vectors, the second one per length and band.
    blocks = F.broadcast(queries.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")))
    shards = F.broadcast(graphs.groupBy("dim", F.col("band").alias("of_band")).agg(F.max("shard").alias("last")))
    asked = (
        queries.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks")).cast("int"))
        .join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .select("dim", (F.col("of_band") + 0).alias("band"), "shard", "block", F.col("vec_id").alias("query_id"), "v")
    )
    offered = graphs.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))

    def answer(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(offered):
            row = offered.iloc[0]
            graph = Graph.read(row, int(row["dim"]))
            ends = np.cumsum(row["id_counts"])
            starts = ends - np.asarray(row["id_counts"])
            ids = np.asarray(row["ids"])
            q = matrix(asked["v"].to_numpy())
            for query, v in zip(asked["query_id"].tolist(), q):
                nodes = graph.search(v, max(width, k))
                scores = graph.raw[nodes] @ v
                counts = ends[nodes] - starts[nodes]
                found = np.concatenate([ids[a:b] for a, b in zip(starts[nodes], ends[nodes])])
                scores = np.repeat(scores, counts)
                scores, found = scores[found != query], found[found != query]
                order = np.lexsort((found, -scores))[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": found[order], "score": scores[order]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ["dim", "band", "shard", "block"]
    found = asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInPandas(answer, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, asks: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", width: int = SEARCH_WIDTH) -> DataFrame:
    """The k nearest rows of ``df`` for each of its rows where ``asks`` (a condition on vec_id) holds, itself left out."""
    vectors = materialise(select_vectors(df, id_col, vec_col), "hnsw-vectors")
    queries = vectors.where(asks).groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("first")).select("vec_id", "first.*")
    return search(index(vectors, k), queries, k, width)


#: Every pair; the operator may miss a neighbour where this does not.
SQL = """
WITH ok AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
      FROM ok q JOIN ok c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
