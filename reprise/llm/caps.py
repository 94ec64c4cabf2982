"""Near-duplicate vectors by spherical-cap filters.

The filters are directions of random product codes. In a code a vector is rotated at random and cut into four blocks, each
block has a small code book of random unit vectors, and every combination of four code words is a direction. A vector
belongs to all filters whose inner product exceeds a threshold, or to its nearest one where none does. They are
list-decoded: the scores of two blocks are added first, and a half is opened only if the best other half lifts it over the
threshold. A few directions per block leave some vectors with many filters and some with none, so independent codes are
joined: as many, at least ``CODES``, as a pair at exactly the similarity needs to share a filter with probability ``HIT``,
for any number and length of vectors. Vectors that share a filter are compared by cosine in double precision, so no link below the similarity
appears. A pair that shares several filters counts in the smallest one.

The size of the code books and the threshold follow from the number of vectors, so that filters hold few unrelated ones.
Equal vectors are one vector with a weight, so copies cost nothing more than their rows, however many there are. A filter with
many members is cut into slices that meet in bounded cells; cells return counts and one link per vector, never pairs.

Defined cases: vectors that are null, zero or hold null or non-finite components have no links and are their own
component; vectors of different lengths are not compared; rows without an id come back without links; rows that repeat an
id are vectors of their own for links but share the id's count; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.llm.common import cells, list_array, streamed_groups
from reprise.llm.vectors import matrix, select_vectors, unit
from reprise.operators.clusters import connected_components
from reprise.session import materialise

SIMILARITY = 0.9
#: Least number of codes, and the number from which filters are widened instead.
CODES, MANY_CODES = 16, 128
#: Predicted share of the pairs at exactly the similarity that meet, and the drawn pairs behind the prediction.
HIT, DRAWN = 0.999, 4096
BLOCKS = 4
#: Code words of a block for up to 2^16 vectors, and the share of the sphere that a filter then covers.
WORDS, SHARE = 4, 0.0012
SLICE = 512
SEED = 20


def cap_share(height: float, dim: int) -> float:
    """Share of the unit sphere whose first coordinate exceeds ``height``."""
    if dim < 2:
        return 0.5
    # The angle to the pole has a density proportional to sin^(dim - 2).
    density = lambda a, b: np.sin(np.linspace(a, b, 2001)) ** (dim - 2)
    edge = math.acos(min(1.0, max(-1.0, height)))
    return float(np.trapezoid(density(0.0, edge)) * edge / (np.trapezoid(density(0.0, math.pi)) * math.pi))


def cap_height(share: float, dim: int) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cap_share(mid, dim) > share else (lo, mid)
    return lo


def _blocks(dim: int) -> list[tuple[int, int]]:
    edges = [round(i * dim / BLOCKS) for i in range(BLOCKS + 1)]
    return list(zip(edges, edges[1:]))


def _books(rng: np.random.Generator, dim: int, words: int) -> list[np.ndarray]:
    """Code books of the blocks. Blocks weigh alike: four code words of length 1/2 make a unit direction."""
    books = [rng.standard_normal((words, b - a)) for a, b in _blocks(dim)]
    return [b / np.maximum(np.sqrt((b ** 2).sum(axis=1, keepdims=True)) * math.sqrt(BLOCKS), 1e-12) for b in books]


def hit_rate(dim: int, words: int, height: float, similarity: float, drawn: int = DRAWN, seed: int = SEED) -> float:
    """Share of drawn pairs at exactly that cosine that share a filter of one code.

    Codes are rotated at random, so it holds for every pair, and codes miss a pair independently.
    """
    rng, hits, batch = np.random.default_rng(seed), 0, 64
    for _ in range(drawn // batch):
        x = unit(rng.standard_normal((batch, dim)))
        off = rng.standard_normal((batch, dim))
        off -= (off * x).sum(axis=1, keepdims=True) * x
        y = similarity * x + math.sqrt(max(0.0, 1.0 - similarity ** 2)) * unit(off) if dim > 1 else x
        books = _books(rng, dim, words)
        hits += sum(len(np.intersect1d(a, b)) > 0 for a, b in zip(_caps(x, books, height), _caps(y, books, height)))
    return hits / (drawn // batch * batch)


@functools.cache
def layout(rows: int, dim: int, similarity: float = SIMILARITY) -> tuple[int, float, int]:
    """(code words of a block, threshold on the inner product with unit vectors, codes).

    Sixteen times the vectors double the code words. The threshold is the height of a cap with the wanted share of the
    sphere. The codes follow from the hit rate of one code, less three standard errors of its estimate; where more than
    ``MANY_CODES`` were needed the caps are widened.
    """
    words = max(WORDS, math.ceil((rows / 256) ** (1 / BLOCKS)))
    share = SHARE * (WORDS / words) ** 1.8
    while True:
        height = cap_height(share, dim)
        hit = hit_rate(dim, words, height, similarity)
        hit -= 3.0 * math.sqrt(hit * (1.0 - hit) / DRAWN)
        codes = CODES if hit >= 1.0 else math.ceil(math.log(1.0 - HIT) / math.log1p(-hit)) if hit > 0.0 else math.inf
        if codes <= MANY_CODES or share >= 0.25:
            return words, height, int(max(CODES, min(codes, 1 << 16)))
        share *= 2.0


def _caps(y: np.ndarray, books: list[np.ndarray], height: float) -> list[np.ndarray]:
    """Sorted filter numbers of each row in one code; the nearest filter where none reaches ``height``."""
    c, found = len(books[0]), []
    scores = [y[:, a:b] @ book.T for (a, b), book in zip(_blocks(y.shape[1]), books)]
    left = (scores[0][:, :, None] + scores[1][:, None, :]).reshape(len(y), -1)
    right = (scores[2][:, :, None] + scores[3][:, None, :]).reshape(len(y), -1)
    best_left, best_right = left.argmax(axis=1), right.argmax(axis=1)
    for i in range(len(y)):
        l, r = left[i], right[i]
        top_l, top_r = l[best_left[i]], r[best_right[i]]
        if top_l + top_r <= height:
            found.append(np.array([best_left[i] * c * c + best_right[i]]))
            continue
        # Only halves that the best other half can lift over the threshold are opened.
        li, ri = np.flatnonzero(l > height - top_r), np.flatnonzero(r > height - top_l)
        a, b = np.nonzero(l[li][:, None] + r[ri][None, :] > height)
        found.append(np.sort(li[a] * (c * c) + ri[b]))
    return found


class Codes:
    """The filters for vectors of one length."""

    def __init__(self, dim: int, words: int, height: float, codes: int = CODES):
        rng = np.random.default_rng(SEED + dim)
        self.words, self.height = words, height
        self.codes = []
        for _ in range(codes):
            rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            self.codes.append((rotation, _books(rng, dim, words)))

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Sorted filter numbers of each row of unit vectors."""
        found = [[] for _ in x]
        for k, (rotation, books) in enumerate(self.codes):
            for out, own in zip(found, _caps(x @ rotation, books, self.height)):
                out.append(k * self.words ** BLOCKS + own)
        return [np.concatenate(f).astype(np.int64) for f in found]


def _filters(vectors: DataFrame, sizes: dict[int, tuple[int, float, int]]) -> DataFrame:
    """(row, weight, v, dim, filters)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Codes] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in codes:
                    codes[dim] = Codes(dim, *sizes[dim])
                own = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for a in range(0, len(own), 256):
                    part = own.slice(a, 256)
                    x = part.column("v").flatten().to_numpy().reshape(-1, dim).astype(np.float64)
                    found = list_array(codes[dim].decode(unit(x)), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "weight", "v", "dim")), found], names=["row", "weight", "v", "dim", "filters"])

    kind = dict(vectors.dtypes)["v"]
    return vectors.select("row", "weight", "v", "dim").mapInArrow(run, f"row long, weight long, v {kind}, dim int, filters array<long>")


def _cell_links(cols: dict[str, np.ndarray], similarity: float) -> dict | None:
    n = len(cols["row"])
    if n < 2:
        return None
    own = cols["slice"] == cols["cell_p"][0]
    whole = cols["cell_p"][0] == cols["cell_q"][0]
    left = np.arange(n) if whole else np.flatnonzero(own)
    right = left if whole else np.flatnonzero(~own)
    x = unit(matrix(cols["v"]))
    near = x[left] @ x[right].T >= similarity
    if whole:
        np.fill_diagonal(near, False)
    if not near.any():
        return None
    # A pair that shares a smaller filter is counted there. Only rows with a close one are looked at.
    here = cols["filter"][0]
    rows, others = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    a, b = left[rows], right[others]
    close = near[np.ix_(rows, others)]
    earlier = [f[f < here] for f in cols["filters"][np.concatenate([a, b])]]
    numbers, where = np.unique(np.concatenate(earlier), return_inverse=True)
    member = np.zeros((len(earlier), len(numbers)), np.float32)
    member[np.repeat(np.arange(len(earlier)), [len(e) for e in earlier]), where] = 1.0
    new = close & ~(member[: len(a)] @ member[len(a):].T > 0)
    count = np.zeros(n, np.int64)
    count[a] += new.astype(np.int64) @ cols["weight"][b]
    if not whole:
        count[b] += cols["weight"][a] @ new.astype(np.int64)
    root = _roots(n, left, right, near)
    touched = np.flatnonzero((count > 0) | (root != np.arange(n)))
    if not len(touched):
        return None
    return {"row": cols["row"][touched], "links": count[touched], "root": cols["row"][root[touched]]}


def _roots(n: int, left: np.ndarray, right: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Smallest position connected to each position, by spreading labels over the matrix until nothing changes."""
    label = np.arange(n)
    while True:
        old = label.copy()
        best = np.where(near, label[right][None, :], n).min(axis=1)
        label[left] = np.minimum(label[left], best)
        best = np.where(near, label[left][:, None], n).min(axis=0)
        label[right] = np.minimum(label[right], best)
        label = label[label]
        if (label == old).all():
            return label


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", similarity: float = SIMILARITY) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``df``."""
    vectors = materialise(select_vectors(df, id_col, vec_col), "caps-vectors")
    classes = materialise(
        vectors.groupBy("v", "dim").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"))
        .withColumn("row", F.monotonically_increasing_id()), "caps-classes")
    members = materialise(vectors.join(classes, ["v", "dim"]).select("vec_id", "row", "first", "weight"), "caps-members")
    # One row per length of vectors, in practice one.
    sizes = {r["dim"]: layout(r["n"], r["dim"], similarity) for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    decoded = materialise(_filters(classes, sizes), "caps-filters")
    keyed = decoded.withColumn("filter", F.explode("filters")).withColumn("key", F.xxhash64("dim", "filter"))
    dealt = cells(keyed, "key", F.xxhash64("row"), SLICE).drop("dim")
    met = materialise(streamed_groups(
        dealt, ["key", "cell_p", "cell_q"], lambda c: _cell_links(c, similarity), "row long, links long, root long"), "caps-links")
    names = classes.select("row", F.col("first").alias("a"))
    across = (
        met.where("row <> root").select("row", "root").distinct().join(names, "row")
        .join(names.select(F.col("row").alias("root"), F.col("a").alias("b")), "root").where("a <> b").select("a", "b")
    )
    # Copies hang on the first of them; a row that repeats an id with another vector ties the two vectors together.
    inside = members.where("vec_id <> first").select(F.col("vec_id").alias("a"), F.col("first").alias("b"))
    component = connected_components(materialise(across.unionByName(inside).distinct(), "caps-edges"), "a", "b")
    linked = met.groupBy("row").agg(F.sum("links").alias("links"))
    counts = members.join(linked, "row", "left").groupBy("vec_id").agg(
        F.sum(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"))
        .join(counts, "vec_id", "left").join(component.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


#: Every pair; for tables of some thousand vectors.
SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT a AS node, a AS to_id FROM l UNION SELECT a, b FROM l UNION SELECT r.node, l.b FROM reach r JOIN l ON r.to_id = l.a),
c AS (SELECT node, min(to_id) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.node = e.vec_id
"""
