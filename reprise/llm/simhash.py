"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees of bounded shards.

A fingerprint is cut into six blocks. Two fingerprints with at most four differing bits agree in at least two blocks, so
each of the fifteen pairs of blocks gives a key, and every linked pair shares a shard under one of the keys. A shard is a
BK-tree: a child hangs under the integer Hamming distance to its parent, and a search for radius r follows only the edges
d - r .. d + r. A crowded shard is cut into slices; the tree of each slice is sent to every other slice, so that
a task holds one tree of a bounded size. A cell returns at most one link per fingerprint (to the root of its local set),
never all pairs, and the links are joined to components over all shards.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and is linked like any other; rows
that repeat an id share its fate; rows without an id keep a fingerprint and get the component of equal fingerprints, null
if no row with an id belongs to it; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.llm.common import (
    Sets, bit_of, bitmap, cells, ids_of, in_small_batches, may_be_in, released, signed, streamed_groups, unused, words_of,
)
from reprise.operators.clusters import connected_components
from reprise.session import materialise

SHINGLE = 4
RADIUS = 4
BLOCKS = 6
SLICE = 256
#: Hashes of one text that are unpacked to bits at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """Bit b is 1 if it is set in over half of the hashes of all word shingles, repeats included."""
    words = [w.lower() for w in words_of(text)]  # bytes.lower() changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    stops = ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i:i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint's 64 bits as a signed long."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = np.fromiter((fingerprint(t, shingle) for t in pdf["text"]), np.uint64, len(pdf))
            yield pd.DataFrame({"doc_id": pd.array(ids_of(pdf["doc_id"]), "Int64"), "fp": signed(got)})

    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        released(run), "doc_id long, fp long")


class BKTree:
    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        if new:
            at = 0
            while True:
                d = (self.values[at] ^ value).bit_count()
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d] = new
                    break
                at = below
        return new

    def within(self, value: int, radius: int) -> list[int]:
        found, stack = [], [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            lo, hi = d - radius, d + radius
            for edge, below in children[at].items():
                if lo <= edge <= hi:
                    stack.append(below)
        return found


def _cell_links(cols: dict[str, np.ndarray], radius: int) -> dict | None:
    values = (cols["fp"].astype(np.int64).view(np.uint64)).tolist()
    n, tree = len(values), BKTree()
    if n < 2:
        return None
    sets = Sets(n)
    if cols["cell_p"][0] == cols["cell_q"][0]:
        for i, v in enumerate(values):
            for j in tree.within(v, radius):
                sets.join(i, j)
            tree.add(v)
    else:
        own = cols["slice"] == cols["cell_p"][0]
        inside = np.flatnonzero(own).tolist()
        for i in inside:
            tree.add(values[i])
        for i in np.flatnonzero(~own).tolist():
            for j in tree.within(values[i], radius):
                sets.join(i, inside[j])
    root = np.fromiter(map(sets.find, range(n)), np.int64, n)
    linked = root != np.arange(n)
    if not linked.any():
        return None
    return {"a": cols["fp"][linked], "b": cols["fp"][root[linked]]}


def links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join all within ``radius`` bits, at most one per row and cell."""
    if not 0 <= radius <= BLOCKS - 2:
        raise ValueError("two of the blocks agree only up to a radius of four")
    edges = [round(i * 64 / BLOCKS) for i in range(BLOCKS + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    pairs = [masks[i] | masks[j] for i, j in combinations(range(BLOCKS), 2)]
    shards = F.explode(F.array(*(
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(pairs)))).alias("shard")
    dealt = cells(values.select("fp", shards), "shard", F.xxhash64("fp"), SLICE)
    found = streamed_groups(dealt, ["shard", "cell_p", "cell_q"], lambda c: _cell_links(c, radius), "a long, b long")
    return found.distinct()


def components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) for every fingerprint of ``prints`` (doc_id, fp): the smallest id reachable over links."""
    first = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-values")
    edges = materialise(links(first.select("fp"), radius), "simhash-links")
    labels = connected_components(edges, "a", "b")
    member = first.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    return member.join(lowest, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs``."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    return prints.join(components(prints, radius), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` without the documents that reach one with a smaller id over links; all columns stay, whatever their names.

    A row is told by its id and fingerprint, so of rows that repeat an id only those that resemble a smaller one go. Rows
    without an id stay. Only texts of ids that lose a row are shuffled, picked by a bitmap of fixed size.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, radius)
    gone_id, gone_print, key, hit, own = unused(docs.columns, "gone_id", "gone_print", "id_or_zero", "may_go", "own_print")
    gone = materialise(found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id), F.col("fp").alias(gone_print)).distinct(), "simhash-gone")

    @F.pandas_udf("long")
    def print_of(texts: pd.Series) -> pd.Series:
        return pd.Series(signed(np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))))

    marked = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    marked = marked.withColumn(hit, may_be_in(marked, key, bitmap(gone, bit_of(gone_id))))
    checked = marked.where(F.col(hit)).withColumn(own, print_of(F.col(text_col)))
    stay = checked.join(gone, (F.col(id_col).cast("long") == F.col(gone_id)) & (F.col(own) == F.col(gone_print)), "left_anti")
    return marked.where(~F.col(hit)).select(*docs.columns).unionByName(stay.select(*docs.columns))
