"""Sums, links and counts over all pairs of hashes within a Hamming radius, without a row for a pair.

Hashes are dealt to the keys of :mod:`reprise.operators.hamming`, under which every pair in range meets, in one shuffle. The rows
of a key are counted and compared where they lie, in Arrow batches as arrays; a key with more than ``BLOCK`` rows is passed on and
cut into slices, whose pairs are cells of their own. A cell returns at most one row for each row that it was given: what its neighbours add up to, or the smallest hash it is linked to.
So a group of near copies costs rows in proportion to its size, however many pairs it holds. Only the comparing itself is
quadratic, inside cells of bounded size that any number of tasks shares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reprise.operators import hamming, skew
from reprise.session import materialise

BLOCK = 1000
#: Pairs that are looked at in one go.
PAIRS = 1 << 21
_TAG = 60


def _keyed(rows: DataFrame, radius: int) -> DataFrame:
    """``rows`` under all their keys: ``key``, whose upper bits number the rule, and ``flip``, the probe that gave it."""
    if radius <= 2:
        blocks = F.transform(hamming._block_keys(F.col("phash")), lambda b: F.struct(
            F.lit(0).alias("flip"), F.shiftleft(b["k"].cast("long"), _TAG).bitwiseOR(b["key"]).alias("key")))
        return rows.select("*", F.inline(blocks))
    probes = []
    for j, (low, width) in enumerate(hamming._layout(radius // 3 + 1)):
        block = hamming.bits(F.col("phash"), low, width).bitwiseOR(F.lit(j << _TAG).cast("long"))
        probes.append(block)
        if radius // (radius // 3 + 1) > 0:
            probes += [block.bitwiseXOR(F.lit(1 << i).cast("long")) for i in range(width)]
    return rows.select("*", F.posexplode(F.array(*probes)).alias("flip", "key"))


def _meets(diff: np.ndarray, key: np.ndarray, a_flip: np.ndarray, b_flip: np.ndarray, radius: int) -> np.ndarray:
    """Whether ordered pairs with this xor count under this key: each pair in range does so under one key, once."""
    distance = np.bitwise_count(diff)
    ok = (distance >= 1) & (distance <= radius)
    rule = key.astype(np.int64) >> _TAG
    if radius <= 2:
        blocks = [(diff >> np.uint64(48 - 16 * i)) & np.uint64(0xFFFF) for i in range(4)]
        first = np.full(len(diff), -1)
        for k, (i, j) in reversed(list(enumerate(hamming.BLOCK_PAIRS))):
            first[(blocks[i] == 0) & (blocks[j] == 0)] = k
        return ok & (first == rule)
    layout = hamming._layout(radius // 3 + 1)
    slack = radius // len(layout)
    first = np.full(len(diff), -1)
    for j, (low, width) in reversed(list(enumerate(layout))):
        first[np.bitwise_count((diff >> np.uint64(low)) & np.uint64((1 << width) - 1)) <= slack] = j
    ok &= first == rule
    whole = np.array([sum(w + 1 for _, w in layout[:j]) for j in range(len(layout))])  # probes without a flip
    if slack > 1:
        # Two wrong bits are met by one flip on each side, the lower one on the left; equal blocks by no flip at all.
        return ok & ((a_flip < b_flip) | (a_flip == b_flip) & np.isin(a_flip, whole))
    return ok & np.isin(a_flip, whole)  # one wrong bit, found by the right side


def _cells(rows: DataFrame, part: list[str], radius: int, block: int) -> DataFrame:
    """Rows dealt to cells (part, key, p, q) of at most two slices; keys under which no two hashes meet are left out."""
    return _sliced(_keyed(skew.spread(rows, *part, "phash"), radius), part, block)


def _sliced(keyed: DataFrame, part: list[str], block: int) -> DataFrame:
    keys = [*part, "key"]
    sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("phash").alias("__lo"), F.max("phash").alias("__hi")).where(
        "__lo < __hi").select(*keys, F.ceil(F.col("__n") / block).cast("int").alias("__slices"))
    return (
        skew.shuffled(keyed, sizes, keys)
        .withColumn("own", F.pmod(F.xxhash64("phash", "flip"), F.col("__slices")).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__slices") - 1)))
        .withColumn("p", F.least("own", "__other")).withColumn("q", F.greatest("own", "__other")).drop("__slices", "__other")
    )


class _Whole:
    """Cuts a stream of rows that are sorted by ``cell`` into frames of whole cells; only the rows of the last one are held."""

    def __init__(self, cell: list[str]):
        self.cell, self.held = cell, []

    def push(self, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(pdf):
            return
        last, same = {c: pdf[c].iloc[-1] for c in self.cell}, np.ones(len(pdf), bool)
        for c in self.cell:
            same &= pdf[c].to_numpy() == last[c]
        start = 0 if same.all() else len(pdf) - int(np.argmin(same[::-1]))
        if start:
            yield pd.concat([*self.held, pdf.iloc[:start]]) if self.held else pdf.iloc[:start]
            self.held = [pdf.iloc[start:]]
        elif self.held and any(self.held[-1][c].iloc[-1] != last[c] for c in self.cell):
            yield pd.concat(self.held)
            self.held = [pdf]
        else:
            self.held.append(pdf)

    def end(self) -> Iterator[pd.DataFrame]:
        if self.held:
            yield pd.concat(self.held)


def _pairs(frame: pd.DataFrame, cell: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last, left, right) of some whole cells, up to ``PAIRS`` pairs at once or one larger cell."""
    cut = np.zeros(len(frame), bool)
    for c in cell:
        values = frame[c].to_numpy()
        cut[1:] |= values[1:] != values[:-1]
    edges = np.concatenate([[0], np.flatnonzero(cut), [len(frame)]])
    size = np.diff(edges)
    done = np.concatenate([[0], np.cumsum(size * size)])
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(done, done[a] + PAIRS, side="right")) - 1)
        n = size[a:b]
        first = np.repeat(edges[a:b] - edges[a], n)
        rows = np.arange(int(n.sum()))
        left = np.repeat(rows, np.repeat(n, n))
        inside = np.arange(len(left)) - np.repeat(np.cumsum(np.repeat(n, n)) - np.repeat(n, n), np.repeat(n, n))
        right = first[left] + inside
        yield int(edges[a]), int(edges[b]), left, right
        a = b


Reduce = Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame]


def _found(frame: pd.DataFrame, cell: list[str], radius: int, reduce: Reduce) -> Iterator[pd.DataFrame]:
    """``reduce`` over the pairs in range of some whole cells."""
    for lo, hi, left, right in _pairs(frame, cell):
        some = frame.iloc[lo:hi].reset_index(drop=True)
        x, key, flip = some["phash"].to_numpy().view(np.uint64), some["key"].to_numpy(), some["flip"].to_numpy()
        if "own" in some:
            own, p, q = some["own"].to_numpy(), some["p"].to_numpy(), some["q"].to_numpy()
            across = (p[left] == q[left]) | (own[left] != own[right])
            left, right = left[across], right[across]
        near = np.bitwise_count(x[left] ^ x[right]) <= radius  # few pairs are, and only these need more tests
        left, right = left[near], right[near]
        ok = _meets(x[left] ^ x[right], key[left], flip[left], flip[right], radius)
        if ok.any():
            out = reduce(some, left[ok], right[ok])
            if len(out):
                yield out


def _compared(rows: DataFrame, part: list[str], radius: int, block: int, reduce: Reduce, schema: str) -> DataFrame:
    """``reduce(rows, left, right)`` over the ordered pairs (places of two rows) in range of some whole cells.

    The rows under their keys, many times the input, are shuffled once: counted in a Spark window, which spills, and compared in the
    same task. Rows of keys with more than ``block`` of them are written beside the results, and met in slices. A row without a
    part or a hash meets nothing.
    """
    keys = [*part, "key"]
    known = F.lit(True)
    for c in [*part, "phash"]:
        known = known & F.col(c).isNotNull()
    keyed = _keyed(skew.spread(rows.where(known), *part, "phash"), radius)
    counted = skew.spread(keyed, *keys).sortWithinPartitions(*keys).withColumn(
        "__n", F.count(F.lit(1)).over(W.partitionBy(*keys))).where("__n > 1")
    given, results = keyed.columns, T.StructType.fromDDL(schema).fields
    both = T.StructType([*(T.StructField(f"found_{f.name}", f.dataType) for f in results), *(T.StructField(f.name, f.dataType) for f in keyed.schema)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = _Whole(keys)
        none = {c: None for c in both.names}

        def out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for found in _found(frame, keys, radius, reduce):
                    yield found.add_prefix("found_").assign(**{c: None for c in given})[both.names]

        for pdf in batches:
            crowded = pdf["__n"].to_numpy() > block
            if crowded.any():
                yield pdf.loc[crowded, given].assign(**{c: v for c, v in none.items() if c not in given})[both.names]
                pdf = pdf[~crowded]
            yield from out(whole.push(pdf))
        yield from out(whole.end())

    near = materialise(counted.mapInPandas(run, both), "near")
    cell = [*keys, "p", "q"]

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = _Whole(cell)
        for pdf in batches:
            for frame in whole.push(pdf):
                yield from _found(frame, cell, radius, reduce)
        for frame in whole.end():
            yield from _found(frame, cell, radius, reduce)

    crowded = _sliced(near.where("key is not null").select(*given), part, block)
    return near.where("key is null").select(*(F.col(f"found_{f.name}").alias(f.name) for f in results)).unionByName(
        crowded.repartition(*cell).sortWithinPartitions(*cell).mapInPandas(slices, schema))


def sums(rows: DataFrame, part: list[str], radius: int, block: int = BLOCK) -> DataFrame:
    """(part, phash, near): what ``n`` adds up to over the rows of the same part within the radius, equal hashes left out.

    ``rows`` has one row for each (part, phash), and a part is not null.
    """
    kinds = dict(rows.dtypes)

    def reduce(some: pd.DataFrame, left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
        near = np.zeros(len(some), np.int64)
        np.add.at(near, left, some["n"].to_numpy()[right])
        hit = np.unique(left)
        return some.loc[hit, [*part, "phash"]].assign(near=near[hit])

    found = _compared(rows.select(*part, "phash", F.col("n").cast("long").alias("n")), part, radius, block, reduce,
                      ", ".join(f"{c} {kinds[c]}" for c in [*part, "phash"]) + ", near long")
    return found.groupBy(*part, "phash").agg(F.sum("near").alias("near"))


def links(values: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Links (phash_a, phash_b) that join all hashes within the radius: in a cell each hash is linked to the smallest one that it
    reaches there, so there are no more links than rows."""

    def reduce(some: pd.DataFrame, left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
        values = some["phash"].to_numpy()
        label = np.arange(len(some))
        order = np.argsort(values, kind="stable")
        rank = np.empty(len(some), np.int64)
        rank[order] = np.arange(len(some))
        label = rank.copy()
        while True:
            old = label.copy()
            np.minimum.at(label, left, label[right])
            np.minimum.at(label, right, label[left])
            if (label == old).all():
                break
        linked = np.flatnonzero(label != rank)
        return pd.DataFrame({"phash_a": values[linked], "phash_b": values[order[label[linked]]]})

    distinct = values.select("phash").where("phash is not null").distinct()
    return _compared(distinct, [], radius, block, reduce, "phash_a long, phash_b long").where(
        "phash_a <> phash_b").distinct()


def distances(values: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """(distancia, pares): pairs of images by the distance of their hashes, from (phash, n) with one row a hash."""

    def reduce(some: pd.DataFrame, left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
        values, n = some["phash"].to_numpy(), some["n"].to_numpy()
        once = values[left] < values[right]
        left, right = left[once], right[once]
        distance = np.bitwise_count((values[left] ^ values[right]).view(np.uint64)).astype(np.int64)
        total = np.zeros(65, np.int64)
        np.add.at(total, distance, n[left] * n[right])
        hit = np.flatnonzero(total)
        return pd.DataFrame({"distancia": hit.astype(np.int32), "pares": total[hit]})

    rows = values.select("phash", F.col("n").cast("long").alias("n"))
    found = _compared(rows, [], radius, block, reduce, "distancia int, pares long")
    same = values.where("n > 1").select(F.lit(0).alias("distancia"), F.expr("n * (n - 1) div 2").alias("pares"))
    return found.unionByName(same).groupBy("distancia").agg(F.sum("pares").alias("pares"))


def reach(rows: DataFrame, tag: str, radius: int, block: int = BLOCK) -> DataFrame:
    """(phash, tag, lo, hi, near): for each hash the tags of the hashes within the radius, with the least ``lo``, the greatest ``hi``
    and the sum of ``n`` among them. ``rows`` (phash, tag, lo, hi, n) has one row for each (phash, tag)."""
    kind = dict(rows.dtypes)[tag]

    def reduce(some: pd.DataFrame, left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
        # A hash with several tags has several rows on the left; each row on the right counts for it once.
        once = ~pd.DataFrame({"phash": some["phash"].to_numpy()[left], "right": right}).duplicated().to_numpy()
        left, right = left[once], right[once]
        met = pd.DataFrame({"phash": some["phash"].to_numpy()[left], tag: some[tag].to_numpy()[right],
                            "lo": some["lo"].to_numpy()[right], "hi": some["hi"].to_numpy()[right], "near": some["n"].to_numpy()[right]})
        return met.groupby(["phash", tag], as_index=False, sort=False).agg(lo=("lo", "min"), hi=("hi", "max"), near=("near", "sum"))

    found = _compared(rows.select("phash", tag, "lo", "hi", F.col("n").cast("long").alias("n")), [], radius, block, reduce,
                      f"phash long, {tag} {kind}, lo long, hi long, near long")
    return found.groupBy("phash", tag).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("near").alias("near"))


def alone_or_not(rows: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """(phash): hashes with another one within the radius."""
    ones = rows.where("phash is not null").select("phash").distinct().withColumn("n", F.lit(1))
    return sums(ones, [], radius, block).select("phash")
