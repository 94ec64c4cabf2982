"""Similarity join of 64-bit hashes within a Hamming radius.

Works on distinct hash values, so any number of images with one hash is a single row. No cross join and no bucket of
unbounded size:

* radius <= 2: four 16-bit blocks; at least two of them agree for every pair in range, so six 32-bit keys find all pairs.
  A key with too many values is split once more by the same rule on its other 32 bits; such a bucket agrees on 48 bits
  and cannot hold more than 65,536 values.
* radius > 2: radius // 3 + 1 blocks; one of them differs in at most two bits. Both sides probe their one-bit
  neighbourhood and meet in the middle. Crowded keys are cut into slices whose pairs are spread over tasks.

Each pair is emitted by the first key that finds it, so no distinct is needed afterwards.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reprise.functions.hashing import HASH_BITS, PHASE_THRESHOLD, hamming
from reprise.operators import skew
from reprise.session import materialise

HOT_KEY = 4096
BLOCK_PAIRS = list(combinations(range(4), 2))


def hash_values(contents: DataFrame) -> DataFrame:
    """phash, number of distinct images that carry it, smallest digest. One hash per digest is assumed."""
    return (
        contents.groupBy("sha256").agg(F.min("phash").alias("phash")).where("phash is not null")
        .groupBy("phash").agg(F.count(F.lit(1)).alias("n"), F.min("sha256").alias("sha256_min"))
    )


def bits(c: Column, low: int, width: int) -> Column:
    if width == HASH_BITS:
        return c
    return F.shiftrightunsigned(c, low).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _block_keys(h: Column) -> Column:
    """(k, key, rest) for every choice of two agreeing blocks."""
    blocks = [bits(h, 48 - 16 * i, 16) for i in range(4)]

    def joined(pair: tuple[int, ...]) -> Column:
        return F.shiftleft(blocks[pair[0]], 16).bitwiseOR(blocks[pair[1]])

    return F.array(*[
        F.struct(F.lit(k).alias("k"), joined(pair).alias("key"),
                 joined(tuple(i for i in range(4) if i not in pair)).alias("rest"))
        for k, pair in enumerate(BLOCK_PAIRS)
    ])


def _first_agreeing(blocks: list[Column]) -> Column:
    """Index of the first block pair in which an xor is zero."""
    out = F.lit(None).cast("int")
    for k, (i, j) in reversed(list(enumerate(BLOCK_PAIRS))):
        out = F.when((blocks[i] == 0) & (blocks[j] == 0), k).otherwise(out)
    return out


def _near_by_blocks(values: DataFrame, radius: int, hot: int) -> DataFrame:
    keyed = values.select("phash", F.inline(_block_keys(F.col("phash"))))
    crowded = materialise(
        keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot).drop("__n"), "crowded")
    keys = ["k", "key"]
    if not crowded.isEmpty():
        keys += ["s", "sub"]
        keyed = _split_crowded(keyed, crowded)
    left = keyed.withColumnsRenamed({"phash": "phash_a", "rest": "__ra"})
    right = keyed.withColumnsRenamed({"phash": "phash_b", "rest": "__rb"})
    diff, rest = F.col("phash_a").bitwiseXOR(F.col("phash_b")), F.col("__ra").bitwiseXOR(F.col("__rb"))
    test = (
        (F.col("phash_a") < F.col("phash_b")) & (F.bit_count(rest) <= radius)
        & (_first_agreeing([bits(diff, 48 - 16 * i, 16) for i in range(4)]) == F.col("k"))
    )
    if "s" in keys:
        first_sub = _first_agreeing([bits(rest, 24 - 8 * i, 8) for i in range(4)])
        test = test & ((F.col("s") == -1) | (first_sub == F.col("s")))
    return skew.shuffled(left, right, keys).where(test).select(
        "phash_a", "phash_b", F.bit_count(rest).cast("int").alias("distancia"))


def _split_crowded(keyed: DataFrame, crowded: DataFrame) -> DataFrame:
    """Second-level keys for the rows of crowded keys, the neutral (-1, 0) for all others."""
    byte = [bits(F.col("rest"), 24 - 8 * i, 8) for i in range(4)]
    finer = F.array(*[
        F.struct(F.lit(s).alias("s"), F.shiftleft(byte[i], 8).bitwiseOR(byte[j]).alias("sub"))
        for s, (i, j) in enumerate(BLOCK_PAIRS)
    ])
    coarse = F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).cast("bigint").alias("sub")))
    return keyed.join(crowded.withColumn("__hot", F.lit(True)), ["k", "key"], "left").select(
        "phash", "rest", "k", "key", F.inline(F.when(F.col("__hot"), finer).otherwise(coarse)))


def _layout(blocks: int) -> list[tuple[int, int]]:
    """(low bit, width) of near-equal blocks covering the hash."""
    edges = [HASH_BITS * i // blocks for i in range(blocks + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _near_by_probing(values: DataFrame, radius: int, hot: int) -> DataFrame:
    layout = _layout(radius // 3 + 1)
    slack = radius // len(layout)
    tag = 60  # block widths stay below this bit, so block number and probed value share one join key

    def probes(flip: bool) -> list[Column]:
        out = []
        for j, (low, width) in enumerate(layout):
            block = bits(F.col("phash"), low, width).bitwiseOR(F.lit(j << tag).cast("bigint"))
            out.append(block)
            if flip:
                out += [block.bitwiseXOR(F.lit(1 << i).cast("bigint")) for i in range(width)]
        return out

    # One wrong bit is found by the right side alone; two need one flip on each side, lower bit on the left.
    def keyed(name: str, flip: bool, pos: str) -> DataFrame:
        return values.select(F.col("phash").alias(name), F.posexplode(F.array(*probes(flip))).alias(pos, "key"))

    left, right = keyed("phash_a", slack > 1, "__i"), keyed("phash_b", slack > 0, "__j")
    sizes = materialise(
        right.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot)
        .select("key", F.ceil(F.col("__n") / hot).cast("int").alias("__slices")), "crowded")
    keys = ["key"]
    if not sizes.isEmpty():
        keys += ["p", "q"]
        left, right = _sliced(left, sizes, "phash_a", "p", "q"), _sliced(right, sizes, "phash_b", "q", "p")
    diff = F.col("phash_a").bitwiseXOR(F.col("phash_b"))
    found_by = F.lit(None).cast("int")
    for j, (low, width) in reversed(list(enumerate(layout))):
        found_by = F.when(F.bit_count(bits(diff, low, width)) <= slack, j).otherwise(found_by)
    test = (
        (F.col("phash_a") < F.col("phash_b")) & (F.bit_count(diff) <= radius)
        & (found_by == F.shiftrightunsigned("key", tag))
    )
    if slack > 1:
        starts = [sum(w + 1 for _, w in layout[:j]) for j in range(len(layout))]
        test = test & ((F.col("__i") < F.col("__j")) | ((F.col("__i") == F.col("__j")) & F.col("__i").isin(starts)))
    return skew.shuffled(left, right, keys).where(test).select(
        "phash_a", "phash_b", F.bit_count(diff).cast("int").alias("distancia"))


def _sliced(side: DataFrame, sizes: DataFrame, name: str, own: str, other: str) -> DataFrame:
    """Cut crowded keys into slices; every slice of one side meets every slice of the other once."""
    n = F.coalesce("__slices", F.lit(1))
    return side.join(sizes, "key", "left").select(
        *side.columns, F.pmod(F.xxhash64(name), n).cast("int").alias(own),
        F.explode(F.sequence(F.lit(0), n - 1)).alias(other)
    )


def near_hashes(values: DataFrame, radius: int = PHASE_THRESHOLD, hot: int = HOT_KEY) -> DataFrame:
    """(phash_a, phash_b, distancia) for all pairs of distinct hash values with 1 <= distance <= radius."""
    distinct = skew.spread(values.select("phash").distinct(), "phash")
    return _near_by_blocks(distinct, radius, hot) if radius <= 2 else _near_by_probing(distinct, radius, hot)


def image_pairs(contents: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of distinct images in range, equal hashes included: the listing form of the similarity join."""
    rows = contents.groupBy("sha256").agg(F.min("phash").alias("phash"))
    across = (
        skew.across_key_pairs(
            edges, rows.select(F.col("phash").alias("phash_a"), F.col("sha256").alias("__x")),
            rows.select(F.col("phash").alias("phash_b"), F.col("sha256").alias("__y")), "phash_a", "phash_b")
        .select(F.least("__x", "__y").alias("sha256_a"), F.greatest("__x", "__y").alias("sha256_b"), "distancia")
    )
    same = skew.within_key_pairs(rows, ["phash"], "sha256", ["sha256"]).select(
        F.col("a.sha256").alias("sha256_a"), F.col("b.sha256").alias("sha256_b"), F.lit(0).alias("distancia")
    )
    return across.unionByName(same)


def distance_counts(contents: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of image pairs per distance, counted from hash multiplicities without listing a pair."""
    values = hash_values(contents)
    n = values.select("phash", "n")
    across = (
        edges.join(n.select(F.col("phash").alias("phash_a"), F.col("n").alias("na")), "phash_a")
        .join(n.select(F.col("phash").alias("phash_b"), F.col("n").alias("nb")), "phash_b")
        .select("distancia", (F.col("na") * F.col("nb")).alias("pares"))
    )
    same = values.where("n > 1").select(
        F.lit(0).alias("distancia"), F.expr("n * (n - 1) div 2").alias("pares"))
    return across.unionByName(same).groupBy("distancia").agg(F.sum("pares").alias("pares"))
