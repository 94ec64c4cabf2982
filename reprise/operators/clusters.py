"""Clusters of near-duplicate images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.functions.hashing import PHASE_THRESHOLD
from reprise.functions.images import PHOTO
from reprise.operators import hamming as near
from reprise.session import materialise


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) with the smallest node as label, by alternating large-star and small-star rounds.

    Every round is two min-aggregates and two joins on a node, so a hub with a huge neighbourhood is combined map-side and
    its join is split by AQE. Each round is written out; only two numbers come back to the driver.
    """
    current = materialise(
        edges.where(F.col(src) != F.col(dst))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct(), "components")
    state = _fingerprint(current)
    while True:  # every round shrinks the edges' labels, so it ends
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialise(
            both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "components")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialise(hooked.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "components")
        previous, state = state, _fingerprint(current)
        if state == previous:
            roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


#: Rounds between two compactions of the arcs that are left.
ROUNDS_PER_WRITE = 3


def _taken(arcs: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """(cluster, phash) of each seed: its neighbours in digest order while they are close to all that were taken before.

    A seed's neighbours pass a task in a sorted stream, whatever their number; only the cluster itself is held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seed, kept, size = None, np.empty(64, np.uint64), 0
        for pdf in batches:
            out_seed, out = [], []
            for h, g in zip(pdf["h"].tolist(), pdf["g"].tolist()):
                if h != seed:
                    seed, kept, size = h, np.empty(64, np.uint64), 1
                    kept[0] = h & (2**64 - 1)
                    out_seed.append(h)
                    out.append(h)
                value = np.uint64(g & (2**64 - 1))
                if (np.bitwise_count(kept[:size] ^ value) <= radius).all():
                    if size == len(kept):
                        kept = np.concatenate([kept, np.empty(size, np.uint64)])
                    kept[size] = value
                    size += 1
                    out_seed.append(h)
                    out.append(g)
            yield pd.DataFrame({"cluster": np.array(out_seed, np.int64), "phash": np.array(out, np.int64)})

    ordered = arcs.join(seeds, "h", "left_semi").select("h", "g", "sha_g").repartition("h").sortWithinPartitions("h", "sha_g", "g")
    return ordered.select("h", "g").mapInPandas(run, "cluster long, phash long")


def complete_linkage(values: DataFrame, edges: DataFrame, radius: int = PHASE_THRESHOLD) -> DataFrame:
    """(phash, cluster) so that all members of a cluster are within ``radius`` of each other.

    The sequential rule picks the image with most neighbours (ties: smallest digest), adds its neighbours in digest order
    while they stay close to everything already added, removes the set and repeats. A pick only depends on nodes up to two
    steps away, so every node that ranks first within two steps can be picked at the same time with the same result. Random
    digests as tie-break keep the number of rounds logarithmic in practice.

    No component is ever gathered, and no neighbourhood either, for any radius. A round writes what it picked; the arcs that are left
    are those of the last compaction without the nodes picked since, and are written anew every few rounds.
    """
    nodes = values.select("phash", "n", F.col("sha256_min").alias("sha"))
    far = nodes.select(F.col("phash").alias("g"), F.col("n").alias("n_g"), F.col("sha").alias("sha_g"))
    base = materialise(
        edges.select(F.col("phash_a").alias("h"), F.col("phash_b").alias("g"))
        .unionByName(edges.select(F.col("phash_b").alias("h"), F.col("phash_a").alias("g"))).join(far, "g")
        .join(nodes.select(F.col("phash").alias("h"), F.col("n").alias("n_h"), F.col("sha").alias("sha_h")), "h"),
        "linkage")
    assigned, recent, rounds = None, None, 0

    def remaining() -> DataFrame:
        if recent is None:
            return base
        return base.join(recent.select(F.col("phash").alias("h")), "h", "left_anti").join(
            recent.select(F.col("phash").alias("g")), "g", "left_anti")

    while True:  # every round picks at least the node that ranks first of all, until no arc is left
        if rounds and rounds % ROUNDS_PER_WRITE == 0:
            base, recent = materialise(remaining(), "linkage"), None
        arcs = remaining()
        weight = -(F.sum("n_g") + F.first("n_h"))
        rank = arcs.groupBy("h").agg(F.struct(weight.alias("w"), F.first("sha_h").alias("s")).alias("rank"))
        link = arcs.select("h", "g")
        one = link.join(rank.select(F.col("h").alias("g"), "rank"), "g").groupBy("h").agg(F.min("rank").alias("m1")).join(
            rank, "h").select("h", "rank", F.least("m1", "rank").alias("m1"))
        seeds = (
            link.join(one.select(F.col("h").alias("g"), F.col("m1").alias("__m")), "g").groupBy("h").agg(
                F.min("__m").alias("m2"))
            .join(one, "h").where(F.col("rank") == F.least("m2", "m1")).select("h")
        )
        done = materialise(_taken(arcs, seeds, radius), "linkage")
        if done.isEmpty():
            break
        assigned = done if assigned is None else assigned.unionByName(done)
        recent = done if recent is None else recent.unionByName(done)
        rounds += 1
    if assigned is None:
        return nodes.select("phash", F.col("phash").alias("cluster"))
    alone = nodes.join(assigned.select("phash"), "phash", "left_anti").select("phash", F.col("phash").alias("cluster"))
    return assigned.select("phash", "cluster").unionByName(alone)


def mixed_clusters(contents: DataFrame, classes: DataFrame, radius: int = PHASE_THRESHOLD) -> DataFrame:
    """(sha256, cluster): identical images plus near-duplicates, the latter only among inspection photos.

    The cluster is labelled by its smallest digest. Only hashes that meet another image need a class, so the class table is
    joined after the cheap prune to hashes with an edge or several digests.
    """
    contents = contents.groupBy("sha256").agg(F.min("phash").alias("phash"))
    photos = contents.join(classes.where(F.col("classe") == PHOTO).select("sha256"), "sha256", "left_semi")
    photos = materialise(photos, "photos")
    values = materialise(near.hash_values(photos), "hash-values")
    edges = materialise(near.near_hashes(values, radius), "edges")
    linked = complete_linkage(values, edges, radius)
    labels = linked.join(values, "phash").groupBy("cluster").agg(F.min("sha256_min").alias("label"))
    by_photo = (
        photos.join(linked, "phash").join(labels, "cluster").select("sha256", F.col("label").alias("cluster"))
    )
    return (
        contents.select("sha256").join(by_photo, "sha256", "left")
        .select("sha256", F.coalesce("cluster", "sha256").alias("cluster"))
    )
