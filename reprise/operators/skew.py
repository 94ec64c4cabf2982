"""Building blocks that keep hot keys from landing in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reprise.session import materialise

PAIR_BLOCK = 2000
#: Pairs that a task makes on average.
TASK_PAIRS = 1 << 20


def shuffled(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of rows that were exploded to many keys, or read from a file of few distinct values, which must not be broadcast.

    Spark takes a side for as large as the file or shuffle below its ``explode``, so the probes of a small table, many times its
    rows, would pass for small and be gathered in the driver; so would links of hashes, which Parquet packs to a twentieth. AQE
    only corrects what has a shuffle of its own.
    """
    return left.join(right.hint("merge"), list(keys), how)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that are about to be exploded, dealt to as many tasks as there are shuffle partitions; AQE and the reader would go by
    their bytes and put all of a small table into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def stand_in(keys: DataFrame, key: str) -> Column:
    """A number for each value of ``key``, no two of ``keys`` (distinct) with the same one: a hash, with the next seed as long as two
    share theirs. Rows that are shuffled again and again carry it in place of a long text."""
    seed = 0
    while True:
        number = hashed(seed, key)
        if keys.groupBy(number.alias("__number")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").isEmpty():
            return number
        seed += 1


def hashed(seed: int, key: str) -> Column:
    # The seed goes first: behind the key it would leave keys with one hash alike.
    return F.xxhash64(F.lit(seed), F.col(key))


def reduce_wanted(
    df: DataFrame, wanted: DataFrame, key: str, reduce: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``reduce`` over the rows whose ``key`` is wanted; ``reduce`` must group by ``key`` and more. ``wanted`` is distinct.

    Rows are combined first: a shuffled semi-join would put a hot key in one task, and the aggregate behind it would reuse
    that partitioning. The join is an inner one because a semi-join would be pushed back below the aggregate.
    """
    return reduce(df).join(wanted.select(key), key)


def unmatched(reduced: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Aggregated rows without a match. Written as an outer join: an anti-join would be pushed below the aggregate, where
    the rows of a hot key are not combined yet. ``known`` may repeat its keys."""
    seen = known.select(*keys).distinct().withColumn("__seen", F.lit(True))
    return reduced.join(seen, list(keys), "left").where(F.col("__seen").isNull()).drop("__seen")


def across_key_pairs(
    edges: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str, block: int = PAIR_BLOCK,
) -> DataFrame:
    """``edges`` (distinct pairs of keys, other columns kept) with every row of ``left`` under the one key and every row of
    ``right`` under the other, whose columns besides the key must differ in name.

    Both ends are cut into slices of about ``block`` rows. A cell is one edge with one slice of each end; both sides are
    brought to the cell before they meet, so a task sees at most block x block rows of two keys however large these are.
    """
    def slices(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    def sliced(rows: DataFrame, key: str, counts: DataFrame, n: str, own: str) -> DataFrame:
        return rows.join(counts, key).withColumn(own, F.pmod(F.xxhash64(*rows.columns), F.col(n)).cast("int")).drop(n)

    n_left, n_right = slices(left, left_key, "__nl"), slices(right, right_key, "__nr")
    cells = materialise(
        shuffled(shuffled(edges, n_left, [left_key]), n_right, [right_key])
        .withColumn("__p", F.explode(F.sequence(F.lit(0), F.col("__nl") - 1)))
        .withColumn("__q", F.explode(F.sequence(F.lit(0), F.col("__nr") - 1))).drop("__nl", "__nr"), "cells")
    cell = [left_key, right_key, "__p", "__q"]
    first = shuffled(cells, sliced(left, left_key, n_left, "__nl", "__p"), [left_key, "__p"])
    second = shuffled(cells.select(*cell), sliced(right, right_key, n_right, "__nr", "__q"), [right_key, "__q"])
    return shuffled(first, second, cell).drop("__p", "__q")


def within_key_pairs(
    df: DataFrame, keys: Sequence[str], order: str, payload: Sequence[str], block: int = PAIR_BLOCK,
    condition=None,
) -> DataFrame:
    """Every unordered pair of rows that share ``keys``, as structs ``a`` and ``b`` with ``a.order < b.order``.

    A key with n rows is cut into ceil(n / block) slices. A pair of slices is one join key, so one task never sees more
    than ``block`` x ``block`` rows of a key however large the key is, and each pair meets in exactly one cell. Keys with a
    single row never enter the join. ``order`` must be unique inside a key.

    Tasks are as many as the pairs need, not the rows: what follows may hold as much as all pairs of a task.
    """
    row = F.struct(F.col(order), *[F.col(c) for c in payload if c != order])
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    # Written once: the two sides are keyed differently, so Spark would otherwise work the rows out for each of them.
    sliced = materialise(df.join(sizes, list(keys)).select(
        *keys, row.alias("__row"), "__n", F.ceil(F.col("__n") / block).cast("int").alias("__slices"),
        F.pmod(F.xxhash64(F.col(order)), F.ceil(F.col("__n") / block)).cast("int").alias("__slice"),
    ), "sliced")
    left = sliced.select(
        *keys, F.col("__row").alias("__l"), F.col("__slice").alias("__p"),
        F.explode(F.sequence(F.col("__slice"), F.col("__slices") - 1)).alias("__q"),
    )
    right = sliced.select(
        *keys, F.col("__row").alias("__r"), F.explode(F.sequence(F.lit(0), F.col("__slice"))).alias("__p"),
        F.col("__slice").alias("__q"),
    )
    cell = [*keys, "__p", "__q"]
    tasks = -(-(sliced.agg(F.sum(F.col("__n") - 1)).first()[0] or 0) // (2 * TASK_PAIRS))
    if tasks > 1:
        left, right = left.repartition(tasks, *cell), right.repartition(tasks, *cell)
    lo, ro = F.col(f"__l.{order}"), F.col(f"__r.{order}")
    pairs = shuffled(left, right, cell).where(
        ((F.col("__p") < F.col("__q")) & (lo != ro)) | ((F.col("__p") == F.col("__q")) & (lo < ro))
    )
    out = pairs.select(
        *keys,
        F.when(lo < ro, F.col("__l")).otherwise(F.col("__r")).alias("a"),
        F.when(lo < ro, F.col("__r")).otherwise(F.col("__l")).alias("b"),
    )
    return out if condition is None else out.where(condition)


def lead_within(
    df: DataFrame, key: str, position: Column, order: Sequence[Column], value: Column, name: str, width: int = 4096
) -> DataFrame:
    """``lead(value)`` over ``key`` ordered by ``order``, without putting a whole key in one window partition.

    ``position`` is the leading order column as a number; rows are windowed per range of ``width`` positions, and the last
    row of a range takes the first row of the next range of its key.
    """
    ranged = df.withColumn("__range", F.floor(position / width))
    inside = W.partitionBy(key, "__range").orderBy(*order)
    nexts = ranged.withColumn("__next", F.lead(value).over(inside))
    heads = (
        ranged.groupBy(key, "__range").agg(F.min_by(value, F.struct(*order)).alias("__head"))
        .withColumn("__following", F.lead("__head").over(W.partitionBy(key).orderBy("__range")))
        .select(key, "__range", "__following")
    )
    return (
        nexts.join(heads, [key, "__range"])
        .withColumn(name, F.coalesce("__next", "__following"))
        .drop("__next", "__following", "__range")
    )


def ranked(df: DataFrame, major: Sequence[str], digest: str, name: str) -> DataFrame:
    """Global 1-based rank by ``major`` descending, ties by the unique ``digest``.

    Rows are dealt out by range, with splitters that Spark samples, and sorted where they lie; a row's number is its place there
    plus the rows of the partitions before. Those counts are all that is gathered, one for each partition.
    """
    order = [*[F.desc(c) for c in major], F.col(digest)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    before, offsets = 0, []
    for part, count in sorted(tuple(r) for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((part, before))
        before += count
    start = df.sparkSession.createDataFrame(offsets, "__part bigint, __before bigint")
    place = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(start), "__part").withColumn(name, place).drop("__part", "__at", "__before")


MEDIAN_BIN = 1 << 16


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Median per key of whole numbers, by counting in two levels.

    Values are counted by bins of ``MEDIAN_BIN``, which are few for any key (coordinates in micro-degrees: a few thousand). The
    one or two bins that hold the middle are looked at again, value by value, at most ``MEDIAN_BIN`` of them. Rows are combined
    before they reach either step, so a key with any number of rows costs no more than that.
    """
    counts = materialise(
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__bin", F.floor(F.col(value) / MEDIAN_BIN)), "median-counts")
    bins = counts.groupBy(*keys, "__bin").agg(F.sum("__c").alias("__c"))
    upto = F.sum("__c").over(W.partitionBy(*keys).orderBy("__bin").rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.sum("__c").over(W.partitionBy(*keys))
    ranges = bins.select(*keys, "__bin", (upto - F.col("__c")).alias("__before"), upto.alias("__upto"), total.alias("__n"))
    middle = ranges.withColumn("__rank", F.explode(F.array(F.floor((F.col("__n") + 1) / 2), F.floor((F.col("__n") + 2) / 2))))
    middle = middle.where((F.col("__before") < F.col("__rank")) & (F.col("__rank") <= F.col("__upto")))
    inside = W.partitionBy(*keys, "__bin").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    held = counts.join(middle.select(*keys, "__bin").distinct(), [*keys, "__bin"]).withColumn("__within", F.sum("__c").over(inside))
    picked = held.join(middle.select(*keys, "__bin", "__before", "__rank"), [*keys, "__bin"]).where(
        F.col("__before") + F.col("__within") >= F.col("__rank")).groupBy(*keys, "__rank").agg(F.min(value).alias("__v"))
    # An odd number of values has one middle rank, an even one two.
    return picked.groupBy(*keys).agg((F.sum("__v") / F.count(F.lit(1))).alias(name))
