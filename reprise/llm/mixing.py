"""Mixing sources to target weights by systematic sampling, in DataFrame expressions only.

Every source gets a target, every document of a source the same expected number of copies ``target / source size``.
Within a source the documents are put in order of size (sixteen classes for each power of two, shuffled inside a class),
the expected copies are prefix-summed, one random offset is added, and a document is emitted once for each integer that
its stretch of the sum crosses. Ordering by size makes the words taken follow the target closely, not only the documents.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; a source without words gets
target 0 and its documents no copies; rows that repeat an id are separate documents; an empty table gives no rows; extra
columns are kept whatever their names, but :func:`mix` replaces those that begin with its prefix. Reruns agree: the order
depends on hashed ids and, where rows repeat an id, on their sizes; rows equal in both are taken equally often in total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reprise.llm.common import WORD

#: Sources in code-point order weigh 3, 1, 2, 3, 1, 2, ...
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
P = "__mix_"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _unit(text: Column) -> Column:
    """A number in [0, 1) from the hash of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets of (source, source_size), one row per source.

    Filling all sources by weight, stopping each at ``most`` times its size and resharing the excess ends at one level L
    with target = min(cap, L * weight). In order of cap / weight the stopped sources come first; L is the level at which
    the first source is not stopped, and the highest of those that the later ones would give.
    """
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by_level = Window.orderBy("__level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        sources.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (rank - 1) % len(weights) + 1))
        .withColumn("__cap", F.col("source_size") * most)
        .withColumn("__total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("__level", F.col("__cap") / F.col("__w"))
        .withColumn("__fill", (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0))) / F.sum("__w").over(after))
        .withColumn("__fill", F.max(F.when(F.col("__level") > F.col("__fill"), F.col("__fill"))).over(every))
        .withColumn("target", F.coalesce(
            F.least(F.col("__cap").cast("double"), F.col("__fill") * F.col("__w")), F.col("__cap").cast("double")))
        .select("source", "source_size", "target")
    )


def size_class(size: Column) -> Column:
    """Sizes below 16 as they are, above that sixteen classes for each power of two; integer arithmetic only."""
    bits = F.length(F.bin(size))
    top = F.call_function("shiftright", size, bits - 5).bitwiseAND(15)
    return F.when(size < 16, size).otherwise(bits * 16 + top)


def mix(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, prefix: str = P) -> DataFrame:
    """``docs`` with the columns size, source_size, target and copies, whose names begin with ``prefix``.

    The place of a document in its source is the count of the size classes before its own, plus the count of the 256 hash
    slices before its own in the class, plus its rank in the slice. Only slices are ranked in a window; classes and slices
    are counted first. So a source with a third of all rows is spread over thousands of window keys.
    """
    size = word_count(F.col(text_col)) if size is None else size
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    keyed = (
        docs.drop(*(c for c in docs.columns if c.startswith(prefix))).withColumn(prefix + "size", size)
        .withColumn(prefix + "source", F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")))
        .withColumn(prefix + "class", size_class(F.col(prefix + "size")).cast("int"))
        .withColumn(prefix + "digest", digest)
        .withColumn(prefix + "slice", F.conv(F.substring(prefix + "digest", 1, 2), 16, 10).cast("int"))
    )
    cell = [prefix + "source", prefix + "class", prefix + "slice"]
    counted = keyed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum(prefix + "size").alias("words"))
    per_class = counted.groupBy(*cell[:2]).agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    in_source = Window.partitionBy(cell[0]).orderBy(cell[1])
    class_start = per_class.select(*cell[:2], (F.sum("n").over(in_source) - F.col("n")).alias("class_start"))
    source = F.when(F.col(cell[0]) != "", F.expr(f"substring({cell[0]}, 2)")).alias("source")
    sizes = per_class.groupBy(cell[0]).agg(F.sum("words").alias("source_size")).select(source, "source_size")
    targets = source_targets(sizes, weights, share, most).select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias(cell[0]),
        F.col("source_size").alias(prefix + "source_size"), F.col("target").alias(prefix + "target"))
    in_class = Window.partitionBy(*cell[:2]).orderBy(cell[2])
    places = (
        counted.select(*cell, (F.sum("n").over(in_class) - F.col("n")).alias("slice_start"))
        .join(class_start, cell[:2]).join(targets, cell[0])
        .select(*cell, (F.col("class_start") + F.col("slice_start")).alias(prefix + "start"), prefix + "source_size", prefix + "target")
    )
    rank = F.col(prefix + "start") + F.row_number().over(Window.partitionBy(*cell).orderBy(prefix + "digest", F.col(id_col), prefix + "size"))
    rate = F.when(F.col(prefix + "source_size") > 0, F.col(prefix + "target") / F.col(prefix + "source_size")).otherwise(F.lit(0.0))
    offset = _unit(F.concat(F.lit(seed + "/"), F.col(cell[0])))
    return (
        keyed.join(places, cell)
        .withColumn(prefix + "rank", rank).withColumn(prefix + "rate", rate).withColumn(prefix + "offset", offset)
        .withColumn(prefix + "copies", F.expr(
            f"cast(floor({prefix}rank * {prefix}rate + {prefix}offset) - floor(({prefix}rank - 1) * {prefix}rate + {prefix}offset) as int)"))
        .drop(prefix + "class", prefix + "digest", prefix + "slice", prefix + "source", prefix + "start", prefix + "rank", prefix + "rate", prefix + "offset")
    )


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    prefix = P
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    mixed = mix(docs, **options, prefix=prefix).where(F.col(prefix + "copies") > 0)
    return mixed.withColumn(prefix + "copy", F.explode(F.sequence(F.lit(1), F.col(prefix + "copies")))).select(*docs.columns)


#: The same mix for one engine's window over each whole source.
SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w,
         source_size * 2 AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total FROM s),
f AS (
  SELECT *, CAST(cap AS DOUBLE) / w AS level,
         (total - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST
                         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS fill FROM w),
t AS (
  SELECT source, source_size,
         coalesce(least(cap::DOUBLE, max(CASE WHEN level > fill THEN fill END) OVER () * w), cap::DOUBLE) AS target FROM f),
r AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
         CAST('0x' || substr(md5('{SEED}/' || coalesce('=' || d.source, '')), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY d.source ORDER BY
           CASE WHEN size < 16 THEN size ELSE len(bin(size)) * 16 + ((size >> (len(bin(size)) - 5)::INT) & 15) END,
           substr(digest, 1, 2), digest, doc_id, size) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(k::DOUBLE * rate + u) - floor((k - 1)::DOUBLE * rate + u)) AS BIGINT) AS taken
FROM r
"""
