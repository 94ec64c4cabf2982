"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts at exactly these characters.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``taken`` has it."""
    lower, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in lower:
            name = "_" + name
        out.append(name)
    return out


#: Bytes of text that a Python worker is given at once, or one longer text. Spark's own bound lets each of an executor's
#: workers hold tens of megabytes several times over: in the JVM, as Arrow data and as Python strings.
BATCH_BYTES = 4 << 20


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose session from now on gives texts to Python workers in batches of ``BATCH_BYTES``."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def give_back() -> None:
    """Returns freed memory to the system. Python workers live on between tasks, and would hold what the largest one took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a partition, which gives memory back at its end."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def ids_of(series: pd.Series) -> list[int | None]:
    """Identifiers as Python integers; pandas turns a column with nulls into floats or objects."""
    return [None if pd.isna(v) else int(v) for v in series]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of polynomial hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLES: dict[np.uint64, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next text."""
    known = _TABLES.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 4096), base, np.uint64)
        known[0] = 1
        known = _TABLES[base] = np.multiply.accumulate(known)
    return known[:n]


class Runs:
    """64-bit hashes of runs of consecutive values, from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, h: np.ndarray):
        self.n = len(h)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(h * _powers(_BASE, self.n), out=self.sums[1:])

    def between(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * _powers(_INVERSE, self.n + 1)[start])

    def every(self, width: int) -> np.ndarray:
        """Of all runs of ``width`` values, in order."""
        if self.n < width:
            return np.empty(0, np.uint64)
        return mix64((self.sums[width:] - self.sums[:-width]) * _powers(_INVERSE, self.n + 1)[: self.n - width + 1])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by prefix and suffix minima of blocks."""
    m = len(a) - width + 1
    if m <= 0:
        return a[:0]
    padded = np.concatenate([a, np.full(-len(a) % width, np.iinfo(a.dtype).max, a.dtype)]).reshape(-1, width)
    front = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:m], front[width - 1:width - 1 + m])


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow column of lists, without a Python object for each number."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind.to_pandas_dtype(), copy=False), kind))


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64, copy=False).view(np.int64)


def streamed_groups(
    df: DataFrame, keys: list[str], step: Callable[[dict[str, np.ndarray]], dict | None], schema: str,
    prepare: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
) -> DataFrame:
    """Apply ``step`` to the rows of every key, given as NumPy columns.

    Rows are dealt out by key and sorted within the partition, so one key is held at a time. Compared with a grouped
    pandas call the cost of a key is a few microseconds, which matters with millions of small keys. The caller bounds the
    size of a key (see :func:`cells`). Keys are not null. ``prepare`` is applied to many keys at once before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        out: list[dict] = []

        def close(frame: pd.DataFrame) -> None:
            cols = {c: frame[c].to_numpy() for c in frame.columns}
            n = len(frame)
            cut = np.zeros(n, bool)
            for k in keys:
                cut[1:] |= cols[k][1:] != cols[k][:-1]
            edges = [0, *np.flatnonzero(cut).tolist(), n]
            for a, b in zip(edges, edges[1:]):
                got = step({c: v[a:b] for c, v in cols.items()})
                if got is not None:
                    out.append(got)

        def drain() -> Iterator[pd.DataFrame]:
            if out:
                yield pd.DataFrame({c: np.concatenate([o[c] for o in out]) for c in out[0]})
                out.clear()

        for pdf in batches:
            if not len(pdf):
                continue
            if prepare is not None:
                pdf = prepare(pdf)
            last = pdf[keys].iloc[-1]
            same = np.ones(len(pdf), bool)
            for k in keys:
                same &= pdf[k].to_numpy() == last[k]
            start = len(pdf) - int(np.argmin(same[::-1])) if not same.all() else 0
            if start:
                close(pd.concat([*held, pdf.iloc[:start]]) if held else pdf.iloc[:start])
                held = [pdf.iloc[start:]]
            elif held and any(held[-1][k].iloc[-1] != last[k] for k in keys):
                close(pd.concat(held))
                held = [pdf]
            else:
                held.append(pdf)
            yield from drain()
        if held:
            close(pd.concat(held))
        yield from drain()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(released(run), schema)


def cells(rows: DataFrame, key: str, item: Column, block: int, known: str | None = None) -> DataFrame:
    """Deal the rows of each key, at least two of them, to cells of two slices, so that every pair of rows meets once.

    A key with n rows has ceil(n / block) slices and its cells (p, q), p <= q, hold the rows of slices p and q: a task
    sees about 2 * block rows of a key however many it has, and nothing is dropped. Adds ``cell_p``, ``cell_q`` and the
    row's own ``slice``; in a cell with p < q only pairs across the two slices are to be compared. ``known`` names a column
    with the rows of the key, if there is one.
    """
    if known is None:
        counted = rows.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("key_rows")).where("key_rows > 1"), key)
    else:
        counted = rows.withColumnRenamed(known, "key_rows").where("key_rows > 1")
    slices = F.ceil(F.col("key_rows") / F.lit(float(block))).cast("int")
    return (
        counted.withColumn("slices", slices)
        .withColumn("slice", F.pmod(item, F.col("slices")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .withColumn("cell_p", F.least("slice", "other"))
        .withColumn("cell_q", F.greatest("slice", "other"))
        .drop("key_rows", "slices", "other")
    )


class Sets:
    """Union-find over positions 0..n-1 of one bounded cell."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


BITMAP_BITS = 24


def bit_of(column: str) -> Column:
    """The place of an id in a bitmap of 2^BITMAP_BITS bits."""
    return F.pmod(F.xxhash64(column), F.lit(1 << BITMAP_BITS)).cast("int")


def bitmap(rows: DataFrame, bit: Column, bits: int = BITMAP_BITS) -> np.ndarray:
    """The places ``bit`` of all rows as 2^bits bits, whatever their number: safe to broadcast. Rows may share a place."""
    chunk = 18

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << chunk, np.uint8)
        flags[pdf["bit"].to_numpy() & ((1 << chunk) - 1)] = 1
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    packed = (
        rows.select(bit.cast("int").alias("bit")).distinct().withColumn("chunk", F.shiftright("bit", chunk))
        .groupBy("chunk").applyInPandas(pack, "chunk int, bits binary").collect()
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in packed:
        out[r["chunk"] << (chunk - 3):(r["chunk"] + 1) << (chunk - 3)] = np.frombuffer(r["bits"], np.uint8)
    return out


def is_set(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def may_be_in(df: DataFrame, column: str, bits: np.ndarray) -> Column:
    """A condition on the rows of ``df`` that holds for all ids of the bitmap and few others.

    The bitmap is a scalar subquery, an array of longs, so rows and their texts are tested where they are scanned and pass no
    Python worker.
    """
    words = df.sparkSession.createDataFrame(pa.table({"words": list_array([bits.view("<i8")], pa.int64())})).scalar()
    place = bit_of(column)
    return F.getbit(F.get(words, F.shiftright(place, 6)), place.bitwiseAND(63)) == 1


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(64).integers(0, 1 << 64, 256, dtype=np.uint64)
#: Bytes that are hashed at once.
_PIECE = 1 << 20


def word_bounds(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end place of every word of UTF-8 bytes; a word also ends at a cut (a place where a text begins)."""
    inside = ~_BLANK[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of many short ranges of bytes in ascending order, without an object for each."""
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        lo = int(starts[a])
        b = max(a + 1, int(np.searchsorted(starts, lo + _PIECE)))
        runs = Runs(_BYTE[data[lo:int(ends[b - 1])]])
        out[a:b] = runs.between(starts[a:b] - lo, ends[a:b] - lo) ^ (ends[a:b] - starts[a:b]).astype(np.uint64)
        a = b
    return out


def text_chunks(column: pa.Array, most: int = _PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive texts of a string column as (row of the first, their bytes, where each begins and the last ends), with
    about ``most`` bytes at once or one longer text."""
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + most)) - 1)
        stop = min(stop, len(column))
        yield row, whole[at[row]:at[stop]], at[row:stop + 1] - at[row]
        row = stop
