"""Large JSON objects read as key-value rows by many tasks.

The files are read as text cut at commas, which Spark splits by byte ranges. Whether a comma ends an entry depends on what
stands before it: it must be outside strings and directly inside the object. A first pass finds for each split how quotes and
brackets change that state, if the split starts outside a string and if it starts inside one. The states of the splits, a few numbers
each, are then known by going through them in order. A second pass cuts each split into entries; what lies before its first and after
its last border is put together with its neighbours' in one small task per file.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PIECE = "file string, start long, turn int, whole boolean, text string"


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep=",").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _splits(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[str]]]:
    """Consecutive rows of one split."""
    files, starts, values = (batch.column(c).to_pylist() for c in ("file", "start", "value"))
    a = 0
    for b in range(1, len(values) + 1):
        if b == len(values) or (files[b], starts[b]) != (files[a], starts[a]):
            yield files[a], starts[a], values[a:b]
            a = b


def scan(rows: list[str], inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(inside a string, depth of brackets) at the comma behind each row, from the state in front of the first."""
    raw = [r.encode() + b"," for r in rows]
    data = np.frombuffer(b"".join(raw), np.uint8)
    place = np.arange(len(data))
    other = np.maximum.accumulate(np.where(data != 92, place, -1))  # the last byte that is no backslash
    before = np.concatenate([[-1], other[:-1]])
    escaped = (place - 1 - before) % 2 == 1
    quote = (data == 34) & ~escaped
    string = (np.cumsum(quote) + inside) % 2 == 1
    step = np.zeros(len(data), np.int64)
    step[(data == 123) | (data == 91)] = 1
    step[(data == 125) | (data == 93)] = -1
    levels = depth + np.cumsum(np.where(string, 0, step))
    ends = np.cumsum([len(r) for r in raw]) - 1
    return string[ends], levels[ends]


def _changes(fragments: DataFrame) -> dict[str, list[tuple[int, bool, int, int]]]:
    """Of each file, by place: (start, whether quotes are odd, change of depth from outside a string, from inside one)."""

    kinds = {"file": pa.string(), "start": pa.int64(), "odd": pa.bool_(), "outside": pa.int64(), "inside": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {c: [] for c in kinds}
            for file, start, rows in _splits(batch):
                string, outside = scan(rows, False, 0)
                for c, v in zip(kinds, (file, start, bool(string[-1]), int(outside[-1]), int(scan(rows, True, 0)[1][-1]))):
                    found[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(found[c], t) for c, t in kinds.items()], names=list(kinds))

    # A split may come in several batches: numbered in order within their task, a few rows per split.
    rows = fragments.mapInArrow(run, "file string, start long, odd boolean, outside long, inside long").withColumn(
        "turn", F.monotonically_increasing_id())
    out: dict[str, list[tuple[int, bool, int, int]]] = defaultdict(list)
    for r in rows.orderBy("file", "start", "turn").collect():
        out[r["file"]].append((r["start"], r["odd"], r["outside"], r["inside"]))
    return out


def _states(changes: dict[str, list[tuple[int, bool, int, int]]]) -> dict[tuple[str, int], tuple[bool, int]]:
    """State in front of each split."""
    states: dict[tuple[str, int], tuple[bool, int]] = {}
    for file, parts in changes.items():
        inside, depth = False, 0
        for start, odd, outside, within in parts:
            states.setdefault((file, start), (inside, depth))
            depth += within if inside else outside
            inside ^= odd
    return states


def _pieces(fragments: DataFrame, states) -> DataFrame:
    """Whole entries, and by split what precedes its first border (turn 0) and follows its last one (turn 1); a split without
    a border is one piece of turn 0."""
    shared = fragments.sparkSession.sparkContext.broadcast(states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple[str, int] | None = None
        state, held, borders = (False, 0), [], 0
        out: list[tuple] = []

        def leave() -> None:
            if here is not None:
                out.append((*here, min(borders, 1), False, ",".join(held)))

        for batch in batches:
            for file, start, rows in _splits(batch):
                if (file, start) != here:
                    leave()
                    here, state, held, borders = (file, start), shared.value[file, start], [], 0
                string, depth = scan(rows, *state)
                state = (bool(string[-1]), int(depth[-1]))
                a = 0
                for b in np.flatnonzero(~string & (depth == 1)).tolist():
                    entry = ",".join([*held, *rows[a:b + 1]])
                    out.append((file, start, 0, borders > 0, entry))
                    held, a, borders = [], b + 1, borders + 1
                held += rows[a:]
            if out:
                yield table(out)
                out.clear()
        leave()
        yield table(out)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[c.split()[0] for c in _PIECE.split(", ")])

    return fragments.mapInArrow(run, _PIECE)


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entries that cross splits of one file, from two pieces per split, and its first and last one without the object's brackets."""
    pdf = pdf.sort_values(["start", "turn"])
    entries, held = [], []
    for turn, text in zip(pdf["turn"], pdf["text"]):
        if turn == 1:  # a border lies in front of it, and another one behind it if it is empty
            entries.append(",".join(held))
            held = [text] if text else []
        else:
            held.append(text)
    entries.append(",".join(held))
    entries[-1] = entries[-1].rstrip().removesuffix("}")
    entries[0] = entries[0].lstrip("\ufeff \t\r\n").removeprefix("{")
    return pd.DataFrame({"text": pd.Series([e for e in entries if e.strip()], dtype=object)})


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(text): every entry ``"key": value`` of the objects in the files of ``path``, each file one object."""
    fragments = _fragments(spark, path)
    pieces = _pieces(fragments, _states(_changes(fragments)))
    crossing = pieces.where("not whole").groupBy("file").applyInPandas(_joined, "text string")
    return pieces.where("whole").select("text").unionByName(crossing)


def read_map(spark: SparkSession, path: str, value_type: str, key: str, value: str) -> DataFrame:
    """(key, value) of all entries."""
    entry = F.concat(F.lit("{"), F.col("text"), F.lit("}"))
    return read_entries(spark, path).select(F.explode(F.from_json(entry, f"map<string,{value_type}>")).alias(key, value))


def write_map(rows: DataFrame, key: str, value: str, path: str) -> None:
    """One object per task, an entry a line."""
    single = F.to_json(F.create_map(F.col(key).cast("string"), F.col(value)))
    entries = rows.select(F.substring(single, F.lit(2), F.length(single) - 2).alias("value"))

    def frame(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark = "{"
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"value": [mark + pdf["value"].iloc[0], *("," + pdf["value"].iloc[1:])]})
                mark = ","
        if mark == ",":
            yield pd.DataFrame({"value": ["}"]})

    entries.mapInPandas(frame, "value string").write.text(path)
