"""Packing of documents into sequences by bounded-space online packing.

Documents are tokenised and end with id 1. Every partition keeps at most ``OPEN`` windows open and takes its documents as they
come: a document goes where it leaves the least room. If it fits nowhere and all windows are open, the fullest one is emitted,
filled up first with the head of the document; a window whose length is a power of two needs no padding and is emitted as it is.
Whole windows of a long document are emitted at once.

The windows that a partition leaves open are merged in rounds: those of ``FAN_IN`` partitions are packed in the same way,
as units that are cut only to fill a window up, until one group is left. Its last windows are joined, cut into full sequences, and what
remains into powers of two. No sequence needs padding then. A task holds its open windows, or those of ``FAN_IN`` tasks, and no more.

Defined cases: a null or empty text is one end mark; a very long text is many pieces; rows that repeat an id are documents of
their own; rows without an id are packed with a null id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.llm.common import ids_of, in_small_batches
from reprise.llm.packing import LENGTH, VOCABULARY, Tokenizer
from reprise.session import materialise

END = 1
OPEN = 32
FAN_IN = 16

_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part int, open boolean"


class Run(NamedTuple):
    """Consecutive ids of a document."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


def split(runs: list[Run], at: int) -> tuple[list[Run], list[Run]]:
    """The first ``at`` ids and the others."""
    head, left = [], at
    for k, run in enumerate(runs):
        if left < len(run.ids):
            if not left:
                return head, runs[k:]
            return [*head, run._replace(ids=run.ids[:left])], [run._replace(start=run.start + left, ids=run.ids[left:]), *runs[k + 1:]]
        head.append(run)
        left -= len(run.ids)
    return head, []


def unpadded(fill: int) -> bool:
    return fill & (fill - 1) == 0


class Windows:
    """At most ``most`` open windows of ``capacity`` ids."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.by_room: list[tuple[int, int]] = []
        self.runs: dict[int, list[Run]] = {}
        self.opened = 0

    def put(self, item: list[Run]) -> Iterator[list[Run]]:
        """Takes an item in; yields the sequences that are finished."""
        size = sum(len(r.ids) for r in item)
        while size:
            if size >= self.capacity:
                head, item = split(item, self.capacity)
                size -= self.capacity
                yield head
                continue
            at = bisect.bisect_left(self.by_room, (size, -1))
            if at < len(self.by_room):
                room, window = self.by_room.pop(at)
                self.runs[window] += item
                if room > size:
                    bisect.insort(self.by_room, (room - size, window))
                else:
                    yield self.runs.pop(window)
                return
            if len(self.by_room) < self.most:
                self.opened += 1
                self.runs[self.opened] = list(item)
                bisect.insort(self.by_room, (self.capacity - size, self.opened))
                return
            room, window = self.by_room.pop(0)
            full = self.runs.pop(window)
            if not unpadded(self.capacity - room):
                head, item = split(item, room)
                size -= room
                full = full + head
            yield full

    def rest(self) -> Iterator[list[Run]]:
        """The open windows as full sequences and powers of two."""
        joined = [r for _, window in self.by_room for r in self.runs[window]]
        left = sum(len(r.ids) for r in joined)
        while left:
            size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            head, joined = split(joined, size)
            left -= size
            yield head


class _Rows:
    """Rows of finished and open windows; ``first`` is the number of the first sequence."""

    def __init__(self, first: int, part: int, with_ids: bool):
        self.number, self.part, self.with_ids = first, part, with_ids
        self.rows: list[tuple] = []

    def add(self, runs: list[Run], still_open: bool = False) -> None:
        offset = 0
        for r in runs:
            raw = np.ascontiguousarray(r.ids, "<u4").tobytes()
            self.rows.append((r.doc_id, r.start, len(r.ids), zlib.crc32(raw), r.doc_tokens, self.number, offset,
                              raw if still_open or self.with_ids else None, self.part, still_open))
            offset += len(r.ids)
        self.number += 1

    def frame(self) -> pd.DataFrame:
        out = pd.DataFrame(self.rows, columns=[c.split()[0] for c in _PLACED.split(", ")])
        out["doc_id"] = out["doc_id"].astype("Int64")
        self.rows = []
        return out


def _first_number(merge: int, part: int) -> int:
    return merge << 56 | part << 32


def _online(docs: DataFrame, capacity: int, vocabulary: str, most: int, with_ids: bool) -> DataFrame:
    """Rows of finished windows, and with ``open`` those that each partition leaves."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, windows = Tokenizer(vocabulary), Windows(capacity, most)
        part = TaskContext.get().partitionId()
        rows = _Rows(_first_number(0, part), part, with_ids)
        end = np.array([END], "<u4")
        for pdf in batches:
            for doc_id, text in zip(ids_of(pdf["doc_id"]), pdf["text"]):
                ids = np.concatenate([tokenizer.encode(text), end])
                for full in windows.put([Run(doc_id, 0, ids, len(ids))]):
                    rows.add(full)
                if len(rows.rows) >= 5000:
                    yield rows.frame()
        for _, window in windows.by_room:
            rows.add(windows.runs[window], still_open=True)
        yield rows.frame()

    return docs.mapInPandas(run, _PLACED)


def _merged(left: DataFrame, merge: int, capacity: int, most: int, with_ids: bool, last: bool) -> DataFrame:
    """The open windows of ``FAN_IN`` parts packed as :func:`_online` packs documents; the last merge leaves none open."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "sequence_id", "offset"])
        part = int(pdf["part"].iloc[0]) // FAN_IN
        windows, rows = Windows(capacity, most), _Rows(_first_number(merge, part), part, with_ids)
        numbers = pdf["sequence_id"].to_numpy()
        runs = [Run(d, s, np.frombuffer(raw, "<u4"), n) for d, s, raw, n in zip(
            ids_of(pdf["doc_id"]), pdf["start"].tolist(), pdf["ids"], pdf["doc_tokens"].tolist())]
        edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(runs)]
        for a, b in zip(edges, edges[1:]):
            for full in windows.put(runs[a:b]):
                rows.add(full)
        if last:
            for full in windows.rest():
                rows.add(full)
        else:
            for _, window in windows.by_room:
                rows.add(windows.runs[window], still_open=True)
        return rows.frame()

    return left.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(run, _PLACED)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = LENGTH, vocabulary: str = VOCABULARY,
         most: int = OPEN, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece of every document."""
    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    placed = materialise(_online(rows, capacity, vocabulary, most, with_ids), "windows-online")
    done, merge = placed.where(~F.col("open")), 0
    parts = placed.agg(F.max("part")).first()[0]
    parts = 0 if parts is None else parts + 1
    while parts:
        last = parts <= FAN_IN
        placed = materialise(_merged(placed.where("open"), merge := merge + 1, capacity, most, with_ids, last), "windows-merged")
        done = done.unionByName(placed.where(~F.col("open")))
        parts = 0 if last else -(-parts // FAN_IN)
    return done.select(*names)
