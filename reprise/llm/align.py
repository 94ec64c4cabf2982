"""Alignment of the tokens of two tokenizers by their byte offsets.

Tokenizer A (byte-level pairs) reads a space and the text, tokenizer B (pieces with byte fallback) the text, to which it adds the
space itself, both without special tokens, whose strings are plain text. So both cut the same bytes.

1. The ends of A's and B's tokens are ascending lists of byte offsets. The shorter list of a document drives a galloping search in
   the longer one: from the place of the key before it, steps double until they pass the key, then halve. Keys are taken at
   strides of 4096, 256, 16 and 1, all of a stride at once, each from the key of the stride before.
2. Ends found in both lists cut the tokens into groups. The tokens of the longer list that overlap a token of the shorter one lie
   between the places of its own end and of the end before it: differences of ranks, without comparing tokens.
3. Links are counted by pair of ids over all documents. A block, the documents of one Arrow batch, names its pairs once in a
   dictionary and each document by places in it; so a pair is shuffled once a block. Totals go back to the blocks by a join on the
   pair, and the best total of each id of B is a table no longer than B's vocabulary, the only thing broadcast.

Defined cases: null and empty texts, and texts that B's bytes do not give back (as those that hold U+2581), have no tokens: all
numbers are 0 and ``groups_sha256`` is ''. Rows that repeat an id, or have none, are documents of their own and count in the
totals. An empty table gives no rows; other columns are ignored. A text is held whole by one task, with its tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.llm.common import in_small_batches, list_array
from reprise.llm.packing import VOCABULARY, Tokenizer
from reprise.session import materialise

MODEL = "piece_bpe_32k.model"
#: Code points of text that are encoded at once, or one longer text.
CHUNK = 1 << 18
STRIDES = (4096, 256, 16, 1)


def _from(keys: np.ndarray, padded: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Ranks of ``keys`` that are ``low`` at least, by doubling steps and then by halving. ``padded`` ends with a value above all."""
    n = len(padded) - 1
    low, high, step = low.copy(), low.copy(), 1
    active = np.arange(len(keys))
    while len(active):
        active = active[padded[high[active]] < keys[active]]
        low[active] = high[active] + 1
        high[active] = np.minimum(high[active] + step, n)
        step *= 2
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) >> 1
        below = padded[middle] < keys[active]
        low[active[below]] = middle[below] + 1
        high[active[~below]] = middle[~below]
        active = active[low[active] < high[active]]
    return low


def gallop(keys: np.ndarray, into: np.ndarray) -> np.ndarray:
    """How many values of ``into`` are below each key; both lists ascend."""
    padded = np.append(into, np.iinfo(np.int64).max)
    rank = np.zeros(len(keys), np.int64)
    before = None
    for stride in STRIDES:
        at = np.arange(0, len(keys), stride)
        rank[at] = _from(keys[at], padded, np.zeros(len(at), np.int64) if before is None else rank[at // before * before])
        before = stride
    return rank


def repeated(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] values), then those of the next."""
    total = np.cumsum(count)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(first - (total - count), count)


class Aligned(NamedTuple):
    """Documents in a row: ids, the first token of each document, the last tokens of the groups, and the linked tokens."""

    a: np.ndarray
    b: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def _driven(short_end: np.ndarray, long_end: np.ndarray, token: np.ndarray, opens: np.ndarray, long_first: np.ndarray):
    """For the tokens ``token`` of the shorter lists: their links (short, long) and the ends found in both (short, long).

    ``opens`` marks the first token of each document, ``long_first`` where its tokens begin in the longer list.
    """
    rank = gallop(short_end[token], long_end)
    both = long_end[rank] == short_end[token]
    first = np.empty(len(token), np.int64)
    first[1:] = rank[:-1] + both[:-1]
    first[opens] = long_first
    count = rank - first + 1
    return np.repeat(token, count), repeated(first, count), token[both], rank[both]


def align(a: list[np.ndarray], b: list[np.ndarray], a_bytes: np.ndarray, b_bytes: np.ndarray) -> Aligned:
    """Token ids of documents that have tokens; ``a_bytes`` and ``b_bytes`` hold the number of bytes of each id."""
    n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    flat_a, flat_b = (np.concatenate(side).astype(np.int64) if side else np.empty(0, np.int64) for side in (a, b))
    # The documents' bytes in a row: both sides give them the same bytes, so one list of offsets serves all.
    end_a, end_b = np.cumsum(a_bytes[flat_a]), np.cumsum(b_bytes[flat_b])
    a_first, b_first = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    by_a = n_a <= n_b
    found = []
    for chosen, n, first, other, ends, into in ((by_a, n_a, a_first, b_first, end_a, end_b), (~by_a, n_b, b_first, a_first, end_b, end_a)):
        size = n[chosen]
        found.append(_driven(ends, into, repeated(first[chosen], size), np.cumsum(size) - size, other[chosen]))
    (la, lb, ca, cb), (mb, ma, db, da) = found
    return Aligned(flat_a, flat_b, a_first, b_first, np.sort(np.concatenate([ca, da])), np.sort(np.concatenate([cb, db])),
                   np.concatenate([la, ma]), np.concatenate([lb, mb]))


class Tokenizers:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, vocabulary: str = VOCABULARY, model: str = MODEL):
        import public_tokenizers
        import sentencepiece

        self.a = Tokenizer(vocabulary, added=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        self.a_bytes = [self.a.fast.decode_single_token_bytes(i) for i in range(self.a.fast.n_vocab)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """Places of the texts that have tokens, and their ids by A and by B."""
        some = [i for i, t in enumerate(texts) if t]
        places, a, b = [], [], []
        for i, pieces in zip(some, self.b.encode([texts[i] for i in some], num_threads=1)):
            spaced = " " + texts[i]
            raw = spaced.encode()
            if b"".join(map(self.b_bytes.__getitem__, pieces)) != raw:
                continue
            ids = self.a.encode(spaced)
            if b"".join(map(self.a_bytes.__getitem__, ids.tolist())) == raw:
                places.append(i)
                a.append(ids)
                b.append(np.array(pieces, np.int64))
        return places, a, b


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK or i + 1 == len(texts):
            yield start, texts[start:i + 1]
            start, size = i + 1, 0


class _Writer:
    """Groups of a document as ``a1,a2|b1;a3|b2,b3``, put together from ready words."""

    def __init__(self, n_a: int, n_b: int):
        self.a, self.a_last, self.b, self.b_last = (
            np.array([b"%d%s" % (i, end) for i in range(n)], object) for n, end in ((n_a, b","), (n_a, b"|"), (n_b, b","), (n_b, b";")))

    def texts(self, x: Aligned) -> Iterator[bytes]:
        """Of each document; A's tokens of a group stand after B's of the groups before, B's after A's of the same group."""
        out = np.empty(len(x.a) + len(x.b), object)
        group_a = np.searchsorted(x.a_last, np.arange(len(x.a)))
        group_b = np.searchsorted(x.b_last, np.arange(len(x.b)))
        b_before = np.concatenate([[0], x.b_last + 1])
        out[np.arange(len(x.a)) + b_before[group_a]] = self.a[x.a]
        out[x.a_last + b_before[:-1]] = self.a_last[x.a[x.a_last]]
        out[np.arange(len(x.b)) + x.a_last[group_b] + 1] = self.b[x.b]
        out[x.b_last + x.a_last + 1] = self.b_last[x.b[x.b_last]]
        edges = np.append(x.a_first + x.b_first, len(out)).tolist()
        for lo, hi in zip(edges, edges[1:]):
            yield b"".join(out[lo:hi].tolist())[:-1]


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, model: str = MODEL) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_ends, b_ends): the tokens of both sides, and past-the-end places of the groups in each."""
    kind = pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(vocabulary, model)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for start, part in _chunks(texts):
                places, a, b = both.encode(part)
                x = align(a, b, both.a_size, both.b_size)
                cut = np.searchsorted(x.a_last, x.a_first)[1:]
                columns = [[np.empty(0, np.int64)] * len(part) for _ in range(4)]
                if places:
                    sides = (a, b, [e + 1 - f for e, f in zip(np.split(x.a_last, cut), x.a_first)], [e + 1 - f for e, f in zip(np.split(x.b_last, cut), x.b_first)])
                    for column, side in zip(columns, sides):
                        for i, values in zip(places, side):
                            column[i] = values
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(part)), *(list_array(c, kind) for c in columns)],
                                                 names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


def _narrow(values: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest one needs; the width follows from the length."""
    most = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // n]).astype(np.int64) if n else np.empty(0, np.int64)


_SCANNED = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int, at binary, "
            "times binary, pairs array<long>, links array<long>")


def _scan(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """A row per document. Its links are ``times`` of the places ``at`` (as differences) in the pairs of its block, which with
    their links in the block stand in the block's first row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(vocabulary, model)
        writer = _Writer(len(both.a_bytes), len(both.b_bytes))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            counts = np.zeros((4, n), np.int64)
            digests, codes, owners = [""] * n, [], []
            for start, part in _chunks(batch.column("text").to_pylist()):
                places, a, b = both.encode(part)
                if not places:
                    continue
                x = align(a, b, both.a_size, both.b_size)
                at = start + np.array(places)
                owner = at[np.searchsorted(x.a_first, x.link_a, side="right") - 1]
                counts[0, at], counts[1, at] = [len(v) for v in a], [len(v) for v in b]
                counts[2] += np.bincount(at[np.searchsorted(x.a_first, x.a_last, side="right") - 1], minlength=n)
                counts[3] += np.bincount(owner, minlength=n)
                codes.append(x.a[x.link_a] << 32 | x.b[x.link_b])
                owners.append(owner)
                for i, text in zip(at.tolist(), writer.texts(x)):
                    digests[i] = hashlib.sha256(text).hexdigest()
            code = np.concatenate(codes) if codes else np.empty(0, np.int64)
            pairs, place, links = np.unique(code, return_inverse=True, return_counts=True)
            key, times = np.unique((np.concatenate(owners) if owners else code) << 32 | place, return_counts=True)
            at, edges = key & 0xFFFFFFFF, np.searchsorted(key >> 32, np.arange(n + 1))
            held = [(_narrow(np.diff(at[i:j], prepend=0)), _narrow(times[i:j])) for i, j in zip(edges.tolist(), edges[1:].tolist())]
            own = lambda values: pa.array([values, *[None] * (n - 1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), batch.column("doc_id"), *(pa.array(c) for c in counts), pa.array(digests, pa.string()),
                 pa.array(np.diff(edges).astype(np.int32)), pa.array([h[0] for h in held], pa.binary()), pa.array([h[1] for h in held], pa.binary()),
                 own(pairs), own(links)], names=[c.split()[0] for c in _SCANNED.split(", ")])
            block += 1

    rows = in_small_batches(docs).select(F.col("doc_id"), F.col("text"))
    return rows.mapInArrow(run, _SCANNED)


def _totals(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(of_block, place, pair, links) of all blocks, and (pair, total, best) of all pairs."""
    by_block = scanned.where("pairs is not null").select(
        F.col("block").alias("of_block"), F.posexplode(F.arrays_zip("pairs", "links")).alias("place", "p")).select(
        "of_block", "place", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))
    totals = materialise(by_block.groupBy("pair").agg(F.sum("links").alias("total")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "align-totals")
    # A row for each id of B at most, 32,000 rows.
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    return by_block, totals.join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def pair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, model: str = MODEL) -> DataFrame:
    """(a, b, links, best): every pair of ids that is linked anywhere, how often, and whether none is linked to b more often."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pairs = _totals(materialise(_scan(rows, vocabulary, model), "align-scan"))[1]
    return pairs.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"),
                        F.col("total").alias("links"), "best")


def link_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, model: str = MODEL) -> DataFrame:
    """Per document: tokens of both sides, groups, links, links that are their B id's best, the sum of their pairs' counts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = materialise(_scan(rows, vocabulary, model), "align-scan")
    by_block, pairs = _totals(scanned)
    scored = by_block.select("of_block", "place", "pair").join(pairs, "pair").select("of_block", "place", "total", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    own = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "at", "times"]

    def run(held: pd.DataFrame, scores: pd.DataFrame) -> pd.DataFrame:
        place = scores["place"].to_numpy()
        total, best = np.zeros(len(scores), np.int64), np.zeros(len(scores), np.int64)
        total[place], best[place] = scores["total"].to_numpy(), scores["best"].to_numpy()
        sums = np.zeros((2, len(held)), np.int64)
        for k, (n, at, times) in enumerate(zip(held["n_pairs"].tolist(), held["at"], held["times"])):
            if n:
                at, times = np.cumsum(_wide(at, n)), _wide(times, n)
                sums[:, k] = (best[at] * times).sum(), (total[at] * times).sum()
        return held.assign(n_best=sums[0], count_sum=sums[1])[names]

    return scanned.select(*own).groupBy("block").cogroup(scored.groupBy("of_block")).applyInPandas(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
