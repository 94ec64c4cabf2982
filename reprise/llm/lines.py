"""Line de-duplication by an exact set-similarity join.

A line is the set of its five-word shingles (a shorter line: its whole word sequence). A line is removed if any earlier
line, in order of document id and line number, has a Jaccard similarity of at least 0.8 with it, whether or not that one is
removed itself. Lines without words are kept. Rows that repeat an id are told apart by a hash of their text, ``sub``, which
orders their lines of one number; it is 0 for all other rows.

1. The tokens of a set are ordered by rarity, estimated from the counts of their words over all documents in a table of
   2^18 counters, ties by hash. Any fixed order is right; rare tokens first make the lists below short.
2. Equal sets are one set, represented by its first line; later lines with it are removed. Only sets of several lines are joined
   with their earliest line.
3. Two sets of similarity s share a token among the first n - ceil(s n) + 1 of each (prefix filter). Prefix tokens found
   in one set only are dropped, so most lines end here: a Bloom filter of the tokens seen twice, by 41 of their bits, drops
   nearly all of them before the tokens are shuffled with their lines, an exact count the rest.
4. The lines of a token meet in cells of bounded size, first without their words: pairs are filtered by size, by what can follow
   the token in both, as a similar pair also meets at the first token that both have, and by sketches of 128 bits: a token
   flips one bit, so two sets differ in at least as many tokens as their sketches in bits. No similar pair is lost.
5. What is left is read again: its lines are picked by a bitmap of fixed size, and each is cut into tokens once. In the cells the
   rest is verified exactly, earliest line first. A cell returns the lines that have an earlier match, not pairs.

Defined cases: a null text has no lines and stays null; empty texts stay empty; a document that loses all lines has the text
""; rows that repeat an id with another text are documents of their own, rows that repeat id and text share their fate; rows
without an id keep their lines and remove none; an empty table gives no rows; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reprise.llm.common import (
    Runs, bit_of, bitmap, cells, hash_ranges, in_small_batches, is_set, may_be_in, mix64, released, signed, streamed_groups, text_chunks, unused, word_bounds,
)
from reprise.session import discard, materialise

SHINGLE = 5
SIMILARITY = 0.8
COUNTERS = 18
SLICE = 128
#: The bitmap of lines that are read again has 2^27 bits, 16 MB.
LINE_BITS = 27
#: Tokens are dealt to 2^9 parts to find those met twice, and are told apart by 32 bits there.
TOKEN_PARTS, TOKEN_PLACE = 9, 32


def prefix_length(n: np.ndarray, similarity: float) -> np.ndarray:
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def word_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Log-counts of all words of all documents by hash, 2^18 bytes whatever the input."""
    size, part = 1 << COUNTERS, 12

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, data, begins in text_chunks(batch.column("text")):
                h = hash_ranges(data, *word_bounds(data, begins))
                total += np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size)
        some = [c for c in range(size >> part) if total[c << part:(c + 1) << part].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([total[c << part:(c + 1) << part].tobytes() for c in some], pa.binary())],
            names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the chunks, one table of counters held at most, however many tasks counted."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                sums[c] = sums.get(c, 0) + np.frombuffer(counts, np.int64)
        logs = [np.minimum(255, np.rint(4 * np.log2(1 + n))).astype(np.uint8).tobytes() for n in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(logs, pa.binary())], names=["chunk", "counts"])

    rows = (
        docs.select(F.col(text_col).alias("text")).mapInArrow(released(count), "chunk int, counts binary")
        .repartition("chunk").mapInArrow(released(add), "chunk int, counts binary").collect()
    )
    logs = np.zeros(size, np.uint8)
    for r in rows:
        logs[r["chunk"] << part:(r["chunk"] + 1) << part] = np.frombuffer(r["counts"], np.uint8)
    return logs


def _tokens(h: np.ndarray, sizes: np.ndarray, logs: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """From the word hashes of consecutive lines of ``sizes`` words (none is empty): the tokens of all lines, rarest first
    within a line, and their number for each line."""
    stops = np.cumsum(sizes)
    starts = stops - sizes
    runs = Runs(h)
    weight = np.concatenate([[0], np.cumsum(logs[(h & np.uint64(len(logs) - 1)).astype(np.int64)].astype(np.int64))])
    line_of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(line_of[:-(shingle - 1)] == line_of[shingle - 1:]) if len(h) >= shingle else np.empty(0, np.int64)
    short = np.flatnonzero(sizes < shingle)
    a = np.concatenate([at, starts[short]])
    b = np.concatenate([at + shingle, stops[short]])
    token = mix64(runs.between(a, b) + (b - a).astype(np.uint64))
    # Mean log-count of the words, so that short lines compare with shingles; it has less than 12 bits.
    rare = ((weight[b] - weight[a]) * 12 // np.maximum(b - a, 1)).astype(np.uint64)
    line = line_of[a]
    key = (line.astype(np.uint64) << np.uint64(44)) | (rare << np.uint64(32)) | (token >> np.uint64(32))
    order = np.argsort(key)
    key, sorted_token = key[order], token[order]
    if len(sizes) >= 1 << 20 or ((key[1:] == key[:-1]) & (sorted_token[1:] != sorted_token[:-1])).any():
        order = np.lexsort((token, rare, line))  # the packed key does not tell some tokens apart
        sorted_token = token[order]
    line = line[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_token[1:] != sorted_token[:-1]) | (line[1:] != line[:-1])
    return sorted_token[new], np.bincount(line[new], minlength=len(sizes))


def _sketches(token: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For sets of different tokens that begin at ``first``: the two halves of 128 bits, of which each token flips one."""
    bit = (token >> np.uint64(40)) & np.uint64(127)
    flip = np.uint64(1) << (bit & np.uint64(63))
    return [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == half, flip, np.uint64(0)), first) for half in (0, 1)]


def _lines_of(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in one buffer: word hashes, and for each line with words its text, its number there and its words."""
    starts, ends = word_bounds(data, begins)
    row = np.searchsorted(begins, starts, side="right") - 1
    ends_of_line = np.flatnonzero(data == 10)
    number = np.searchsorted(ends_of_line, starts) - np.searchsorted(ends_of_line, begins[row])
    new = np.ones(len(starts), bool)
    new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(new)
    return hash_ranges(data, starts, ends), row[first], number[first], np.diff(np.append(first, len(starts)))


def _repeated(docs: DataFrame) -> np.ndarray:
    """A bitmap of the ids that several rows have, and few others."""
    often = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return bitmap(often, bit_of("doc_id"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select("doc_id", bit_of("doc_id").alias("bit"), F.xxhash64("text").alias("hash"), "text")


def _subs(batch: pa.RecordBatch, repeated: np.ndarray) -> np.ndarray:
    return np.where(is_set(repeated, batch.column("bit").to_numpy()), batch.column("hash").to_numpy(), 0)


def _places(ids: np.ndarray, lines: np.ndarray, subs: np.ndarray) -> pa.Array:
    """Order of lines as one number, which Spark can aggregate by hash: document id, line, and what tells rows of one id apart, the
    latter two by 31 bits."""
    both = np.empty((len(ids), 2), np.int64)
    both[:, 0] = (ids << 62) | (lines.astype(np.int64) << 31) | (subs % (1 << 31))
    both[:, 1] = ids >> 2
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(ids), [None, pa.py_buffer(both)])


def _scan(docs: DataFrame, shared, repeated, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, line, sub, s1, s2, n, k1, k2, prefix, place) for each line with words; s1 and s2 name the set, k1 and k2 are its sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, subs = batch.column("doc_id").to_numpy(), _subs(batch, repeated.value)
            for base, data, begins in text_chunks(batch.column("text")):
                h, row, number, sizes = _lines_of(data, begins)
                if not len(sizes):
                    continue
                token, n = _tokens(h, sizes, shared.value, shingle)
                first = np.cumsum(n) - n
                s1 = np.add.reduceat(mix64(token), first)
                s2 = np.add.reduceat(mix64(token ^ np.uint64(0xD6E8FEB86659FD93)), first)
                take = prefix_length(n, similarity)
                offsets = np.concatenate([[0], np.cumsum(take)])
                at = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], take)
                prefix = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(signed(token[at])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[base + row]), pa.array(number.astype(np.int32)), pa.array(subs[base + row]), pa.array(signed(s1)),
                     pa.array(signed(s2)), pa.array(n.astype(np.int32)), *(pa.array(signed(k)) for k in _sketches(token, first)), prefix,
                     _places(ids[base + row], number, subs[base + row])],
                    names=["doc_id", "line", "sub", "s1", "s2", "n", "k1", "k2", "prefix", "place"])

    return _keyed(docs).mapInArrow(
        released(run), "doc_id long, line int, sub long, s1 long, s2 long, n int, k1 long, k2 long, prefix array<long>, place decimal(38,0)")


def _filter_bits(sets: int) -> int:
    """Log of the bits of the filter of :func:`_met_twice`: eight for each set and more, 2 to 64 MB in all."""
    return min(29, max(24, (8 * sets - 1).bit_length()))


def _bits_of(token: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a token in a filter of 2^``bits`` of them, which lie in the segment of its part."""
    width = bits - TOKEN_PARTS
    low, segment = token & np.uint64((1 << TOKEN_PLACE) - 1), (token >> np.uint64(TOKEN_PLACE) & np.uint64((1 << TOKEN_PARTS) - 1)) << np.uint64(width)
    return tuple((segment | (h & np.uint64((1 << width) - 1))).astype(np.int64) for h in (low, low >> np.uint64(TOKEN_PLACE - width)))


def _met_twice(marked: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of 2^``bits`` bits of the prefix tokens that two sets or more have.

    Tokens are told apart by 41 bits, so its size bounds the tokens that are met, not all tokens. Tasks send what they saw, at
    most two of each, by part; a part is sorted on its own and gives its segment of the filter.
    """
    parts, width = 1 << TOKEN_PARTS, bits - TOKEN_PARTS

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.sort(batch.column("prefix").flatten().to_numpy().view(np.uint64) & np.uint64((1 << TOKEN_PARTS + TOKEN_PLACE) - 1))
            third = np.zeros(len(place), bool)
            third[2:] = place[2:] == place[:-2]
            place = place[~third]
            edges = np.searchsorted(place, np.arange(parts + 1, dtype=np.uint64) << np.uint64(TOKEN_PLACE)).tolist()
            place = place.astype(np.uint32)
            some = [c for c in range(parts) if edges[c] < edges[c + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([place[edges[c]:edges[c + 1]].tobytes() for c in some], pa.binary())],
                names=["part", "places"])

    def segment(part: int, places: list[bytes]) -> pa.RecordBatch:
        place = np.sort(np.frombuffer(b"".join(places), np.uint32))
        flags = np.zeros(1 << width, bool)
        for bit in _bits_of(place[1:][place[1:] == place[:-1]].astype(np.uint64), bits):
            flags[bit] = True
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["part", "places"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for c, raw in zip(batch.column("part").to_pylist(), batch.column("places").to_pylist()):
                if c != part and held:
                    yield segment(part, held)
                    held = []
                part = c
                held.append(raw)
        if held:
            yield segment(part, held)

    rows = (
        marked.select("prefix").mapInArrow(released(seen), "part int, places binary")
        .repartition("part").sortWithinPartitions("part").mapInArrow(released(add), "part int, places binary").collect()
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        out[r["part"] << (width - 3):(r["part"] + 1) << (width - 3)] = np.frombuffer(r["places"], np.uint8)
    return out


def _postings(marked: DataFrame, sets: int) -> DataFrame:
    """(token, doc_id, line, sub, n, k1, k2, pos, prev) of the prefix tokens that several sets may have."""
    bits = _filter_bits(sets)
    twice = marked.sparkSession.sparkContext.broadcast(_met_twice(marked, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, edges = batch.column("prefix").flatten().to_numpy(), batch.column("prefix").offsets.to_numpy().astype(np.int64)
            edges = edges - edges[0]
            one, other = _bits_of(token.view(np.uint64), bits)
            met = np.flatnonzero(is_set(twice.value, one) & is_set(twice.value, other))
            row = np.searchsorted(edges, met, side="right") - 1
            pos = met - edges[row]
            prev = np.where(pos > 0, token[np.maximum(met - 1, 0)], 0)
            own = [pa.array(batch.column(c).to_numpy()[row]) for c in ("doc_id", "line", "sub", "n", "k1", "k2")]
            yield pa.RecordBatch.from_arrays([pa.array(token[met]), *own, pa.array(pos.astype(np.int32)), pa.array(prev)],
                                             names=["token", "doc_id", "line", "sub", "n", "k1", "k2", "pos", "prev"])

    return marked.select("doc_id", "line", "sub", "n", "k1", "k2", "prefix").mapInArrow(
        released(run), "token long, doc_id long, line int, sub long, n int, k1 long, k2 long, pos int, prev long")


def _place(doc_id, line, sub):
    """Place of a line in the bitmap, for columns and arrays alike, from numbers below 2^31."""
    return (doc_id * 1000003 + line * 7919 + sub) % (1 << LINE_BITS)


def _line_places(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in one buffer, for each line: its text, its number there, where it begins and where it ends."""
    ends = np.flatnonzero(data == 10)
    before = np.searchsorted(ends, begins)
    count = np.diff(before) + 1
    row = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = before[row] + number
    padded = np.append(ends, 0)  # looked at for the first and the last line of a text, and not used there
    start = np.where(number > 0, padded[np.maximum(at - 1, 0)] + 1, begins[row])
    stop = np.where(number + 1 < count[row], padded[np.minimum(at, len(ends))], begins[row + 1])
    return row, number, start, stop


def _token_sets(docs: DataFrame, wanted: DataFrame, shared, repeated, shingle: int) -> DataFrame:
    """(doc_id, line, sub, tokens): the wanted lines and few others."""
    place = _place(F.pmod(F.col("doc_id"), F.lit(1 << 31)), F.col("line").cast("long"), F.pmod(F.col("sub"), F.lit(1 << 31)))
    picked = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, place, LINE_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, subs = batch.column("doc_id").to_numpy(), _subs(batch, repeated.value)
            for base, data, begins in text_chunks(batch.column("text")):
                row, number, start, stop = _line_places(data, begins)
                own = ids[base + row]
                sub = subs[base + row]
                hit = np.flatnonzero(is_set(picked.value, _place(own % (1 << 31), number, sub % (1 << 31))))
                if not len(hit):
                    continue
                some = np.concatenate([data[a:b] for a, b in zip(start[hit].tolist(), stop[hit].tolist())])
                edges = np.concatenate([[0], np.cumsum(stop[hit] - start[hit])])
                h, line, _, sizes = _lines_of(some, edges)  # lines without words are not among them
                if not len(sizes):
                    continue
                hit = hit[line]
                token, n = _tokens(h, sizes, shared.value, shingle)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(signed(token)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[hit]), pa.array(number[hit].astype(np.int32)), pa.array(sub[hit]), tokens], names=["doc_id", "line", "sub", "tokens"])

    return _keyed(docs).mapInArrow(released(run), "doc_id long, line int, sub long, tokens array<long>")


def _may_match(a, b, i, j, apart, similarity: float):
    """Whether sets of ``a`` and ``b`` tokens may be similar if ``i`` and ``j`` of them come before a common one and their sketches
    differ in ``apart`` bits."""
    need = np.ceil(similarity * (a + b) / (1.0 + similarity) - 1e-9)
    return (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9) & (np.minimum(a - i, b - j) >= need) & (a + b - apart >= 2 * need)


def _apart(k1, k2, other1, other2):
    return np.bitwise_count((k1 ^ other1).view(np.uint64)).astype(np.int64) + np.bitwise_count((k2 ^ other2).view(np.uint64))


def _filtered(cols: dict[str, np.ndarray], similarity: float) -> dict | None:
    """Rows of a cell that may match another one; ``later`` marks those that follow such a one."""
    if len(cols["line"]) < 2:
        return None
    order = np.lexsort((cols["sub"], cols["line"], cols["doc_id"]))
    cols = {k: v[order] for k, v in cols.items()}
    n, pos, prev, k1, k2 = cols["n"].astype(np.int64), cols["pos"].astype(np.int64), cols["prev"], cols["k1"], cols["k2"]
    apart = _apart(k1[:, None], k2[:, None], k1[None, :], k2[None, :])
    pair = _may_match(n[:, None], n[None, :], pos[:, None], pos[None, :], apart, similarity)
    # Two sets that also share the token before meet there.
    pair &= (pos[:, None] == 0) | (pos[None, :] == 0) | (prev[:, None] != prev[None, :])
    pair = np.triu(pair, 1)
    if cols["cell_p"][0] != cols["cell_q"][0]:
        pair &= cols["slice"][:, None] != cols["slice"][None, :]
    later = pair.any(axis=0)
    some = later | pair.any(axis=1)
    if not later.any():
        return None
    return {k: v[some] for k, v in (cols | {"later": later}).items() if k in _FILTERED}


_FILTERED = ("token", "cell_p", "cell_q", "slice", "doc_id", "line", "sub", "later")
_POSTING = ("token", "doc_id", "line", "sub", "n", "k1", "k2", "pos", "prev", "sets")


def _met(postings: DataFrame, similarity: float) -> DataFrame:
    """Rows of each token that may match another one, as :func:`_filtered` leaves them. Rows of a token with more than two
    slices (``sets``) are passed on unread, with ``later`` null; none but the rows of one token up to that size are held.
    The tokens are compared where Spark has sorted them to count their rows, without another shuffle."""
    most = 2 * SLICE

    def compared(cols: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        edges = np.flatnonzero(np.concatenate([[True], cols["token"][1:] != cols["token"][:-1], [True]]))
        sizes = np.diff(edges)
        # Two rows, by far the most frequent case: all such tokens at once.
        i = edges[:-1][sizes == 2]
        j = i + 1
        n, pos, prev, k1, k2 = cols["n"].astype(np.int64), cols["pos"].astype(np.int64), cols["prev"], cols["k1"], cols["k2"]
        hit = _may_match(n[i], n[j], pos[i], pos[j], _apart(k1[i], k2[i], k1[j], k2[j]), similarity) & ((pos[i] == 0) | (pos[j] == 0) | (prev[i] != prev[j]))
        i, j = i[hit], j[hit]
        after = np.zeros(len(i), bool)
        for k in ("sub", "line", "doc_id"):
            a, b = cols[k][i], cols[k][j]
            after = (a > b) | (a == b) & after
        both = np.concatenate([i, j])
        yield {k: cols[k][both] for k in ("token", "doc_id", "line", "sub")} | {"later": np.concatenate([after, ~after])}
        for k in np.flatnonzero(sizes > 2).tolist():
            group = {c: v[edges[k]:edges[k + 1]] for c, v in cols.items()}
            zero = np.zeros(sizes[k], np.int32)
            got = _filtered(group | {"cell_p": zero, "cell_q": zero, "slice": zero}, similarity)
            if got is not None:
                yield {c: got[c] for c in ("token", "doc_id", "line", "sub", "later")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None  # the last rows, of one token
        for batch in batches:
            crowded = batch.filter(pc.greater(batch.column("sets"), most))
            if crowded.num_rows:
                yield pa.RecordBatch.from_arrays([*crowded.columns, pa.nulls(crowded.num_rows, pa.bool_())], names=[*_POSTING, "later"])
            if crowded.num_rows == batch.num_rows:
                continue
            rest = batch.filter(pc.less_equal(batch.column("sets"), most))
            cols = {k: rest.column(k).to_numpy() for k in _POSTING}
            if held is not None:
                cols = {k: np.concatenate([held[k], v]) for k, v in cols.items()}
            last = int(np.argmax(cols["token"] == cols["token"][-1]))  # rows of a token lie together
            held = {k: v[last:] for k, v in cols.items()}
            if last:
                yield found({k: v[:last] for k, v in cols.items()})
        if held is not None:
            yield found(held)

    def found(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
        parts = list(compared(cols))
        out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        n = len(out["later"])
        return pa.RecordBatch.from_arrays(
            [pa.array(out[k]) if k in out else pa.nulls(n, batch_types[k]) for k in _POSTING] + [pa.array(out["later"])],
            names=[*_POSTING, "later"])

    batch_types = {"n": pa.int32(), "k1": pa.int64(), "k2": pa.int64(), "pos": pa.int32(), "prev": pa.int64(), "sets": pa.int64()}
    counted = postings.repartition("token").sortWithinPartitions("token").withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("token")))
    return counted.where("sets > 1").select(*_POSTING).mapInArrow(
        released(run), "token long, doc_id long, line int, sub long, n int, k1 long, k2 long, pos int, prev long, sets long, later boolean")


def _placed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows with the place of their own token among those of their line."""
    sets = pdf["tokens"].tolist()
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    first = np.cumsum(n) - n
    hit = np.flatnonzero(np.concatenate(sets) == np.repeat(pdf["token"].to_numpy(), n))
    owner = np.searchsorted(first, hit, side="right") - 1
    place = np.full(len(pdf), -1)
    place[owner] = hit - first[owner]
    return pdf.assign(at=place)


def _matched(cols: dict[str, np.ndarray], similarity: float) -> dict | None:
    """Lines of a cell that have an earlier line of that similarity in it."""
    order = np.lexsort((cols["sub"], cols["line"], cols["doc_id"]))
    doc, line, sub, later, at, side = (cols[c][order].tolist() for c in ("doc_id", "line", "sub", "later", "at", "slice"))
    across = cols["cell_p"][0] != cols["cell_q"][0]
    tokens = cols["tokens"][order]
    size = [len(t) for t in tokens]
    sets: list[frozenset | None] = [None] * len(doc)
    before: list[frozenset | None] = [None] * len(doc)  # tokens in front of the cell's one
    found = []
    for j in range(1, len(doc)):
        if not later[j] or at[j] < 0:
            continue
        b, q = size[j], at[j]
        for i in range(j):
            a, p = size[i], at[i]
            if p < 0 or across and side[i] == side[j] or min(a, b) < similarity * max(a, b) - 1e-9 or (doc[i], line[i], sub[i]) == (doc[j], line[j], sub[j]):
                continue
            need = ceil(similarity * (a + b) / (1.0 + similarity) - 1e-9)
            if min(a - p, b - q) < need:
                continue
            for k in (i, j):
                if before[k] is None:
                    before[k] = frozenset(tokens[k][:at[k]].tolist())
            if not before[i].isdisjoint(before[j]):
                continue  # the two also meet at that token, and are verified there
            for k in (i, j):
                if sets[k] is None:
                    sets[k] = frozenset(tokens[k].tolist())
            if len(sets[i] & sets[j]) >= need:
                found.append(j)
                break
    if not found:
        return None
    return {c: cols[c][order][found] for c in ("doc_id", "line", "sub")}


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                  similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, line, sub) of the lines, counted from 0, that an earlier one resembles; ``sub`` is the hash of the text where
    several rows have the id, else 0."""
    docs = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _removed(docs, _repeated(docs), shingle, similarity)


def _removed(docs: DataFrame, repeated: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    # 2^18 bytes and 2 MB.
    context = docs.sparkSession.sparkContext
    shared, repeated = context.broadcast(word_counts(docs, "text")), context.broadcast(repeated)
    every = materialise(_scan(docs, shared, repeated, shingle, similarity), "lines-sets")
    # Only sets of several lines are joined with their earliest line; a bitmap tells nearly all others.
    several = materialise(every.groupBy("s1", "s2").agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("lines")).where(
        "lines > 1").select("s1", "s2", "earliest"), "lines-several")
    often = may_be_in(every, "s1", bitmap(several, bit_of("s1")))
    first = F.coalesce(F.col("place") == F.col("earliest"), F.lit(True))
    told = materialise(every.where(often).join(several, ["s1", "s2"], "left").select(
        "doc_id", "line", "sub", "n", "k1", "k2", F.when(first, F.col("prefix")).alias("prefix")), "lines-told")
    copies = told.where("prefix is null").select("doc_id", "line", "sub")
    marked = every.where(~often).select(*told.columns).unionByName(told.where("prefix is not null"))
    met = materialise(_met(_postings(marked, every.count()), similarity), "lines-met")
    discard(every)
    crowded = materialise(streamed_groups(
        cells(met.where("later is null").drop("later"), "token", F.xxhash64("doc_id", "line", "sub"), SLICE, "sets"), ["token", "cell_p", "cell_q"],
        lambda c: _filtered(c, similarity), "token long, cell_p int, cell_q int, slice int, doc_id long, line int, sub long, later boolean"), "lines-crowded")
    zero = F.lit(0)
    left = crowded.unionByName(met.where("later is not null").select(
        "token", zero.alias("cell_p"), zero.alias("cell_q"), zero.alias("slice"), "doc_id", "line", "sub", "later"))
    similar = streamed_groups(
        left.join(_token_sets(docs, left, shared, repeated, shingle), ["doc_id", "line", "sub"]), ["token", "cell_p", "cell_q"],
        lambda c: _matched(c, similarity), "doc_id long, line int, sub long", _placed)
    removed = materialise(similar.unionByName(copies).distinct(), "lines-removed")
    discard(told, several, met, crowded)
    return removed


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the columns they have, each text without the lines removed."""
    narrow = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    repeated = _repeated(narrow)
    key, own, of_id, of_sub, gone = unused(docs.columns, "id_or_zero", "own_sub", "of_id", "of_sub", "gone_lines")
    by_doc = _removed(narrow, repeated, shingle, similarity).groupBy(F.col("doc_id").alias(of_id), F.col("sub").alias(of_sub)).agg(
        F.collect_list("line").alias(gone))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for text, numbers in zip(texts, gone):
            if text is not None and numbers is not None:
                skip = set(numbers.tolist())
                text = "\n".join([line for i, line in enumerate(text.split("\n")) if i not in skip])
            out.append(text)
        return pd.Series(out, dtype=object)

    # Only the texts of documents that may lose lines are shuffled.
    marked = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    loses, repeats = may_be_in(marked, key, bitmap(by_doc, bit_of(of_id))), may_be_in(marked, key, repeated)
    names = docs.columns
    told = marked.where(loses).withColumn(own, F.when(repeats, F.xxhash64(text_col)).otherwise(F.lit(0).cast("long")))
    changed = (
        told.join(by_doc, (F.col(id_col).cast("long") == F.col(of_id)) & (F.col(own) == F.col(of_sub)), "left")
        .withColumn(text_col, cut(F.col(text_col), F.col(gone))).select(*names)
    )
    return marked.where(~loses).select(*names).unionByName(changed)
