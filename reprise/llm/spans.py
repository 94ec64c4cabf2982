"""Substring de-duplication: words covered by a long window that also starts in a document with a smaller id.

The windows of 50 words are the edges of a De Bruijn graph of the documents, whose nodes are the 49 words that two windows share.

1. Only regions that may repeat enter the graph. The 16-word k-mer with the smallest hash stands for a window, equal windows have
   equal ones, and windows whose k-mer occurs in one document only are left out. Documents with the same word sequence are one
   document, represented by the smallest id.
2. Every window of a region is an edge with the edge before it and the edge after it, or none at the border of its region. Grouped by
   edge they give its smallest and greatest document and whether it has several predecessors or several successors.
3. Edges that follow each other without a branch are one path: a path ends where an edge has several successors or the next
   one several predecessors. So all documents that hold an edge of a path hold all of it. The branching edges and those of two documents
   are told to every task by bitmaps of fixed size, by which each document contracts its own edges; an edge that is taken for
   a branching one by mistake is so in all documents, and only makes paths shorter.
4. Paths, now one row for many windows, are joined by their hashes over all documents. The one in the smallest document is the source.
5. The words at the source's coordinates are read again. A later occurrence is removed if the digest of its own words is the source's.

Nothing is listed pair-wise: a passage that many documents share is one path with one source.

Defined cases: a null text has no words; texts of fewer than 50 words lose nothing; rows that repeat an id are judged each
by its own words and do not precede each other; rows without an id lose nothing and are no source; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reprise.llm.common import Runs, bit_of, bitmap, in_small_batches, is_set, list_array, may_be_in, released, signed, sliding_min, words_of
from reprise.session import materialise

WINDOW = 50
KMER = 16
#: Windows of a run with one smallest k-mer at most; longer ones (one k-mer repeated on end) are several rows.
LONGEST_RUN = 64
#: The bitmaps of edges have 2^27 bits, 16 MB each.
EDGE_BITS = 27
_NOTHING = hashlib.sha256(b"").hexdigest()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _sequence(words: list[bytes]) -> tuple[bytes, int]:
    joined = b" ".join(words)
    digest = hashlib.sha256(joined)
    return digest.hexdigest(), int.from_bytes(digest.digest()[:8], "little", signed=True)


def minimizers(h: np.ndarray, window: int = WINDOW, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer hash, first window, number of windows) of each run of windows with one smallest k-mer."""
    if len(h) < window:
        none = np.empty(0, np.int64)
        return none, none, none
    runs = Runs(h)
    least = sliding_min(runs.every(kmer), window - kmer + 1)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    sizes = np.diff(np.concatenate([starts, [len(least)]]))
    if sizes.max() > LONGEST_RUN:
        starts = np.concatenate([np.arange(a, a + n, LONGEST_RUN) for a, n in zip(starts.tolist(), sizes.tolist())])
        sizes = np.diff(np.concatenate([starts, [len(least)]]))
    return signed(least[starts]), starts, sizes


def scan(docs: DataFrame, id_col: str, text_col: str, window: int, kmer: int) -> DataFrame:
    """One row per document: its size, the digest of its words, and the runs of windows with one smallest k-mer as arrays."""
    schema = "doc_id long, n_words long, digest string, seq long, kmers array<long>, starts array<int>, sizes array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, seqs, found = [], [], [], ([], [], [])
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                digest, seq = _sequence(words)
                sizes.append(len(words))
                digests.append(digest)
                seqs.append(seq)
                for column, part in zip(found, minimizers(word_hashes(words) if len(words) >= window else np.empty(0, np.uint64), window, kmer)):
                    column.append(part)
            kinds = (pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(seqs, pa.int64()),
                 *(list_array(c, k) for c, k in zip(found, kinds))],
                names=["doc_id", "n_words", "digest", "seq", "kmers", "starts", "sizes"])

    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), schema)


def _with_text(docs: DataFrame, by_doc: DataFrame) -> DataFrame:
    """``by_doc`` (doc_id, seq, ...) with the texts; other rows of an id are told apart by their ``seq`` where the words are read."""
    some = docs.where(may_be_in(docs, "doc_id", bitmap(by_doc, bit_of("doc_id"))))
    return some.join(by_doc, "doc_id").select("text", *by_doc.columns)


def _regions(docs: DataFrame, repeated: DataFrame, window: int) -> DataFrame:
    """(doc_id, seq, starts, sizes, words): per document the runs of windows that may repeat, by their first windows and lengths, and
    the hashes of their words one after the other."""
    by_doc = materialise(repeated.groupBy("doc_id", "seq").agg(F.collect_list(F.struct("start", "size")).alias("places")), "spans-places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            ends = places.offsets.to_numpy().tolist()
            start, size = (places.values.field(k).to_numpy().astype(np.int64) for k in range(2))
            taken, starts, sizes, found = [], [], [], []
            for i, (text, seq) in enumerate(zip(batch.column("text"), batch.column("seq").to_pylist())):
                words = words_of(text.as_py())
                if _sequence(words)[1] != seq:
                    continue  # another row with the same id
                own = np.arange(ends[i], ends[i + 1])
                own = own[np.argsort(start[own], kind="stable")]
                a, b = start[own], start[own] + size[own]
                new = np.concatenate([[True], a[1:] > b[:-1]])
                first, last = a[new], b[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])]
                h = word_hashes(words)
                taken.append(i)
                starts.append(first)
                sizes.append(last - first)
                found.append(np.concatenate([h[x:y + window - 1] for x, y in zip(first.tolist(), last.tolist())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(taken, pa.int32())), batch.column("seq").take(pa.array(taken, pa.int32())),
                 list_array(starts, pa.int32()), list_array(sizes, pa.int32()), list_array([signed(f) for f in found], pa.int64())],
                names=["doc_id", "seq", "starts", "sizes", "words"])

    return _with_text(docs, by_doc).mapInArrow(
        released(run), "doc_id long, seq long, starts array<int>, sizes array<int>, words array<long>")


def _runs(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, int, Runs, np.ndarray]]:
    """(row, first window, runs of its words, hashes of its windows) of every run of windows of a batch."""
    starts, sizes, words = (batch.column(c) for c in ("starts", "sizes", "words"))
    at, edges = words.offsets.to_numpy().tolist(), starts.offsets.to_numpy().tolist()
    start, size, word = (c.values.to_numpy() for c in (starts, sizes, words))
    for i in range(batch.num_rows):
        place = at[i]
        for k in range(edges[i], edges[i + 1]):
            n = int(size[k])
            runs = Runs(word[place:place + n + window - 1].view(np.uint64))
            yield i, int(start[k]), runs, signed(runs.every(window))
            place += n + window - 1


def _edges(regions: DataFrame, window: int) -> DataFrame:
    """(edge, a, b, splits, joins): edges of two documents or more, smallest and greatest one, whether several edges follow or precede."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column("doc_id").to_numpy(), []
            for i, _, _, e in _runs(batch, window):
                parts.append((e, np.concatenate([[0], e[:-1]]), np.concatenate([e[1:], [0]]), np.full(len(e), ids[i])))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["edge", "before", "after", "doc_id"])

    found = regions.mapInArrow(released(run), "edge long, before long, after long, doc_id long").groupBy("edge").agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("before").alias("before_lo"), F.max("before").alias("before_hi"),
        F.min("after").alias("after_lo"), F.max("after").alias("after_hi"))
    return found.where("a < b").select("edge", (F.col("after_lo") != F.col("after_hi")).alias("splits"), (F.col("before_lo") != F.col("before_hi")).alias("joins"))


def _paths(regions: DataFrame, edges: DataFrame, window: int) -> DataFrame:
    """(doc_id, seq, edge, path, start, size): the documents' contracted paths, named by their first edge and by all their words."""
    size = 1 << EDGE_BITS
    place = F.pmod(F.col("edge"), F.lit(size))
    shared = regions.sparkSession.sparkContext.broadcast(tuple(
        bitmap(rows, place, EDGE_BITS) for rows in (edges, edges.where("splits"), edges.where("joins"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, firsts, names, starts, sizes = [], [], [], [], []
            for i, start, runs, e in _runs(batch, window):
                inside, splits, joins = (is_set(bits, e & (size - 1)) for bits in shared.value)
                begins = inside.copy()
                begins[1:] &= ~inside[:-1] | joins[1:] | splits[:-1]
                ends = inside.copy()
                ends[:-1] &= ~inside[1:] | begins[1:]
                first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
                rows.append(np.full(len(first), i))
                firsts.append(e[first])
                names.append(signed(runs.between(first, last + window - 1) ^ ((last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
                starts.append(start + first)
                sizes.append(last - first)
            row, *columns = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (rows, firsts, names, starts, sizes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(row.astype(np.int32))) for c in ("doc_id", "seq")]
                + [pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.int32, np.int32))],
                names=["doc_id", "seq", "edge", "path", "start", "size"])

    return regions.mapInArrow(released(run), "doc_id long, seq long, edge long, path long, start int, size int")


def _span_digest(words: list[bytes], start: int, size: int, window: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words[start:start + size + window - 1]))


def _source_digests(docs: DataFrame, sources: DataFrame, window: int) -> DataFrame:
    """(edge, path, digest) of the words at the sources' coordinates (doc_id, seq, start, size)."""
    by_doc = materialise(sources.groupBy("doc_id", "seq").agg(F.collect_list(F.struct("edge", "path", "start", "size")).alias("places")), "spans-sources")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [])
            for text, seq, places in zip(batch.column("text"), batch.column("seq").to_pylist(), batch.column("places").to_pylist()):
                words = words_of(text.as_py())
                if _sequence(words)[1] != seq:
                    continue
                for p in places:
                    for column, value in zip(out, (p["edge"], p["path"], _span_digest(words, p["start"], p["size"], window))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary()))], names=["edge", "path", "digest"])

    return _with_text(docs, by_doc).mapInArrow(released(run), "edge long, path long, digest binary")


def covered(docs: DataFrame, scanned: DataFrame, window: int) -> DataFrame:
    """(doc_id, seq, spans): per document the runs of windows (start, size) that also start in a document with a smaller id, with the
    digest that their words must have."""
    single = scanned.where("size(kmers) > 0 and doc_id is not null")
    first = single.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    single = materialise(
        single.join(first, "digest").where("doc_id = first_id")
        .select("doc_id", "seq", F.explode(F.arrays_zip("kmers", "starts", "sizes")).alias("x"))
        .select("doc_id", "seq", F.col("x.kmers").alias("kmer"), F.col("x.starts").alias("start"), F.col("x.sizes").alias("size")), "spans-minimizers")
    shared = single.groupBy("kmer").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("kmer")
    regions = materialise(_regions(docs, single.join(shared, "kmer"), window), "spans-regions")
    edges = materialise(_edges(regions, window), "spans-edges")
    paths = materialise(_paths(regions, edges, window), "spans-paths")
    names = ["edge", "path"]
    lowest = materialise(paths.groupBy(*names).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select(*names, "a"), "spans-lowest")
    met = materialise(paths.join(lowest, names), "spans-met")
    # The smallest document may hold a path twice, or two rows may have its id; any of them is a source.
    sources = met.where("doc_id = a").groupBy(*names).agg(F.min(F.struct("doc_id", "seq", "start", "size")).alias("x")).select(*names, "x.*")
    checked = met.where("doc_id > a").join(_source_digests(docs, sources, window), names)
    return materialise(checked.groupBy("doc_id", "seq").agg(F.collect_list(F.struct("start", "size", "digest")).alias("spans")), "spans-hits")


def _cut(docs: DataFrame, hits: DataFrame, window: int) -> DataFrame:
    """(doc_id, seq, n_removed, kept) for documents that keep a part of their words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, seq, text, spans in zip(pdf["doc_id"], pdf["seq"], pdf["text"], pdf["spans"]):
                words = words_of(text)
                if _sequence(words)[1] != seq:
                    continue
                gone = np.zeros(len(words), bool)
                for span in spans:
                    if _span_digest(words, span["start"], span["size"], window) == bytes(span["digest"]):
                        gone[span["start"]:span["start"] + span["size"] + window - 1] = True
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                out.append((doc, seq, int(gone.sum()), kept.decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["doc_id", "seq", "n_removed", "kept"])

    return _with_text(docs, hits).mapInPandas(
        released(run), "doc_id long, seq long, n_removed long, kept string")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, kmer: int = KMER,
                   texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of ``docs``; with ``texts`` also the kept words as ``kept``
    (null where nothing is removed, and the source text holds)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = materialise(scan(docs, "doc_id", "text", window, kmer), "spans-scan")
    cut = _cut(docs, covered(docs, scanned, window), window).select(
        "doc_id", "seq", F.col("n_removed").alias("cut"), F.sha2("kept", 256).alias("cut_sha256"), *(["kept"] if texts else []))
    first = scanned.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window)).groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    copy = F.col("doc_id") > F.col("first_id")
    base = scanned.select("doc_id", "n_words", "digest", "seq").join(first, "digest", "left")
    return base.join(cut.dropDuplicates(["doc_id", "seq"]), ["doc_id", "seq"], "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_NOTHING)).otherwise(F.coalesce("cut_sha256", "digest")).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if texts else []))


#: Every window as one text, for tables of some thousand documents.
SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d WHERE len(w) >= {WINDOW}),
k AS (SELECT doc_id, p, md5(array_to_string(w[p:p + {WINDOW - 1}], ' ')) AS h FROM x),
m AS (SELECT h, min(doc_id) AS a FROM k GROUP BY h),
r AS (SELECT DISTINCT k.doc_id, unnest(range(k.p, k.p + {WINDOW})) AS i FROM k JOIN m USING (h) WHERE m.a < k.doc_id),
g AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string([w[i] for i in range(1, len(w) + 1) if gone IS NULL OR NOT list_contains(gone, i)], ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
