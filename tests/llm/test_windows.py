"""Bounded-space packing: every id once, nothing padded, little cut."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reprise.llm import windows
from reprise.llm.windows import Run, Windows


def check(rows, docs, capacity):
    """``docs``: (doc_id, ids) of every document. Pieces of documents that share an id are told apart by their ids alone."""
    by_id, wanted = defaultdict(list), defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    for d, ids in docs:
        wanted[d].append(ids)
    assert set(by_id) == set(wanted)
    for d, pieces in by_id.items():
        assert sum(r.length for r in pieces) == sum(map(len, wanted[d]))
        if len(wanted[d]) == 1:
            at, ids = 0, wanted[d][0]
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
                at += r.length
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    fills = []
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        fills.append(at)
    return fills


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("fan_in", [16, 2])
def test_every_id_is_placed_once(docs_of, tokenizer, monkeypatch, fan_in):
    monkeypatch.setattr(windows, "FAN_IN", fan_in)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice((1, 3, 40, 300, 900))))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "x <|endoftext|> y"), (903, "word " * 30_000), (None, "no id"), (None, None), (904, "same"), (904, "same"), (904, "other text")]
    docs = docs_of(rows).repartition(7)
    got = windows.pack(docs, with_ids=True).collect()
    ids = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows]
    fills = check(got, ids, 2048)
    assert all(f == 2048 or windows.unpadded(f) for f in fills) and sum(f < 2048 for f in fills) <= 40
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    whole = {r.doc_id for r in got if r.length == r.doc_tokens}
    assert len(whole) > 0.6 * len(rows)
    assert windows.pack(docs).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_empty_table(docs_of):
    assert windows.pack(docs_of([])).collect() == []


def test_window_choice():
    run = lambda n: [Run(n, 0, np.zeros(n, "<u4"), n)]
    w = Windows(16, 2)
    assert list(w.put(run(9))) == [] and list(w.put(run(11))) == []  # two windows
    assert list(w.put(run(5)))[0][0].doc_id == 11  # least room, exactly full
    assert list(w.put(run(8))) == []  # a new window
    assert list(w.put(run(7)))[0][0].doc_id == 9
    w = Windows(16, 2)
    [list(w.put(run(n))) for n in (9, 12)]
    full = list(w.put(run(10)))  # fits nowhere: the fullest is filled up
    assert [[(r.doc_id, r.start, len(r.ids)) for r in f] for f in full] == [[(12, 0, 12), (10, 0, 4)]]
    w = Windows(16, 1)
    list(w.put(run(8)))
    assert [len(f) for f in w.put(run(10))] == [1]  # eight needs no padding
    assert [sum(len(r.ids) for r in f) for f in w.rest()] == [8, 2]
    assert [sum(len(r.ids) for r in f) for f in w.put(run(40))][0] == 16


def test_query_reads_every_document(spark, sf_dir, tokenizer):
    from reprise.llm import queries

    rows = queries.op11_windows(spark, sf_dir).collect()
    docs = [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    fills = check(rows, docs, 2048)
    assert len(rows) < 1.6 * len(docs) and sum(f < 2048 for f in fills) <= 11
