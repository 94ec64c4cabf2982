"""Which lines of `op3_lines` are shuffled: those of tokens that several sets have, and of pairs that may be similar."""

import random

import numpy as np
import pyarrow as pa

from reprise.llm import lines


def test_sketches_never_differ_in_more_bits_than_sets():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    sets = [rng.choice(pool, n, replace=False) for n in (1, 2, 5, 30, 60, 200, 399, 400) for _ in range(6)]
    n = np.array([len(s) for s in sets])
    k1, k2 = (lines.signed(k) for k in lines._sketches(np.concatenate(sets), np.cumsum(n) - n))
    for a, s in enumerate(sets):
        apart = lines._apart(k1[a:a + 1], k2[a:a + 1], k1, k2)
        for b, t in enumerate(sets):
            assert apart[b] <= len(set(s.tolist()) ^ set(t.tolist()))
    assert lines._apart(k1[:1], k2[:1], k1[:1], k2[:1])[0] == 0


def test_lines_that_share_little_are_not_read_again(spark, monkeypatch):
    rng = random.Random(7)
    often = [f"w{i}" for i in range(60)]

    def line(rare):
        words = [rng.choice(often) for _ in range(40)]
        return words[:20] + rare + words[20:]
    rows = [(i, " ".join(line([f"rare{i // 2}x{k}" for k in range(5)]))) for i in range(60)]
    base = line([f"only{k}" for k in range(5)])
    rows += [(100, " ".join(base)), (101, " ".join(base + ["end"]))]
    read = []
    token_sets = lines._token_sets

    def watched(docs, wanted, *args):
        read.extend(r.doc_id for r in wanted.select("doc_id").distinct().collect())
        return token_sets(docs, wanted, *args)
    monkeypatch.setattr(lines, "_token_sets", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.line) for r in lines.removed_lines(docs).collect()]
    assert got == [(101, 0)]
    assert sorted(read) == [100, 101]


def test_tokens_of_one_set_are_not_shuffled(spark):
    rng = np.random.default_rng(6)
    tokens = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, 440_000))
    rng.shuffle(tokens)
    tokens = tokens[:400_000]
    twice = tokens[:5_000]
    flat = np.concatenate([tokens, twice, twice[:100]])
    count = len(flat) // 10
    zeros = pa.array(np.zeros(count, np.int64))
    marked = spark.createDataFrame(pa.table({
        "doc_id": pa.array(np.arange(count)), "line": zeros.cast(pa.int32()), "sub": zeros, "n": pa.array(np.full(count, 50, np.int32)),
        "k1": zeros, "k2": zeros, "prefix": pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 10, dtype=np.int32)), pa.array(flat)),
    })).repartition(5)
    got = np.array([r.token for r in lines._postings(marked, 1).select("token").collect()])
    met = got[np.isin(got, twice)]
    assert len(met) == 10_100 and set(met.tolist()) == set(twice.tolist())
    # 2^24 places met by 400,000 tokens would pass about 9,000 more.
    assert len(got) - len(met) < 100
