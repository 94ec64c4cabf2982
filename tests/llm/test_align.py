"""Alignment of two tokenizers against brute force on small documents."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from reprise.llm import align


def test_gallop_finds_ranks():
    rng = np.random.default_rng(2)
    for n, m in ((0, 5), (5, 0), (1, 1), (7, 300), (5000, 9000), (20_000, 50)):
        keys, into = (np.sort(rng.choice(100_000, k, replace=False)) for k in (n, m))
        assert (align.gallop(keys, into) == np.searchsorted(into, keys)).all()


def brute(rows):
    """The contract, one token at a time."""
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(align.MODEL))
    byte_of = {}
    n = 0
    for b in range(256):  # the printable code points of byte-level vocabularies
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            byte_of[chr(b)] = b
        else:
            byte_of[chr(256 + n)] = b
            n += 1
    found, total = [], Counter()
    for d, t in rows:
        a = b = []
        if t:
            a, b = slow.encode(" " + t, add_special_tokens=False).ids, pieces.encode(t)
        xs = [bytes(byte_of[c] for c in slow.id_to_token(i)) for i in a]
        ys = [bytes([int(p[3:-1], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [pieces.id_to_piece(i)]]
        if not t or not b"".join(xs) == b"".join(ys) == (" " + t).encode():
            found.append((d, [], [], [], ""))
            continue
        spans = []
        for side in (xs, ys):
            at, out = 0, []
            for x in side:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, last = [], 0
        for c in common:
            groups.append(tuple([i for i, (s, e) in zip(ids, side) if last <= s and e <= c] for ids, side in zip((a, b), spans)))
            last = c
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        total.update(links)
        found.append((d, a, b, links, text, groups))
    highest = Counter()
    for (_, y), c in total.items():
        highest[y] = max(highest[y], c)
    out = []
    for d, a, b, links, text, *groups in found:
        out.append((d, len(a), len(b), len(groups[0]) if groups else 0, len(links), sum(total[p] == highest[p[1]] for p in links),
                    sum(total[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, total, highest, found


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(7)
    words = "the tokenizer splits unbelievable naïve Straße 東京 emoji🙂 x1234 can't l'été \t \n  <s> </s> <|endoftext|> ﬁ".split(" ")
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "a▁b"), (104, "\x00\x01"), (None, "no id"), (None, None), (105, "same id"), (105, "same id"), (105, "other"),
             (106, "z" * 300), (107, "日本語" * 50), (108, "the cat sat " * 200)]
    return rows


@pytest.mark.parametrize("chunk", [1 << 18, 50])
def test_scores(docs_of, odd, monkeypatch, chunk):
    monkeypatch.setattr(align, "CHUNK", chunk)
    want = brute(odd)[0]
    got = align.link_scores(docs_of(odd).repartition(5))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) > 60 and {w[0]: w[1] for w in want}[103] == 0


def test_pair_counts_and_alignments(docs_of, odd):
    _, total, highest, found = brute(odd)
    got = align.pair_counts(docs_of(odd)).collect()
    assert {(r.a, r.b): r.links for r in got} == total and all(r.best == (r.links == highest[r.b]) for r in got)
    sides = [(r.doc_id, r.a_ids, r.b_ids, r.a_ends, r.b_ends) for r in align.alignments(docs_of(odd)).collect()]
    want = []
    for d, a, b, _, _, *groups in found:
        ends = [list(np.cumsum([len(g[k]) for g in groups[0]]).tolist()) for k in (0, 1)] if groups else [[], []]
        want.append((d, list(a), list(b), *ends))
    assert sorted(sides, key=repr) == sorted(want, key=repr)


def test_very_long_text(docs_of):
    rows = [(1, "many words of a very long text, " * 9000), (2, "short")]
    got = {r.doc_id: r for r in align.link_scores(docs_of(rows)).collect()}
    assert got[1].n_a > 60_000 and got[1].n_links >= max(got[1].n_a, got[1].n_b) and got[2].n_groups == 1


def test_empty_table(docs_of):
    none = docs_of([])
    assert align.link_scores(none).collect() == align.pair_counts(none).collect() == align.alignments(none).collect() == []


def test_query(spark, sf_dir):
    from reprise.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    small = [r for r in rows if len(r[1] or "") < 3000][:60]
    assert queries.op12_align(spark, sf_dir).count() == len(rows)
    docs = spark.createDataFrame(small, "doc_id long, text string")
    assert sorted(map(tuple, align.link_scores(docs).collect())) == sorted(brute(small)[0])
