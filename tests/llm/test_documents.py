"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from reprise.llm import langid, lines, mixing, packing, simhash, spans
from reprise.llm.common import hash_ranges, sliding_min, word_bounds

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Texts of every awkward kind."""
    rng = random.Random(5)
    base, passage = prose(rng, 300), prose(rng, 60)
    rows = [(0, base), (1, base), (2, base + " tail of it"), (3, None), (4, ""), (5, " \t\n "), (6, "one"), (7, "a a a " * 100), (8, prose(rng, 5000))]
    rows += [(10 + i, prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 40)) for i in range(6)]
    rows += [(20, base), (20, base), (21, "same id"), (21, "other text " * 30), (None, base), (None, None), (30, "ÄÖ ß x é 日本 " * 20), (31, passage)]
    rows += [(40 + i, base.replace("w1 ", f"x{i} ", 1)) for i in range(8)]
    return rows


def brute_spans(rows, window=50):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        for p in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[p:p + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words:
        gone = set()
        for p in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[p:p + window])] < d:
                gone.update(range(p, p + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_spans(docs_of, odd):
    got = spans.repeated_spans(docs_of(odd)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_spans(odd)


def test_spans_of_random_mixtures(docs_of):
    rng = random.Random(8)
    pool = [prose(rng, n) for n in (20, 49, 50, 51, 70, 120)]
    rows = [(i, " ".join(rng.choice(pool) if rng.random() < 0.6 else prose(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    got = spans.repeated_spans(docs_of(rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_spans(rows)


def brute_print(text, shingle=4):
    words = (text or "").encode().split()
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0
    k = min(shingle, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components_of(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(docs_of, odd):
    got = simhash.near_duplicates(docs_of(odd)).collect()
    want = [(d, brute_print(t)) for d, t in odd]
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1) for r in got), key=repr) == sorted(want, key=repr)
    known = [(d, f) for d, f in want if d is not None]
    near = components_of({d for d, _ in known}, [(a, b) for a, f in known for b, g in known if (f ^ g).bit_count() <= 4])
    assert all(r.component_id == near[r.doc_id] for r in got if r.doc_id is not None)


def test_simhash_links_all_within_the_radius_over_slices(spark, monkeypatch):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 700:
        v = centre
        for b in rng.sample(range(64), rng.randint(1, 7)):
            v ^= 1 << b
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(500)}
    values = sorted(values)
    monkeypatch.setattr(simhash, "SLICE", 64)
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)], "doc_id long, fp long")
    got = {r.fp & (1 << 64) - 1: r.component_id for r in simhash.components(df, 4).collect()}
    near = components_of(range(len(values)), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4])
    assert got == {v: near[i] for i, v in enumerate(values)}


def test_one_of_each_keeps_columns_and_rows_without_id(docs_of, odd):
    docs = docs_of(odd)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and 0 in ids and 1 not in ids and 20 not in ids


def brute_lines(rows, similarity=0.8, shingle=5):
    seen, gone = [], set()
    for d, t in sorted(((d, t) for d, t in rows if d is not None), key=lambda r: r[0]):
        for i, line in enumerate((t or "").encode().split(b"\n")):
            w = line.split()
            if w:
                s = frozenset(tuple(w[k:k + shingle]) for k in range(max(1, len(w) - shingle + 1)))
                if any(len(s & o) >= similarity * len(s | o) - 1e-9 and k != (d, i) for k, o in seen):
                    gone.add((d, i))
                seen.append(((d, i), s))
    return gone


@pytest.mark.parametrize("block", [16, 2])
def test_lines(docs_of, monkeypatch, block):
    rng = random.Random(4)
    pool = [prose(rng, n) for n in (1, 2, 4, 5, 6, 30, 30, 60, 90)]

    def line():
        base = rng.choice(pool).split()
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            base.insert(rng.randrange(len(base) + 1), rng.choice(WORDS))
        return " ".join(base)
    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 6)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "\n \n"), (903, "a " * 3000), (None, pool[5]), (None, None)]
    monkeypatch.setattr(lines, "SLICE", block)
    passed_on = []
    met = lines._met

    def watched(*args):
        out = met(*args)
        passed_on.append(out.where("later is null").count())
        return out
    monkeypatch.setattr(lines, "_met", watched)
    docs = docs_of(rows)
    got = {(r.doc_id, r.line) for r in lines.removed_lines(docs).collect()}
    assert got == brute_lines(rows)
    assert block > 2 or passed_on[0]  # tokens of more than two slices
    kept = lines.drop_lines(docs)
    assert kept.columns == docs.columns
    want = [(d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in got)) for d, t in rows]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_words_of_bytes():
    text = " äb\tc\x0bd  e f\n\ng".encode()
    a, b = word_bounds(np.frombuffer(text, np.uint8), np.array([0, 4, len(text)]))
    assert [text[i:j] for i, j in zip(a, b)] == [*text[:4].split(), *text[4:].split()]
    h = hash_ranges(np.frombuffer(b"ab ab ba ab", np.uint8), np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11]))
    assert h[0] == h[1] == h[3] != h[2]
    x = np.random.default_rng(0).integers(0, 99, 50)
    assert sliding_min(x, 7).tolist() == [x[i:i + 7].min() for i in range(44)]


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = langid.learn(docs.where(langid.remainder(docs.doc_id) != 2))
    got = langid.identify(docs, filters).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.95


def test_language_edges(docs_of, odd):
    rows = [(i, "the cat sat on the mat and then it ran away") for i in range(20)]
    filters = langid.learn(docs_of(rows))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs_of([(1, None), (2, ""), (3, "123 !?"), (4, "the cat ran"), (5, "x")]), filters).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and 0 <= got[4][1] <= 1
    none = langid.learn(docs_of([]))
    assert langid.identify(docs_of([(1, "text")]), none).first().lang_pred == "und"
    kept = langid.known_language(docs_of([(1, "the cat sat on the mat"), (2, None), (3, "42")]), filters, 0.1)
    assert [r.doc_id for r in kept.collect()] == [1]


def all_grams(text):
    return np.concatenate([np.empty(0, np.uint64), *langid.grams(text)])


def test_language_agrees_with_exact_sets(spark, sf_dir):
    """Wherever exact counts are clearly apart, the filters decide alike."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = langid.learn(docs.where(langid.remainder(docs.doc_id) != 2))
    masks = {lang: i for i, lang in enumerate(filters.languages)}
    rows = docs.where("text is not null").select("doc_id", "text").collect()
    every = np.unique(np.concatenate([all_grams(r.text) for r in rows]))
    found = filters.masks(every)
    learned = {}
    sample = learned_pairs(spark, docs)
    for lang in masks:
        learned[lang] = {g for a, g in sample if a == lang}
        bit = np.array([(int(m[masks[lang] // 64]) >> (masks[lang] % 64)) & 1 for m in found], bool)
        exact = np.array([int(g) in learned[lang] for g in every.view(np.int64).tolist()])
        assert bit[exact].all()  # no member is missed
        assert (bit & ~exact).sum() <= 0.03 * max(1, (~exact).sum())
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, filters).collect()}
    checked = 0
    for r in rows:
        grams = all_grams(r.text)
        if not len(grams):
            assert got[r.doc_id] == "und"
            continue
        hits = sorted(((sum(g in own for g in grams.view(np.int64).tolist()), lang) for lang, own in learned.items()), reverse=True)
        if hits[0][0] - hits[1][0] > 0.1 * len(grams):
            checked += 1
            assert got[r.doc_id] == hits[0][1]
    assert checked > 100


def learned_pairs(spark, docs):
    """The (language, n-gram) pairs that were put into the filters."""
    kept = []
    real = langid.Filters.of
    langid.Filters.of = classmethod(lambda cls, pairs: kept.extend((a, int(g)) for a, g in pairs) or real(kept))
    try:
        langid.learn(docs.where(langid.remainder(docs.doc_id) != 2))
    finally:
        langid.Filters.of = real
    return kept


def test_very_long_texts_and_empty_tables(docs_of):
    long = "the cat sat on the mat and ran away " * 40_000
    filters = langid.learn(docs_of([(i, "the cat sat on the mat and then it ran away") for i in range(20)]))
    assert langid.identify(docs_of([(1, long)]), filters).first().lang_pred == "en"
    assert langid.identify(docs_of([]), filters).collect() == []
    mixed = mixing.mix(docs_of([(1, long, "a"), (2, "short", "a"), (3, "b c", "b")])).collect()
    assert {r.doc_id: r["__mix_size"] for r in mixed} == {1: 9 * 40_000, 2: 1, 3: 2}


def test_bloom_slices_return_every_language_and_correct_counts():
    learned = [("a", int(g)) for g in range(1000)] + [("b", int(g)) for g in range(500, 1500)]
    f = langid.Filters.of(learned)
    masks = f.masks(np.arange(1500, dtype=np.int64).view(np.uint64))[:, 0]
    assert (masks[:1000] & 1).all() and (masks[500:] & 2).all() and (masks[:500] & 2).mean() < 0.05
    assert (f.wrong < 0.01).all()


def test_mixing_targets(spark):
    df = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    # 1665 words by 3 : 1 : 2 : 3; a and c stop at 200 and 20, null at 0, b takes the rest.
    assert got == {"a": 200.0, "b": 1445.0, "c": 20.0, None: 0.0}


def test_mixing(docs_of):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.choice((1, 5, 40, 300))), rng.choice(("a", "a", "a", "b", "c", None))) for i in range(600)]
    rows += [(700, None, "a"), (701, "", "empty"), (5, "twice here", "b"), (5, "twice here", "b"), (None, "no id", "c")]
    docs = docs_of(rows)
    got = mixing.mix(docs).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        assert r["__mix_size"] == len((r.text or "").split()) and 0 <= r["__mix_copies"] <= 2
        taken[r.source] += r["__mix_size"] * r["__mix_copies"]
        target[r.source] = r["__mix_target"]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 300 for s in target)
    out = mixing.emit(docs)
    assert out.columns == docs.columns and out.count() == sum(r["__mix_copies"] for r in got)


def test_packing(docs_of, odd):
    from tokenizers import Tokenizer

    import public_tokenizers

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    literal = "a <|endoftext|> b"
    assert slow.encode(literal, add_special_tokens=False).ids == [64, 220, 50256, 275] == packing.Tokenizer().encode(literal).tolist()
    assert len(packing.Tokenizer(added=False).encode(literal)) == 9
    rng = random.Random(2)
    rows = odd + [(100 + i, prose(rng, rng.randint(1, 900))) for i in range(300)] + [(500, "<|endoftext|> it's 12 \n\n  x"), (501, prose(rng, 60_000))]
    docs = docs_of(rows)
    packed = packing.pack(docs).collect()
    want = sorted((repr(d), zlib.crc32(np.array(slow.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()), len(slow.encode(t or "").ids) + 1)
                  for d, t in rows if len(slow.encode(t or "").ids) < 2048)
    cut = {r.doc_id for r in packed if r.piece}
    assert cut == {8, 501} and want == sorted((repr(r.doc_id), r.ids_crc32, r.length) for r in packed if r.doc_id not in cut)
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in packed)
    assert len(bins) <= -(-total // 2048) + 1
    pieces = sorted((r.piece, r.start, r.length) for r in packed if r.doc_id == 501)
    assert all(n == 2048 for _, _, n in pieces[1:]) and [s for _, s, _ in pieces[1:]] == [pieces[0][2] + 2048 * k for k in range(len(pieces) - 1)]


def test_sequences_hold_the_ids(docs_of):
    docs = docs_of([(1, "a b c"), (2, "d e"), (3, "word " * 3000)])
    pieces = packing.pieces(docs)
    placed = packing.pack(docs).join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    tokens = packing.Tokenizer()
    whole = sum(len(tokens.encode(t)) + 1 for t in ("a b c", "d e", "word " * 3000))
    assert sum(len(r.ids) for r in packing.sequences(placed).collect()) == whole


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 900, 400).tolist()
    a, b = packing.Grouping([], []), packing.Grouping([], [])
    packing.best_fit(a, list(range(400)), size, 2048)
    packing.best_fit(b, list(range(399, -1, -1)), size, 2048)
    for child in (packing.cross(a, b, size, 2048, rng), packing.mutate(a, size, 2048, rng)):
        assert sorted(i for g in child.bins for i in g) == list(range(400))
        assert all(2048 - sum(size[i] for i in g) == r >= 0 for g, r in zip(child.bins, child.room))
    best = packing.evolve(size, 2048, [a], 3, generations=30)
    assert len(best.bins) <= len(a.bins)


def test_empty_tables(docs_of):
    none = docs_of([])
    for made in (spans.repeated_spans(none), simhash.near_duplicates(none), simhash.one_of_each(none), lines.drop_lines(none),
                 mixing.mix(none), mixing.emit(none), packing.pack(none)):
        assert made.collect() == []
