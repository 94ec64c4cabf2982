"""Vectors, pages, conversations, the registered queries and the pipeline."""

import hashlib
import random

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from reprise.llm import caps, chat, hnsw, html, queries

VECTORS = "vec_id long, embedding array<float>, label int, v string, row long, filter long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", 1, 2) for i, v in rows], VECTORS)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 32))
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(1000 + i, base[i % 20] + rng.standard_normal(32) * rng.choice([0.0, 0.1, 0.35, 0.5])) for i in range(150)]
    rows += [(2000 + i, base[7] * (i + 1)) for i in range(40)]
    return [(i, np.asarray(v, np.float32)) for i, v in rows]


ODD = [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] + [1.0] * 31), (5003, [float("inf")] * 32), (5004, [None] + [1.0] * 31), (5005, []), (5006, [1.0, 2.0])]


def test_caps(spark, cloud, monkeypatch):
    monkeypatch.setattr(caps, "SLICE", 16)
    got = {r.vec_id: r for r in caps.near_vectors(vectors(spark, cloud + ODD)).collect()}
    ids = np.array([i for i, _ in cloud])
    x = np.array([v for _, v in cloud], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    assert sum(got[i].n_links for i in ids) >= 0.98 * near.sum()
    assert all(got[i].n_links <= n for i, n in zip(ids, near.sum(axis=1)))
    assert {got[2000 + i].component_id for i in range(40)} == {7} and got[7].kept and not got[2000].kept
    assert all(got[i].n_links == 0 and got[i].component_id == i for i, _ in ODD)
    assert caps.near_vectors(vectors(spark, [])).collect() == []


def test_copies_of_a_vector_are_compared_once(spark, monkeypatch):
    """Thousands of copies: each links with all others, and no cell ever sees more than one of them."""
    seen = []
    real = caps.cells
    monkeypatch.setattr(caps, "cells", lambda rows, *a, **k: seen.append(rows.count()) or real(rows, *a, **k))
    rows = [(i, [1.0, 2.0, 0.0, 0.5]) for i in range(6000)] + [(7000, [1.0, 2.0, 0.01, 0.5]), (7001, [-1.0, 0.0, 0.0, 0.0]), (7001, [1.0, 2.0, 0.0, 0.5])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in caps.near_vectors(vectors(spark, rows)).collect()}
    assert got[0] == got[5999] == (6001, 0) and got[7000] == (6001, 0)
    assert got[7001] == (6001, 0)  # the second of its rows is a copy
    assert seen[0] < 3 * 2000


def test_hnsw(spark, cloud, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 128)
    df = vectors(spark, cloud + ODD)
    got = hnsw.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    x, ids, hit = np.array([v for _, v in cloud], np.float64), np.array([i for i, _ in cloud]), []
    for q in [i for i in ids.tolist() if i % 20 == 0]:
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in {v for _, v, _ in own}
        score = x @ x[np.flatnonzero(ids == q)[0]]
        assert all(abs(s - score[np.flatnonzero(ids == v)[0]]) < 1e-9 for _, v, s in own)
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        best = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist()) if i != q)[:20]
        hit.append(len({v for _, v in best} & {v for _, v, _ in own}) / 20)
    assert np.mean(hit) > 0.95
    assert hnsw.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0, 20).collect() == []


def recall(df, rows, k=20):
    got = hnsw.nearest(df, F.col("vec_id") % 20 == 0, k).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    ids = np.array([i for i, _ in rows])
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        hits.append(len(set(ids[np.argsort(-score, kind="stable")[:k]].tolist()) & found[ids[q]]) / k)
    return float(np.mean(hits))


@pytest.mark.parametrize("kind", ["one long vector", "log-normal", "many scales"])
def test_recall_with_mixed_norms(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "one long vector":
        x[77] *= 10_000
    elif kind == "log-normal":
        x *= np.exp(rng.standard_normal(1500))[:, None]
    else:
        x *= 10.0 ** rng.integers(-9, 10, 1500)[:, None]
    rows = list(enumerate(x))
    assert recall(vectors(spark, rows), rows) >= 0.95


def test_repeated_query_ids_ask_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (20, [0.2, 0.9])]
    got = [[(r.query_id, r.rank, r.vec_id) for r in hnsw.nearest(vectors(spark, rows[::way]), F.col("vec_id") % 20 == 0, 20).collect()] for way in (1, -1)]
    assert sorted(got[0]) == sorted(got[1]) and {q for q, _, _ in got[0]} == {0, 20}


def test_equal_vectors_give_the_smallest_ids(spark):
    df = vectors(spark, [(i, [1.0, 0.0]) for i in range(0, 60)] + [(100, [0.0, 1.0])])
    got = hnsw.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)] == list(range(1, 21))
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 20), key=lambda r: r.rank)] == list(range(0, 20))


PAGES = {
    "plain": ("<html><head><title>T</title></head><body><nav><a>Home</a></nav><article><h1>Head &amp; line</h1><p>One, two.\n three<p>Four.<br>Five"
              "<ul><li>a<li>b</ul></article><aside>More</aside><footer>End</footer></body></html>", "Head & line\nOne, two. three\nFour. Five\na\nb"),
    "hints": ("<body><div class='main-menu'>Menu</div><div id=content><h1>Title</h1><p>Long text, with commas, and stops. And more of it.</p><p>Short</p>"
              "<div class='ad'>Buy, buy, buy. Now, or never, they say.</div></div><div class='comments'><p>A reader, who writes, long, long, long. And long, long.</p></div>"
              "<form>Name <input></form><script>var a = '<p>no</p>';</script><!-- <p>no</p> --></body>", "Title\nLong text, with commas, and stops. And more of it.\nShort"),
    "notice": ("<body><div class='cookie-notice'>We use cookies, as all do, to do things. Accept, please.</div><main><p>Text, that is long enough. It is, it is.</p></main></body>",
               "Text, that is long enough. It is, it is."),
    "stray": ("</div><p>Only <b>text</i> here, and there. 1 < 2, they say.", "Only text here, and there. 1 < 2, they say."),
}


def test_html(spark):
    for name, (page, want) in PAGES.items():
        assert html.extract(page) == want, name
    assert html.extract(None) == html.extract("") == html.extract("<script>x</script>") == html.extract("<") [:0]
    deep = "<div>" * 3000 + "<p>Deep, but there.</p>" + "</div>" * 3000
    assert html.extract(deep) == "Deep, but there."
    df = spark.createDataFrame([(1, "u", PAGES["plain"][0], "t"), (1, "u", PAGES["plain"][0], "t"), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = html.texts(df).collect()
    assert sorted(r.n_chars for r in got) == [0, len(PAGES["plain"][1]), len(PAGES["plain"][1])] and html.texts(df.limit(0)).collect() == []


def test_html_keeps_whole_articles(spark, sf_dir):
    import re
    from html import unescape

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = r.html[r.html.index("<article>"):r.html.index("</article>")]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert html.extract(r.html) == "\n".join(b for b in blocks if b)


def test_template_language():
    t = chat.compile_template
    assert t("a{{ 'b' + 1 + 2 }}c{# no #}")({})[0] == "ab12c"
    assert t("{% for x in xs %}{% if x == 'a' or x == 'b' %}{{ x | upper }}{% elif not x %}-{% else %}?{% endif %}{% endfor %}")({"xs": ["a", "", "z", "b"]})[0] == "A-?B"
    assert t("{% set y = 'q' %}{{ y }}{% generation %}{{ z.k }}{% endgeneration %}!")({"z": {"k": "mm"}}) == ("qmm!", [(1, 3)])
    assert t("{{ x.__class__ }}{{ x.upper }}")({"x": "s"})[0] == ""
    assert len(chat.fold(chat.parse("{% if 1 == 1 %}a{{ 'b' | upper }}{% else %}c{% endif %}d"))) == 1
    for bad in ("{{ x() }}", "{{ x | eval }}", "{% import os %}", "{% if x %}", "{{ x[0] }}", "{{ }}", "{% for x %}{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            t(bad)


def test_chat_round_trip(spark):
    rng = random.Random(1)
    parts = ["<|im_end|>", "<|im_start|>assistant", "<\\|", "\\", "<", "|", "\n", "é", "日", "assistant\n", "ok "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb\\", None]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9))), "x", 3)
            for c in range(60) for t in range(rng.randint(1, 5))]
    rows += [(70, 0, "assistant", None, "x", 3), (71, 0, "user", "tie", "x", 3), (71, 0, "user", "tie", "x", 3), (None, 0, "user", "no id", "x", 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, loss string, turns int")
    formatted = chat.format_conversations(df)
    by = {}
    for c, t, r, x, *_ in sorted(rows, key=lambda q: (q[1], q[2] or "", q[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    for r in formatted.collect():
        assert chat.read_back(r.formatted) == by[r.conv_id]
        assert [chat.unescape(r.formatted[s.start:s.end]) for s in r.loss] == [x for role, x in by[r.conv_id] if role == "assistant"]
    for r in chat.digests(formatted).collect():
        said = "".join(f"{a}\n{b}\n" for a, b in by[r.conv_id])
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.n_turns == len(by[r.conv_id])
    assert chat.digests(chat.format_conversations(df.limit(0))).collect() == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare.compare(spark, compare.connect(sf_dir), queries.queries()[name], queries.oracle_sql()[name], sf_dir) is None


def test_very_long_turns_and_texts(spark):
    text = "a <|im_end|> b\n" * 60_000
    rows = [(1, 0, "user", text, "x", 3), (1, 1, "assistant", text, "x", 3)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, loss string, turns int"))
    assert chat.read_back(formatted.first().formatted) == [("user", text), ("assistant", text)]


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)} and set(queries.queries()) | {"pipeline"} <= names


def test_op3_query(spark, sf_dir):
    got = queries.op3_lines(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and any(r.n_chars == 0 for r in got)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language"](spark, docs, sf_dir)
    assert known.columns == docs.columns and known.count() == docs.count()
    thinned = stages["repeated_lines"](spark, known, sf_dir)
    assert thinned.columns == docs.columns and thinned.schema == docs.schema and thinned.count() == docs.count()
    single = stages["near_copies"](spark, docs, sf_dir)
    assert single.columns == docs.columns and 0 < single.count() < docs.count()
    assert stages["source_mix"](spark, docs, sf_dir).columns == docs.columns
    packed = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all() and set(packed.doc_id) <= {r.doc_id for r in docs.select("doc_id").collect()}
