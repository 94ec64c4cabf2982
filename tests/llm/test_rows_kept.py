"""No row, line or column is lost where ids repeat or columns have the operators' own names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reprise.llm import lines, mixing, simhash

LONG = " ".join(f"word{i}" for i in range(40))
OTHER = " ".join(f"thing{i}" for i in range(40))
CLASHING = ["__key", "__hit", "__gone", "__id", "__mix_size", "__mix_copies", "__mix_copy", "gone_id", "may_go", "own_print", "id_or_zero", "sub", "line",
            "gone_lines", "token", "fp", "component_id", "lost", "line_key", "item", "row"]


@pytest.fixture(scope="module")
def clashing(spark):
    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t), *("mine",) * len(CLASHING)) for d, t, s in rows], schema)
    return make


ROWS = [(1, LONG, "a"), (2, LONG + " tail", "a"), (2, OTHER, "a"), (3, None, "b"), (4, "", None), (4, "", None), (None, LONG, "a"), (None, None, "b"),
        (5, "one line here\n" + LONG, "b"), (6, LONG + "\n" + OTHER, "c"), (6, "quite another line of words\n" + LONG, "c")]


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_rows_that_repeat_an_id_lose_their_own_lines(clashing):
    a, b, c, d = ("\n".join([f"{x}{i} " * 12 for i in range(2)]) for x in "abcd")
    got = texts(lines.drop_lines(clashing([(1, a + "\n" + b, "s"), (2, c + "\n" + b, "s"), (2, d + "\n" + LONG, "s"), (3, LONG, "s")])))
    assert got == sorted([(1, a + "\n" + b), (2, c), (2, d + "\n" + LONG), (3, "")], key=repr)


def test_equal_lines_of_rows_with_one_id(clashing):
    got = texts(lines.drop_lines(clashing([(7, LONG + "\nx1", "s"), (7, LONG + "\nx2", "s"), (7, LONG + "\nx2", "s")])))
    assert sum(t.count(LONG) for _, t in got) in (1, 2)  # the rows that are equal share their fate
    assert sorted(t[-2:] for _, t in got) == ["x1", "x2", "x2"]


def test_near_copies_go_by_row(clashing):
    docs = clashing(ROWS)
    kept = simhash.one_of_each(docs, shingle=4)
    assert kept.columns == docs.columns and all(r["__key"] == "mine" == r["own_print"] for r in kept.collect())
    assert (2, OTHER) in texts(kept) and (2, LONG + " tail") not in texts(kept) and (1, LONG) in texts(kept)


def test_emit_keeps_columns(clashing):
    docs = clashing(ROWS)
    out = mixing.emit(docs)
    assert out.columns == docs.columns and all(r["__mix_size"] == "mine" == r["__mix_copy"] for r in out.collect())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_with_odd_rows_and_empty_tables(spark, sf_dir, clashing, name, stage):
    docs = clashing(ROWS)
    out, none = stage(spark, docs, sf_dir), stage(spark, docs.limit(0), sf_dir)
    assert none.collect() == []
    got = out.collect()
    if name == "sequences":
        assert sorted(r.doc_id for r in got if r.doc_id) == sorted(d for d, _, _ in ROWS if d)
        return
    assert out.columns == docs.columns and none.columns == docs.columns
    assert all(r[c] == "mine" for r in got for c in CLASHING)
    left = sorted(((r.doc_id, r.text) for r in got), key=repr)
    if name == "language":
        assert left == sorted(((d, t) for d, t, _ in ROWS if t), key=repr)
    if name == "repeated_lines":
        assert len(left) == len(ROWS) and left.count((2, OTHER)) == 1 and (None, LONG) in left
        assert out.where("text is not null and n_chars <> char_length(text)").count() == 0
    if name == "near_copies":
        assert (2, OTHER) in left and (1, LONG) in left and (2, LONG + " tail") not in left


def test_places_of_lines():
    import numpy as np

    texts = ["", "a", "\n", "ab\n\ncd\n", "", "x\ny", ""]
    raw = [t.encode() for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    row, number, start, stop = lines._line_places(np.frombuffer(b"".join(raw), np.uint8), begins)
    joined = "".join(texts)
    got = [(r, n, joined[a:b]) for r, n, a, b in zip(row.tolist(), number.tolist(), start.tolist(), stop.tolist())]
    assert got == [(i, n, line) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n"))]


def test_bitmap_condition_stays_out_of_python(spark):
    from reprise.llm.common import bit_of, bitmap, may_be_in

    ids = spark.range(0, 500, 7).withColumnRenamed("id", "doc_id")
    rows = spark.range(500).withColumnRenamed("id", "doc_id")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")  # as in sessions that the library did not make
    kept = rows.where(may_be_in(rows, "doc_id", bitmap(ids, bit_of("doc_id"))))
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    got = {r.doc_id for r in kept.collect()}
    assert got >= set(range(0, 500, 7)) and len(got) < 80
    assert "Python" not in kept._jdf.queryExecution().executedPlan().toString()
