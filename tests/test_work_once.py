"""What a row costs is paid once: readings, digests and hashes are not worked out anew for every mention."""

from pyspark.sql import functions as F

from reprise.functions import geo
from reprise.plans.views import Views


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def tables(spark, folder):
    spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 30).alias("text")).write.parquet(f"{folder}/documents.parquet")
    spark.range(7).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((i * 37 + F.col("id") * 11) % 64).cast("float"))
                          .alias("embedding")).write.parquet(f"{folder}/embeddings.parquet")
    return Views(spark, str(folder))


def test_a_text_is_searched_once_for_its_coordinate(spark):
    rows = spark.createDataFrame([("-12,345678 S , -45.678901 W",), ("51.500100 N, 10.120000 E | -12.500, -45.250",), ("",), (None,)], "t string")
    found = rows.select(geo.extract_coordinate(F.col("t")).alias("p"))
    assert plan(found).count("regexp_extract_all") == 4
    assert [r.p and tuple(r.p) for r in found.collect()] == [(-12.345678, -45.678901), (-12.5, -45.25), None, None]


def test_a_filter_on_readings_does_not_read_again(spark, tmp_path):
    read = tables(spark, tmp_path).coordinates.where("lat is not null and lon is not null")
    assert "regexp_extract_all" not in plan(read) and read.count() > 0


def test_the_middle_of_a_vector_is_sorted_out_once(spark, tmp_path):
    v = tables(spark, tmp_path)
    made = plan(v._content_hashes())
    assert made.count("sort_array") == 1 and "sort_array" not in made.split("lambdafunction", 1)[1]
    bits = {r.vec_id: sum(1 << (63 - i) for i, x in enumerate(r.embedding) if x >= sorted(r.embedding)[32]) for r in v.table("embeddings").collect()}
    for r in v.content_hashes.collect():
        b = r.base_id
        flips = 0 if b % 3 == 0 else 1 << b % 62 if b % 3 == 1 else 1 << b % 62 | 1 << (b + 7) % 62
        assert r.phash & (2**64 - 1) == bits[b % 7] ^ flips


def test_texts_are_hashed_once(spark, tmp_path):
    v = tables(spark, tmp_path)
    assert "sha2(" not in plan(v.occ) and v.occ.count() == 40 and v.contents.count() == 30
