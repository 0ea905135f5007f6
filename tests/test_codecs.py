import random

from pyspark.sql import functions as F

from tessera.operators import codecs
from tessera.operators.numbering import dense_ids


def test_vbyte(spark):
    values = [0, 1, 127, 128, 130, 16383, 16384, 2**31, 2**40 + 5]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", codecs.vbyte(F.col("v")).alias("code"), codecs.vbyte_size(F.col("v")).alias("n"))
    rows = df.withColumn("back", codecs.from_vbyte(F.col("code"))).collect()
    assert [r.back for r in rows] == values and all(len(r.code) == 2 * r.n for r in rows)
    assert [r.code for r in rows][:5] == ["00", "01", "7F", "8100", "8102"]


def test_pair(spark):
    df = spark.createDataFrame([(0, 3), (14, 14), (15, 0), (2, 15), (20, 160)], "a int, b int")
    assert [r[0] for r in df.select(codecs.pair(F.col("a"), F.col("b"))).collect()] == ["03", "EE", "F000", "2F00", "FF058111"]


def test_sorted_list_by_word_and_number(spark):
    words = ["b", "c", "α", "αa", "αα"]
    coded = codecs.front_coded(spark.createDataFrame([(w,) for w in words], "term string"), ranges=3)
    rows = sorted(coded.collect())
    assert [(r.ordinal, r.term, r.shared, r.rest) for r in rows] == [(0, "b", 0, "b"), (1, "c", 0, "c"), (2, "α", 0, "α"), (3, "αa", 1, "a"), (4, "αα", 1, "α")]
    assert sorted(codecs.from_front_coded(coded.drop("term")).collect()) == list(enumerate(words))


def test_front_coding_of_many(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abé𝔸", k=rng.randrange(1, 9))) for _ in range(500)}, key=str.encode)
    coded = codecs.front_coded(spark.createDataFrame([(w,) for w in words], "term string"), ranges=7)
    assert [r.term for r in sorted(codecs.from_front_coded(coded.drop("term")).collect())] == words
    assert codecs.front_coded(spark.createDataFrame([], "term string")).collect() == []


def test_gaps(spark):
    rows = {("a", 3, 1), ("a", 10, 2), ("b", 0, 5), ("a", 11, 1)}
    delta = codecs.gaps(spark.createDataFrame(list(rows), "term string, docid long, tf long"))
    assert sorted((r.term, r.at, r.gap) for r in delta.collect()) == [("a", 1, 3), ("a", 2, 7), ("a", 3, 1), ("b", 1, 0)]
    assert {tuple(r) for r in codecs.from_gaps(delta).collect()} == rows


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"), F.lit(1).alias("range"))
    got = dense_ids(df, ["v"], ranges=9)
    assert got.columns == ["v", "range", "docid"]
    assert all(r.v == r.docid for r in got.collect())
    assert dense_ids(df.where("false"), ["v"]).collect() == []
