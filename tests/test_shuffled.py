"""Rows that queries shuffle, held against the rows they are made of."""

import compare
import pytest

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import analyze, index, search
from tessera.plans import registry

FOLDER = f"{compare.DATA}/sf0.001"
#: At most so many rows shuffled for each different word of a document; numbers before: see each line's end.
MOST = {
    "bm25_stemmed": 1.25,  # 1.30
    "bm25_stored_index": 2,  # 2.64
    "bm25_alpha": 0.6,  # 2.72
    "bm25_weighted_query": 0.53,  # 0.59
    "postings_roundtrip": 4.5,  # 5.91
    "bm25_oov": 0.53,  # 0.59
    "bm25_top10": 0.53,  # 0.59
    "result_lines": 0.53,  # 0.59
    "bm25_top1": 0.53,  # 0.58
    "bm25_blank_queries": 0.42,  # 0.45
    "stream_segments": 1.8,  # 2.56
    "index_bytes": 2.8,  # 3.11
    "merge_segments": 0.1,  # 1.02
    "postings_delta": 2.5,  # 3.91
    "index_roundtrip": 1.8,  # 2.46
    "vbyte_sizes": 2.8,  # 3.11
    "collection_stats": 0.8,  # 1.46
    "postings_packed": 0.8,  # 1.46
}


def _shuffled(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum({(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}.values())


@pytest.fixture(scope="module")
def postings(spark):
    return registry.tokenize_documents(spark, FOLDER).count()


@pytest.mark.parametrize("name", list(MOST))
def test_few_rows_are_shuffled(spark, postings, name):
    before = _shuffled(spark)
    registry.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    assert _shuffled(spark) - before <= MOST[name] * postings


@pytest.mark.parametrize("name", ["stemmed_lines", "keyword_filter"])
def test_tokens_are_not_shuffled_to_their_stems(spark, name):
    """Where the planner would not broadcast the stems by itself, as is so for a large vocabulary."""
    tokens = registry.stopword_filter(spark, FOLDER).count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = _shuffled(spark)
        registry.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        assert _shuffled(spark) - before < tokens
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rare_terms_are_stemmed_as_common_ones_are(spark, monkeypatch):
    terms = spark.createDataFrame([(i, w) for i, w in enumerate("cats cats running running running flies #(cats)# relational the cats é".split())], "pos int, term string")
    keep = spark.createDataFrame([("cat",), ("run",)], "term string")
    want, kept = sorted(analyze.stem_terms(terms).collect()), sorted(analyze.stem_terms(terms, keep).collect())
    assert [r.term for r in want] == "cat cat run run run fli #(cats)# relat the cat é".split()
    assert [r.pos for r in kept] == [0, 1, 2, 3, 4, 6, 9]
    for n in (0, 2):
        monkeypatch.setattr(analyze, "COMMON_TERMS", n)
        assert sorted(analyze.stem_terms(terms).collect()) == want and sorted(analyze.stem_terms(terms, keep).collect()) == kept


def test_words_need_no_regular_expression(spark):
    plan = spark.createDataFrame([("a b",)], "t string").select(X.words(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan


@pytest.mark.parametrize("k", [1, 3, 100])
def test_scores_by_document_are_those_by_joins(spark, monkeypatch, k):
    docs = spark.range(60).select(F.col("id").alias("docid"), F.concat(F.lit("d"), "id").alias("docname"), F.expr("CASE id % 5 WHEN 0 THEN 'a b b c' WHEN 1 THEN 'c d' WHEN 2 THEN 'a' WHEN 3 THEN '#!2!# e a' ELSE 'f' END").alias("content"))
    queries = spark.createDataFrame([(1, "a b"), (2, "c #!3!# d"), (3, "unknown"), (4, "#!-2!# a e"), (5, "#!-1!# a #!3!# f")], "qid int, query string")
    made = index.build(docs)
    got = []
    for sent, cells in ((200_000, 1 << 22), (200_000, 1), (0, 1)):
        monkeypatch.setattr(search, "SENT_WEIGHTS", sent)
        monkeypatch.setattr(search, "CELLS", cells)
        found = search.search(made, queries, k)
        got.append((found.dtypes, sorted(found.collect())))
    assert got[0] == got[1] == got[2] and len(got[0][1]) > 2


def test_weights_are_summed_within_a_row(spark):
    docs = spark.createDataFrame([(1, "x", "b a b"), (2, "y", "b a #!3!# b #!-1!# a c"), (3, "z", ""), (4, "w", None)], "docid long, docname string, content string")
    made = index.build(docs)
    want = {("a", 1, 1, 3), ("b", 1, 2, 3), ("a", 2, 0, 3), ("b", 2, 4, 3), ("c", 2, -1, 3)}
    assert {tuple(r) for r in made.postings.collect()} == want
    some = index.build(docs, terms=spark.createDataFrame([("b",), ("zz",)], "term string"))
    assert {tuple(r) for r in some.postings.collect()} == {r for r in want if r[0] == "b"} and some.stats.first()[:2] == (2, 6)
