import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import analyze, extract, index, search
from tessera.operators.numbering import dense_ids


def docs(spark, *contents):
    return spark.createDataFrame([(i, f"doc{i + 1}", c) for i, c in enumerate(contents)], "docid long, docname string, content string")


def ask(spark, made, *lines, **kw):
    raw = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "n int, line string")
    name, terms = analyze.query_parts(F.col("line"))
    found = search.with_names(search.search(made, raw.select(F.coalesce(name, F.col("n").cast("string")).alias("qid"), terms.alias("query")), **kw), made)
    return [(r.qid, r.docname, r.rank, r.score) for r in found.orderBy("qid", "rank").collect()]


def analysed(spark, text):
    d = docs(spark, text)
    return d.withColumn("content", F.array_join(X.words(X.strip_markup(F.col("content")), math=True), " "))


def test_weighted_document(spark):
    made = index.build(analysed(spark, "α c <center>#!2!# b</center>"))
    assert [(r.docid, r.docname, r.dl) for r in made.docs.collect()] == [(0, "doc1", 4)]
    assert {(r.term, r.tf) for r in made.postings.collect()} == {("α", 1), ("b", 2), ("c", 1)}
    got = ask(spark, made, "q1; α", "q2; b", "q3; #!5!# b", "q4; c c", "q5; center")
    assert got == [("q1", "doc1", 1, 0.026153), ("q2", "doc1", 1, 0.03596), ("q3", "doc1", 1, 0.03596), ("q4", "doc1", 1, 0.047947)]


def test_two_segments(spark):
    one, two = index.build(docs(spark, "α b")), index.build(docs(spark, "α c").withColumn("docname", F.lit("doc2")))
    both = index.merge(one, two)
    assert {(r.term, r.docid, r.tf) for r in both.postings.collect()} == {("α", 0, 1), ("α", 1, 1), ("b", 0, 1), ("c", 1, 1)}
    assert ask(spark, both, "q1; α", "q2; b", "q3; c") == [("q1", "doc1", 1, 0.016575), ("q1", "doc2", 2, 0.016575), ("q2", "doc1", 1, 0.063013), ("q3", "doc2", 1, 0.063013)]
    assert ask(spark, both, "q1; α", k=1) == [("q1", "doc1", 1, 0.016575)]


def test_merged_is_as_if_indexed_at_once(spark):
    texts = ["α b", "", "α c c", "b b #!3!# d", "e"]
    whole = index.build(docs(spark, *texts))
    parts = [index.build(dense_ids(docs(spark, *part).where("content <> ''"), ["docid"], "id").drop("docid").withColumnRenamed("id", "docid")) for part in (texts[:3], texts[3:])]
    merged = index.merge(*parts)
    names = lambda x: sorted((r.term, r.tf, r.dl) for r in x.postings.collect())
    assert names(merged) == names(whole)
    assert merged.stats.first()[:2] == whole.stats.first()[:2] == (4, 11)
    assert sorted(merged.dictionary.collect()) == sorted(whole.dictionary.collect())


def test_alpha(spark):
    both = index.build(docs(spark, "α b\n #(c)#", "α c\n #(c)#"))
    got = ask(spark, both, "q1; α", "q2; b", math=True, alpha=0.18)
    assert got == [("q1", "doc1", 1, 0.013591), ("q1", "doc2", 2, 0.013591), ("q2", "doc1", 1, 0.051671)]
    assert ask(spark, both, "q; #(c)#", math=True, alpha=0.25, k=1000) == [("q", "doc1", 1, 0.004144), ("q", "doc2", 2, 0.004144)]


def test_parameters_are_checked(spark):
    made = index.build(docs(spark, "a"))
    with pytest.raises(ValueError):
        ask(spark, made, "a", k=0)
    with pytest.raises(ValueError):
        ask(spark, made, "a", alpha=1.5)


def test_empty_documents_queries_and_tables(spark):
    made = index.build(docs(spark, "a", "", None, "#!0!# a", "#!-3!# a"))
    assert made.stats.first()["n"] == 1
    assert ask(spark, made, "q; ", "r;", "s; #!0!# a", "zz") == []
    none = index.build(docs(spark, "a").where("false"))
    assert ask(spark, none, "a") == [] and none.stats.first()[:2] == (0, 0)


def test_stored_index(spark, tmp_path):
    made = index.build(docs(spark, "α b", "α c"))
    index.write(made, str(tmp_path / "i"), "math")
    again = index.load(spark, str(tmp_path / "i"), "math")
    for a, b in zip(made, again):
        assert sorted(a.collect()) == sorted(b.collect())
    with pytest.raises(ValueError):
        index.load(spark, str(tmp_path / "i"), "text")
    plan = again.postings.where("term = 'b'")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(term,b)" in plan
    asked = spark.createDataFrame([("α",), ("x",)], "term string")
    assert sorted(index.term_df(again, asked).collect()) == [("x", -1), ("α", 2)]
    assert [r.docname for r in index.docs_by_id(again, spark.createDataFrame([(1,), (7,)], "docid long")).collect()] == ["doc2"]


def test_search_without_an_index_reads_only_the_querys_terms(spark):
    d = docs(spark, "a b b", "b c", "d d d d", "")
    weights = search.query_weights(spark.createDataFrame([("q", "b c zz")], "qid string, query string"))
    terms = weights.select("term", F.col("term").alias("as")).distinct()
    once = index.build_for(d, terms, X.words(F.col("content")))
    assert {r.term for r in once.postings.collect()} == {"b", "c"}
    assert sorted(search.rank(once, weights).collect()) == sorted(search.rank(index.build(d), weights).collect())


def test_stop_and_key_words(spark):
    d = spark.createDataFrame([(1, "The cats #(x)# are matting"), (2, "the"), (3, None)], "id int, t string")
    lines = lambda *w: spark.createDataFrame([(x,) for x in w], "value string")
    stop = analyze.word_list(lines("the are", "THE"))
    assert sorted(analyze.Analyzer(math=True, stopwords=stop).lines(d, "id", "t").collect()) == [(1, "cat #(x)# mat"), (2, ""), (3, "")]
    keep = analyze.word_list(lines("cats"))
    assert sorted(analyze.Analyzer(math=True, keywords=keep).lines(d, "id", "t").collect()) == [(1, "cat #(x)#"), (2, ""), (3, "")]
    none = analyze.word_list(lines("x").where("false"))
    assert sorted(analyze.Analyzer(math=True, keywords=none).lines(d, "id", "t").collect()) == [(1, "#(x)#"), (2, ""), (3, "")]
    plain = analyze.word_list(lines("cats #(x)# #!3!#"), stem=False)
    assert {r.term for r in plain.collect()} == {"cats", "#(x)#", "3"}


def test_extract(spark):
    d = spark.createDataFrame([("a_b_1",), ("2",), ("x_2",), (None,)], "docname string")
    ids = spark.createDataFrame([("2",), ("1",), ("2",)], "v string")
    assert sorted(r.docname for r in extract.extract(d, ids, suffix=True).collect()) == ["2", "a_b_1", "x_2"]
    assert [r.docname for r in extract.extract(d, ids).collect()] == ["2"]


def test_query_names(spark):
    q = spark.createDataFrame([("q 1;x",), ("a;b;c",), ("none",), (";x",)], "line string")
    a, b = analyze.query_parts(F.col("line")), analyze.query_parts(F.col("line"), spaces=False)
    got = [tuple(r) for r in q.select(*a, *b).collect()]
    assert got == [("q 1", "x", None, "q 1;x"), ("a", "b;c", "a", "b;c"), (None, "none", None, "none"), ("", "x", "", "x")]
