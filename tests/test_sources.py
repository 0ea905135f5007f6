import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.sources import results, trec
from tessera.streaming import ingest


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_trec(spark, tmp_path):
    a = write(tmp_path, "a", "<DOC>\n<DOCNO> one </DOCNO>\n<DOCHDR>\nhttp://x\nmore\n</DOCHDR>\nfirst\n</DOC>\n<junk><DOC><DOCNO>two</DOCNO>in line</DOC>\n")
    b = write(tmp_path, "b", "<DOC>\n<DOCNO>three</DOCNO>\nz\x00z</DOC>")
    c = write(tmp_path, "c", "<DOC>\n<DOCNO>four</DOCNO>\n</DOC>\n<DOC>\n<DOCNO>lost</DOCNO>\nno end")
    got = [tuple(r) for r in trec.read_trec(spark, [a, b, c]).orderBy("docid").collect()]
    assert got == [(0, " one ", "http://x", "\nfirst\n"), (1, "two", None, "in line"), (2, "three", None, "\nz z"), (3, "four", None, "\n")]


def test_trec_end_on_its_own_line(spark, tmp_path):
    p = write(tmp_path, "a", "<DOC>\n<DOCNO>1</DOCNO>\nsays </DOC> here\n</DOC>\n<DOC>\n<DOCNO>2</DOCNO>\nx\n</DOC>\n")
    assert [(r.docname, r.content) for r in trec.read_trec(spark, p, own_line=True).orderBy("docid").collect()] == [("1", "\nsays </DOC> here"), ("2", "\nx")]


def test_trec_without_name(spark, tmp_path):
    p = write(tmp_path, "a", "<DOC>\nx\n</DOC>\n")
    with pytest.raises(Exception, match="without DOCNO"):
        trec.read_trec(spark, p).collect()


def test_one_large_file_is_read_in_parts(spark, tmp_path):
    p = write(tmp_path, "a", "".join(f"<DOC>\n<DOCNO>{i}</DOCNO>\n{'x' * (i % 97)}\n</DOC>\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = trec.read_trec(spark, p).orderBy("docid").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.docid, r.docname, len(r.content)) for r in got] == [(i, str(i), i % 97 + 2) for i in range(3000)]


def test_written_and_read(spark, tmp_path):
    d = spark.createDataFrame([("a", "x\ny"), ("b", ""), ("c", None)], "docname string, content string").coalesce(1)
    trec.write_trec(d, str(tmp_path / "out"))
    assert [(r.docname, r.content) for r in trec.read_trec(spark, str(tmp_path / "out")).orderBy("docid").collect()] == [("a", "\nx\ny\n"), ("b", "\n\n"), ("c", "\n\n")]


def test_queries_end_at_an_empty_line(spark, tmp_path):
    p = write(tmp_path, "q", "a;b\nc\n\nd\n")
    assert [tuple(r) for r in trec.read_queries(spark, p).orderBy("qline").collect()] == [(0, "a;b"), (1, "c")]


def test_topics(spark, tmp_path):
    p = write(tmp_path, "t", 'skip\n<x Query topic="A.1">\n<b>one</b> two\nthree\nQuery topic="z" Query topic="A.2"\n')
    assert sorted(tuple(r) for r in trec.read_topics(spark, p, X.strip_markup).collect()) == [("A.1", " one two three"), ("A.2", "")]


def test_lines_and_whole_files(spark, tmp_path):
    p = write(tmp_path, "l", "b\nα\n")
    assert [r.value for r in trec.read_lines(spark, p).orderBy("file", "block", "serial").collect()] == ["b", "α"]
    assert [r.content for r in trec.read_whole(spark, p).collect()] == ["b\nα\n"]


def test_six_digits(spark):
    numbers = [0.0261529, 1.0, 123456.7, 0.000012, 10.5, 2.7667451, 0.0, 1234567.0, 0.00414367]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    assert [r[1] for r in sorted(df.select("i", results.six_digits(F.col("x"))).collect())] == [f"{x:g}" for x in numbers]


def test_result_files(spark, tmp_path):
    r = spark.createDataFrame([("q", "d2", 2, 0.5), ("q", "d1", 1, 1.25)], "qid string, docname string, rank int, score double")
    results.write_lines(r, str(tmp_path / "a"))
    results.write_lines(r, str(tmp_path / "b"), "mine")
    assert [x.value for x in spark.read.text(str(tmp_path / "a")).collect()] == ["q\td1\t1\t1.25", "q\td2\t2\t0.5"]
    assert [x.value for x in spark.read.text(str(tmp_path / "b")).collect()] == ["q Q0 d1 1 1.25 mine", "q Q0 d2 2 0.5 mine"]


def test_stream_of_documents(spark, tmp_path):
    d = spark.createDataFrame([(i, f"d{i}", f"a w{i % 3}") for i in range(20)], "docid long, docname string, content string")
    d.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = ingest.document_stream(spark, str(tmp_path / "in"), d.schema, files_per_batch=1)
    ingest.write_segments(stream, str(tmp_path / "out")).awaitTermination()
    assert ingest.batches(spark, str(tmp_path / "out")).count() == 4
    made = ingest.load_segments(spark, str(tmp_path / "out"))
    assert {(r.term, r.df) for r in made.dictionary.collect()} == {("a", 20), ("w0", 7), ("w1", 7), ("w2", 6)}
