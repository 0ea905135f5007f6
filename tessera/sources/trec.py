"""Documents in TREC markup: <DOC> <DOCNO>name</DOCNO> [<DOCHDR>...</DOCHDR>] content </DOC>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shared import once
from ..operators.numbering import dense_ids

END = "</DOC>"


def _in_order(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    """(value, file, block, serial, file_size): records of text files; (file, block, serial) is their order."""
    raw = spark.read.option("lineSep", separator).text(paths)
    meta = F.col("_metadata")
    return raw.select(
        "value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("serial"), meta["file_size"].alias("file_size")
    )


def parse(record: Column) -> dict[str, Column]:
    """docname, header and content of a text from <DOC> to before </DOC>.

    The name is what stands between the DOCNO tags, untrimmed; header is the first line of DOCHDR, null without one; content
    begins after </DOCHDR>, or after </DOCNO> without one.  NUL is a space.  Without a name a record is an error.
    """
    text = F.translate(record, "\x00", " ")
    rest = F.regexp_extract(text, r"(?s)<DOCNO>.*?</DOCNO>(.*)\z", 1)
    name = F.regexp_extract(text, r"(?s)<DOCNO>(.*?)</DOCNO>", 1)
    has_header = rest.rlike(r"(?s)<DOCHDR>.*</DOCHDR>")
    return {
        "docname": F.when(name != "", name).otherwise(F.raise_error(F.concat(F.lit("document without DOCNO: "), F.substring(text, 1, 80)))),
        "header": F.when(has_header, F.regexp_extract(rest, r"<DOCHDR>\r?\n?([^\r\n]*)", 1)),
        "content": F.when(has_header, F.regexp_extract(rest, r"(?s)</DOCHDR>(.*)\z", 1)).otherwise(rest),
    }


def read_trec(spark: SparkSession, paths: str | list[str], own_line: bool = False) -> DataFrame:
    """(docid, docname, header, content) of the files' documents; docids are dense, by file name and place.

    With own_line, only a line that is </DOC> ends a document.  Text between documents is skipped; a last document that does
    not end is dropped.  Files are split at document ends, so one large file is read by many tasks.
    """
    separator = f"\n{END}\n" if own_line else END
    records = _in_order(spark, paths, separator)
    # whether a file ends in the separator follows from the bytes between separators
    sizes = records.groupBy("file").agg(
        (F.sum(F.octet_length("value")) + F.count(F.lit(1)) * len(separator) - F.max("file_size")).alias("over"), F.max(F.struct("block", "serial")).alias("last")
    )
    open_ends = sizes.where("over > 0").select("file", F.col("last.block").alias("block"), F.col("last.serial").alias("serial"))
    closed = records.where(F.instr("value", "<DOC>") > 0).join(open_ends, ["file", "block", "serial"], "left_anti")
    # places are numbered, not texts: these are moved once, to their numbers
    place = ["file", "block", "serial"]
    body = F.regexp_extract("value", r"(?s)<DOC>(.*)\z", 1)
    numbered = closed.join(dense_ids(closed.select(*place), place), place).select("docid", "value")
    return once(numbered, {"body": body}).select("docid", *[c.alias(n) for n, c in parse(F.col("body")).items()])


def to_trec(docname: Column, content: Column, header: Column | None = None) -> Column:
    """One document in TREC markup, without the last line end."""
    head = F.lit("") if header is None else F.coalesce(F.concat(F.lit("<DOCHDR>\n"), header, F.lit("\n</DOCHDR>\n")), F.lit(""))
    return F.concat(F.lit("<DOC>\n<DOCNO>"), docname, F.lit("</DOCNO>\n"), head, content, F.lit(f"\n{END}"))


def write_trec(docs: DataFrame, path: str, docname: str = "docname", content: str = "content") -> None:
    """Files of documents in TREC markup, in the rows' order."""
    docs.select(to_trec(F.col(docname).cast("string"), F.coalesce(F.col(content), F.lit("")))).write.text(path)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, serial, value): every line on its own, and the columns it is ordered by."""
    return _in_order(spark, paths, "\n").select("file", "block", "serial", "value")


def read_whole(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, content): each file as one document."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def read_queries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(qline, line) of query files, up to each file's first empty line.  A file of queries is read by one task."""
    files = read_whole(spark, paths)
    lines = files.select("file", F.posexplode(F.split(F.regexp_replace("content", r"\n\z", ""), "\n")).alias("qline", "line"))
    seen = Window.partitionBy("file").orderBy("qline").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("ended", F.max(F.col("line") == "").over(seen)).where("NOT ended").select("qline", "line")


TOPIC = r'(?s).*Query topic="([^"]*)"'


def topics(lines: DataFrame, partition: str, order: str, line: str, clean) -> DataFrame:
    """(partition, qid, query): a line with `Query topic="X"` (its last) opens query X, the others are cleaned and joined by a space.

    Lines before the first topic are left out.
    """
    is_topic = F.col(line).rlike('Query topic="')
    by_file = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("__n", F.sum(is_topic.cast("int")).over(by_file)).where("__n > 0")
    text = F.sort_array(F.collect_list(F.when(~is_topic, F.struct(F.col(order).alias("at"), clean(F.col(line)).alias("text")))))
    return numbered.groupBy(partition, "__n").agg(
        F.max(F.when(is_topic, F.regexp_extract(line, TOPIC, 1))).alias("qid"), F.array_join(F.transform(text, lambda x: x["text"]), " ").alias("query")
    ).drop("__n")


def read_topics(spark: SparkSession, paths: str | list[str], clean) -> DataFrame:
    """(qid, query) of topic files; clean is applied to each line's text.  A file of topics is read by one task."""
    files = read_whole(spark, paths)
    lines = files.select("file", F.posexplode(F.split(F.regexp_replace("content", r"\n\z", ""), "\n")).alias("pos", "line"))
    return topics(lines, "file", "pos", "line", clean).select("qid", "query")
