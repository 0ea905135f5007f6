"""Removal of repeated runs of lines.

The corpus is a set of sequences of line ids.  Prefix doubling (see
``doubling``) ranks the positions at 1, 2, 4 ... lines, min_lines among them, until nothing repeats.  The ranks give the intervals of the suffix
array by their longest common prefix, and so for every position the longest stretch of lines from there on that also begins earlier,
by doc_id and then line, and where.  Such stretches that reach beyond the one of the line before are the maximal runs, each a copy of one source as a
whole.  Maximal runs with min_lines or more lines in common are reported and removed as one; copies from different places
that merely touch remain runs of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import doubling
from .common import fresh, staged

#: A run is removed if it has so many lines and characters (line ends not counted).
MIN_LINES, MIN_CHARS = 2, 40
#: Lists of runs are broadcast up to so many documents, and joined by shuffle beyond.
BROADCAST_DOCS = 1_000_000


def sequence(text: str = "text", doc_id: str = "doc_id"):
    """Tells apart documents with the same doc_id but different texts."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, seq, start_line, end_line, n_lines, n_chars, source_doc_id, source_line) of every run to remove.

    A run is a maximal stretch of lines of which any min_lines + 1 neighbouring ones occur earlier, or min_lines such lines alone.
    Lines are numbered from 0 and end_line is included; the source is the
    earliest copy of the run's first min_lines lines.  Runs of different sources may have lines in common.  Null texts have no
    lines; an empty text has one empty line.  Repeated rows of one document count once.  Null
    doc_ids are a value of their own that comes before all others.
    Where copies overlap within a document, as in one line repeated over and over, all but
    the first occurrence go.
    """
    ranked = _ranked(docs, min_lines)
    in_doc = Window.partitionBy("doc_id", "seq").orderBy("start")
    opens = F.coalesce(F.col("start") > F.lag("end").over(in_doc) - (min_lines - 1), F.lit(True))
    runs = (
        _maximal(ranked, min_lines)
        .withColumn("run", opens.cast("int"))
        .withColumn("run", F.sum("run").over(in_doc))
        .groupBy("doc_id", "seq", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    firsts = dict(ranked).get(min_lines, ranked[0][1]).select(F.col("seq").alias("s"), F.col("pos").alias("p"), "first")
    named = runs.join(firsts, (F.col("seq") == F.col("s")) & (F.col("start") == F.col("p")))
    return _measured(docs, named.select("doc_id", "seq", "start", "end", "first"), min_chars)


def maximal_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """As repeated_runs, but a run occurs as a whole at its source, the earliest such place, and is part of no longer one.

    Runs that have lines in common stay apart, and each has min_chars by itself.
    """
    return _measured(docs, _maximal(_ranked(docs, min_lines), min_lines), min_chars)


def _ranked(docs: DataFrame, min_lines: int) -> list[tuple[int, DataFrame]]:
    """The ranks of all lines by size, see doubling.levels."""
    lines = docs.select(
        "doc_id", sequence().alias("seq"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    ).select("doc_id", "seq", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"))
    return doubling.levels(doubling.rerank(lines, ["a", "b"]), min_lines)


def _maximal(ranked: list[tuple[int, DataFrame]], min_lines: int) -> DataFrame:
    """(doc_id, seq, start, end, first) of the maximal runs."""
    in_doc = Window.partitionBy("doc_id", "seq").orderBy("start")
    return (
        doubling.longest(ranked, min_lines)
        .select("doc_id", "seq", F.col("pos").alias("start"), (F.col("pos") + F.col("length") - 1).alias("end"), "first")
        .withColumn("before", F.lag("end").over(in_doc))
        .where("before IS NULL OR before < end")
        .drop("before")
    )


def _measured(docs: DataFrame, runs: DataFrame, min_chars: int) -> DataFrame:
    """runs(doc_id, seq, start, end, first) that have min_chars, with lengths, as repeated_runs gives them."""
    lengths = (
        docs.select("doc_id", sequence().alias("seq"), F.transform(F.split("text", "\n"), F.length).alias("sizes"))
        .where("sizes IS NOT NULL")
        .dropDuplicates(["doc_id", "seq"])
    )
    same = runs["doc_id"].eqNullSafe(lengths["doc_id"]) & (runs["seq"] == lengths["seq"])
    n_lines = F.col("end") - F.col("start") + 1
    n_chars = F.aggregate(F.slice("sizes", F.col("start") + 1, n_lines), F.lit(0), lambda s, x: s + x)
    return (
        runs.join(lengths, same)
        .select(
            runs["doc_id"],
            runs["seq"],
            F.col("start").alias("start_line"),
            F.col("end").alias("end_line"),
            n_lines.alias("n_lines"),
            n_chars.alias("n_chars"),
            F.col("first.doc_id").alias("source_doc_id"),
            F.col("first.pos").alias("source_line"),
        )
        .where(F.col("n_chars") >= min_chars)
    )


def remove_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs without the lines of repeated runs; a document of which nothing but white space is left goes too.

    Columns stay as they are, n_chars, if there, follows the new text.  Rows
    without removed lines, null and empty texts among them, are returned unchanged.
    """
    runs = repeated_runs(docs, min_lines, min_chars)
    key, gone = fresh(docs, "seq"), fresh(docs, "gone")
    per_doc = staged(
        runs.groupBy(F.col("doc_id"), F.col("seq").alias(key)).agg(F.collect_list(F.struct("start_line", "end_line")).alias(gone)),
        "line-runs",
    ).withColumnRenamed("doc_id", fresh(docs, "of"))
    of = per_doc.columns[0]
    if per_doc.count() <= BROADCAST_DOCS:
        per_doc = F.broadcast(per_doc)
    same = (sequence() == F.col(key)) & docs["doc_id"].eqNullSafe(F.col(of))
    inside = lambda i: F.exists(F.col(gone), lambda g: (i >= g["start_line"]) & (i <= g["end_line"]))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~inside(i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)
    out = docs.join(per_doc, same, "left").withColumn("text", text).where(F.col(gone).isNull() | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
