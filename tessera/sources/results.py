"""Search results as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def six_digits(x: Column) -> Column:
    """A number with six significant digits and no zeros at the end; with an exponent below -4 and from 6 on.

    A half is rounded away from zero, by the number's shortest decimal form.
    """
    power = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(x)))).cast("int")
    exact = x.cast("decimal(38,12)")
    short = lambda v: F.regexp_replace(F.regexp_replace(v.cast("string"), r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")
    plain = F.coalesce(*[F.when(power == p, short(F.round(exact, 5 - p))) for p in range(-4, 6)])
    tail = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.coalesce(plain, F.concat(short(F.round((x / F.pow(F.lit(10.0), power)).cast("decimal(38,12)"), 5)), tail))


def result_line(qid: Column, docname: Column, rank: Column, score: Column) -> Column:
    """[qid TAB] docname TAB rank TAB score; no qid where it is null.  Names are whole: nothing is cut off at 1023 bytes."""
    return F.concat_ws("\t", qid.cast("string"), docname.cast("string"), rank.cast("string"), six_digits(score))


def run_line(qid: Column, docname: Column, rank: Column, score: Column, tag: str) -> Column:
    """qid Q0 docname rank score tag."""
    return F.concat_ws(" ", qid.cast("string"), F.lit("Q0"), docname.cast("string"), rank.cast("string"), six_digits(score), F.lit(tag))


def write_lines(results: DataFrame, path: str, tag: str | None = None) -> None:
    """Results (qid, docname, rank, score) in order of qid and rank, as result lines, or with a tag as run lines."""
    q = [F.col(c) for c in ("qid", "docname", "rank", "score")]
    line = result_line(*q) if tag is None else run_line(*q, tag)
    results.orderBy("qid", "rank").select(line.alias("value")).write.text(path)
