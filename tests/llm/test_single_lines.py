"""Repeated runs that may be one line long, against a plain program."""

import pytest
from test_brute_force import DOCS, line_runs, random_texts

from tessera.llm import line_dedup, queries

LONG = "one line that is long enough to be told from chance, and repeated"


@pytest.mark.parametrize("min_chars", [0, 6, line_dedup.MIN_CHARS])
def test_runs_of_one_line_and_more(spark, min_chars):
    texts = random_texts(1, 60, words=" ".join([f"{c} {c}two {c * 50}" for c in "abcdef"] + [f"w{i}" for i in range(300)]), sep="\n")
    got = line_dedup.repeated_runs(spark.createDataFrame(texts, DOCS), 1, min_chars)
    rows = sorted((r.doc_id, r.start_line, r.end_line, r.source_doc_id, r.source_line) for r in got.collect())
    assert rows == line_runs(texts, 1, min_chars) != []


def test_the_query_has_single_lines_and_whole_documents(spark, tmp_path):
    texts = [(1, f"a\n{LONG}\nb"), (2, f"c\n{LONG}\nd"), (3, LONG), (4, "short\nx"), (5, "short\ny"), (6, "w " * 60), (7, "w " * 60)]
    spark.createDataFrame(texts, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op2_single_lines"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start_line, r.end_line, r.source_doc_id, r.source_line) for r in got) == [(2, 1, 1, 1, 1), (3, 0, 0, 1, 1), (7, 0, 0, 6, 0)]
    kept = {r.doc_id: r.text for r in line_dedup.remove_runs(spark.createDataFrame(texts, DOCS), 1).collect()}
    assert kept == {d: t for d, t in texts if d not in (2, 3, 7)} | {2: "c\nd"}
