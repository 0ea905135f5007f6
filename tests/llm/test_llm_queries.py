import compare
import pyarrow.parquet as pq
import pytest

import __spark_entry__
import corpus_pipeline
from tessera.llm import licenses, pii, queries, token_counts

SMALL = f"{compare.DATA}/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    compare.same(spark, queries.QUERIES[name], queries.ORACLES[name], SMALL)


def test_pipeline_agrees_with_sql(spark):
    compare.same(spark, corpus_pipeline.run, corpus_pipeline.ORACLE_SQL, SMALL)


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "source_mixing"]


def test_registered_scans_without_sql(spark):
    """Whole tables, against the tokenizer itself and the finders one text at a time."""
    docs = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    ranks = open(token_counts.RANKS, "rb").read()
    bpe = token_counts.encoding(ranks, token_counts.PATTERN)
    run = lambda name: queries.QUERIES[name](spark, SMALL).collect()
    assert {r.doc_id: r.n_tokens for r in run("op10_token_counts")} == {d["doc_id"]: len(bpe.encode_ordinary(d["text"] or "")) for d in docs}
    find = licenses.Finder()
    assert sorted((r.doc_id, r.start, r.end, r.notice, r.edits) for r in run("op5_license_scan")) == sorted((d["doc_id"], *x) for d in docs for x in find(d["text"] or "")) != []
    find = pii.Finder()
    assert sorted((r.doc_id, r.start, r.end, r.kind, r.score) for r in run("op9_pii")) == sorted((d["doc_id"], *x) for d in docs for x in find(d["text"] or "")) != []
