"""From raw documents to a training mix: each stage is one operator over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.shared import remove, shared_path, spread, temporary
from tessera.llm import decontaminate, jaccard, line_dedup, mixing, quality
from tessera.llm.queries import ORACLES, mixing_sql


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the newest policy keeps."""
    return quality.keep_good(docs)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs deleted; documents of which nothing is left go."""
    return line_dedup.remove_runs(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least doc_id, of every group of similar ones."""
    return jaccard.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without phrase or proximity match of a benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as drawn, with their place in the training order."""
    return mixing.mix_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_runs),
    ("near_duplicates", near_copies),
    ("decontamination", benchmark_leaks),
    ("source_mixing", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again; what a stage no longer needs is deleted."""
    docs, before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for name, stage in STAGES:
        path = shared_path(spark, name)
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs


def _over(query: str, relation: str) -> str:
    return ORACLES[query].replace("FROM documents", f"FROM {relation}")


_COLUMNS = "doc_id, text, lang, source, n_chars"
ORACLE_SQL: str | None = f"""
WITH q AS MATERIALIZED ({_over("op8_quality_rules", "documents")}),
s1 AS MATERIALIZED (SELECT {_COLUMNS} FROM documents WHERE doc_id IN (SELECT doc_id FROM q WHERE keep_v2)),
runs AS MATERIALIZED ({_over("op2_line_dedup", "s1")}),
cut AS MATERIALIZED (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text
  FROM (
    SELECT l.doc_id, line, pos, EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = l.doc_id AND l.pos BETWEEN start_line AND end_line) AS gone
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
      FROM s1 WHERE doc_id IN (SELECT doc_id FROM runs)) l)
  GROUP BY doc_id),
s2 AS MATERIALIZED (
  SELECT {_COLUMNS} FROM s1 WHERE doc_id NOT IN (SELECT doc_id FROM cut)
  UNION ALL
  SELECT doc_id, cut.text, lang, source, length(cut.text) AS n_chars FROM s1 JOIN cut USING (doc_id)
  WHERE trim(translate(coalesce(cut.text, ''), chr(10) || chr(9) || chr(13), '   ')) <> ''),
near AS MATERIALIZED ({_over("op7_ngram_jaccard", "s2")}),
s3 AS MATERIALIZED (SELECT {_COLUMNS} FROM s2 WHERE doc_id NOT IN (SELECT doc_id FROM near WHERE doc_id <> class_id)),
leaks AS MATERIALIZED ({_over("op4_decontamination", "s3")}),
s4 AS MATERIALIZED (SELECT {_COLUMNS} FROM s3 WHERE doc_id NOT IN (SELECT doc_id FROM leaks)),
mix AS MATERIALIZED ({mixing_sql("SELECT doc_id, source, text FROM s4")})
SELECT s4.*, epoch AS mix_epoch, block AS mix_block, place AS mix_place FROM s4 JOIN mix USING (doc_id)"""
