"""Incremental indexing: every micro-batch of documents becomes one segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index as ix


def write_segments(stream: DataFrame, folder: str, docid: str = "docid", docname: str = "docname", content: str = "content") -> StreamingQuery:
    """Starts a query that writes each batch of analysed documents as an index under folder/segments/batch=<id>.

    A batch that is run again after a failure replaces its own segment, so every document is indexed exactly once.
    """

    def one(batch: DataFrame, number: int) -> None:
        ix.write(ix.build(batch, docid, docname, content), f"{folder}/segments/batch={number}", mode="overwrite")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def load_segments(spark: SparkSession, folder: str) -> ix.Index:
    """One index over all segments; docids are those of the documents."""
    docs, postings = (spark.read.parquet(f"{folder}/segments/*/{t}") for t in ("docs", "postings"))
    return ix.index_of(docs, postings)


def document_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of documents as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, n, total) of the segments."""
    return spark.read.option("basePath", f"{folder}/segments").parquet(f"{folder}/segments/*/stats").select("batch", "n", F.col("total"))
