"""BM25 ranked search."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, IntegralType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.shared import small, staged
from .index import Index

K1, B, QUERY_SATURATION = 1.2, 0.75, 10.0
#: Weights of queries' terms that are sent to every task, results of one task, and scores that a task makes at once, at most.
SENT_WEIGHTS, TASK_RESULTS, CELLS = 200_000, 1_000_000, 1 << 22


def query_weights(queries: DataFrame, math: bool = False, alpha: float = 0.18) -> DataFrame:
    """(qid, term, weight) from queries(qid, query), query being analysed terms with #!n!# weights.

    Weights are scaled to a mean of 1 over all the query's tokens, known or not, and saturate.
    With math, tuples count alpha and words 1 - alpha.  A query whose weights add up to 0 has no terms.
    """
    tokens = queries.select("qid", F.explode(X.weighted(F.col("query"))).alias("t")).select("qid", "t.term", "t.weight")
    return token_weights(tokens, math, alpha)


def token_weights(tokens: DataFrame, math: bool = False, alpha: float = 0.18) -> DataFrame:
    """As query_weights, from (qid, term, weight) rows, one per token."""
    terms = tokens.groupBy("qid", "term").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("qid")
    scaled = terms.withColumn("sum", F.sum("w").over(whole)).withColumn("tokens", F.sum("n").over(whole)).where("sum <> 0")
    x = F.col("w") * (F.col("tokens").cast("double") / F.col("sum"))
    weight = x / (x + QUERY_SATURATION)
    if math:
        weight = weight * F.when(X.is_tuple(F.col("term")), F.lit(alpha)).otherwise(F.lit(1 - alpha))
    return scaled.select("qid", "term", weight.alias("weight"))


def search(index: Index, queries: DataFrame, k: int = 10, math: bool = False, alpha: float = 0.18) -> DataFrame:
    """(qid, docid, rank, score): the k best documents of each query, scores to 6 places, ties by docid."""
    return rank(index, small(staged(query_weights(queries, math, alpha), "weights")), k, alpha)


def rank(index: Index, weights: DataFrame, k: int = 10, alpha: float = 0.18) -> DataFrame:
    """As search, for (qid, term, weight).

    The postings of the queries' terms are brought together by document, so a score is made where the document is, and
    each task gives the k best of its documents.  More queries than can be sent there are joined with the postings.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be from 0 to 1")
    # the small side first: idf belongs to the query's terms
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rated = (
        weights.join(index.dictionary, "term")
        .crossJoin(index.stats.select("n", (F.col("total").cast("double") / F.col("n")).alias("mean")))
        .select("qid", "term", (F.col("weight") * idf).alias("weight"), "mean")
    )
    if isinstance(index.postings.schema["docid"].dataType, IntegralType):
        sent = rated.limit(SENT_WEIGHTS + 1).toArrow()
        if sent.num_rows <= SENT_WEIGHTS and k * pc.count_distinct(sent["qid"]).as_py() <= TASK_RESULTS:
            return _by_document(index, sent, rated.schema, k)
    f, dl = F.col("tf"), F.col("dl")
    score = F.col("weight") * (f * (K1 + 1) / (f + K1 * ((1 - B) + B * dl / F.col("mean"))))
    scored = index.postings.join(rated, "term").groupBy("qid", "docid").agg(F.round(F.sum(score), 6).alias("score")).where("score > 0")
    return _numbered(scored, "qid", k).select("qid", "docid", "rank", "score")


def _numbered(scored: DataFrame, query: str, k: int) -> DataFrame:
    best = Window.partitionBy(query).orderBy(F.desc("score"), "docid")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _by_document(index: Index, rated: pa.Table, schema: StructType, k: int) -> DataFrame:
    """rank() with the rated terms (qid, term, weight, mean) sent to the postings."""
    spark, kind = index.postings.sparkSession, index.postings.schema["docid"].dataType
    terms, queries = (rated[c].combine_chunks().dictionary_encode() for c in ("term", "qid"))
    order = np.argsort(terms.indices.to_numpy(), kind="stable")
    begins = np.searchsorted(terms.indices.to_numpy()[order], np.arange(len(terms.dictionary) + 1))
    local = lambda name, values: spark.createDataFrame(pa.table({name: values, "number": pa.array(range(len(values)), pa.int32())}), StructType([schema[name], StructField("number", IntegerType())]))
    hits = index.postings.join(F.broadcast(local("term", terms.dictionary)), "term").select(
        F.col("docid").cast("long").alias("docid"), "number", F.col("tf").cast("double").alias("tf"), F.col("dl").cast("double").alias("dl")
    )
    best = _best(begins, queries.indices.to_numpy()[order], rated["weight"].to_numpy()[order], len(queries.dictionary), rated["mean"][0].as_py() if rated.num_rows else 1.0, k)
    scored = hits.repartition("docid").sortWithinPartitions("docid").mapInArrow(best, "number int, docid long, score double")
    return _numbered(scored, "number", k).join(F.broadcast(local("qid", queries.dictionary)), "number").select("qid", F.col("docid").cast(kind), "rank", "score")


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches in order of docid, the first column, cut between documents."""
    rest: list[np.ndarray] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        columns = [np.concatenate(x) for x in zip(rest, columns)] if rest else columns
        cut = int(np.searchsorted(columns[0], columns[0][-1])) if batch.num_rows else 0
        if cut:
            yield [c[:cut] for c in columns]
        rest = [c[cut:] for c in columns]
    if rest and len(rest[0]):
        yield rest


def _best(begins: np.ndarray, query: np.ndarray, weight: np.ndarray, queries: int, mean: float, k: int):
    """A function of (docid, term's number, tf, dl) in order of docid to each query's k best (query's number, docid, score).

    Term t has the queries query[begins[t]:begins[t + 1]].  A document adds at most one number for each weight, so documents are taken by so many
    that a task's memory is bounded.
    """
    step = max(1, CELLS // max(1, len(query)))
    often = np.diff(begins)

    def run(batches):
        found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        least = np.zeros(queries)  # of a query that has k documents, the last one's score; later documents with the same come after it
        for docid, term, tf, dl in _documents(batches):
            begin = np.flatnonzero(np.append(True, docid[1:] != docid[:-1]))
            for at in range(0, len(begin), step):
                part = slice(begin[at], begin[at + step] if at + step < len(begin) else len(docid))
                docs = docid[begin[at : at + step]]
                t, f = term[part], tf[part]
                with np.errstate(divide="raise", invalid="raise"):
                    gain = f * (K1 + 1) / (f + K1 * ((1 - B) + B * dl[part] / mean))
                n = often[t]
                entry = np.repeat(begins[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
                cell = np.repeat(np.searchsorted(docs, docid[part]) * queries, n) + query[entry]
                score = np.bincount(cell, np.repeat(gain, n) * weight[entry], len(docs) * queries)
                score = (np.floor(score * 1e6 + 0.5) / 1e6).reshape(len(docs), queries)
                d, q = np.nonzero(score > least)
                if len(d):
                    found = [np.concatenate(x) for x in zip(found, (q, docs[d], score[d, q]))]
                    order = np.lexsort((found[1], -found[2], found[0]))
                    found = [x[order] for x in found]
                    place = np.arange(len(order)) - np.searchsorted(found[0], found[0])
                    found = [x[place < k] for x in found]
                    full = place[place < k] == k - 1
                    least[found[0][full]] = found[2][full]
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["number", "docid", "score"])

    return run


def with_names(results: DataFrame, index: Index) -> DataFrame:
    """Results with docname."""
    return results.join(index.docs.select("docid", "docname"), "docid").select("qid", "docid", "docname", "rank", "score")
