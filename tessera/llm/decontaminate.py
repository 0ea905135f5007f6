"""Benchmark decontamination over a positional inverted index.

The index holds postings (term, doc, position) of the corpus.  Only terms that
a benchmark item can be found by are stored: collection frequencies of
all test terms are counted first, and every window of PHRASE item tokens
is represented by its two rarest terms, every item also by its RAREST rarest ones.

A posting at position p of a term at offset o of an item puts the item's start
at p - o.  Lists adjusted by their offsets are intersected from the rarest
terms on: starts on which two terms of one window agree are candidates, and
only for these are the lists of all the item's terms read.

* phrase: a maximal run of at least PHRASE consecutive item tokens (the whole item where that is
  shorter) appears in the document;
* proximity: at least SHARE of the item's RAREST rarest terms have adjusted
  starts within SLACK tokens of each other, which small edits, insertions and deletions do not break.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernel
from .common import fresh, staged

PHRASE, RAREST, SHARE, SLACK = 13, 8, 0.75, 10
#: Items of fewer tokens say too little for proximity, and for a document with their phrase to count as leaked.
MIN_TOKENS = 6
#: Test terms and candidate ids are sent to every task up to so many, and joined by shuffle beyond.
MAX_TERMS, BROADCAST_IDS = 2_000_000, 4_000_000


def _schema(texts: DataFrame) -> str:
    return f"doc {texts.schema['doc'].dataType.simpleString()}, pos int, term long"


@kernel.tidied
def _all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, text, offsets in kernel.chunks(batch.column(1)):
            h, _, _, rows = kernel.tokens(text, offsets)
            yield _rows(batch, first, h, rows, np.arange(len(h)))


def _rows(batch: pa.RecordBatch, first: int, h: np.ndarray, rows: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    row = np.searchsorted(rows, at, "right") - 1
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(row + first)), pa.array((at - rows[row]).astype(np.int32)), pa.array(h[at].view(np.int64))],
        names=["doc", "pos", "term"],
    )


def membership(terms: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Positions of the hashes that are among the terms: a bitmap decides most, binary search the rest."""
    terms = np.unique(terms)
    bits = max(1 << 16, 1 << (max(1, len(terms)) * 16 - 1).bit_length())
    seen = np.zeros(bits, bool)
    seen[(terms & np.uint64(bits - 1)).astype(np.int64)] = True

    def find(h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(seen[(h & np.uint64(bits - 1)).astype(np.int64)])
        if not len(at) or not len(terms):
            return at[:0]
        x = h[at]
        k = np.minimum(np.searchsorted(terms, x), len(terms) - 1)
        return at[terms[k] == x]

    return find


def _sent(docs: DataFrame, terms: DataFrame):
    """The terms as a broadcast array, or None if they are too many."""
    if terms.count() > MAX_TERMS:
        return None
    array = np.array([r[0] for r in terms.toLocalIterator()], np.int64).view(np.uint64)
    return docs.sparkSession.sparkContext.broadcast(array)


def postings(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, pos, term) of the given distinct terms in texts(doc, text)."""
    sent = _sent(texts, terms)
    if sent is None:
        return texts.mapInArrow(_all_tokens, _schema(texts)).join(terms, "term", "left_semi").select("doc", "pos", "term")

    @kernel.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = membership(sent.value)
        for batch in batches:
            for first, text, offsets in kernel.chunks(batch.column(1)):
                h, _, _, rows = kernel.tokens(text, offsets)
                yield _rows(batch, first, h, rows, find(h))

    return texts.mapInArrow(run, _schema(texts))


def frequencies(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, cf): occurrences of each of the distinct terms, zero included."""
    sent = _sent(texts, terms)
    if sent is None:
        counted = texts.mapInArrow(_all_tokens, _schema(texts)).join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    else:

        @kernel.tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = membership(sent.value)
            for batch in batches:
                for _, text, offsets in kernel.chunks(batch.column(1)):
                    h, _, _, _ = kernel.tokens(text, offsets)
                    term, n = np.unique(h[find(h)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], names=["term", "n"])

        counted = texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("cf"))
    return terms.join(counted, "term", "left").select("term", F.coalesce("cf", F.lit(0)).alias("cf"))


def matches(
    docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE, rarest: int = RAREST, share: float = SHARE, slack: int = SLACK, min_tokens: int = MIN_TOKENS
) -> DataFrame:
    """(item_id, doc_id, kind, start, item_start, n_matched, n_terms) of all phrase and proximity matches.

    start counts the document's tokens from 0.  For a phrase, n_matched of the
    item's n_terms tokens agree from item_start on; there is a row for every
    maximal run of at least `phrase` tokens, or of the whole item where that is shorter, down to one token.  A proximity row is given once for a document and item
    without phrase match, for items of at least min_tokens tokens: n_matched of the n_terms terms that are the item's `rarest`, at least `share` of them,
    lie within `slack` tokens of where they should, and start is where they
    put the item's beginning (where most terms agree; the first such place).

    Rows with a null id or text match nothing; repeated
    rows count once, and rows with one id and different texts are searched together, as if laid over each other.  Ties among
    rarest terms go to the one that comes first in the item.  Ids may be of any type.
    """
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("doc"), "text")
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").alias("doc"), "text").distinct()
    tokens = items.mapInArrow(_all_tokens, _schema(items)).select(F.col("doc").alias("item"), F.col("pos").alias("off"), "term").distinct()
    length = Window.partitionBy("item")
    tokens = staged(tokens.withColumn("len", F.max("off").over(length) + 1), "items")
    terms = tokens.select("term").distinct()
    rated = staged(tokens.join(staged(frequencies(texts, terms), "frequencies"), "term"), "rated")

    # the two rarest positions of every window, and the rarest terms of every item
    reach = F.least(F.lit(phrase), "len")
    window = rated.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("off") - reach + 1), F.least("off", F.col("len") - reach))).alias("window"))
    rank = F.row_number().over(Window.partitionBy("item", "window").orderBy("cf", "off"))
    anchors = window.withColumn("rank", rank).where("rank <= 2").select("item", "off", "term").distinct()
    once = rated.where(F.col("len") >= min_tokens).groupBy("item", "term", "cf").agg(F.min("off").alias("at"))
    few = once.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("cf", "at"))).where(F.col("rank") <= rarest)
    few = few.join(rated.select("item", "term", "off"), ["item", "term"]).select("item", "off", "term")
    probes = staged(
        anchors.withColumn("anchor", F.lit(True)).unionByName(few.withColumn("anchor", F.lit(False))).groupBy("item", "off", "term").agg(
            F.max("anchor").alias("anchor"), F.max(~F.col("anchor")).alias("rare")
        ),
        "probes",
    )
    index = staged(postings(texts, probes.select("term").distinct()), "index")
    placed = index.join(probes, "term").select("doc", "item", (F.col("pos") - F.col("off")).alias("base"), "off", "term", "anchor", "rare").distinct()

    # starts on which two anchors of a window agree, or the only one
    diagonal = Window.partitionBy("doc", "item", "base").orderBy("off")
    short = rated.select("item", reach.alias("reach")).distinct()
    agreed = (
        placed.where("anchor")
        .withColumn("gap", F.col("off") - F.lag("off").over(diagonal))
        .join(short, "item")
        .where("gap < reach OR reach = 1")
        .select("doc", "item", "base")
        .distinct()
    )
    agreed = staged(agreed, "candidates")
    ids = agreed.select("doc").distinct()
    # beyond the bound of a broadcast, postings are moved and not texts
    if ids.count() <= BROADCAST_IDS:
        full = postings(texts.join(F.broadcast(ids), "doc", "left_semi"), terms).distinct()
    else:
        full = postings(texts, terms).join(ids, "doc", "left_semi").distinct()
    on_line = (
        agreed.join(tokens, "item")
        .select("doc", "item", "base", "off", "len", "term", (F.col("base") + F.col("off")).alias("pos"))
        .join(full, ["doc", "term", "pos"])
    )
    runs = (
        on_line.withColumn("run", F.col("off") - F.row_number().over(diagonal))
        .groupBy("doc", "item", "base", "run", "len")
        .agg(F.min("off").alias("first"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= F.least(F.lit(phrase), "len"))
    )
    phrases = runs.select(
        F.col("item").alias("item_id"), F.col("doc").alias("doc_id"), F.lit("phrase").alias("kind"),
        (F.col("base") + F.col("first")).cast("int").alias("start"), F.col("first").cast("int").alias("item_start"),
        F.col("n").cast("int").alias("n_matched"), F.col("len").cast("int").alias("n_terms"),
    )
    phrases = staged(phrases, "phrases")

    near = Window.partitionBy("doc", "item").orderBy("base").rangeBetween(0, slack)
    wanted_terms = few.groupBy("item").agg(F.countDistinct("term").alias("of"))
    close = (
        placed.where("rare")
        .withColumn("n", F.size(F.collect_set("term").over(near)))
        .join(wanted_terms, "item")
        .where(F.col("n") >= F.col("of") * share)
        .groupBy("doc", "item", "of")
        .agg(F.max(F.struct(F.col("n"), (-F.col("base")).alias("back"))).alias("best"))
    )
    proximity = close.select(
        F.col("item").alias("item_id"), F.col("doc").alias("doc_id"), F.lit("proximity").alias("kind"),
        F.greatest(-F.col("best.back"), F.lit(0)).cast("int").alias("start"), F.lit(0).alias("item_start"),
        F.col("best.n").cast("int").alias("n_matched"), F.col("of").cast("int").alias("n_terms"),
    )
    return phrases.unionByName(proximity.join(phrases, ["item_id", "doc_id"], "left_anti"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, **parameters) -> DataFrame:
    """docs without those that match an item of at least min_tokens tokens, columns unchanged; rows with null doc_id or text stay."""
    name = fresh(docs, "leaked")
    # of shorter items only whole ones match, as phrases
    found = matches(docs, benchmark, min_tokens=min_tokens, **parameters).where((F.col("kind") == "proximity") | (F.col("n_terms") >= min_tokens))
    leaked = staged(found.select(F.col("doc_id").alias(name)).distinct(), "leaked")
    if leaked.count() <= BROADCAST_IDS:
        leaked = F.broadcast(leaked)
    return docs.join(leaked, docs["doc_id"] == F.col(name), "left_anti")
