"""Mixing sources to target weights.

Source i has the share p_i of the corpus's tokens.  Temperature mixing gives it
the weight w_i = p_i^x / sum p_j^x.  x = 1 keeps the natural shares, x = 0 makes all
sources equal.  x is bisected so that the weights' entropy is
TARGET_ENTROPY of the largest possible one, and raised where a source would
otherwise be repeated more than MAX_REPEATS times.

The weights become budgets of tokens, and the budgets a sequence of blocks.  Every
source is passed through in seeded permutations, one per epoch, until its budget
is used; a document's block is where its first token falls when the source's
budget is spread evenly over the blocks.  So every block of about
BLOCK_TOKENS tokens has the target mix, and within it the order is again a permutation.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, staged

TARGET_ENTROPY, MAX_REPEATS = 0.98, 4.0
BLOCK_TOKENS = 1_000_000
SEED = 20240229
STEPS = 60
#: Documents a source has per part of a running sum.
PART_DOCS = 50_000
#: Sources with weights are broadcast up to so many, and joined by shuffle beyond.
BROADCAST_SOURCES = 1_000_000


def exponent(tokens: np.ndarray, target_entropy: float, max_repeats: float, budget: float) -> float:
    """The exponent, rounded to 6 places; see the module's text.

    Entropy falls and the largest repetition w_i * budget / tokens_i falls with
    growing x.  Where even x = 1 repeats too much (a budget above max_repeats
    corpora) x is 1.  Shares are summed in rising order, for the same bits everywhere.
    """
    t = np.sort(tokens.astype(float))
    p = t / t.sum()

    def weights(x: float) -> np.ndarray:
        w = p**x
        return w / w.sum()

    def too_flat(x: float) -> bool:
        w = weights(x)
        return float(-(w * np.log(w)).sum()) > target_entropy * math.log(len(w)) + 1e-12 or float((w * budget / t).max()) > max_repeats

    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if too_flat(mid) else (low, mid)
    return round(high, 6)


def weigh(sources: DataFrame, target_entropy: float, max_repeats: float, budget_tokens: int | None) -> DataFrame:
    """(source, docs, tokens, exponent, weight, budget) from (source, docs, tokens); sources without tokens have none.

    One task sees one number per source: the exponent depends on all of them.
    """

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x[x["tokens"] > 0]
        if not len(x):
            return pd.DataFrame({"k": [], "exponent": [], "norm": [], "total": [], "all": []})
        everything = int(x["tokens"].sum())
        total = everything if budget_tokens is None else budget_tokens
        e = exponent(x["tokens"].to_numpy(), target_entropy, max_repeats, total)
        norm = float(np.sort((x["tokens"].to_numpy() / everything) ** e).sum())
        return pd.DataFrame({"k": [0], "exponent": [e], "norm": [norm], "total": [total], "all": [everything]})

    one = sources.select(F.lit(0).alias("k"), "tokens").groupBy("k").applyInPandas(run, "k int, exponent double, norm double, total long, all long")
    weight = F.pow(F.col("tokens") / F.col("all"), F.col("exponent")) / F.col("norm")
    return (
        sources.where("tokens > 0")
        .crossJoin(F.broadcast(one))
        .select("source", "docs", "tokens", "exponent", F.round(weight, 9).alias("weight"), "total")
        .withColumn("budget", F.floor(F.col("weight") * F.col("total")).cast("long"))
        .drop("total")
    )


def n_tokens(text: str = "text"):
    """Tokens of a text: its maximal runs of anything but white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def digest(*parts):
    """32 bits of an MD5 digest of the parts, nulls left out."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _drawn(docs: DataFrame, tokens, target_entropy: float, max_repeats: float, budget_tokens: int | None, block_tokens: int, seed: int) -> DataFrame:
    """mix() with `mark`, which stands for the text, `copies`, the rows equal to this one in doc_id, source and text, and `occurrence`, which of them it is."""
    counted = F.explode(F.array((n_tokens() if tokens is None else F.coalesce(tokens, F.lit(0))).cast("long"))).alias("n_tokens")
    rows = docs.select("doc_id", "source", F.md5("text").alias("mark"), counted).where("n_tokens > 0")
    narrow = staged(rows.groupBy("doc_id", "source", "mark", "n_tokens").agg(F.count(F.lit(1)).alias("copies")), "lengths")
    sources = narrow.groupBy("source").agg(F.sum("copies").alias("docs"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    weights = staged(weigh(sources, target_entropy, max_repeats, budget_tokens), "weights")
    total = weights.agg(F.sum("budget")).first()[0] or 0
    blocks = max(1, math.ceil(total / block_tokens))
    if weights.count() <= BROADCAST_SOURCES:
        weights = F.broadcast(weights)

    # one row for each document and epoch; positions in the permutation by a seeded hash
    this = (F.coalesce(F.col("doc_id").cast("string"), "mark"), F.col("occurrence"))
    parts = F.ceil(F.col("docs") / PART_DOCS)
    epochs = F.sequence(F.lit(0), F.floor((F.col("budget") - 1) / F.col("tokens")).cast("int"))
    drawn = (
        narrow.join(weights.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .where("budget > 0")
        .select("doc_id", "source", "mark", "copies", "n_tokens", "tokens", "weight", "budget", "docs", epochs.alias("epochs"), F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("occurrence"))
        .withColumn("epoch", F.explode("epochs"))
        .drop("epochs")
        .withColumn("order", digest(F.lit(seed), F.col("epoch"), *this))
        .withColumn("part", F.floor(F.col("order") * parts / 2**32).cast("long"))
    )
    # running sums in two steps, so that no task holds a whole source
    sums = drawn.groupBy("source", "epoch", "part").agg(F.sum("n_tokens").alias("sum"))
    before = Window.partitionBy("source", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = staged(sums.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("part").alias("p"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("ahead")), "parts")
    within = Window.partitionBy("source", "epoch", "part").orderBy("order", "doc_id", "n_tokens", "mark", "occurrence").rowsBetween(Window.unboundedPreceding, -1)
    if sums.count() <= BROADCAST_SOURCES:
        sums = F.broadcast(sums)
    first = F.col("epoch") * F.col("tokens") + F.col("ahead") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("part") == F.col("p"))
    return (
        drawn.join(sums, same)
        .withColumn("first", first)
        .where("first < budget")
        .withColumn("block", F.floor(F.col("first").cast("double") * blocks / F.col("budget")).cast("long"))
        .withColumn("place", digest(F.lit(seed + 1), F.col("block"), F.col("epoch"), *this))
    )


def mix(
    docs: DataFrame,
    target_entropy: float = TARGET_ENTROPY,
    max_repeats: float = MAX_REPEATS,
    budget_tokens: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
    tokens: Column | None = None,
) -> DataFrame:
    """(doc_id, source, n_tokens, weight, epoch, block, place) of every document drawn into the mix.

    Sorting by (block, place) gives the training order.  budget_tokens is by
    default the number of tokens of the corpus.  tokens gives a document's tokens, such as a column of counts by a tokenizer; by default they are runs
    of anything but white space, which says little of languages written without it.  A document is drawn into an
    epoch if its first token lies within the source's budget.  A null source is a source of
    its own; documents without tokens, null texts among them, are never drawn; rows with null doc_id
    are drawn like others, in the order of their texts' digests.  Repeated rows are separate documents.  Orders with equal hashes go
    by doc_id.
    """
    return _drawn(docs, tokens, target_entropy, max_repeats, budget_tokens, block_tokens, seed).select("doc_id", "source", "n_tokens", "weight", "epoch", "block", "place")


def mix_documents(
    docs: DataFrame,
    target_entropy: float = TARGET_ENTROPY,
    max_repeats: float = MAX_REPEATS,
    budget_tokens: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
    tokens: Column | None = None,
) -> DataFrame:
    """The documents drawn, each as often as drawn, with the columns of docs and mix_epoch, mix_block and mix_place.

    Existing columns of these names keep theirs; the new ones then end in an underscore.  Every row of mix() is one row here.  Rows that
    agree in doc_id, source and text are numbered as they come, and each is drawn as its number is.
    """
    names = {c: fresh(docs, f"mix_{c}") for c in ("epoch", "block", "place")}
    doc, mark, source, copies, nth, entries, mine = (fresh(docs, f"drawn_{c}") for c in ("doc", "mark", "source", "copies", "occurrence", "entries", "number"))
    drawn = _drawn(docs, tokens, target_entropy, max_repeats, budget_tokens, block_tokens, seed)
    keys = {"doc_id": doc, "source": source, "mark": mark, "occurrence": nth}
    drawn = drawn.groupBy(*[F.col(c).alias(n) for c, n in keys.items()]).agg(F.first("copies").alias(copies), F.collect_list(F.struct(*[F.col(c).alias(n) for c, n in names.items()])).alias(entries))
    drawn = staged(drawn, "drawn")
    if drawn.count() <= BROADCAST_SOURCES:
        drawn = F.broadcast(drawn)
    same = docs["doc_id"].eqNullSafe(F.col(doc)) & docs["source"].eqNullSafe(F.col(source)) & (F.md5(docs["text"]) == F.col(mark))
    own = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.join(drawn.where(F.col(copies) == 1), same).select(*own, F.inline(entries))
    several = drawn.where(F.col(copies) > 1)
    if several.isEmpty():
        return out
    # only repeated rows are moved to be numbered
    repeated = docs.join(F.broadcast(several) if drawn.count() <= BROADCAST_SOURCES else several, same, "left_semi")
    number = F.row_number().over(Window.partitionBy("doc_id", "source", F.md5("text")).orderBy(F.lit(0))) - 1
    repeated = repeated.withColumn(mine, number)
    same = repeated["doc_id"].eqNullSafe(F.col(doc)) & repeated["source"].eqNullSafe(F.col(source)) & (F.md5(repeated["text"]) == F.col(mark)) & (F.col(mine) == F.col(nth))
    return out.unionByName(repeated.join(several, same).select(*own, F.inline(entries)))

