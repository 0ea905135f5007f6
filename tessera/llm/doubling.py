"""Distributed prefix doubling over the positions of many sequences.

A position's *rank* at size n stands for the n items from it on: two positions
have the same rank exactly when those items agree.  As rank serves the
earliest position that begins with the same items, which also names the first
copy.  A round sorts the pairs (rank here, rank `step` items later), gives every
group of equal pairs a new rank, and drops positions that are alone, for
nothing that begins there can repeat at any larger size.  The equal-rank groups at the
threshold are the intervals of the suffix array whose longest common prefix
reaches it.

Positions are rows (doc_id, seq, pos): seq identifies the sequence.  Rows equal in all three are one position.
Where there are very many, a position is one whole number instead, as Numbered says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged


class Named:
    """Positions as (doc_id, seq, pos)."""

    columns = ("doc_id", "seq", "pos")
    sequence = ("doc_id", "seq")
    pos = "pos"

    @staticmethod
    def here() -> Column:
        return F.struct("doc_id", "seq", "pos")


class Placed:
    """Positions as (content, pos)."""

    columns = ("content", "pos")
    sequence = ("content",)
    pos = "pos"

    @staticmethod
    def here() -> Column:
        return F.struct("content", "pos")


class Numbered:
    """Positions as one whole number `at` = sequence number * SPAN + position, in the order of the sequences."""

    SPAN = 1 << 28
    columns = ("at",)
    sequence = ("sequence",)
    pos = "at"

    @staticmethod
    def here() -> Column:
        return F.col("at")


def _with_sequence(positions: DataFrame, kind) -> DataFrame:
    return positions.withColumn("sequence", F.shiftright("at", 28)) if kind is Numbered else positions


def rerank(positions: DataFrame, key: list[str], kind=Named, hot: Column | None = None) -> DataFrame:
    """The positions that share key with another position, and `first`, the least position with that key.

    Keys for which `hot` is true, all of them by default, may belong to any number of positions: their least and
    last ones are aggregated before they are shuffled, and joined back, a join that adaptive execution splits where it is skewed.  hot has to
    follow from key.  The positions of any other key meet in one task, which saves a shuffle.
    """
    def aggregated(rows: DataFrame) -> DataFrame:
        ends = rows.groupBy(*key).agg(F.min(kind.here()).alias("__least"), F.max(kind.here()).alias("__last")).where("__least <> __last")
        # a position's first so far may be part of the key
        keyed = ends.select(*[F.col(k).alias(f"__{k}") for k in key], "__least")
        joined = rows.join(keyed, [F.col(k) == F.col(f"__{k}") for k in key])
        return joined.select(*kind.columns, F.col("__least").alias("first"))

    if hot is None:
        return aggregated(positions)
    same = Window.partitionBy(*key)
    met = (
        positions.where(~hot)
        .withColumn("least", F.min(kind.here()).over(same))
        .withColumn("last", F.max(kind.here()).over(same))
        .where("least <> last")
        .select(*kind.columns, F.col("least").alias("first"))
    )
    return met.unionByName(aggregated(positions.where(hot)))


def double(positions: DataFrame, size: int, threshold: int, kind=Named, hot: DataFrame | None = None) -> DataFrame:
    """Ranks (position, first) at `threshold` from those at `size`, both without lone positions.

    hot(hot) has the firsts at `size` that very many positions may have, if it is known that all others have fewer.
    """
    while size < threshold:
        step = min(size, threshold - size)
        ahead = Window.partitionBy(*kind.sequence).orderBy(kind.pos).rangeBetween(step, step)
        pairs = _with_sequence(positions, kind).withColumn("then", F.min("first").over(ahead)).where("then IS NOT NULL").select(*kind.columns, "first", "then")
        flag = None
        if hot is not None:
            # read in several ways where some are hot
            pairs, flag = marked(pairs if hot.isEmpty() else staged(pairs, "pairs"), "first", hot)
            hot = None
        positions = rerank(pairs, ["first", "then"], kind, flag)
        size += step
    return positions


def levels(ranks: DataFrame, threshold: int) -> list[tuple[int, DataFrame]]:
    """(size, ranks), stored, for Named positions: from ranks of single items on, doubled until nothing repeats; threshold is one of the sizes.

    Each position is there once, so joins by position do not multiply repeated rows.
    """
    out = [(1, staged(ranks.distinct(), "ranks"))]
    while True:
        size, last = out[-1]
        more = min(2 * size, threshold) if size < threshold else 2 * size
        ranks = staged(double(last, size, more), "ranks")
        if ranks.isEmpty():
            return out
        out.append((more, ranks))


def longest(ranked: list[tuple[int, DataFrame]], least: int) -> DataFrame:
    """(position, length, first): the longest prefix from a position on that begins earlier too, if it has `least` items, one of the sizes of levels().

    first is the earliest position of that prefix.  The positions with one (length, first), and first itself, are an interval of the
    suffix array with that common prefix, each subinterval of a longer one being there as its first position only.  A position
    enters at the largest size at which it is a later copy; then the sizes below are added from the largest one down, wherever that
    leaves it a later copy, which comes to the length as no size is more than twice the one below.
    """
    found = longer = None
    for size, ranks in reversed(ranked):
        if found is not None:
            found = staged(_lengthened(found, size, ranks), "lengths")
        if size >= least:
            later = ranks.where(Named.here() != F.col("first"))
            enter = later if longer is None else later.join(longer, ["seq", "pos"], "left_anti")
            enter = enter.select(*Named.columns, F.lit(size).alias("length"), "first")
            found = enter if found is None else found.unionByName(enter)
            longer = later.select("seq", "pos")
    if found is None:
        return ranked[0][1].where("false").select(*Named.columns, F.lit(0).alias("length"), "first")
    return found


def _lengthened(found: DataFrame, size: int, ranks: DataFrame) -> DataFrame:
    """found, with `size` more items where those repeat as well within the same interval; ranks are those at size."""
    sources = found.select("length", "first").distinct().select("first.doc_id", "first.seq", "first.pos", "length", "first")
    ahead = ranks.select(F.col("seq").alias("__seq"), F.col("pos").alias("__pos"), F.col("first").alias("then"))
    pairs = staged(
        found.unionByName(sources)
        .join(ahead, (F.col("seq") == F.col("__seq")) & (F.col("pos") + F.col("length") == F.col("__pos")), "left")
        .select(*Named.columns, "length", "first", "then"),
        "pairs",
    )
    key = ["length", "first", "then"]
    least = pairs.where("then IS NOT NULL").groupBy(*key).agg(F.min(Named.here()).alias("__least"), F.max(Named.here()).alias("__last")).where("__least <> __last")
    keyed = least.select(*[F.col(k).alias(f"__{k}") for k in key], "__least")
    more = F.col("__least") != Named.here()
    return (
        pairs.where(Named.here() != F.col("first"))
        .join(keyed, [F.col(k) == F.col(f"__{k}") for k in key], "left")
        .select(
            *Named.columns,
            F.when(more, F.col("length") + size).otherwise(F.col("length")).alias("length"),
            F.when(more, F.col("__least")).otherwise(F.col("first")).alias("first"),
        )
    )


def hot_keys(counted: DataFrame, least: int, most: int) -> DataFrame:
    """(hot): the hashes whose counts in counted(hash, n) come to `least`; of more than `most` of them the most frequent ones."""
    total = counted.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return total.orderBy(F.desc("n"), "hash").limit(most).select(F.col("hash").alias("hot"))


def marked(rows: DataFrame, key: str, hot: DataFrame) -> tuple[DataFrame, Column]:
    """rows, and whether their key is in hot(hot), a stored table."""
    if hot.isEmpty():
        return rows, F.lit(False)
    return rows.join(F.broadcast(hot), F.col(key) == F.col("hot"), "left"), F.col("hot").isNotNull()


def later_runs(positions: DataFrame, threshold: int, kind=Named) -> DataFrame:
    """(sequence, start, end, first): maximal stretches of items, end included, that lie within later copies.

    A stretch joins windows of `threshold` items that overlap or touch; first
    is the earliest copy of its first window.  With Numbered, start and end are numbers as well.
    """
    in_doc = Window.partitionBy(*kind.sequence).orderBy(kind.pos)
    opens = F.coalesce(F.col(kind.pos) > F.lag(kind.pos).over(in_doc) + threshold, F.lit(True))
    pos = positions.schema[kind.pos].dataType
    return (
        _with_sequence(positions.where(kind.here() != F.col("first")), kind)
        .withColumn("run", F.sum(opens.cast("int")).over(in_doc))
        .groupBy(*kind.sequence, "run")
        .agg(
            F.min(kind.pos).alias("start"),
            (F.max(kind.pos) + (threshold - 1)).cast(pos).alias("end"),
            F.min_by("first", kind.pos).alias("first"),
        )
        .drop("run")
    )
