"""Compact forms of postings and sorted strings, as relations.

Parquet packs pages in much the same way by itself; these are for
looking at sizes, and for exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shared import staged
from .numbering import dense_ids


def vbyte_size(value: Column) -> Column:
    """Bytes of a whole number >= 0 in groups of seven bits."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("int")


def vbyte(value: Column) -> Column:
    """The number as hexadecimal bytes, high groups first, with the top bit set on all but the last."""
    n = vbyte_size(value)
    value = value.cast("long")
    digit = lambda i: F.call_function("shiftrightunsigned", value, ((n - 1 - i) * 7).cast("int")).bitwiseAND(F.lit(127))
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(digit(i) + F.when(i < n - 1, 128).otherwise(0)), 2, "0")), "")


def from_vbyte(code: Column) -> Column:
    """The number of hexadecimal bytes as vbyte() makes them."""
    n = (F.length(code) / 2).cast("int")
    byte = lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda v, i: v * 128 + byte(i).bitwiseAND(F.lit(127)))


def pair(a: Column, b: Column) -> Column:
    """Two numbers in one byte of two halves; a half of 15 stands for a vbyte of the rest after it, first a's."""
    half = lambda x: F.hex(F.least(x, F.lit(15)))
    rest = lambda x: F.when(x >= 15, vbyte(x - 15)).otherwise("")
    return F.concat(half(a), half(b), rest(a), rest(b))


#: Documents in a block of a term's list, and entries in a block of gaps.
LIST_BLOCK = 1 << 20


def _before(blocks: DataFrame, value: Column, name: str) -> DataFrame:
    """blocks(term, block, ...) and, as `name`, the value over a term's earlier blocks; a term has one row per block here."""
    earlier = Window.partitionBy("term").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn(name, F.coalesce(value.over(earlier), F.lit(0)))


def gaps(postings: DataFrame, block: int = LIST_BLOCK) -> DataFrame:
    """(term, at, tf, gap): gap is the docid less the term's one before, the docid itself for the first; at counts a term's list from 1.

    A list is worked on in blocks of docids, so that no task holds the list of a word that is everywhere: each block
    goes on from the last docid and the number of entries of the blocks before.  Postings are stored, for they are read for
    the blocks and again for the lists.
    """
    placed = staged(postings.select("term", "docid", "tf"), "postings").withColumn("block", F.floor(F.col("docid") / block))
    blocks = placed.groupBy("term", "block").agg(F.max("docid").alias("last"), F.count(F.lit(1)).alias("n"))
    blocks = _before(_before(blocks, F.max("last"), "base"), F.sum("n"), "ahead").select("term", "block", "base", "ahead")
    within = Window.partitionBy("term", "block").orderBy("docid")
    rows = placed.withColumns({"row": F.row_number().over(within), "before": F.lag("docid").over(within)}).join(blocks, ["term", "block"])
    return rows.select("term", (F.col("row") + F.col("ahead")).alias("at"), "tf", (F.col("docid") - F.coalesce("before", "base")).alias("gap"))


def from_gaps(delta: DataFrame, block: int = LIST_BLOCK) -> DataFrame:
    """(term, docid, tf) from gaps, in blocks of entries; the gaps are stored."""
    placed = staged(delta.select("term", "at", "gap", "tf"), "gaps").withColumn("block", F.floor(F.col("at") / block))
    blocks = _before(placed.groupBy("term", "block").agg(F.sum("gap").alias("sum")), F.sum("sum"), "base").select("term", "block", "base")
    running = Window.partitionBy("term", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("sum", F.sum("gap").over(running)).join(blocks, ["term", "block"])
    return rows.select("term", (F.col("base") + F.col("sum")).alias("docid"), "tf")


def packed(postings: DataFrame, block: int = LIST_BLOCK) -> DataFrame:
    """(term, block, df, postings): each term's list as 'docid:tf docid:tf ...', a row for each block of docids it is in; df counts the row's entries."""
    entry = F.struct("docid", "tf")
    text = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.concat_ws(":", x["docid"], x["tf"]))
    by_block = postings.groupBy("term", F.floor(F.col("docid") / block).alias("block"))
    return by_block.agg(F.count(F.lit(1)).alias("df"), F.array_join(text, " ").alias("postings"))


def front_coded(terms: DataFrame, group: int = 16, ranges: int | None = None) -> DataFrame:
    """(ordinal, term, shared, rest) of distinct terms(term) in byte order.

    The first of every `group` terms is whole, the others share `shared` characters with the one
    before.  Ordinals count from 0.
    """
    numbered = dense_ids(terms.select("term"), ["term"], "ordinal", ranges)
    in_group = Window.partitionBy(F.floor(F.col("ordinal") / group)).orderBy("ordinal")
    previous = F.lag("term").over(in_group)
    shared = F.when(F.col("previous").isNull(), F.lit(0)).otherwise(common_prefix(F.col("previous"), F.col("term")))
    return numbered.withColumn("previous", previous).select("ordinal", "term", shared.alias("shared")).withColumn("rest", F.expr("substring(term, shared + 1)"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, in characters."""
    n = F.least(F.length(a), F.length(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.coalesce(F.get(differs, 0) - 1, n).cast("int")


def from_front_coded(coded: DataFrame, group: int = 16) -> DataFrame:
    """(ordinal, term) from (ordinal, shared, rest): the groups' terms are rebuilt one after another."""
    entry = F.struct("ordinal", "shared", "rest")
    rebuilt = F.aggregate(
        F.array_sort(F.collect_list(entry)),
        F.array().cast("array<struct<ordinal:long,term:string>>"),
        lambda acc, x: F.concat(
            acc,
            F.array(F.struct(x["ordinal"].alias("ordinal"), F.concat(F.coalesce(F.substring(F.element_at(F.concat(F.array(F.struct(F.lit(-1).cast("long").alias("ordinal"), F.lit("").alias("term"))), acc), -1)["term"], F.lit(1), x["shared"]), F.lit("")), x["rest"]).alias("term"))),
        ),
    )
    return coded.groupBy(F.floor(F.col("ordinal") / group)).agg(rebuilt.alias("terms")).select(F.inline("terms"))
