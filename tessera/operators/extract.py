"""Selecting documents by a list of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suffix_key(name: Column) -> Column:
    """What follows the last underscore; the whole name without one."""
    return F.substring_index(name, "_", -1)


def extract(docs: DataFrame, names: DataFrame, docname: str = "docname", suffix: bool = False) -> DataFrame:
    """The rows of docs whose name, or its suffix, is in names (its first column)."""
    listed = names.select(F.col(names.columns[0]).alias("__listed"))
    key = suffix_key(F.col(docname)) if suffix else F.col(docname)
    return docs.join(listed, key == F.col("__listed"), "left_semi")


def extract_counts(docs: DataFrame, names: DataFrame, docname: str = "docname", suffix: bool = False) -> DataFrame:
    """(processed, extracted): how many rows docs has, and how many of them extract() takes."""
    listed = names.select(F.col(names.columns[0]).alias("__listed")).distinct()
    key = suffix_key(F.col(docname)) if suffix else F.col(docname)
    return docs.select(key.alias("__key")).join(listed, F.col("__key") == F.col("__listed"), "left").agg(
        F.count(F.lit(1)).alias("processed"), F.count("__listed").alias("extracted")
    )
