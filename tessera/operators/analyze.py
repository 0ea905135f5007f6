"""From texts to weighted terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import porter
from ..functions import text as X
from ..functions.shared import staged


def word_list(lines: DataFrame, column: str = "value", stem: bool = True) -> DataFrame:
    """The distinct terms of a word list's lines: (term).  Unstemmed lists know no #!n!# tuple."""
    terms = lines.select(F.explode(X.words(F.col(column), math=True)).alias("term")).distinct()
    if stem:
        return stem_terms(terms).select("term").distinct()
    weights = F.col("term").startswith("#!")
    return terms.select(F.when(weights, F.regexp_extract("term", X.WORD, 0)).otherwise(F.col("term")).alias("term")).distinct()


#: Distinct terms whose stems are sent to every executor at most, the most frequent ones.
COMMON_TERMS = 200_000


def stem_terms(terms: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """terms with `term` stemmed by way of the distinct terms; math tuples stay as they are.  With keep(term), only these stems and tuples are left.

    Stems of the common terms are broadcast, so that only occurrences of the others are shuffled to a join.
    """
    tuples = X.is_tuple(F.col("term"))
    counts = terms.where(~tuples).groupBy(F.col("term").alias("plain")).agg(F.floor(F.log2(F.count(F.lit(1)))).cast("int").alias("power"))
    # stored: a condition on the stem would otherwise be pushed through all steps, and grow with each
    stems = staged(porter.stem(counts, "plain", "stem"), "stems")
    if keep is not None:
        stems = staged(stems.join(keep.select(F.col("term").alias("stem")), "stem", "left_semi"), "stems")
    room, least = COMMON_TERMS, 64  # common are the terms that occur 2^least times or more
    for power, n in sorted(stems.groupBy("power").count().collect(), reverse=True):
        room -= n
        if room < 0:
            break
        least = power
    common = F.broadcast(stems.where(F.col("power") >= least).select("plain", "stem"))
    joined = terms.join(common, F.col("term") == F.col("plain"), "left")
    if room < 0 or keep is not None:
        joined = joined.where(F.col("stem").isNotNull() | tuples)
    out = joined.withColumn("term", F.coalesce("stem", "term")).drop("plain", "stem")
    if room >= 0:
        return out
    rare = stems.where(F.col("power") < least).select("plain", "stem")
    rest = terms.where(~tuples).join(common, F.col("term") == F.col("plain"), "left_anti").join(rare, F.col("term") == F.col("plain"))
    return out.unionByName(rest.withColumn("term", F.col("stem")).drop("plain", "stem"))


@dataclass(frozen=True)
class Analyzer:
    """Tokens of texts, folded, stemmed and filtered.

    stopwords and keywords are tables (term), as word_list makes them.  Stop words go first; keywords,
    if given, are the only terms left besides tuples, so an empty table leaves only tuples.
    """

    math: bool = False
    stem: bool = True
    stopwords: DataFrame | None = None
    keywords: DataFrame | None = None

    def tokens(self, docs: DataFrame, key: str, column: str) -> DataFrame:
        """(key, pos, term) of docs; other columns are dropped."""
        out = docs.select(F.col(key), F.posexplode(X.words(F.col(column), self.math)).alias("pos", "term"))
        if self.stem:
            out = stem_terms(out, self.keywords)
        if self.stopwords is not None:
            out = out.join(self.stopwords.select("term"), "term", "left_anti")
        if self.keywords is not None and not self.stem:
            listed = self.keywords.select(F.col("term").alias("listed"))
            out = out.join(listed, F.col("term") == F.col("listed"), "left").where(F.col("listed").isNotNull() | X.is_tuple(F.col("term"))).drop("listed")
        return out.select(key, "pos", "term")

    def lines(self, docs: DataFrame, key: str, column: str) -> DataFrame:
        """(key, line): the tokens of each row joined by a space; a row without tokens has an empty line."""
        tokens = self.tokens(docs, key, column)
        joined = tokens.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]), " ").alias("line"))
        return docs.select(key).join(joined, key, "left").select(key, F.coalesce("line", F.lit("")).alias("line"))


def query_parts(query: Column, spaces: bool = True) -> tuple[Column, Column]:
    """Name and terms of `name;terms`.  Without spaces, the ; counts only before the first space.  No name: null."""
    at = F.instr(query, ";")
    blank = F.instr(query, " ")
    named = (at > 0) if spaces else (at > 0) & ((blank == 0) | (at < blank))
    name = F.when(named, F.substring(query, F.lit(1), at - 1))
    return name, F.when(named, F.substring(query, at + 1, F.length(query))).otherwise(query)
