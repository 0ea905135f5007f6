"""Porter's stemmer (1980, with its author's later departures) as projections.

Meant for distinct terms: stem a vocabulary and join, not every occurrence.
Letters are bytes to the algorithm: ~ after each non-ASCII character stands for its
further bytes, all consonants.  A y that is a consonant is written Y on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C, V = "[^aeiouy]", "[aeiouy]"
M0, M1, M_ONE = f"^{C}*{V}+{C}+", f"^{C}*{V}+{C}+{V}+{C}", f"^{C}*{V}+{C}+{V}*\\z"
CVC = f"{C}{V}[^aeiouywxY]\\z"
STEP2 = dict(x.split(":") for x in (
    "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate "
    "alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
).split())
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent (?<=[st])ion ou ism ate iti ous ive ize".split()


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _suffix(w: Column, suffixes) -> tuple[Column, Column]:
    """Stem and suffix, the longest that matches; both empty without one."""
    pattern = rf"(?s)^(.*?)({'|'.join(suffixes)})\z"
    return F.regexp_extract(w, pattern, 1), F.regexp_extract(w, pattern, 2)


def stem(df: DataFrame, term: str, out: str) -> DataFrame:
    """df with the stem of its column `term` in `out`; terms of at most two bytes stay as they are."""
    w = F.col(out)
    marked = F.regexp_replace(F.col(term), r"([^\x00-\x7F])", "$1~")
    marked = F.regexp_replace(marked, "^y", "Y")
    for _ in range(2):
        marked = F.regexp_replace(marked, f"({V})y", "$1Y")
    df = df.withColumn(out, marked)

    df = df.withColumn(
        out, F.when(w.endswith("sses"), _cut(w, 2)).when(w.endswith("ies"), _cut(w, 2)).when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)).otherwise(w)
    )
    bare = F.regexp_replace(w, r"(?:ed|ing)\z", "")
    removed = ~w.endswith("eed") & w.rlike(r"(?:ed|ing)\z") & bare.rlike(V)
    df = df.withColumn(out, F.when(w.endswith("eed"), F.when(_cut(w, 3).rlike(M0), _cut(w, 1)).otherwise(w)).when(removed, F.concat(bare, F.lit("|"))).otherwise(w))
    rest = _cut(w, 1)
    fixed = (
        F.when(rest.rlike(r"(?:at|bl|iz)\z"), F.concat(rest, F.lit("e")))
        .when(rest.rlike(r"(?:([^aeiouyY~])\1|[yY]Y)\z"), F.when(rest.rlike(r"[lsz]\z"), rest).otherwise(_cut(rest, 1)))
        .when(rest.rlike(M_ONE) & rest.rlike(CVC), F.concat(rest, F.lit("e")))
        .otherwise(rest)
    )
    df = df.withColumn(out, F.when(w.endswith("|"), fixed).otherwise(w))

    # a word of which one letter is left is done: a sentinel keeps the further steps away
    df = df.withColumn(out, F.when(F.length(w) == 1, F.concat(w, F.lit("|"))).when(w.rlike(r"[yY]\z") & _cut(w, 1).rlike(V), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w))
    for table in (STEP2, STEP3):
        a, b = _suffix(w, table)
        new = F.concat(a, F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), b))
        df = df.withColumn(out, F.when((b != "") & a.rlike(M0), new).otherwise(w))
    a, b = _suffix(w, STEP4)
    df = df.withColumn(out, F.when((b != "") & a.rlike(M1), a).otherwise(w))
    a = _cut(w, 1)
    df = df.withColumn(out, F.when(w.endswith("e") & (a.rlike(M1) | (a.rlike(M_ONE) & ~a.rlike(CVC))), a).otherwise(w))
    df = df.withColumn(out, F.when(w.endswith("ll") & w.rlike(M1), _cut(w, 1)).otherwise(w))
    return df.withColumn(out, F.when(F.octet_length(term) > 2, F.translate(w, "Y~|", "y")).otherwise(F.col(term)))
