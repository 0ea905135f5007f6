"""Column functions for markup removal, tokenising and case folding.

Bytes above 127 always belong to words, and only A-Z are folded, so results do
not depend on a locale or a Unicode version.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKUP = (
    r"(?is)<!--.*?(?:-->|\z)|<script.*?(?:</script>|\z)|<style.*?(?:</style>|\z)|<[^>]*(?:>|\z)|&[^; \t\n\x0B\f\r]*;"
)
# as what a word has: the same class, negated, takes Java some ten times as long
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
TUPLE = r"#(?:\{[^\x00 \t\r\n#]+\}|\([^\x00 \t\r\n#]+\)|![^\x00 \t\r\n#]+!)#(?= |\n|\z)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters that no word has.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def fold(text: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(text, UPPER, LOWER)


def strip_markup(text: Column) -> Column:
    """Comments, scripts, styles, tags and entities become spaces; runs of white space become one
    character, a line end if they hold one; a run at the end goes.

    What is not closed reaches to the end.  An entity is & to ; without white space between; it is dropped, not decoded.
    """
    out = F.regexp_replace(text, MARKUP, " ")
    out = F.regexp_replace(out, r"[ \t\x0B\f\r]*\n[ \t\n\x0B\f\r]*", "\n")
    out = F.regexp_replace(out, r"[ \t\x0B\f\r]+", " ")
    return F.regexp_replace(out, r"[ \n]+\z", "")


def _parts(text: Column) -> Column:
    """What stands between spaces.  One space as the pattern needs no regular expression, and no function for each token."""
    return F.array_remove(F.split(text, " "), "")


def words(text: Column, math: bool = False) -> Column:
    """Folded tokens, in order.  With math, tuples such as #(a,b)# are tokens of their own, kept as they are."""
    if not math:
        return _parts(F.translate(text, UPPER + BETWEEN, LOWER + " " * len(BETWEEN)))
    # a word takes the character that ends it, so a tuple right after a word is lost
    hits = F.regexp_extract_all(text, F.lit(f"{TUPLE}|{WORD}#?"), F.lit(0))
    return F.transform(hits, lambda x: F.when(x.startswith("#"), x).otherwise(fold(F.rtrim(x, F.lit("#")))))


def raw_tokens(text: Column) -> Column:
    """Tokens between spaces, tabs and line ends, as an index and a query hold them."""
    return _parts(F.translate(text, "\t\r\n", "   "))


def is_tuple(term: Column) -> Column:
    return term.startswith("#")


def weighted(text: Column) -> Column:
    """array<struct<pos,term,weight>> of the tokens between white space, in one pass.

    A token #!n!# is no token: it sets the weight of all that follow, until the next; at first it
    is 1.  n may have a sign, and what follows its digits is ignored; without digits it is an error.
    Null texts have null.
    """
    mark = r"#!(?<![^ \t\r\n]#!)([^ \t\r\n]+)!#(?![^ \t\r\n])"  # looks behind only where a mark may be
    number = lambda inner: F.regexp_extract(inner, "^([+-]?[0-9]+)", 1).cast("int")
    entry = lambda i, t, w: F.struct(i.alias("pos"), t.alias("term"), w.alias("weight"))
    weights = F.concat(F.array(F.lit(1)), F.transform(F.regexp_extract_all(text, F.lit(mark), F.lit(1)), number))
    parts = F.arrays_zip(F.split(text, mark).alias("part"), weights.alias("weight"))
    tokens = F.flatten(F.transform(parts, lambda p: F.transform(raw_tokens(p["part"]), lambda t: F.struct(t.alias("term"), p["weight"].alias("weight")))))
    marked = F.transform(tokens, lambda t, i: entry(i, t["term"], t["weight"]))
    # most texts have no weights, and need no look-around
    return F.when(F.instr(text, "#!") > 0, marked).otherwise(F.transform(raw_tokens(text), lambda t, i: entry(i, t, F.lit(1))))
