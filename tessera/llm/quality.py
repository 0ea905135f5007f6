"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one integer whose bit i says that rule i failed.  A policy is a versioned
mask: a document is rejected by it when ``failed & mask <> 0``.  Changing
policies, or asking what a policy would do without one of its rules, is bit
arithmetic on the ledger and never touches the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once

STOPWORDS = (
    "the of and to in is that for it as with was on are this from "
    "de la le et les des en un du une que est pour qui dans par au "
    "der die und den von zu das mit sich ist im dem nicht ein "
    "el los se las por con una su para es"
).split()

#: What several measurements are made of -> Spark SQL over text.
PARTS = {
    "words": r"regexp_extract_all(text, '[^ \\t\\r\\n]+', 0)",
    "letter_runs": r"regexp_extract_all(text, '\\p{L}+', 0)",
    "lines": r"split(text, '\\n')",
}
#: Measurement -> Spark SQL over text and PARTS; all are counts.
MEASURES = {
    "n_characters": "length(text)",
    "n_words": "size(words)",
    "n_letters": "aggregate(letter_runs, 0, (n, x) -> n + length(x))",
    "n_upper": r"length(regexp_replace(text, '[^\\p{Lu}]+', ''))",
    "n_symbols": r"length(regexp_replace(text, '[^#$%&*<>=@^_{}\\[\\]~`|\\\\+/]+', ''))",
    "n_digits": r"length(regexp_replace(text, '[^0-9]+', ''))",
    "n_pipes": "length(text) - length(replace(text, '|', ''))",
    "n_distinct_words": "size(array_distinct(words))",
    "n_stopwords": "size(filter(letter_runs, x -> lower(x) IN (" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")))",
    "n_lines": "size(lines)",
    "n_distinct_lines": "size(array_distinct(lines))",
    "n_ellipsis_lines": r"regexp_count(text, '(?:\\.\\.\\.|…)[ \\t]*(?:\\n|\\z)')",
    "n_bullet_lines": r"regexp_count(text, '(?:\\A|\\n)[ \\t]*[-*•][ \\t]')",
}

#: Bit i belongs to the i-th rule: name -> condition for failure over the measurements.
#: Products of whole numbers, so that no verdict hangs on rounding.  As a vocabulary grows with about the root of
#: a text's length, few_distinct_words asks less of long texts.
RULES = {
    "no_words": "n_words < 1",
    "too_long": "n_words > 1000000",
    "mean_word_length": "n_words >= 5 AND (n_letters < 2 * n_words OR n_letters > 15 * n_words)",
    "symbols": "n_words >= 5 AND n_symbols * 10 > n_characters",
    "upper_case": "n_letters >= 40 AND n_upper * 2 > n_letters",
    "pipes": "n_pipes >= 3 AND n_pipes * 4 > n_words",
    "few_distinct_words": "n_words >= 20 AND n_distinct_words * 10 < n_words AND n_distinct_words * n_distinct_words < 25 * n_words",
    "repeats_itself": "n_words >= 20 AND n_words <= 1000 AND n_distinct_words * 4 < n_words",
    "duplicate_lines": "n_lines >= 6 AND n_distinct_lines * 2 < n_lines",
    "digits": "n_characters >= 200 AND n_digits * 5 > n_characters",
    "no_stopwords": "n_words >= 50 AND n_stopwords < 2",
    "ellipsis_lines": "n_lines >= 5 AND n_ellipsis_lines * 10 > n_lines * 3",
    "bullet_lines": "n_lines >= 5 AND n_bullet_lines * 10 > n_lines * 9",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}


def mask(*rules: str) -> int:
    """The integer with the bits of the named rules set."""
    return sum(BITS[r] for r in set(rules))


#: Policies are never edited; a change is a new version.
POLICIES = {
    "v1": mask("no_words", "symbols", "upper_case", "few_distinct_words"),
    "v2": mask(*RULES),
}


def marked(rows: DataFrame) -> DataFrame:
    """rows(text, ...) without null texts, with measurements and `failed`; text is dropped."""
    parts = once(rows, {n: F.expr(sql) for n, sql in PARTS.items()})
    measured = once(parts, {m: F.expr(sql).cast("long") for m, sql in MEASURES.items()}).drop("text", *PARTS)
    bits = [F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return once(measured, {"failed": failed})


def ledger(docs: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, measurements, failed, keep_<version>...) of every row of docs(doc_id, text).

    One scan, no shuffle, only built-in expressions.  A null text counts as an
    empty one and fails ``no_words``.  Repeated rows give repeated entries; a
    null doc_id stays null; other columns are ignored.
    """
    return apply_policies(marked(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))), policies)


def passes(bits: int) -> Column:
    """Whether a ledger row is kept by the policy with this mask."""
    return F.col("failed").bitwiseAND(F.lit(bits)) == 0


def apply_policies(entries: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """A ledger with one keep_<version> column for each policy."""
    chosen = POLICIES if policies is None else policies
    return entries.select("*", *[passes(m).alias(f"keep_{v}") for v, m in chosen.items()])


def ablations(entries: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """For each policy and each of its rules: documents that fail the rule, that fail it alone, and
    that the policy without it would keep; also the policy's totals and the documents' joint bits.

    A single aggregation over the ledger: documents are first counted by their
    failure bits, of which there are at most 2^rules whatever the corpus.  An
    empty ledger gives no rows.
    """
    chosen = POLICIES if policies is None else policies
    spark = entries.sparkSession
    by_bits = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("docs"))
    rules = spark.createDataFrame(
        [(v, m, r, BITS[r]) for v, m in chosen.items() for r in RULES if m & BITS[r]],
        "policy string, mask long, rule string, bit long",
    )
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    n = lambda cond: F.sum(F.when(cond, F.col("docs")).otherwise(0)).cast("long")
    return (
        by_bits.crossJoin(F.broadcast(rules))
        .groupBy("policy", "rule")
        .agg(
            F.sum("docs").cast("long").alias("documents"),
            n(hit != 0).alias("rejected"),
            n(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("fail_rule"),
            n(hit == F.col("bit")).alias("only_this_rule"),
            n(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without_rule"),
            F.coalesce(F.bit_or(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed"))), F.lit(0)).alias("joint_bits"),
        )
    )


def keep_good(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The rows of docs that the policy keeps, columns unchanged (extra ones too).

    The ledger of docs beside its rows, in one scan: the policy's mask decides over the failure bits.  A null text
    counts as an empty one; a null doc_id says nothing about its row; repeated rows are judged alike.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return marked(rows).where(passes(POLICIES[policy])).select("row.*")
