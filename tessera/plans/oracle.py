"""Pieces of DuckDB SQL for the registered queries, written apart from the plans they check."""

from __future__ import annotations

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TAGS = r"(?is)<!--.*?(?:-->|\z)|<script.*?(?:</script>|\z)|<style.*?(?:</style>|\z)|<[^>]*(?:>|\z)|&[^; \t\n\x0B\f\r]*;"


def folded(text: str) -> str:
    return f"translate({text}, '{UP}', '{LOW}')"


def words(text: str) -> str:
    return f"regexp_extract_all({folded(text)}, '{WORD}')"


def stripped(text: str) -> str:
    out = f"regexp_replace({text}, '{TAGS}', ' ', 'g')"
    out = rf"regexp_replace({out}, '[ \t\x0B\f\r]*\n[ \t\n\x0B\f\r]*', chr(10), 'g')"
    out = rf"regexp_replace({out}, '[ \t\x0B\f\r]+', ' ', 'g')"
    return rf"regexp_replace({out}, '[ \n]+\z', '')"


def math_words(text: str) -> str:
    """Tuples and folded words; a space put before each line end and at the end takes the look-ahead's place."""
    kind = "[^\\x00 \\t\\r\\n#]+"
    tuples = rf"#(?:\{{{kind}\}}|\({kind}\)|!{kind}!)# "
    hits = f"regexp_extract_all(replace({text}, chr(10), ' ' || chr(10)) || ' ', '{tuples}|{WORD}#?')"
    return f"list_transform({hits}, lambda x: CASE WHEN x[1] = '#' THEN rtrim(x, ' ') ELSE {folded('rtrim(x, chr(35))')} END)"


def raw_tokens(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '[ \t\r\n]+'), lambda t: t <> '')"


def stems(terms: str) -> str:
    """A relation (term, stem) over a relation with distinct `term`, as a chain of projections."""
    c, v = "[^aeiouy]", "[aeiouy]"
    more0, more1, one = f"^{c}*{v}+{c}+", f"^{c}*{v}+{c}+{v}+{c}", rf"^{c}*{v}+{c}+{v}*\z"
    cvc = rf"{c}{v}[^aeiouywxY]\z"
    cut = lambda n: f"left(w, length(w) - {n})"
    has = lambda x, p: f"regexp_matches({x}, '{p}')"

    def table(pairs: list[tuple[str, str]], measure: str) -> str:
        # of suffixes that end each other the longest counts, so longer ones are asked first
        ordered = sorted(pairs, key=lambda p: -len(p[0]))
        return "CASE " + " ".join(f"WHEN ends_with(w, '{s}') THEN CASE WHEN {has(cut(len(s)), measure)} THEN {cut(len(s))} || '{new}' ELSE w END" for s, new in ordered) + " ELSE w END"

    two = [tuple(x.split("-")) for x in (
        "ational-ate tional-tion enci-ence anci-ance izer-ize bli-ble alli-al entli-ent eli-e ousli-ous ization-ize ation-ate ator-ate alism-al "
        "iveness-ive fulness-ful ousness-ous aliti-al iviti-ive biliti-ble logi-log").split()]  # fmt: skip
    three = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
    four = [(s, "") for s in "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()]
    steps = [
        r"regexp_replace(term, '([^\x00-\x7F])', '\1~', 'g')",
        "regexp_replace(w, '^y', 'Y')",
        rf"regexp_replace(w, '({v})y', '\1Y', 'g')",
        rf"regexp_replace(w, '({v})y', '\1Y', 'g')",
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {has(cut(3), more0)} THEN {cut(1)} ELSE w END"
        f" WHEN ends_with(w, 'ed') AND {has(cut(2), v)} THEN {cut(2)} || '|' WHEN ends_with(w, 'ing') AND {has(cut(3), v)} THEN {cut(3)} || '|' ELSE w END",
        f"CASE WHEN NOT ends_with(w, '|') THEN w WHEN {has('w', '(at|bl|iz)[|]' + chr(92) + 'z')} THEN {cut(1)} || 'e'"
        f" WHEN {has(cut(1), '[^aeiouy~]' + chr(92) + 'z')} AND lower(right({cut(1)}, 1)) = lower(right({cut(2)}, 1)) AND length(w) > 2"
        f" THEN CASE WHEN {has(cut(1), '[lsz]' + chr(92) + 'z')} THEN {cut(1)} ELSE {cut(2)} END"
        f" WHEN {has(cut(1), one)} AND {has(cut(1), cvc)} THEN {cut(1)} || 'e' ELSE {cut(1)} END",
        f"CASE WHEN length(w) = 1 THEN w || '|' WHEN lower(right(w, 1)) = 'y' AND {has(cut(1), v)} THEN {cut(1)} || 'i' ELSE w END",
        table(two, more0),
        table(three, more0),
        f"CASE WHEN {has('w', '[st]ion' + chr(92) + 'z')} THEN CASE WHEN {has(cut(3), more1)} THEN {cut(3)} ELSE w END ELSE {table(four, more1)} END",
        f"CASE WHEN ends_with(w, 'e') AND ({has(cut(1), more1)} OR {has(cut(1), one)} AND NOT {has(cut(1), cvc)}) THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {has('w', more1)} THEN {cut(1)} ELSE w END",
    ]
    out = f"SELECT term, {steps[0]} AS w FROM ({terms})"
    for s in steps[1:]:
        out = f"SELECT term, {s} AS w FROM ({out})"
    return f"SELECT term, CASE WHEN strlen(term) > 2 THEN translate(w, 'Y~|', 'y') ELSE term END AS stem FROM ({out})"


def bm25(postings: str, weights: str, k: int = 10, sizes: str | None = None) -> str:
    """Top k over a relation postings(docid, term, tf) and weights(qid, term, weight); sizes(docid, dl) is by default made from postings."""
    sizes = sizes or "SELECT docid, sum(tf)::BIGINT AS dl FROM tf GROUP BY docid HAVING sum(tf) > 0"
    return f"""
WITH tf AS MATERIALIZED ({postings}), qw AS MATERIALIZED ({weights}),
dl AS MATERIALIZED ({sizes}),
st AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS mean FROM dl),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
sc AS (
  SELECT qid, docid, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)))), 6) AS score
  FROM qw JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (docid), st GROUP BY qid, docid)
SELECT qid, docid, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid))::INT AS rank, score FROM sc WHERE score > 0 QUALIFY rank <= {k}"""


def query_weights(tokens: str, alpha: float | None = None) -> str:
    """(qid, term, weight) of a relation (qid, term, weight) with a row per token."""
    side = "" if alpha is None else f" * CASE WHEN term[1] = '#' THEN {alpha} ELSE {1 - alpha} END"
    return f"""SELECT qid, term, x / (x + 10.0){side} AS weight FROM (
  SELECT qid, term, sum(weight)::DOUBLE * (sum(count(*)) OVER (PARTITION BY qid) / sum(sum(weight)) OVER (PARTITION BY qid))::DOUBLE AS x
  FROM ({tokens}) GROUP BY qid, term)"""
