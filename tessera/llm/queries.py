"""Registered queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, licenses, line_dedup, mixing, passage_dedup, pii, quality, token_counts, warc
from .common import shared_path, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ledger(table(spark, sf_dir, "documents"))


def op8_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_runs(table(spark, sf_dir, "documents")).drop("seq")


def op2_single_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op2_line_dedup, but a run may begin and end at one line; the least number of characters alone decides."""
    return line_dedup.repeated_runs(table(spark, sf_dir, "documents"), min_lines=1).drop("seq")


def op2_maximal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op2_line_dedup, but runs that occur at their sources as wholes; those that overlap are not joined."""
    return line_dedup.maximal_runs(table(spark, sf_dir, "documents")).drop("seq")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.repeated_passages(table(spark, sf_dir, "documents")).drop("seq")


def _worn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files with some damage, one in eight of them plain, and read back."""
    folder = shared_path(spark, "warc")
    plain = F.coalesce(F.col("page_id") % 8 == 0, F.lit(False))
    for compress, part in ((True, ~plain), (False, plain)):
        pages = table(spark, sf_dir, "pages").where(part)
        # written once, by this action
        warc.write_pages(pages, f"{folder}/{'gz' if compress else 'plain'}", damage=warc.wear, compress=compress).write.format("noop").mode("overwrite").save()
    rows = warc.read_warc(spark, folder)
    page = F.regexp_extract(F.col("headers")["warc-record-id"], r"^<urn:page:(-?\d+)>$", 1)
    return rows.withColumns({"page_id": page.try_cast("long"), "url": F.col("headers")["warc-target-uri"], "html": F.col("block").cast("string")})


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each recovered page and each gap."""
    return _worn_pages(spark, sf_dir).select(
        F.regexp_extract("path", "[^/]+$", 0).alias("file"), "kind", "offset", "length", "page_id", "url", F.length("html").alias("n_chars"), "reason"
    )


def op3_recovered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that op3_warc recovers, by what they hold."""
    return _worn_pages(spark, sf_dir).where("kind = 'record'").select("page_id", "url", F.length("html").alias("n_chars"), F.md5("html").alias("digest"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op8_quality_rules": op8_quality_rules,
    "op8_ablations": op8_ablations,
    "op2_line_dedup": op2_line_dedup,
    "op2_single_lines": op2_single_lines,
    "op2_maximal_runs": op2_maximal_runs,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op4_decontamination": op4_decontamination,
    "op1_mixing": op1_mixing,
    "op6_suffix_array": op6_suffix_array,
    "op3_warc": op3_warc,
    "op3_recovered_pages": op3_recovered_pages,
    "op5_license_scan": op5_license_scan,
    "op9_pii": op9_pii,
    "op10_token_counts": op10_token_counts,
}

_WORDS = r"regexp_extract_all(t, '[^ \t\r\n]+')"
_LEDGER = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id,
    length(t)::BIGINT AS n_characters,
    len({_WORDS})::BIGINT AS n_words,
    length(regexp_replace(t, '[^\p{{L}}]', '', 'g'))::BIGINT AS n_letters,
    length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g'))::BIGINT AS n_upper,
    length(regexp_replace(t, '[^#$%&*<>=@^_{{}}\[\]~`|\\+/]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^0-9]', '', 'g'))::BIGINT AS n_digits,
    (len(string_split(t, '|')) - 1)::BIGINT AS n_pipes,
    len(list_distinct({_WORDS}))::BIGINT AS n_distinct_words,
    len(list_filter(regexp_extract_all(t, '\p{{L}}+'), lambda x: lower(x) IN ({", ".join(repr(w) for w in quality.STOPWORDS)})))::BIGINT AS n_stopwords,
    len(string_split(t, chr(10)))::BIGINT AS n_lines,
    len(list_distinct(string_split(t, chr(10))))::BIGINT AS n_distinct_lines,
    len(regexp_extract_all(t, '(?:\.\.\.|…)[ \t]*(?:\n|\z)'))::BIGINT AS n_ellipsis_lines,
    len(regexp_extract_all(t, '(?:\A|\n)[ \t]*[-*•][ \t]'))::BIGINT AS n_bullet_lines
  FROM d),
l AS (SELECT *, ({" + ".join(f"CASE WHEN {rule} THEN {quality.BITS[name]} ELSE 0 END" for name, rule in quality.RULES.items())})::BIGINT AS failed FROM m)
"""
_TOKENS = r"regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_ABLATIONS = "\nUNION ALL\n".join(
    f"""SELECT '{v}' AS policy, '{r}' AS rule, count(*)::BIGINT AS documents,
      (count(*) FILTER (failed & {m} <> 0))::BIGINT AS rejected,
      (count(*) FILTER (failed & {quality.BITS[r]} <> 0))::BIGINT AS fail_rule,
      (count(*) FILTER (failed & {m} = {quality.BITS[r]}))::BIGINT AS only_this_rule,
      (count(*) FILTER (failed & {m & ~quality.BITS[r]} = 0))::BIGINT AS kept_without_rule,
      coalesce(bit_or(failed) FILTER (failed & {quality.BITS[r]} <> 0), 0)::BIGINT AS joint_bits FROM l HAVING count(*) > 0"""
    for v, m in quality.POLICIES.items()
    for r in quality.RULES
    if m & quality.BITS[r]
)


def _line_runs(n: int) -> str:
    """Runs of repeated lines that begin and end at n lines: joined where n + 1 lines repeat."""
    key = lambda k: ", ".join(["line", *[f"l{i}" for i in range(1, k)]])
    return f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents),
w AS (SELECT doc_id, pos, line, {", ".join(f"lead(line, {i}) OVER (PARTITION BY doc_id ORDER BY pos) AS l{i}" for i in range(1, n + 1))} FROM l),
f AS (
  SELECT doc_id, pos, first_value(doc_id) OVER same AS fd, first_value(pos) OVER same AS fp,
    l{n} IS NOT NULL AND row_number() OVER longer > 1 AS goes_on
  FROM w {f"WHERE l{n - 1} IS NOT NULL" if n > 1 else ""}
  WINDOW same AS (PARTITION BY {key(n)} ORDER BY doc_id, pos), longer AS (PARTITION BY {key(n + 1)} ORDER BY doc_id, pos)),
c AS (
  SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) = pos - 1 AND lag(goes_on) OVER (PARTITION BY doc_id ORDER BY pos) AS joined
  FROM f WHERE fd <> doc_id OR fp <> pos),
r AS (SELECT *, sum((NOT coalesce(joined, false))::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c),
g AS (
  SELECT doc_id, run, min(pos) AS s, max(pos) + {n - 1} AS e, arg_min(fd, pos) AS sd, arg_min(fp, pos) AS sl
  FROM r GROUP BY doc_id, run)
SELECT g.doc_id, s::INT AS start_line, e::INT AS end_line, (e - s + 1)::INT AS n_lines, sum(length(line))::INT AS n_chars,
  sd AS source_doc_id, sl::INT AS source_line
FROM g JOIN l ON l.doc_id = g.doc_id AND l.pos BETWEEN s AND e
GROUP BY g.doc_id, s, e, sd, sl, run HAVING sum(length(line)) >= {line_dedup.MIN_CHARS}"""


def mixing_sql(documents: str) -> str:
    """The mix of a relation (doc_id, source, text) with the default parameters."""
    hashed = lambda *x: f"('0x' || substr(md5(concat_ws(':', {', '.join(x)})), 1, 8))::BIGINT"
    flat = lambda x: (
        f"(-list_sum(list_transform(p, lambda q: pow(q, {x}) / z * ln(pow(q, {x}) / z))) > {mixing.TARGET_ENTROPY} * ln(len(p)) + 1e-12"
        f" OR list_max(list_transform(p, lambda q: pow(q, {x}) / z / q)) > {mixing.MAX_REPEATS})"
    )
    return f"""
WITH RECURSIVE n AS (
  SELECT doc_id, source, md5(text) AS mark, row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS occurrence,
    len(regexp_extract_all(text, '[^ \\t\\r\\n]+'))::BIGINT AS n_tokens FROM ({documents})
  WHERE len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) > 0),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM n GROUP BY source),
p AS (SELECT list(tokens / (SELECT sum(tokens) FROM s) ORDER BY tokens) AS p FROM s),
b(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN {flat("(low + high) / 2")} THEN (low + high) / 2 ELSE low END,
    CASE WHEN {flat("(low + high) / 2")} THEN high ELSE (low + high) / 2 END
  FROM (SELECT b.*, p.p, list_sum(list_transform(p.p, lambda q: pow(q, (low + high) / 2))) AS z FROM b, p WHERE i < {mixing.STEPS})),
x AS (SELECT round(high, 6) AS x, (SELECT sum(tokens) FROM s)::BIGINT AS total FROM b WHERE i = {mixing.STEPS}),
z AS (SELECT x, total, list_sum(list_transform(p.p, lambda q: pow(q, x))) AS z FROM x, p),
w AS (SELECT source, tokens, total, round(pow(tokens / total, x) / z, 9) AS weight, floor(round(pow(tokens / total, x) / z, 9) * total)::BIGINT AS budget FROM s, z),
k AS (SELECT greatest(1, ceil(sum(budget) / {float(mixing.BLOCK_TOKENS)}))::BIGINT AS blocks FROM w),
d AS (
  SELECT n.doc_id, n.source, mark, coalesce(doc_id::VARCHAR, mark) AS this, occurrence, n_tokens, weight, tokens, budget, unnest(range(0, ((budget - 1) // tokens + 1)::BIGINT)) AS epoch
  FROM n JOIN w ON n.source IS NOT DISTINCT FROM w.source WHERE budget > 0),
o AS (
  SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch
      ORDER BY {hashed(str(mixing.SEED), "epoch", "this", "occurrence")}, doc_id, n_tokens, mark, occurrence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM d),
f AS (SELECT *, floor(first::DOUBLE * blocks / budget)::BIGINT AS block FROM o, k WHERE first < budget)
SELECT doc_id, source, n_tokens, weight, epoch::INT AS epoch, block, {hashed(str(mixing.SEED + 1), "block", "epoch", "this", "occurrence")} AS place FROM f"""


ORACLES: dict[str, str] = {
    "op8_quality_rules": _LEDGER + "SELECT *, " + ", ".join(f"failed & {m} = 0 AS keep_{v}" for v, m in quality.POLICIES.items()) + " FROM l",
    "op8_ablations": _LEDGER + _ABLATIONS,
    "op2_line_dedup": _line_runs(2),
    "op2_single_lines": _line_runs(1),
    "op2_maximal_runs": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents),
p AS (SELECT a.doc_id, a.pos, b.doc_id AS sd, b.pos AS sl FROM l a JOIN l b ON a.line = b.line AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.pos < a.pos)),
s AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, sd, pos - sl ORDER BY pos) AS stretch FROM p),
e AS (SELECT *, max(pos) OVER (PARTITION BY doc_id, sd, pos - sl, stretch) AS e FROM s),
f AS (SELECT doc_id, pos, min(struct_pack(back := -e, sd := sd, sl := sl)) AS f FROM e GROUP BY doc_id, pos),
m AS (SELECT * FROM f QUALIFY coalesce(lag(f.back) OVER (PARTITION BY doc_id ORDER BY pos) > f.back, true))
SELECT m.doc_id, m.pos::INT AS start_line, (-f.back)::INT AS end_line, (1 - f.back - m.pos)::INT AS n_lines, sum(length(line))::INT AS n_chars,
  f.sd AS source_doc_id, f.sl::INT AS source_line
FROM m JOIN l ON l.doc_id = m.doc_id AND l.pos BETWEEN m.pos AND -f.back
WHERE 1 - f.back - m.pos >= {line_dedup.MIN_LINES} GROUP BY m.doc_id, m.pos, f HAVING sum(length(line)) >= {line_dedup.MIN_CHARS}""",
    "op7_ngram_jaccard": f"""
WITH RECURSIVE t AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL),
g AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS grams
  FROM t WHERE len(w) > 0),
c AS (SELECT grams, min(doc_id) AS doc, list(doc_id) AS docs FROM g GROUP BY grams),
e AS (SELECT doc, len(grams) AS n, len(docs) AS docs, unnest(grams) AS gram FROM c),
p AS (
  SELECT a.doc AS x, b.doc AS y, a.docs AS nx, b.docs AS ny
  FROM e a JOIN e b ON a.gram = b.gram AND a.doc < b.doc GROUP BY a.doc, b.doc, a.n, b.n, a.docs, b.docs
  HAVING count(*) / (a.n + b.n - count(*)) >= {jaccard.THRESHOLD}),
l AS (SELECT x AS doc, y AS other, ny AS docs FROM p UNION ALL SELECT y, x, nx FROM p),
reach AS (SELECT doc AS a, doc AS b FROM l UNION SELECT reach.a, l.other FROM reach JOIN l ON reach.b = l.doc),
class AS (SELECT a AS doc, min(b) AS class_id FROM reach GROUP BY a),
links AS (SELECT doc, sum(docs) AS n FROM l GROUP BY doc),
m AS (SELECT doc, unnest(docs) AS doc_id, len(docs) AS copies FROM c)
SELECT doc_id, coalesce(class_id, doc) AS class_id, (copies - 1 + coalesce(n, 0))::BIGINT AS n_links
FROM m LEFT JOIN class USING (doc) LEFT JOIN links USING (doc) WHERE copies > 1 OR n IS NOT NULL""",
    "op4_decontamination": f"""
WITH dt AS (SELECT doc_id AS doc, unnest({_TOKENS}) AS term, generate_subscripts({_TOKENS}, 1) - 1 AS pos FROM documents),
bt AS (SELECT item_id AS item, unnest({_TOKENS}) AS term, generate_subscripts({_TOKENS}, 1) - 1 AS off, len({_TOKENS}) AS len FROM benchmark),
cf AS (SELECT term, (SELECT 0) + count(pos) AS cf FROM (SELECT DISTINCT term FROM bt) LEFT JOIN dt USING (term) GROUP BY term),
placed AS (SELECT doc, item, pos - off AS base, off, len, term FROM dt JOIN bt USING (term)),
runs AS (SELECT *, off - row_number() OVER (PARTITION BY doc, item, base ORDER BY off) AS run FROM placed),
phrases AS (
  SELECT item AS item_id, doc AS doc_id, 'phrase' AS kind, (base + min(off))::INT AS start, min(off)::INT AS item_start,
    count(*)::INT AS n_matched, len::INT AS n_terms
  FROM runs GROUP BY doc, item, base, run, len HAVING count(*) >= least({decontaminate.PHRASE}, len)),
rare AS (
  SELECT item, term, row_number() OVER (PARTITION BY item ORDER BY cf, place) AS rank
  FROM (SELECT item, term, cf, min(off) AS place FROM bt JOIN cf USING (term) WHERE len >= {decontaminate.MIN_TOKENS} GROUP BY item, term, cf)
  QUALIFY rank <= {decontaminate.RAREST}),
sizes AS (SELECT item, count(*) AS total FROM rare GROUP BY item),
close AS (
  SELECT doc, item, base, count(DISTINCT term) OVER (PARTITION BY doc, item ORDER BY base RANGE BETWEEN CURRENT ROW AND {decontaminate.SLACK} FOLLOWING) AS n
  FROM placed SEMI JOIN rare USING (item, term)),
best AS (SELECT doc, item, total, max(struct_pack(n := n, back := -base)) AS best FROM close JOIN sizes USING (item)
  WHERE n >= total * {decontaminate.SHARE} GROUP BY doc, item, total)
SELECT * FROM phrases
UNION ALL
SELECT item, doc, 'proximity', greatest(-best.back, 0)::INT, 0::INT, best.n::INT, total::INT FROM best
WHERE NOT EXISTS (SELECT 1 FROM phrases WHERE item_id = item AND doc_id = doc)""",
    "op3_recovered_pages": """
SELECT page_id, coalesce(url, '') AS url, length(coalesce(html, ''))::INT AS n_chars, md5(coalesce(html, '')) AS digest FROM pages
WHERE ('0x' || substr(md5(coalesce(page_id::VARCHAR, 'None')), 1, 4))::INT % 64 >= 2""",
    "op1_mixing": mixing_sql("SELECT doc_id, source, text FROM documents"),
    "op6_suffix_array": f"""
WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
w AS (
  SELECT doc_id, unnest(range(0, len(w) - {passage_dedup.THRESHOLD - 1})) AS pos,
    unnest(list_transform(range(1, len(w) - {passage_dedup.THRESHOLD - 2}), lambda i: md5(array_to_string(w[i:i + {passage_dedup.THRESHOLD - 1}], ' ')))) AS gram
  FROM t WHERE len(w) >= {passage_dedup.THRESHOLD}),
f AS (SELECT doc_id, pos, first_value(doc_id) OVER same AS fd, first_value(pos) OVER same AS fp FROM w WINDOW same AS (PARTITION BY gram ORDER BY doc_id, pos)),
c AS (
  SELECT *, pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + {passage_dedup.THRESHOLD} AS opens
  FROM f WHERE fd <> doc_id OR fp <> pos),
r AS (SELECT *, sum(coalesce(opens, true)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c)
SELECT doc_id, min(pos)::INT AS start_token, (max(pos) + {passage_dedup.THRESHOLD - 1})::INT AS end_token,
  (max(pos) - min(pos) + {passage_dedup.THRESHOLD})::INT AS n_tokens, arg_min(fd, pos) AS source_doc_id, arg_min(fp, pos)::INT AS source_token
FROM r GROUP BY doc_id, run""",
}
