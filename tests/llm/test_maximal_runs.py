"""Runs of lines that are copies of one source as wholes, against a plain program."""

import pytest
from test_brute_force import DOCS, random_texts

from tessera.llm import line_dedup


def maximal_runs(texts, n):
    """From every line the longest stretch that begins earlier too, unless it is part of the line before's."""
    docs, out = sorted((d, t.split("\n")) for d, t in set(texts)), []
    for d, lines in docs:
        end = -1
        for p in range(len(lines)):
            best = (0, 0, 0)
            for e, other in docs:
                for q in range(len(other) if e < d else p if e == d else 0):
                    k = 0
                    while p + k < len(lines) and q + k < len(other) and lines[p + k] == other[q + k]:
                        k += 1
                    best = max(best, (k, -e, -q))
            if best[0] >= n and p + best[0] - 1 > end:
                out.append((d, p, p + best[0] - 1, -best[1], -best[2]))
            end = max(end, p + best[0] - 1)
    return out


def rows(got):
    return sorted((r.doc_id, r.start_line, r.end_line, r.source_doc_id, r.source_line) for r in got.collect())


def test_overlapping_copies_of_two_sources_are_two_maximal_runs(spark):
    a, b, c, d = ("line %d of twelve" % i for i in range(4))
    texts = [(1, f"{a}\n{b}\n{c}\nx"), (2, f"y\n{b}\n{c}\n{d}"), (3, f"{a}\n{b}\n{c}\n{d}")]
    docs = spark.createDataFrame(texts, DOCS)
    assert rows(line_dedup.maximal_runs(docs)) == [(3, 0, 2, 1, 0), (3, 1, 3, 2, 1)]
    assert rows(line_dedup.maximal_runs(docs, min_chars=50)) == []
    assert rows(line_dedup.repeated_runs(docs, min_chars=50)) == [(3, 0, 3, 1, 0)]


@pytest.mark.parametrize("min_lines", [1, 2, 5])
def test_maximal_runs(spark, min_lines):
    """Repeated rows and whole copies among the texts."""
    texts = random_texts(min_lines, 40, words="one two three four", length=30, sep="\n")
    texts += [(40 + d, t) for d, t in texts[:8]] + texts[5:12] + [(60, "\n".join(["same"] * 21))]
    got = rows(line_dedup.maximal_runs(spark.createDataFrame(texts, DOCS), min_lines, 0))
    assert got == maximal_runs(texts, min_lines) != []
    assert max(e - s for _, s, e, _, _ in got) >= 19
