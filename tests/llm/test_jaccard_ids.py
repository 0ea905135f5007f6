"""One doc_id with several texts in the join of similar documents."""

import pytest
from test_brute_force import DOCS

from tessera.llm import jaccard


def words(name, n=60):
    return [f"{name}{i}" for i in range(n)]


@pytest.mark.parametrize("turned", [False, True])
def test_a_doc_id_stands_for_each_of_its_texts(spark, turned):
    near = lambda x: " ".join([*words(x)[:-2], "other", "end"])
    rows = [(1, " ".join(words("a"))), (1, " ".join(words("b"))), (1, " ".join(words("c"))), (2, near("a")), (3, near("b")), (4, near("c")), (5, " ".join(words("d"))), (5, near("d"))]
    docs = spark.createDataFrame(rows[::-1] if turned else rows, DOCS).coalesce(1)
    got = jaccard.similar_documents(docs).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 3), (2, 1, 1), (3, 1, 1), (4, 1, 1), (5, 5, 2)]
    assert {r.doc_id for r in jaccard.keep_one(docs).collect()} == {1, 5}
