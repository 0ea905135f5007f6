import compare
import pytest

import __spark_entry__
from tessera.plans import registry


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_agrees_with_sql(spark, name):
    assert compare.same(spark, registry.QUERIES[name], registry.ORACLES[name], f"{compare.DATA}/sf0.001")


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "docid", "rank", "score"] and df.count() == 400


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
