import os

from tessera.functions import shared


def test_tables_are_deleted_when_done(spark):
    kept = shared.staged(spark.range(3), "kept")
    with shared.temporary(spark):
        gone = shared.staged(spark.range(5), "gone")
        assert gone.count() == 5
        path = gone.inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(os.path.dirname(path)) and kept.count() == 3
    path = kept.inputFiles()[0].removeprefix("file://")
    shared.release(spark)
    assert not os.path.exists(os.path.dirname(path))


def test_a_small_table_is_spread_and_values_are_made_once(spark):
    one = spark.range(100).coalesce(1)
    assert shared.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(20)
    assert shared.spread(many) is many
    made = shared.once(one, {"x": one["id"] * 2}).where("x > 10")
    assert made.count() == 94
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("* 2") == 1
