"""Tables in the folder that all executors share, checked broadcasts, and free column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of the tables stored so far, by application.
_stored: dict[str, list[str]] = {}
#: Rows of two or three short columns that are sent to every executor at most.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor shares.

    Where it is unset, a local master gets a temporary folder of its own; any
    other master is refused, as a machine-local folder would be lost with its machine.
    """
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, and gives the planner exact sizes.

    Meant for intermediate tables that are far smaller than the corpus.  They stay until release() or the end of temporary().
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    _stored.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table's folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, first: int = 0) -> None:
    """Deletes the tables that staged() has stored, from the one with this number on; for when what was made from them is written."""
    paths = _stored.get(spark.sparkContext.applicationId, [])
    while len(paths) > first:
        remove(spark, paths.pop())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end, by when everything made from them has to be written."""
    first = len(_stored.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, first)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a stored table, marked for broadcast if it has at most so many rows; else it is joined as the planner sees fit."""
    return F.broadcast(df) if df.count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as the session has cores; a large table, which has more of them by itself, stays as it is.

    A table of one row group is read by one task, which would then do all the work on its texts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df and further columns, each evaluated once for a row however often it is used later.

    The optimizer moves neither conditions nor projections through a generator, and would otherwise
    repeat a column's expression in each of them.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def fresh(df: DataFrame, base: str) -> str:
    """A column name starting with base that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name
