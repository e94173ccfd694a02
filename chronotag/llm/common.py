"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stage_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the one named by ``spark.checkpoint.dir``.  Only a single-machine
    session without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chronotag-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage: a lost executor costs the tasks that follow, not the
    scan that produced the table.  A table to ``keep`` outlives its scope.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _scopes and not keep:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


#: The tables written within each open scope, and where a staged table lies.
_scopes: list[list[str]] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that no result reads any more."""
    for df in tables:
        if path := _paths.pop(df, None):
            _delete(df.sparkSession, path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove the tables staged within, once the results that read them have been
    written elsewhere; outside of any scope they stay, as results are lazy."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Catalyst copies a projected expression into the lambdas that use it, where
    it would run again for every element; a lambda's own variable does not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(name: str, *taken: DataFrame) -> str:
    """``name``, with as many underscores before it as make it clash with no
    column of the tables, whatever the case."""
    names = {c.lower() for df in taken for c in df.columns}
    while name.lower() in names:
        name = f"_{name}"
    return name


#: A key is hot from this share of all rows on, so there are at most as many hot keys.
HOT_SHARES = 512


def join_hot(rows: DataFrame, side: DataFrame, key: str, how: str = "inner", name: str = "hot") -> DataFrame:
    """``rows`` joined with ``side`` on ``key``, which ``side`` has once at most.

    Keys that hold more than 1/HOT_SHARES of the rows, null among them, are
    joined by broadcasting their few rows of ``side``; only the others are
    shuffled, so no task gets a hot key's rows.  ``how`` is inner or left.
    """
    counts = staged(rows.groupBy(key).agg(F.count("*").alias("n")), f"{name}-keys")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r[0] for r in counts.where(F.col("n") * HOT_SHARES > total).select(key).collect()]  # at most HOT_SHARES
    if not hot:
        return rows.join(side, key, how)
    named = [h for h in hot if h is not None]
    is_hot = F.coalesce(F.col(key).isin(named), F.lit(False)) if named else F.lit(False)
    warm = rows.where(is_hot | F.col(key).isNull()).join(F.broadcast(side.where(is_hot)), key, how)
    return warm.unionByName(rows.where(~is_hot & F.col(key).isNotNull()).join(side, key, how))
