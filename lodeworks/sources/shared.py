"""Intermediate tables in the folder that all executors share.

A written table cuts the lineage as a reliable checkpoint does and survives lost executors; columnar files take
less disk than serialised rows. Who stages a table drops it with :func:`discard` once what was made of it is written.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder made here if the session is local, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodeworks-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_staged: ContextVar[list[DataFrame] | None] = ContextVar("staged", default=None)


@contextmanager
def noted() -> Iterator[list[DataFrame]]:
    """The tables staged within it, as a list: for who wants to delete them once the result is written."""
    tables: list[DataFrame] = []
    token = _staged.set(tables)
    try:
        yield tables
    finally:
        _staged.reset(token)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of each action are deleted when the action is over: its result is written, nobody reads them again."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def stage(df: DataFrame, name: str, gather: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    gather: for rows that are few next to the tasks that make them; adaptive execution puts them together into files of a
    usable size first.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with shuffles_dropped(spark):
        (df.hint("rebalance") if gather else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    if (tables := _staged.get()) is not None:
        tables.append(out)
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """Staged tables of one schema as one scan, whose plan doesn't grow with their number."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t.staged_at for t in tables))


def discard(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing will read again."""
    for t in tables:
        path = getattr(t, "staged_at", None)
        if path:
            context = t.sparkSession.sparkContext
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)
