"""Columns made in Python, Arrow batch by Arrow batch."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodeworks.llm.rows import only


#: Rows of an Arrow batch. Texts can be long, and a batch is held by the executor and by its Python worker at once.
ROWS = 256


def give_back() -> None:
    """Freed memory goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def _giving_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``; at a task's end the worker, which lives on, gives freed memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` with batches of ``ROWS`` rows at most (a setting of the session from then on)."""
    setting, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(setting)) <= ROWS:
        conf.set(setting, str(ROWS))
    return df.mapInArrow(_giving_back(work), schema)


def add_columns(df: DataFrame, source: str, made: dict[str, pa.DataType], factory: Callable[[], Callable[[list], list[list]]]) -> DataFrame:
    """``df`` with the columns ``made`` (replaced where present), a batch at a time.

    ``factory`` runs once for a task and gives the function from the values of ``source`` to one list for each column; what
    the function has as ``finish`` runs at the task's end, as workers live on.
    """
    kept = [c for c in df.columns if c not in made]
    at = kept.index(source)
    names = [f"c{i}" for i in range(len(kept) + len(made))]  # names with dots can't be mapped

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = factory()
        for b in batches:
            new = [pa.array(v, k) for v, k in zip(make(b.column(at).to_pylist()), made.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=names)
        getattr(make, "finish", int)()

    kinds = {pa.string(): T.StringType(), pa.binary(): T.BinaryType(), pa.float64(): T.DoubleType(), pa.int64(): T.LongType()}
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, [*(df.schema[c].dataType for c in kept), *map(kinds.get, made.values())], strict=True)])
    return mapped(only(df, kept).toDF(*names[: len(kept)]), work, schema).toDF(*kept, *made)
