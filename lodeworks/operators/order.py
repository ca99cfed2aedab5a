"""Positions in a global order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.sources.shared import stage


def number_rows(df: DataFrame, keys: list, name: str = "pos") -> DataFrame:
    """Number rows from 1 in the order of ``keys`` without one task that sees them all.

    A range sort, places inside each part, and the parts' counts summed up (a row for each part).
    """
    placed = stage(df.orderBy(*keys).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    first = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    return placed.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_place") + 1).drop("_id", "_part", "_place", "_first")
