"""Keys of document rows, and rows carried along whole.

An operator takes the columns it works on under names of its own and the whole row as one struct, and gives the row back
column by column, so no name in a table can clash with a name inside an operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def named(name: str) -> Column:
    """The column called ``name``, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def only(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names``, whatever characters they hold."""
    return df.select(*map(named, names))


def free(df: DataFrame, name: str) -> str:
    """``name``, or one made of it that no column of ``df`` has."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def packed(docs: DataFrame, **columns: str) -> DataFrame:
    """The columns ``columns`` (new name = name in ``docs``), and the whole row as struct ``row``."""
    fields = [named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return docs.select(*(named(c).alias(k) for k, c in columns.items()), F.struct(*fields).alias("row"))


def unpacked(df: DataFrame, names: list[str], made: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``names`` of the rows packed in ``df``, those in ``made`` replaced or, if new, put behind."""
    made = dict(made or {})
    kept = [made.pop(c, F.col(f"row.c{i}")).alias(c) for i, c in enumerate(names)]
    return df.select(*kept, *(v.alias(k) for k, v in made.items()))


def keys(doc_id: Column, text: Column) -> list[Column]:
    """k1, k2: two longs that name a row by its id and text, nulls included.

    Rows alike in both have one key and share every decision.
    """
    return [
        F.xxhash64(doc_id, doc_id.isNull(), F.octet_length(text)).alias("k1"),
        F.xxhash64(F.lit(1), text, text.isNull()).alias("k2"),
    ]


def ascii_lower(text: Column) -> Column:
    """A-Z only, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
