"""Leaves of JSON settings as ``a:b:c`` keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.sources.shared import stage

AT_ONCE = 4


def flatten_json(rows: DataFrame, column: str) -> DataFrame:
    """Each row's leaves: key, value (text) and the other columns. Arrays are leaves; bad JSON, scalar roots and empty objects give none.

    Every level is one explode of the objects that are left, leaves pass through; after ``AT_ONCE`` levels what still holds objects goes
    on as JSON text in a table, so a plan's length doesn't follow the depth of the settings and no depth is cut.
    """
    others = [c for c in rows.columns if c != column]
    is_map = lambda v: f"startswith(schema_of_variant({v}), 'OBJECT')"
    entries = lambda v: f"map_entries(try_variant_get({v}, '$', 'map<string,variant>'))"
    inside = rows.select(*others, F.lit("").alias("key"), F.expr(f"try_parse_json({column})").alias("v")).where(F.expr(is_map("v")))
    found = None
    while True:
        for _ in range(AT_ONCE):
            down = f"transform({entries('v')}, x -> struct(if(key = '', x.key, concat(key, ':', x.key)) as key, x.value as v))"
            inside = inside.select(*others, F.expr(f"explode(if({is_map('v')}, {down}, array(struct(key, v))))").alias("e")).select(*others, F.col("e.key").alias("key"), F.col("e.v").alias("v"))
        made = stage(inside.select(*others, "key", F.expr("cast(v as string)").alias("value"), F.expr(is_map("v")).alias("deeper"), F.expr("to_json(v)").alias("json")), "leaves", gather=True)
        leaves = made.where("not coalesce(deeper, false)").select(*others, "key", "value")
        found = leaves if found is None else found.unionByName(leaves)
        more = made.where("deeper")
        if more.isEmpty():
            return found
        inside = more.select(*others, "key", F.expr("parse_json(json)").alias("v"))
