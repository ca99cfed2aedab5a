"""The rules: each a function from facts to findings, in RULES by its id, with title and whether it is opt-in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.sources.facts import SCHEMAS, Facts

GUARANTEED, HIGH, MODERATE, ADVISORY = 1, 2, 3, 4


#: The category of each rule's findings, by number (:data:`lodeworks.sinks.reports.CATEGORIES`).
CATEGORY = {
    "R0001": 2, "R0002": 1, "R0003": 5, "R0004": 6, "R0005": 3, "R0006": 4, "R0007": 7, "R0008": 7, "R0009": 8, "R0010": 9, "R0011": 10, "R0012": 11, "R0013": 12, "R0018": 13, "R0019": 14,
    "R0020": 15, "R0021": 16, "R0022": 17, "R0023": 19, "R0024": 20, "R0025": 18, "R0026": 21, "R0027": 19, "R0028": 22, "R0029": 23, "R0030": 24, "R0031": 25, "R0032": 26, "R0033": 27, "R0034": 27,
}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    title: str
    analyse: Callable[[Facts], DataFrame]
    opt_in: str | None = None  # the option that turns it on


RULES: dict[str, Rule] = {}


def rule(rule_id: str, title: str, opt_in: str | None = None):
    def add(f: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
        RULES[rule_id] = Rule(rule_id, title, f, opt_in)
        return f

    return add


def finding(df: DataFrame, rule_id: str, certainty: int | Column, message: Column, path: str | Column = "path", line: str | Column = "line", symbol: str | Column | None = None, ch: str | Column | None = None, related: str | Column | None = None) -> DataFrame:
    """Rows as findings."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    none = F.lit(None)
    return df.select(
        F.lit(rule_id).alias("rule_id"),
        F.lit(RULES[rule_id].title).alias("title"),
        message.alias("message"),
        (certainty if isinstance(certainty, Column) else F.lit(certainty)).cast("tinyint").alias("certainty"),
        F.lit(CATEGORY[rule_id]).cast("tinyint").alias("category"),
        col(path).alias("file_path"),
        col(line).cast("int").alias("line_number"),
        (col(ch) if ch is not None else F.lit(0)).cast("int").alias("character_offset"),
        (col(symbol) if symbol is not None else none).cast("string").alias("symbol_id"),
        (col(related) if related is not None else none).cast("array<struct<file_path:string,line_number:int>>").alias("related"),
    )


def analyse(facts: Facts, options: set[str] = frozenset(), off: set[str] = frozenset(), limits: dict[str, int] | None = None) -> DataFrame:
    """The findings of all rules that are on, in the order of their ids (column order of a union; sort to report).

    limits: by rule id, for rules that have one.
    """
    from lodeworks.rules import code, packages, shapes  # noqa: F401  fills RULES

    dead = {x.lower() for x in off}
    on = [r for k, r in sorted(RULES.items()) if k.lower() not in dead and (r.opt_in is None or r.opt_in in options)]
    parts = [r.analyse(facts, limits[r.rule_id]) if limits and r.rule_id in limits else r.analyse(facts) for r in on]
    if not parts:
        return facts.spark.createDataFrame([], SCHEMAS["findings"])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
