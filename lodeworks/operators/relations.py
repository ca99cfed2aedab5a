"""Joins that answer questions on declared and referenced things."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unreferenced(declared: DataFrame, referenced: DataFrame, key: str | list[str]) -> DataFrame:
    return declared.join(referenced.select(key if isinstance(key, list) else [key]), key, "left_anti")


def scoped_candidates(declared: DataFrame, name_docs: DataFrame, name: str = "name") -> DataFrame:
    """Declarations whose name is spelled anywhere; an attribute's is also looked up without ``Attribute``."""
    short = F.regexp_replace(name, "Attribute$", "")
    spelled = declared.withColumn("_n", F.explode(F.array_distinct(F.array(F.col(name), F.when(short != "", short).otherwise(F.col(name))))))
    return spelled.join(name_docs.select(F.col(name).alias("_n")).distinct(), "_n", "left_semi").drop("_n").distinct()


def unused_with_evidence(things: DataFrame, contributed: DataFrame, used: DataFrame, key: str, part: str) -> DataFrame:
    """Things known to contribute something of which nothing is used; things without known parts are not judged."""
    live = contributed.join(used.select(part).distinct(), part, "left_semi").select(key)
    return things.join(contributed.select(key).distinct(), key, "left_semi").join(live, key, "left_anti")


def contract_live(implements: DataFrame, references: DataFrame) -> DataFrame:
    """(symbol_id) of implementations whose contract is referenced."""
    return implements.join(references.select(F.col("symbol_id").alias("contract_symbol_id")).distinct(), "contract_symbol_id", "left_semi").select("symbol_id").distinct()


def suffix_unbound(keys: DataFrame, paths: DataFrame) -> DataFrame:
    """Keys ``a:b:c`` that equal no path and end in ``:path`` of none, case-blind; met on the last segment."""
    last = lambda c: F.lower(F.element_at(F.split(c, ":"), -1))
    p = paths.select(F.lower("path").alias("_p"), last(F.col("path")).alias("_last")).distinct()
    k = keys.withColumn("_last", last(F.col("key")))
    low = F.lower("key")
    fits = (low == F.col("_p")) | low.endswith(F.concat(F.lit(":"), F.col("_p")))
    return k.join(p, (k["_last"] == p["_last"]) & fits, "left_anti").drop("_last")


def contained(spans: DataFrame, points: DataFrame, key: list[str], start: str, stop: str, at: str, how: str = "inner") -> DataFrame:
    """Points inside spans of the same key: an equi-join with a range behind it."""
    s, p = spans.alias("s"), points.alias("p")
    same = [F.col(f"s.{k}") == F.col(f"p.{k}") for k in key]
    on = F.col(f"p.{at}").between(F.col(f"s.{start}"), F.col(f"s.{stop}"))
    for c in same:
        on = c & on
    return s.join(p, on, how)


def touches(start: Column, stop: Column, hunk_start: Column, hunk_count: Column) -> Column:
    """A hunk in or next to a region; one of no lines counts as one."""
    end = hunk_start + F.greatest(hunk_count, F.lit(1)) - 1
    return (end >= start - 1) & (hunk_start <= stop + 1)


def anchor_line(start: Column, stop: Column, lines: Column, hunk_start: Column) -> Column:
    """The first changed line inside, else the changed line nearest the start (first of ties), else the hunk's start held inside."""
    inside = F.array_min(F.filter(lines, lambda x: x.between(start, stop)))
    near = F.array_min(F.transform(lines, lambda x, i: F.struct(F.abs(x - start).alias("d"), i.alias("i"), x.alias("x"))))["x"]
    return F.coalesce(inside, near, F.least(F.greatest(hunk_start, start), stop))


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key; order 0 is the newest."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def runs_of(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """(key, runs): how often ``value`` changes along the order, the first counted."""
    w = Window.partitionBy(*key).orderBy(order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return rows.withColumn("_c", change).groupBy(*key).agg(F.sum("_c").cast("bigint").alias("runs"))


def flagged_blocks(rows: DataFrame, key: list[str], line: str, flag: str, least: int = 2, ratio: float = 0.6) -> DataFrame:
    """(key, start, stop, lines, share): islands of consecutive lines of which a share is flagged."""
    w = Window.partitionBy(*key).orderBy(line)
    islands = rows.withColumn("_i", F.col(line) - F.row_number().over(w))
    out = islands.groupBy(*key, "_i").agg(F.min(line).alias("start"), F.max(line).alias("stop"), F.count("*").alias("lines"), F.avg(F.col(flag).cast("double")).alias("share"))
    return out.where((F.col("lines") >= least) & (F.col("share") >= ratio)).drop("_i")


def namespace_of(places: DataFrame, namespaces: DataFrame) -> DataFrame:
    """``places`` (path, line, ...) with ``namespace``: the innermost declared around the line, else the file's own, else null (global).

    namespaces: path, name, line, end_line, file_scoped; a file-scoped one goes to the file's end. Nested names are joined by the caller.
    """
    p = places.withColumn("_id", F.monotonically_increasing_id())
    inside = p.select("_id", "path", F.col("line").alias("_at")).join(namespaces, "path").where("_at >= line and (file_scoped or _at <= end_line)")
    best = inside.groupBy("_id").agg(F.max_by("name", F.struct(~F.col("file_scoped"), "line", -F.coalesce("end_line", F.lit(0)))).alias("namespace"))
    return p.join(best, "_id", "left").drop("_id")


def all_uses(uses: DataFrame, key: str, holds: Column) -> DataFrame:
    """(key, uses): of what is used, where every use ``holds``."""
    return uses.groupBy(key).agg(F.count("*").alias("uses"), F.bool_and(F.coalesce(holds, F.lit(False))).alias("_all")).where("_all").drop("_all")


def written_not_read(uses: DataFrame, key: str, writes: Column, reads: Column) -> DataFrame:
    """(key, uses): of what is used, where a use ``writes`` and none ``reads``."""
    g = uses.groupBy(key).agg(F.count("*").alias("uses"), F.bool_or(writes).alias("_w"), F.bool_or(reads).alias("_r"))
    return g.where("_w and not coalesce(_r, false)").drop("_w", "_r")
