"""Entropy rate: new findings per thousand changed lines, its status, ledger and months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_MIN_LINES = 50


def changed_lines(numstat: DataFrame, excluded_globs: list[str] = ()) -> DataFrame:
    """One row (lines): lines added and deleted in files that no glob excludes."""
    from lodeworks.functions.text import first_glob

    kept = numstat.where(first_glob(F.col("path"), list(excluded_globs)).isNull())
    return kept.agg(F.coalesce(F.sum(F.col("added") + F.col("deleted")), F.lit(0)).cast("bigint").alias("lines"))


def status(min_lines: int = DEFAULT_MIN_LINES) -> Column:
    """Of columns baseline_existed, baseline_sha, is_git, head_sha, dirty, lines; the first that holds."""
    return (
        F.when(~F.col("baseline_existed"), "baseline_seeded")
        .when(F.col("baseline_sha").isNull(), "no_baseline_reference")
        .when(~F.col("is_git") | F.col("head_sha").isNull(), "not_a_git_repository")
        .when(F.col("dirty"), "dirty_working_tree")
        .when(F.col("lines").isNull(), "not_a_git_repository")
        .when(F.col("baseline_sha") == F.col("head_sha"), "unchanged_range")
        .when(F.col("lines") <= 0, "below_minimum_change")
        .when(F.col("lines") < max(min_lines, 1), "below_minimum_change")
        .otherwise("scored")
    )


def rate(new: Column, lines: Column, of: Column) -> Column:
    """Per thousand lines, null where not measured."""
    return F.when(of.isin("scored", "below_minimum_change") & (lines > 0), new * F.lit(1000.0) / lines)


def exceeds(value: Column, of: Column, budget: float | None) -> Column:
    """Over the budget; the budget itself passes."""
    return F.lit(False) if budget is None else F.coalesce((of == "scored") & (value > budget), F.lit(False))


def monthly(ledger: DataFrame) -> DataFrame:
    """(month, new_findings, resolved_findings, lines_changed, rate): by the first seven characters of the date."""
    month = F.substring("recorded_at_utc", 1, 7)
    rows = ledger.withColumn("month", month).where(F.col("month").rlike(r"^\d{4}-(0[1-9]|1[0-2])$"))
    lines = F.sum(F.greatest(F.col("lines_changed"), F.lit(0)))
    out = rows.groupBy("month").agg(F.sum("new_findings").cast("bigint").alias("new_findings"), F.sum("resolved_findings").cast("bigint").alias("resolved_findings"), lines.cast("bigint").alias("lines_changed"))
    return out.withColumn("rate", F.when(F.col("lines_changed") > 0, F.col("new_findings") * F.lit(1000.0) / F.col("lines_changed")))


def upsert(ledger: DataFrame, entries: DataFrame, key: str = "commit_sha") -> DataFrame:
    """The ledger with entries put in by key, sorted by it; an empty key is refused."""
    new = entries.where(F.coalesce(F.col(key), F.lit("")) != "")
    return ledger.join(new.select(key), key, "left_anti").unionByName(new).orderBy(key)
