"""Clone drift: a commit changed one copy of a clone set and left its siblings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.fix_shape import fix_shaped, rename_only
from lodeworks.operators.relations import anchor_line, newest, touches


def comparable(members: DataFrame, identifiers: DataFrame, exec_lines: DataFrame) -> DataFrame:
    """(set_id, path, comparable): false only where no member has an executable line and none shares an identifier with this one."""
    span = members.select("set_id", "path", "start_line", "end_line")
    runs = span.join(exec_lines, "path").where("line between start_line and end_line").select("set_id").distinct()
    names = span.join(identifiers.select("path", "line", "text"), "path").where("line between start_line and end_line").select("set_id", "path", "text").distinct()
    other = names.select("set_id", F.col("path").alias("p2"), "text")
    shared = names.join(other, ["set_id", "text"]).where("path <> p2").select("set_id", "path").distinct()
    out = span.select("set_id", "path").join(runs.withColumn("r", F.lit(True)), "set_id", "left").join(shared.withColumn("s", F.lit(True)), ["set_id", "path"], "left")
    has = names.select("set_id").distinct().withColumn("k", F.lit(True))  # no evidence at all: comparable
    out = out.join(has, "set_id", "left")
    return out.select("set_id", "path", (F.coalesce("r", F.lit(False)) | F.coalesce("s", F.lit(False)) | F.col("k").isNull()).alias("comparable"))


def detect(members: DataFrame, commits: DataFrame, commit_files: DataFrame, hunks: DataFrame, identifiers: DataFrame, exec_lines: DataFrame) -> DataFrame:
    """(set_id, path, sha, anchor, tier, siblings, catch_ups), one row of a commit and file.

    members: set_id, path, start_line, end_line. Only the newest commit of each path counts (order 0 is the newest), merges don't.
    """
    plain = commits.where("not coalesce(is_merge, false)").select("sha", F.col("log_pos").alias("ord"))
    touched = commit_files.join(plain, "sha").join(members.select("path").distinct(), "path", "left_semi")
    last = newest(touched, "path", "ord").select("path", "sha", "ord")
    m = members.join(last, "path")
    sibling = members.select("set_id", F.col("path").alias("s_path"), F.col("start_line").alias("s_start"), F.col("end_line").alias("s_end"))
    pairs = m.select("set_id", "path", "sha", "ord").join(sibling, "set_id").where("path <> s_path")
    files = commit_files.select("sha", F.col("path").alias("s_path"), F.lit(True).alias("also")).distinct()
    sided = pairs.join(files, ["sha", "s_path"], "left").groupBy("set_id", "path").agg(F.count("also").alias("n"), F.sort_array(F.collect_set("s_path")).alias("siblings")).where("n = 0").drop("n")
    s_last = last.select(F.col("path").alias("s_path"), F.col("sha").alias("s_sha"), F.col("ord").alias("s_ord"))
    later = pairs.join(s_last, "s_path").where("s_ord < ord").groupBy("set_id", "path").agg(F.sort_array(F.collect_set("s_path")).alias("catch_ups"))
    old = hunks.select(F.col("sha").alias("s_sha"), F.col("path").alias("s_path"), F.col("new_start").alias("h_start"), F.col("new_count").alias("h_count"), "old_count").where("old_count > 0")
    earlier = pairs.join(s_last, "s_path").where("s_ord > ord").join(old, ["s_sha", "s_path"]).where(touches(F.col("s_start"), F.col("s_end"), F.col("h_start"), F.col("h_count"))).select("set_id", "path").distinct()
    change = m.join(sided, ["set_id", "path"]).join(earlier, ["set_id", "path"], "left_anti").join(hunks, ["sha", "path"])
    change = change.where(~F.coalesce("is_file_creation", F.lit(False)) & touches(F.col("start_line"), F.col("end_line"), F.col("new_start"), F.col("new_count")))
    change = change.withColumns({"fix": fix_shaped(F.col("added"), F.col("removed")) & ~rename_only(F.col("added"), F.col("removed")), "anchor": anchor_line(F.col("start_line"), F.col("end_line"), F.coalesce("changed_new_lines", F.array().cast("array<int>")), F.col("new_start"))})
    change = change.join(comparable(members, identifiers, exec_lines), ["set_id", "path"], "left").join(later, ["set_id", "path"], "left")
    tier = F.when(F.col("fix") & F.coalesce("comparable", F.lit(True)), "high").otherwise("advisory")
    rows = change.select("set_id", "path", "sha", "anchor", tier.alias("tier"), "siblings", F.coalesce("catch_ups", F.array().cast("array<string>")).alias("catch_ups"))
    one = Window.partitionBy("sha", "path").orderBy(F.desc("tier"), "set_id", "anchor")
    return rows.withColumn("r", F.row_number().over(one)).where("r = 1").drop("r")
