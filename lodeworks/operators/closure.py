"""Closures over edge tables, by rounds of frontier joins.

Every round joins the newest pairs with the edges and keeps those not seen before, by one anti-join with all rounds before it; a round is
written to the shared folder. Rounds are as many as the longest path; a cycle ends when it brings nothing new.

Staged tables are small as files and large as rows (sorted keys in Parquet), so a size estimate would broadcast them through the driver,
each round anew: their joins are merge joins, which adaptive execution splits where a key is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.sources.shared import stage, together


def closure(edges: DataFrame, src: str = "src", dst: str = "dst", onward: str | None = None, roots: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """(root, node, depth): what each root reaches, by its shortest way.

    onward: a boolean edge column; a node reached only by edges that are not onward is reached but not gone on from.
    roots: (root) to start from, all sources by default. blocked: (node) that the walk stops before.
    """
    step = edges.select(F.col(src).alias("s"), F.col(dst).alias("node"), (F.col(onward) if onward else F.lit(True)).alias("go")).groupBy("s", "node").agg(F.max("go").alias("go"))
    if blocked is not None:
        step = step.join(blocked.select("node").distinct().hint("merge"), "node", "left_anti")
    step = stage(step, "edges", gather=True)
    new = step.where("s is not null").select(F.col("s").alias("root"), "node", "go")
    if roots is not None:
        new = new.join(roots.select("root").distinct().hint("merge"), "root", "left_semi")
    depth = 1
    front = stage(new.withColumn("depth", F.lit(depth)), "front", gather=True)
    seen = [front]  # (root, node, go, depth): pairs as they are first reached, or first reached by an onward edge
    while not front.isEmpty():
        depth += 1
        going = front.where("go").select("root", F.col("node").alias("s"))
        front = going.join(step.hint("merge"), "s").groupBy("root", "node").agg(F.max("go").alias("go"))
        # pairs that go on are done with; of the others an onward edge can still bring news
        known = together(seen).select(F.col("root").alias("r"), F.col("node").alias("n"), F.col("go").alias("was"))
        front = front.join(known.hint("merge"), (F.col("root") == F.col("r")) & F.col("node").eqNullSafe(F.col("n")) & (F.col("was") | ~F.col("go")), "left_anti")
        front = stage(front.withColumn("depth", F.lit(depth)), "front", gather=True)
        seen.append(front)
    pairs = together(seen)
    if onward is None:  # every pair goes on, so none is met twice
        return pairs.select("root", "node", "depth")
    return pairs.groupBy("root", "node").agg(F.min("depth").alias("depth"))


def exclusive_subtree(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): what a root reaches and no other root does."""
    reach = closure(edges, roots=roots)
    alone = reach.groupBy("node").agg(F.count("*").alias("n"), F.min("root").alias("root")).where("n = 1")
    return alone.select("root", "node")


def strongest_requirement(edges: DataFrame, version: str) -> DataFrame:
    """(root, node, required): the largest version asked for along any way from a root."""
    reach = closure(edges).select("root", F.col("node").alias("s"))
    every = reach.union(edges.select(F.col("src"), F.col("src")).distinct())
    asked = edges.select(F.col("src").alias("s"), F.col("dst").alias("node"), F.col(version).alias("v")).groupBy("s", "node").agg(F.max("v").alias("v"))
    return every.join(asked.hint("merge"), "s").groupBy("root", "node").agg(F.max("v").alias("required"))


def fixpoint(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): nodes found from ``seeds`` (node) along (src, dst), seeds at 0."""
    start = seeds.select("node").distinct()
    found = closure(edges, roots=start.select(F.col("node").alias("root"))).select("node", "depth")
    return start.withColumn("depth", F.lit(0)).union(found).groupBy("node").agg(F.min("depth").alias("depth"))


def everywhere(rows: DataFrame, of: list[str], over: list[str], holds: str) -> DataFrame:
    """Relational division: groups ``of`` where ``holds`` is true in each of their ``over`` groups."""
    each = rows.groupBy(*of, *over).agg(F.bool_or(F.coalesce(F.col(holds), F.lit(False))).alias("ok"))
    return each.groupBy(*of).agg(F.bool_and("ok").alias("ok"), F.count("*").alias("places")).where("ok").drop("ok")
