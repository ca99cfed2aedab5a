"""Complexity of callables from rows of syntax nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.sources.shared import stage, together

#: Decision points; a default label, a discarded arm and ``??`` are none.
DECISIONS = ("if", "while", "do", "for", "foreach", "case", "catch", "filter", "and", "or", "ternary", "arm")
NESTING = ("if", "ternary", "switch", "while", "do", "for", "foreach", "catch")
DEEPENS = (*NESTING, "else", "lambda", "local_function")


def cyclomatic(nodes: DataFrame) -> DataFrame:
    """(body_id, complexity): one and each decision point. nodes: body_id, kind."""
    return nodes.groupBy("body_id").agg((F.lit(1) + F.count_if(F.col("kind").isin(*DECISIONS))).cast("bigint").alias("complexity"))


def cognitive_of(nodes: DataFrame) -> DataFrame:
    """(body_id, complexity) of nodes whose nesting is known. nodes: body_id, kind, nesting."""
    score = F.when(F.col("kind").isin(*NESTING), F.lit(1) + F.col("nesting")).when(F.col("kind").isin("goto", "else", "else_if", "operators"), F.lit(1)).otherwise(F.lit(0))
    return nodes.groupBy("body_id").agg(F.sum(score).cast("bigint").alias("complexity"))


def nested(nodes: DataFrame) -> DataFrame:
    """Nodes with ``nesting``: how many nodes around them deepen. nodes: body_id, node_id, parent_id, kind.

    Each round a node adds what the node it points at has summed up and points where that one pointed, so way and sum double: as many joins
    as the depth has binary digits. Nodes that point nowhere are done. ``else_if`` keeps its level. What hangs on no root, by a parent that
    isn't there or a circle, is left out. Nothing is broadcast: staged nodes are small as files and large as rows.
    """
    own = F.col("kind").isin(*DEEPENS).cast("int")
    last = stage(nodes.withColumns({"_at": F.col("parent_id"), "_sum": own}), "nodes")
    rounds, reach, largest = [last], 1, None
    while not (open_ := last.where("_at is not null")).isEmpty():
        if reach >= 64:  # deeper than code is: a circle never ends, and no way is longer than its body has nodes
            largest = largest or rounds[0].groupBy("body_id").count().agg(F.max("count")).first()[0]
            if reach > largest:
                break
        there = together(rounds).where("_at is null").unionByName(open_).select("body_id", F.col("node_id").alias("_at"), F.col("_at").alias("_next"), F.col("_sum").alias("_more"))
        met = open_.join(there.hint("merge"), ["body_id", "_at"])
        last = stage(met.select(*nodes.columns, F.col("_next").alias("_at"), (F.col("_sum") + F.col("_more")).alias("_sum")), "nodes", gather=True)
        rounds.append(last)
        reach *= 2
    return together(rounds).where("_at is null").select(*nodes.columns, (F.col("_sum") - own).alias("nesting"))


def operator_runs(nodes: DataFrame) -> DataFrame:
    """Boolean operators in pre-order (body_id, tree_id, ord, operator) as one node of kind ``operators`` for each run."""
    w = Window.partitionBy("body_id", "tree_id").orderBy("ord")
    marked = nodes.withColumn("_before", F.lag("operator").over(w))
    return marked.where(~F.col("operator").eqNullSafe(F.col("_before"))).select("body_id", F.lit("operators").alias("kind"), F.lit(0).alias("nesting"))


def cognitive(nodes: DataFrame) -> DataFrame:
    """(body_id, complexity). nodes: body_id, node_id, parent_id, ord, kind, operator (and, or of boolean operators; their tree is the parent_id)."""
    nodes = stage(nodes.select("body_id", "node_id", "parent_id", "ord", "kind", "operator"), "syntax")
    placed = nested(nodes.select("body_id", "node_id", "parent_id", "kind")).select("body_id", "kind", "nesting")
    boolean = nodes.where("operator in ('and', 'or')").withColumn("tree_id", F.col("parent_id"))
    return cognitive_of(placed.where(~F.col("kind").isin("and", "or")).union(operator_runs(boolean)))


def over(scores: DataFrame, limit: int = 15) -> DataFrame:
    return scores.where(F.col("complexity") > limit)
