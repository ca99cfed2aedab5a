"""Graph operators over edge DataFrames: components, closures, relational division."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.sources.shared import discard, stage


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Alternating large-star and small-star steps. Each step is an aggregation with a map-side combine and one
    equi-join that adaptive execution can split, so a hub with a third of all edges is dealt out. Every round is
    written to the shared folder, the one before it deleted; a loop ends when a round changes nothing. Null ends and
    loops are dropped.
    """
    e = stage(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "star",
        gather=True,
    )
    before = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == before or now[0] == 0:
            break
        before = tuple(now)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(low.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        former, e = e, stage(hooked.union(low.select("u", F.col("m").alias("v"))).distinct(), "star", gather=True)
        discard(former)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
