"""Analogue inputs: code-base tables read off the supplied star schema and prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.sources.tables import table

#: The same inputs as SQL, for the oracles.
FINDINGS_SQL = """f AS (SELECT event_id, event_type AS rule_id, event_type || ' title' AS title, CAST(event_id % 4 + 1 AS INTEGER) AS certainty, CAST(event_id % 27 + 1 AS INTEGER) AS category,
  '/repo/src/u' || CAST(user_id AS VARCHAR) || '/e' || CAST(event_id AS VARCHAR) || '.cs' AS file_path, CAST(event_id % 500 + 1 AS INTEGER) AS line_number, CAST(event_id % 80 AS INTEGER) AS character_offset,
  'value ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS message, ts FROM events)"""
FOREST_SQL = "forest AS (SELECT p_partkey AS src, p_partkey // 3 AS dst, p_size % 5 <> 0 AS go, p_size AS version FROM part WHERE p_partkey // 3 > 0)"
LINES_SQL = """lines AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, parts[i] AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""
NS_SQL = """ns AS (SELECT page_id, url, array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')), '.') AS ns FROM pages)"""


def findings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    path = F.concat(F.lit("/repo/src/u"), F.col("user_id").cast("string"), F.lit("/e"), F.col("event_id").cast("string"), F.lit(".cs"))
    return e.select(
        "event_id",
        F.col("event_type").alias("rule_id"),
        F.concat("event_type", F.lit(" title")).alias("title"),
        (F.col("event_id") % 4 + 1).cast("int").alias("certainty"),
        (F.col("event_id") % 27 + 1).cast("int").alias("category"),
        path.alias("file_path"),
        (F.col("event_id") % 500 + 1).cast("int").alias("line_number"),
        (F.col("event_id") % 80).cast("int").alias("character_offset"),
        F.concat(F.lit("value "), F.floor("value").cast("bigint").cast("string")).alias("message"),
        "ts",
    )


def forest(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 3").alias("dst"), (F.col("p_size") % 5 != 0).alias("go"), F.col("p_size").alias("version"))
    return p.where("dst > 0")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def namespaces(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return table(spark, d, "pages").select("page_id", "url", F.array_join(F.reverse(F.split(host, "\\.")), ".").alias("ns"))
