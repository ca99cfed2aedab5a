"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import byte_bpe, chat_format, decontaminate, exact_dedup, language_id, line_dedup, simhash, span_dedup, token_shards, url_filter
from lodeworks.sources.shared import shared_path
from lodeworks.sources.tables import table

#: Rank files; their places can be given anew here.
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = spark.sparkContext.broadcast(byte_bpe.load_ranks(BPE_RANKS)), public_tokenizers.PATTERN

    def tokenizer():
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(ranks.value), special_tokens={}).encode_ordinary

    path = shared_path(spark, "shards")
    index = token_shards.materialise(table(spark, sf_dir, "documents"), path, tokenizer, end=50256)
    return index.withColumn("path", F.lit(path))


def op2_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: (host, path, verdict) of the rules for ``pages``.
URL_RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.digests(chat_format.format_chats(rows))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, byte_bpe.load_ranks(PIECE_RANKS))
    rows = docs.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "text")
    return language_id.predict(rows, model).drop("text")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), byte_bpe.load_ranks(BPE_RANKS), public_tokenizers.PATTERN)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k1", "k2")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


QUERIES = {
    "op1_token_shards": op1_token_shards,
    "op2_span_dedup": op2_span_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_language_id": op5_language_id,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_simhash": op7_simhash,
    "op8_url_filter": op8_url_filter,
    "op9_decontaminate": op9_decontaminate,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE = {
    "op4_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(role) + length(text) + 16
    + 2 * length(role || text) - length(replace(role || text, '\', '')) - length(replace(replace(replace(role || text, '<', ''), '[', ''), '|', '')) AS n
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens
FROM e GROUP BY conv_id
""",
    "op10_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
""",
}
