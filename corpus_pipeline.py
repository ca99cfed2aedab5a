"""From documents to token ids: language, lines, near copies, benchmark leaks, encoding.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet in the shared folder and read again as the
next one's docs. All but the last return the columns of ``documents``, and any further ones of ``docs``, whatever their names.
No rows in, no rows out of any stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import byte_bpe, decontaminate, language_id, line_dedup, near_copies
from lodeworks.llm.registry import BPE_RANKS, PIECE_RANKS
from lodeworks.llm.rows import free, named, only
from lodeworks.sources.shared import discard, stage
from lodeworks.sources.tables import table


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language of posterior 0.5 or more, go.

    A null or empty text has no letter and goes. Whole texts count, however long. A null id or language isn't learned from, its row is
    judged like any other; ties go to the language first in order; repeated rows share their verdict. Where nothing can be learned, no row stays.
    """
    return language_id.accepted(docs, language_id.train(docs, byte_bpe.load_ranks(PIECE_RANKS)))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen before go; a document goes when all its lines did. n_chars follows the text.

    Null and empty texts have no lines and stay as they are. Of tied lines the first by (doc_id, line) stays, null ids last;
    rows alike in id and text share decisions and stay as often as they come. n_chars of a text that didn't change stays, null included.
    """
    gone, left = free(docs, "removed"), free(docs, "kept")
    done = line_dedup.clean(docs, to=(gone, left)).where((named(gone) == 0) | (named(left) > 0))
    n_chars = F.when(named(gone) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return only(done.withColumn("n_chars", n_chars), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (5-word shingles, similarity 0.8 or more) stays: the one with the smallest id.

    Candidates are found by operator 7's fingerprints and grid, and by bands beyond its four bits; all are verified.
    Null and blank texts are copies of each other; a null id comes after all others; rows alike in id and text are one document.
    """
    return near_copies.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark item contaminates go.

    Null and empty texts match nothing and stay; null ids make no difference; repeated rows stay or go together. An empty benchmark drops nothing.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (little-endian unsigned 32-bit), n_tokens, and whether decoding gives the text again.

    Null and empty texts have no ids. Whole texts are encoded; every row gives one, repeated rows too. Further columns are left out.
    """
    ranks = byte_bpe.load_ranks(BPE_RANKS)
    coded = byte_bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", "ids", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language_id", detect_language),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("byte_bpe", tokenize),
]

#: No SQL: near copies and the tokenizer are not expressible; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        former, docs = docs, stage(work(spark, docs, sf_dir), name)
        discard(former)
    return docs
