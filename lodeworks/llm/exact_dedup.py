"""Exact dedup by content-defined chunk recipes (operator 10), DataFrame functions only.

A text, A-Z lowered, is cut where its own bytes say so: behind a window of three bytes each of which is in a class of its own
(``CLASSES``), ``LEAST`` bytes after the last cut at the earliest and ``MOST`` at the latest. A cut depends on the window
alone, so an edit changes the chunks around it and the cuts meet again behind it.

* Chunks. All chunks are put together by their bytes: distinct ones are counted with a map-side combine, so each chunk's bytes are moved
  once from each task that has it, however many documents hold it. A chunk gets an identifier: the row number of its 128-bit hash in the
  table of chunks. Identifiers are verified by that: a hash behind which two different byte strings stand is seen there, and the
  table is made anew with other hashes (``salt``) until there is none.
* Recipes. A document is the ordered list of its chunks' identifiers. Documents are equal when their lists are; that list is the only key
  of a group. Long documents aren't moved: their chunks' hashes are, then their identifiers.
* Groups are counted with a map-side combine, and the groups' rows meet their keeper in an equi-join that adaptive
  execution can split, so a group may hold a third of all rows. The same holds for a chunk that is in a third of them.

The SHA-256 of a text is output and decides nothing.

Defined cases: null text is the empty text, which has the empty recipe; all such rows are one group. Of rows equal in
text and id, one stays (the one read last). A null doc_id loses to any other; a group of null ids has keep_id null and
one row that stays. No rows in, no rows out. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.rows import ascii_lower, named, packed, unpacked
from lodeworks.sources.shared import discard, stage

LEAST, MOST = 256, 4096
#: The bytes of each place of the window: every fourth or so, spread by a multiplication.
CLASSES = tuple("".join(f"\\x{b:02x}" for b in range(256) if b * factor % 256 < 60) for factor in (157, 89, 203))


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text's UTF-8 bytes in order, each byte as one character; joined they are the bytes."""
    window = "".join(f"[{c}]" for c in CLASSES)
    cut = rf"(?s).{{{least - 3},{most - 3}}}?{window}|.{{1,{most}}}"
    return F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(cut), F.lit(0))


def hashed(chunk: Column, salt: int) -> Column:
    """struct(h1, h2): 128 bits of a chunk."""
    return F.struct(F.xxhash64(F.lit(2 * salt), chunk).alias("h1"), F.xxhash64(F.lit(2 * salt + 1), chunk).alias("h2"))


def chunk_table(docs: DataFrame, text: str = "text", least: int = LEAST, most: int = MOST, salt: int = 0, hashes: Callable[[Column, int], Column] = hashed) -> DataFrame:
    """h1, h2, contents (different byte strings behind the hash: 1 if it is verified), copies."""
    piece = docs.select(F.explode(chunks(ascii_lower(named(text)), least, most)).alias("c")).select(hashes(F.col("c"), salt).alias("h"), "c")
    distinct = piece.groupBy("h.h1", "h.h2", "c").agg(F.count("*").alias("n"))
    return distinct.groupBy("h1", "h2").agg(F.count("*").alias("contents"), F.sum("n").alias("copies"))


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hashes: Callable[[Column, int], Column] = hashed) -> DataFrame:
    """row, doc_id, digest, recipe: each document's list of verified chunk identifiers."""
    norm = docs.select(named(doc_id).alias("doc_id"), ascii_lower(named(text)).alias("t"))
    for salt in count():
        made = F.transform(chunks(F.col("t")), lambda c: hashes(c, salt))  # noqa: B023
        base = stage(norm.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.unhex(F.sha2("t", 256)).alias("digest"), made.alias("hashes")), "hashes")
        table = stage(chunk_table(docs, text, salt=salt, hashes=hashes), "chunks", gather=True)
        if table.where("contents > 1").isEmpty():
            break
        discard(base, table)
    identified = table.select("h1", "h2", F.monotonically_increasing_id().alias("id"))
    pieces = base.select("row", F.posexplode("hashes").alias("at", "h")).select("row", "at", "h.h1", "h.h2")
    lists = pieces.join(identified, ["h1", "h2"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("ids"))
    empty = F.expr("cast(array() as array<bigint>)")
    return base.select("row", "doc_id", "digest").join(lists, "row", "left").select("row", "doc_id", "digest", F.coalesce(F.col("ids.id"), empty).alias("recipe"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hashes: Callable[[Column, int], Column] = hashed) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    base = stage(recipes(docs, doc_id, text, hashes), "recipes", gather=True)
    # a row that stays is the largest by (id present, id, row)
    rank = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("row"))
    # a table, so that what the join reads is dealt out for it alone and can be split
    groups = stage(base.groupBy("recipe").agg(F.max(rank).alias("best"), F.count("*").alias("group_size")), "groups", gather=True)
    return base.join(groups, "recipe").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.size("recipe").alias("n_chunks"),
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose text no other document that stays has; all columns. Ids have to be present and distinct."""
    kept = exact_groups(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("kept_id"))
    return unpacked(packed(docs, i=doc_id).join(kept, F.col("i").eqNullSafe(F.col("kept_id")), "left_semi"), docs.columns)
