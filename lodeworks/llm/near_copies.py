"""Near copies by verified shingle similarity: SimHash near-dedup (operator 7) for a corpus pipeline, at similarity 0.8.

A document is the set of its shingles of five consecutive words (A-Z lowered, cut at ASCII white space), hashed as in
:mod:`lodeworks.llm.simhash`. Two documents are near copies when the Jaccard similarity of their sets is 0.8 or more.

* Candidates by fingerprint: operator 7 as it is, on these shingles. The grid of segment popcounts links fingerprints within four bits,
  and each component of linked fingerprints is a cell.
* Why not the grid alone: at similarity 0.8 fingerprints differ in about ten of 64 bits, in sixteen now and then. For
  that radius a grid of segment popcounts has to ask for so little in common that all points are crowded.
* Candidates beyond four bits: bands of MinHash values, a cell for each band (``LEVELS``: bands, values in a band). By the first level
  a pair of similarity s shares a cell with probability 1 - (1 - s^5)^24: 0.99993 at 0.8, more above.
* Verification: exact, on the sets themselves, made anew from the text for the documents that share a cell only.
* Cells of up to ``crowd`` sets give their pairs. Larger ones never do: every set in them first meets the ``LEADERS`` sets of
  smallest hash in its largest cell, which joins a group of copies at a cost linear in its size. A cell whose sets
  are all in one component then is done. Else the sets outside its largest component meet all sets of the cell, ``BLOCK`` at a time,
  or, if they are more than a block, all its sets are dealt out again by the next level's longer bands. Slices of a large cell are
  compared in tasks of their own; a task holds one block of sets. No set and no link is dropped. At the last level, a cell
  whose n sets share ten MinHash values and yet fall into many components costs up to n x n / ``BLOCK`` rows.
* Equal sets are one point throughout.

Components come from :func:`lodeworks.operators.graph.connected_components`. Defined cases: null and blank texts have
the empty set and are copies of each other only; fewer words than a shingle: the whole sequence is the one shingle. Repeated
rows are one document. Other columns go along, whatever their names. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.arrow import mapped
from lodeworks.llm.rows import keys, named, packed, unpacked
from lodeworks.llm.simhash import fingerprint_of, near_links, shingle_hashes
from lodeworks.operators.graph import connected_components
from lodeworks.sources.shared import discard, noted, stage

WIDTH, SIMILARITY, CROWD = 5, 0.8, 16
LEVELS = ((24, 5), (86, 10))
LEADERS, BLOCK, SLICE = 16, 64, 256
#: Rows (three longs each) that may be broadcast.
BROADCAST_ROWS = 500_000


@cache
def _seeds(level: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(42 + level)
    n = LEVELS[level][0] * LEVELS[level][1]
    return draw.integers(0, 2**64, n, np.uint64), draw.integers(0, 2**64, n, np.uint64) | np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return set_of(shingle_hashes(text, width))


def set_of(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, np.uint64))


def band_cells(members: np.ndarray, level: int = 0) -> list[int]:
    """A cell for each band, none for the empty set."""
    if not len(members):
        return []
    (xor, odd), (bands, values) = _seeds(level), LEVELS[level]
    least = np.full(bands * values, 2**64 - 1, np.uint64)
    for at in range(0, len(members), 2048):
        np.minimum(least, ((members[at : at + 2048, None] ^ xor) * odd).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(b.tobytes(), bands * level + i) - 2**63 for i, b in enumerate(least.reshape(bands, values))]


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, doc_id, node, cells, fp): node names the set, fp is the fingerprint as a signed long."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                b = whole.slice(at, 1024)
                sets, prints = [], []
                for t in b.column(3):
                    hashes = shingle_hashes(t.as_py(), WIDTH)
                    sets.append(set_of(hashes))
                    prints.append(fingerprint_of(hashes))
                fp = pa.array(np.array(prints, np.uint64).view(np.int64))
                node = pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), node, pa.array([band_cells(s) for s in sets], pa.list_(pa.int64())), fp], names=["k1", "k2", "doc_id", "node", "cells", "fp"])

    rows = docs.select(*keys(named(doc_id), named(text)), named(doc_id).alias("doc_id"), named(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return mapped(rows, read, f"k1 long, k2 long, doc_id {kind}, node long, cells array<long>, fp long")


def sets_of(texts: DataFrame) -> DataFrame:
    """(node, members): the sets of (node, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                b = whole.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["node", "members"])

    return mapped(texts, read, "node long, members binary")


def _alike(a: np.ndarray, flat: np.ndarray, size: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the sets that stand behind each other in ``flat`` are within ``similarity`` of ``a``."""
    hit = a[np.minimum(np.searchsorted(a, flat), len(a) - 1)] == flat
    both = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
    return both >= similarity * (len(a) + size - both) - 1e-9


def verified_pairs(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of (a, b, x, y) whose sets x and y are alike."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(v.as_py(), np.uint64) for v in b.column(i)] for i in (2, 3))
            near = [bool(_alike(p, q, np.array([len(q)]), similarity)[0]) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    return mapped(pairs, check, "a long, b long")


def compared(members: DataFrame, leaders: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between the ``members`` of each cell and its ``leaders`` (both cell, node; leaders also block, members also n and blocks).

    A cell is cut into slices of about ``SLICE`` members, each of which meets every block of leaders in a task of its own.
    """
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    m = members.select("cell", "node", F.pmod(F.xxhash64("node", F.lit(1)), slices).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("last"))
    wide = leaders.join(members.groupBy("cell").agg(F.max(slices).alias("slices")), "cell")
    ahead = wide.select("cell", "node", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "block", F.lit(0).alias("last"))
    key = ["cell", "slice", "block"]
    both = ahead.unionByName(m).join(sets, "node").select(F.xxhash64(*key).alias("key"), "last", "node", "members")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, held, flat, size = None, [], [], np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            a, b = [], []
            for key, last, node, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                own = np.frombuffer(raw.as_py(), np.uint64)
                if key != now:
                    now, names, held, flat = key, [], [], None
                if not last:
                    names.append(node)
                    held.append(own)
                    continue
                if flat is None:
                    flat, size, held = np.concatenate(held) if held else np.empty(0, np.uint64), np.array([len(h) for h in held]), []
                if names:
                    met = np.flatnonzero(_alike(own, flat, size, similarity)).tolist()
                    a += [names[i] for i in met if names[i] != node]
                    b += [node for i in met if names[i] != node]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = both.repartition("key").sortWithinPartitions("key", "last")
    return mapped(dealt, check, "a long, b long").distinct()


def finer_cells(nodes: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """(node, cell) by the bands of ``level``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [band_cells(np.frombuffer(m.as_py(), np.uint64), level) for m in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, pa.list_(pa.int64()))], names=["node", "cells"])

    made = mapped(sets.join(nodes, "node", "left_semi").select("node", "members"), deal, "node long, cells array<long>")
    return made.select("node", F.explode("cells").alias("cell"))


def crowded_links(crowded: DataFrame, sets: DataFrame, links: DataFrame, similarity: float, crowd: int, level: int) -> DataFrame:
    """(a, b): links that, with ``links``, connect all alike sets of the cells ``crowded`` (cell, node, n)."""
    largest = crowded.groupBy("node").agg(F.max(F.struct("n", "cell")).alias("c")).select("node", "c.cell", "c.n", F.lit(1).alias("blocks"))
    first = Window.partitionBy("cell").orderBy(F.xxhash64("node"), "node")
    leaders = largest.withColumn("r", F.row_number().over(first)).where(F.col("r") <= LEADERS).select("cell", "node", F.lit(0).alias("block"))
    found = stage(compared(largest, leaders, sets, similarity), "led", gather=True)
    part = connected_components(links.union(found), "a", "b").withColumnRenamed("component", "part")
    inside = crowded.join(part, "node", "left").select("cell", "node", "n", F.coalesce("part", "node").alias("part"))
    inside = stage(inside, "inside", gather=True)
    size = inside.groupBy("cell", "part").agg(F.count("*").alias("k"))
    split = size.groupBy("cell").agg(F.count("*").alias("parts"), F.max(F.struct("k", "part")).alias("most"), F.sum("k").alias("all")).where("parts > 1")
    split = stage(split.select("cell", F.col("most.part").alias("main"), (F.col("all") - F.col("most.k")).alias("others")), "split", gather=True)
    open_cells, last = split, level + 1 == len(LEVELS)
    if not last:
        many = split.where(F.col("others") > BLOCK)
        if not many.isEmpty():
            nodes = inside.join(many, "cell", "left_semi").select("node").distinct()
            known = stage(links.union(found), "links", gather=True)
            found = stage(found.union(cell_links(finer_cells(nodes, sets, level + 1), sets, known, similarity, crowd, level + 1)), "links", gather=True)
        open_cells = split.where(F.col("others") <= BLOCK)
    if not open_cells.isEmpty():
        # a block holds about BLOCK sets; blocks of a cell of few others are one
        blocks = F.ceil(F.col("others") / BLOCK).cast("int")
        mixed = inside.join(open_cells, "cell")
        alone = mixed.where("part <> main").select("cell", "node", F.pmod(F.xxhash64("node", F.lit(2)), blocks).cast("int").alias("block"))
        found = stage(found.union(compared(mixed.select("cell", "node", "n", blocks.alias("blocks")), alone, sets, similarity)), "links", gather=True)
    return found


def cell_links(cells: DataFrame, sets: DataFrame | None, known: DataFrame | None, similarity: float, crowd: int, level: int, sets_for=None) -> DataFrame:
    """(a, b): links that, with ``known``, connect all alike sets that share one of ``cells`` (node, cell).

    sets_for: makes the table of sets (node, members) from the nodes (node) that need one, where ``sets`` isn't given.
    """
    size = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    together = stage(cells.join(size, "cell"), "cells", gather=True)
    calm, crowded = together.where(F.col("n") <= crowd), together.where(F.col("n") > crowd)
    other = calm.select("cell", F.col("node").alias("b"))
    pairs = stage(calm.select("cell", F.col("node").alias("a")).join(other, "cell").where("a < b").select("a", "b").distinct(), "pairs", gather=True)
    if sets is None:
        sets = sets_for(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowded.select("node")).distinct())
    x, y = (sets.select(F.col("node").alias(k), F.col("members").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    found = stage(verified_pairs(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), similarity), "links", gather=True)
    if not crowded.isEmpty():
        found = found.union(crowded_links(crowded, sets, found if known is None else found.union(known), similarity, crowd, level))
    return found


def grid_cells(rows: DataFrame) -> DataFrame:
    """(node, cell): sets whose fingerprints (node, fp) the grid links, at four bits or fewer and over others, share a cell."""
    parts = connected_components(near_links(rows.select("fp").distinct()), "a", "b").select(F.col("node").alias("of"), "component")
    named_by = F.xxhash64(F.lit("fingerprints"), F.coalesce("component", "fp"))
    return rows.distinct().join(parts, F.col("fp") == F.col("of"), "left").select("node", named_by.alias("cell"))


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """A row per document: k1, k2, doc_id, part."""
    rows = stage(signatures(docs, doc_id, text), "signatures", gather=True)
    cells = rows.groupBy("node").agg(F.first("cells").alias("cells")).select("node", F.explode("cells").alias("cell"))
    # the empty set is alike to no other
    cells = cells.union(stage(grid_cells(rows.where(F.size("cells") > 0).select("node", "fp")), "grid", gather=True))

    def sets_for(nodes: DataFrame) -> DataFrame:
        one = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("r")).select("node", "r.k1", "r.k2")
        one = stage(one, "chosen", gather=True)
        near = F.broadcast(one) if one.count() <= BROADCAST_ROWS else one
        texts = docs.select(*keys(named(doc_id), named(text)), named(text).alias("text")).join(near, ["k1", "k2"]).select("node", "text")
        # rows alike in id and text have one set
        return stage(sets_of(texts).dropDuplicates(["node"]), "sets", gather=True)

    parts = connected_components(cell_links(cells, None, None, similarity, crowd, 0, sets_for), "a", "b").withColumnRenamed("node", "of")
    return rows.join(parts, F.col("node") == F.col("of"), "left").select("k1", "k2", "doc_id", F.coalesce("component", "node").alias("part"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component stays: the one with the smallest id, ids before nulls; columns unchanged."""
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("k1"), F.col("k2"))
    with noted() as tables:
        every = stage(components(docs, doc_id, text), "parts", gather=True)
        best = stage(every.groupBy("part").agg(F.min(rank).alias("r")).select("part", F.col("r.k1").alias("b1"), F.col("r.k2").alias("b2")), "best", gather=True)
        gone = every.join(best, "part").where("k1 <> b1 or k2 <> b2").select("k1", "k2").distinct()
        gone = stage(gone, "gone", gather=True)
        twice = every.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1")
        few = gone.count() <= BROADCAST_ROWS and twice.isEmpty()
    discard(*(t for t in tables if t is not best and t is not gone))
    rows = packed(docs, i=doc_id, t=text).select(*keys(F.col("i"), F.col("t")), "row")
    if few:  # texts stay where they are
        return unpacked(rows.join(F.broadcast(gone), ["k1", "k2"], "left_anti"), docs.columns)
    # rows alike in id and text are one document
    one = best.select(F.col("b1").alias("k1"), F.col("b2").alias("k2"))
    return unpacked(rows.join(one, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]), docs.columns)
