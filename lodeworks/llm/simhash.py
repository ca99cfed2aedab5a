"""SimHash near-dedup by segment popcounts (operator 7).

Fingerprints: a document's words (A-Z lowered, cut at ASCII white space), its shingles of consecutive words, XXH64 of
each (seed 42); a bit is set where over half of the hashes have it. Equal fingerprints are collapsed first, so exact
copies never meet in pairs.

Linking distinct fingerprints at ``radius`` differing bits or fewer:

* Embedding. The 64 bits are 32 segments of two; a fingerprint is the point of its 32 bit counts. The Manhattan distance
  of two points is at most the Hamming distance of the fingerprints. Counts are held in unary, so that the Manhattan
  distance is the number of differing bits of two points.
* Grid range join. The coordinates are eight groups of four. Points within a Manhattan distance of 4 agree in at least
  four groups, so they share a cell of one of the C(8, 4) = 70 grids that each keep four of the groups. A point's cells
  are made once, after the points are dealt out anew; cells are counted with a map-side combine and lone points drop out.
* Inside a cell the range condition is tested on the points first; the exact Hamming distance only for pairs in range.
  A cell emits a forest that spans its links, never its pairs.
* Crowded cells (over ``crowd`` points) are not compared in one task. Fingerprints within 4 bits have one within 2 bits
  of both, so their points meet under each of the 2,081 values within 2 bits of them; all points of such a group are in
  range of each other, there are 2,081 at most, and linking them to the least needs no pair. No point or link is dropped.

Components come from the star algorithm of :mod:`lodeworks.operators.graph`; nothing goes to the driver but counts.

Defined cases: null and blank texts have fingerprint zero and link like any other; fewer words than a shingle: the
whole sequence is the one shingle. component_id is the smallest non-null doc_id of the component, null if it has none.
Repeated rows repeat in the result. No rows in, no rows out. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.arrow import mapped
from lodeworks.llm.rows import keys, named, packed, unpacked
from lodeworks.operators.graph import connected_components
from lodeworks.sources.shared import discard, noted, stage

CROWD = 4096
#: Segments are two bits, groups of coordinates a byte.
GROUPS, ALIKE = 8, 4


def shingle_hashes(text: str | None, width: int) -> list[int]:
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return []
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, width: int = 4) -> int:
    return fingerprint_of(shingle_hashes(text, width))


def fingerprint_of(hashes: list[int]) -> int:
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(k1, k2, doc_id, fp): fp as a signed long."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(3)), np.uint64, len(b)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(fp)], names=["k1", "k2", "doc_id", "fp"])

    rows = docs.select(*keys(named(doc_id), named(text)), named(doc_id).alias("doc_id"), named(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return mapped(rows, read, f"k1 long, k2 long, doc_id {kind}, fp long")


def points_of(fp: np.ndarray) -> np.ndarray:
    """The counts of the 32 segments, each in unary: 00, 01 or 11."""
    low, high = fp & np.uint64(0x5555555555555555), (fp >> np.uint64(1)) & np.uint64(0x5555555555555555)
    return (low | high) | (low & high) << np.uint64(1)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of points: at most the Hamming distance of the fingerprints."""
    return np.bitwise_count(a ^ b)


#: The groups of coordinates that each grid keeps.
GRIDS = np.array([sum(0xFF << 8 * i for i in c) for c in combinations(range(GROUPS), ALIKE)], np.uint64)
_SALT = (np.arange(len(GRIDS), dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def cells(points: DataFrame) -> DataFrame:
    """(cell, fp): the cell of every point in every grid. Two cells that collide are one; verification keeps that harmless."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 2000):
                part = fp[at : at + 2000]
                cell = (points_of(part)[:, None] & GRIDS) ^ _SALT
                cell ^= cell >> np.uint64(31)
                cell *= np.uint64(0xBF58476D1CE4E5B9)
                cell ^= cell >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([pa.array(cell.ravel().view(np.int64)), pa.array(np.repeat(part, len(GRIDS)).view(np.int64))], names=["cell", "fp"])

    # a point makes 70 rows, so points are dealt by a key that no shuffle before has used: one by fp would be left out and its small
    # parts merged into a few tasks
    parts = -(-int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    return mapped(points.select("fp").repartition(parts, F.xxhash64("fp")), deal, "cell long, fp long")


def _forest(fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that span the components of the points of one cell, breadth first, a row of distances at a time."""
    at, rest = points_of(fp), np.arange(len(fp))
    while len(rest):
        root, front, rest = fp[rest[0]], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            step = max(1, 4_000_000 // len(rest))
            for k in range(0, len(front), step):
                some = front[k : k + step]
                i, j = np.nonzero(manhattan(at[some, None], at[rest]) <= radius)
                near[j[np.bitwise_count(fp[some[i]] ^ fp[rest[j]]) <= radius]] = True
            front, rest = rest[near], rest[~near]
            if len(front):
                yield np.full(len(front), root), fp[front]


def links(grouped: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between points of one cell; ``grouped`` is dealt and sorted by cell."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_c, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def found(cell: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(cell):
                return
            start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            size = np.diff(np.append(start, len(cell)))
            two = start[size == 2]
            two = two[manhattan(points_of(fp[two]), points_of(fp[two + 1])) <= radius]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            out = [(fp[two], fp[two + 1])]
            for at, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                out.extend(_forest(fp[at : at + n], radius))
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
            for at in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], names=["a", "b"])

        for b in batches:
            cell = np.concatenate((held_c, b.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((held_f, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            cut = np.searchsorted(cell, cell[-1]) if len(cell) else 0  # the last cell may go on
            yield from found(cell[:cut], fp[:cut])
            held_c, held_f = cell[cut:], fp[cut:]
        yield from found(held_c, held_f)

    return mapped(grouped, verify, "a long, b long")


def midpoint_links(points: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that connect every two of ``points`` within ``radius`` bits, by the values between them."""
    one = np.array([0, *(1 << i for i in range(64))], np.uint64)
    flips = np.unique(one[:, None] ^ one) if radius == 4 else one if radius == 2 else one[:1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 50):
                part = fp[at : at + 50]
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], names=["middle", "fp"])

    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    between = mapped(points.select("fp").repartition(parts, F.xxhash64("fp")), deal, "middle long, fp long")
    least = between.groupBy("middle").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("each"))  # 2,081 at most
    return least.where(F.size("each") > 1).select("a", F.explode("each").alias("b")).where("a <> b").distinct()


def near_links(points: DataFrame, radius: int = 4, crowd: int = CROWD) -> DataFrame:
    """Links that connect every two of the distinct ``points`` (column fp) within ``radius`` bits, 4 at most and even."""
    if radius not in (0, 2, 4):
        raise ValueError("the grid is laid out for a radius of 0, 2 or 4")
    dealt = stage(cells(points), "cells")
    shared = dealt.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    together = stage(dealt.join(shared, "cell"), "shared", gather=True)
    discard(dealt)
    calm = together.where(F.col("n") <= crowd).repartition("cell").sortWithinPartitions("cell").select("cell", "fp")
    found = links(calm, radius).distinct()
    crowded = stage(together.where(F.col("n") > crowd).select("fp").distinct(), "crowded", gather=True)
    if not crowded.isEmpty():
        found = found.union(midpoint_links(crowded, radius))
    found = stage(found, "links", gather=True)
    discard(together, crowded)
    return found


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, crowd: int = CROWD) -> DataFrame:
    """A row per document: k1, k2, doc_id, fp, part, component_id."""
    rows = stage(fingerprints(docs, doc_id, text, width), "fingerprints", gather=True)
    found = near_links(rows.select("fp").distinct(), radius, crowd)
    parts = connected_components(found, "a", "b")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    part = stage(least.join(parts, least["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("part")), "parts", gather=True)
    discard(found)
    lowest = part.groupBy("part").agg(F.min("least").alias("component_id"))
    return rows.join(part.join(lowest, "part").select("fp", "part", "component_id"), "fp")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One document of each component stays: the one with the smallest id, ids before nulls; columns unchanged."""
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("k1"), F.col("k2"))
    with noted() as tables:
        best = components(docs, doc_id, text, width, radius).groupBy("part").agg(F.min(rank).alias("r")).select("r.k1", "r.k2")
        best = stage(best, "best", gather=True)
    discard(*(t for t in tables if t is not best))
    rows = packed(docs, i=doc_id, t=text)
    # rows alike in id and text are one document
    return unpacked(rows.select(*keys(F.col("i"), F.col("t")), "row").join(best, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]), docs.columns)
