"""Training-order materialisation of token sequences (operator 1).

Texts are tokenized, an end token behind each, and cut into sequences of ``length`` ids, the last of a text padded with the
end token. Sequences are numbered 0..N-1, and a keyed permutation gives each number its global slot: a Feistel network over
the next even power of two, walked along its cycle until it falls below N; a bijection of 0..N-1 that needs no table and
can be undone. Shards are runs of ``per_shard`` slots. A record is ``length`` little-endian ids of ``width`` bytes and a line
break, so slot s stands in shard s div per_shard at byte (s mod per_shard) x stride, and a reader goes on from any slot
with one seek.

Plan: one pass tokenizes and writes the records, with their task and their place in it, to the shared folder; tasks'
record counts (one row a task) give each task its first number, so numbering takes no shuffle and no task sees all rows. The
slot follows by arithmetic. Records are then dealt by ranges of shards, ``waves`` times a part of all shards, so shuffle
files, deleted wave by wave, take a fraction of the output; a task writes whole shards in slot order with Spark's committed text writer, and a
lost executor's tasks are written again whole.

Defined cases: null and empty texts have one sequence, of end tokens (n_tokens 1). An id that ``width`` bytes can't hold is an error. Repeated rows have sequences of their
own. Extra columns are ignored. No rows: no shards, an empty index. The order depends on the key, the rows and
the input's partitions, and is fixed once written.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.llm.arrow import mapped
from lodeworks.sources.shared import discard, shuffles_dropped, stage

LENGTH, PER_SHARD, WAVES, BATCH = 256, 16_384, 4, 8192


class Permutation:
    """A keyed bijection of 0..size-1."""

    def __init__(self, size: int, key: bytes, rounds: int = 6):
        self.size = size
        self.half = max(1, ((max(size, 2) - 1).bit_length() + 1) // 2)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(key + bytes([r])).digest()[:8])) for r in range(rounds)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(29)) & np.uint64((1 << self.half) - 1)

    def _feistel(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & np.uint64((1 << self.half) - 1)
        for key in reversed(self.keys) if back else self.keys:
            left, right = (right ^ self._mix(left, key), left) if back else (right, left ^ self._mix(right, key))
        return left << np.uint64(self.half) | right

    def _walk(self, number: np.ndarray, back: bool) -> np.ndarray:
        out = self._feistel(np.asarray(number).astype(np.uint64), back)
        while (over := out >= self.size).any():
            out[over] = self._feistel(out[over], back)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, False)

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def stride(length: int = LENGTH, width: int = 2) -> int:
    return length * width + 1


def sequences(docs: DataFrame, tokenizer: Callable[[], Callable[[str], list[int]]], end: int, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, width: int = 2) -> DataFrame:
    """(doc_id, piece, n_tokens, task, place, record): the sequences; place counts the records of a task from 0."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind, code = rows.schema["doc_id"].dataType.simpleString(), {2: "H", 4: "I"}[width]
    names = ["doc_id", "piece", "n_tokens", "task", "place", "record"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, done, step = tokenizer(), TaskContext.get().partitionId(), 0, length * width
        pad = array(code, [end]) * length
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                row, piece, size, record = [], [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    ids = array(code, encode(t) if t else ())
                    n = len(ids) // length + 1
                    used = len(ids) + 1
                    ids.extend(pad[: n * length - len(ids)])
                    if sys.byteorder == "big":
                        ids.byteswap()
                    data = ids.tobytes()
                    row += [i] * n
                    piece += range(n)
                    size += [length] * (n - 1) + [used - (n - 1) * length]
                    record += [data[k : k + step] for k in range(0, len(data), step)]
                n = len(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(size, pa.int32()), pa.array([task] * n, pa.int32()), pa.array(range(done, done + n), pa.int64()), pa.array(record, pa.binary())], names=names)
                done += n

    return mapped(rows, cut, f"doc_id {kind}, piece int, n_tokens int, task int, place long, record binary")


def materialise(docs: DataFrame, path: str, tokenizer: Callable[[], Callable[[str], list[int]]], end: int, key: bytes = b"order 1", doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, width: int = 2, waves: int = WAVES) -> DataFrame:
    """Write the shards to folders ``path``/shard=K and return their index.

    tokenizer: makes the function from a text to its ids, once for each task. Index: doc_id, piece, n_tokens, slot, shard,
    at (the record's first byte in the shard).
    """
    spark = docs.sparkSession
    held = stage(sequences(docs, tokenizer, end, doc_id, text, length, width), "sequences")
    # a row for each task: as many as the input has splits
    tasks = held.groupBy("task").agg(F.count("*").alias("n"))
    before = stage(tasks.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("first"), "n"), "tasks")
    size = before.agg(F.sum("n")).first()[0] or 0
    order = Permutation(size, key)

    @F.pandas_udf("long")
    def slot_of(number: pd.Series) -> pd.Series:
        return pd.Series(order.slot(number.to_numpy()))

    placed = held.join(F.broadcast(before.select("task", "first")), "task").withColumn("slot", slot_of(F.col("first") + F.col("place")))
    placed = placed.withColumn("shard", F.expr(f"cast(slot div {per_shard} as int)"))
    shards = -(-size // per_shard)
    # numbers and records of a fixed size: batches can be larger than those of texts
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    texts = spark.conf.get(setting)
    spark.conf.set(setting, str(BATCH))
    for wave in range(waves):
        low, high = shards * wave // waves, shards * (wave + 1) // waves
        if low == high:
            continue
        part = placed.where((F.col("shard") >= low) & (F.col("shard") < high)).select(F.col("record").cast("string").alias("value"), "shard", "slot")
        # a shard's task is known, so no pass over the rows has to find ranges
        part = part.repartitionById(high - low, F.col("shard") - low).sortWithinPartitions("shard", "slot")
        with shuffles_dropped(spark):
            part.drop("slot").write.mode("append").partitionBy("shard").text(path)
    index = stage(placed.select("doc_id", "piece", "n_tokens", "slot", "shard", (F.col("slot") % per_shard * stride(length, width)).alias("at")), "index")
    spark.conf.set(setting, texts)
    discard(held, before)
    return index


def read_slots(spark: SparkSession, path: str, slot: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD, width: int = 2) -> Iterator[np.ndarray]:
    """The sequences of ``count`` slots from ``slot`` on, read in order with a seek for each shard."""
    jvm, step = spark.sparkContext._jvm, stride(length, width)
    while count > 0:
        shard, at = divmod(slot, per_shard)
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files = [s for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")] if fs.exists(folder) else []
        n = min(count, files[0].getLen() // step - at) if files else 0
        if n <= 0:
            return
        stream = fs.open(files[0].getPath())
        stream.seek(at * step)
        data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n * step))
        stream.close()
        yield from np.frombuffer(data, np.uint8).reshape(n, step)[:, :-1].copy().view(f"<u{width}")
        slot, count = slot + n, count - n
