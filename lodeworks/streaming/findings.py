"""The baseline over a stream of finding batches: new fingerprints and ledger entries batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.operators.findings import fingerprint


def track(stream: DataFrame, state: str, ledger: str, checkpoint: str, root: str = "", on_new: Callable[[DataFrame, int], None] | None = None, available_now: bool = True):
    """Start a query that appends unseen fingerprints to ``state`` and a row for each batch to ``ledger`` (both Parquet folders by batch).

    A batch that runs again overwrites its own folders, so each counts once. Returns the running query.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        now = df.select(fingerprint(F.col("rule_id"), F.col("file_path"), F.col("message"), root).alias("fingerprint")).distinct()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            known = spark.read.schema("fingerprint string, batch long").parquet(state).where(F.col("batch") < number)
            now = now.join(known, "fingerprint", "left_anti")
        now.write.mode("overwrite").parquet(f"{state}/batch={number}")
        new = spark.read.schema("fingerprint string").parquet(f"{state}/batch={number}")
        new.agg(F.count("*").alias("new_findings")).write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        if on_new:
            on_new(new, number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
