from lodeworks.streaming.findings import track


def test_new_fingerprints_by_batch(spark, tmp_path):
    schema = "rule_id string, file_path string, message string"
    source = str(tmp_path / "in")
    row = lambda *n: spark.createDataFrame([("R1", "a.cs", f"m{i}") for i in n], schema)
    for part in ((1, 2, 2), (2, 3)):
        row(*part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        track(stream, str(tmp_path / "state"), str(tmp_path / "ledger"), str(tmp_path / "cp")).awaitTermination()
    got = {r.batch: r.new_findings for r in spark.read.parquet(str(tmp_path / "ledger")).collect()}
    assert got == {0: 2, 1: 1}
    assert spark.read.parquet(str(tmp_path / "state")).count() == 3
