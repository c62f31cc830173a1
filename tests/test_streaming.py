from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillgraph.streaming import ingest


def test_uploads_are_taken_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda name, rows: (folder / name).write_text("\n".join(map(json.dumps, rows)))
    put("1.json", [{"filename": "a.pdf", "file_size": 1}, {"filename": "b.exe", "file_size": 1}])
    for _ in range(2):
        ingest.ingest_uploads(ingest.upload_stream(spark, str(folder)), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert [r.title for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["a.pdf"]
    put("2.json", [{"filename": "c.txt", "file_size": None}])
    ingest.ingest_uploads(ingest.upload_stream(spark, str(folder)), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(r.title for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a.pdf", "c.txt"]


def _log(spark, tmp_path, rows):
    schema = "document_id string, status string, at timestamp, seq long"
    made = spark.createDataFrame(rows, "document_id string, status string, at string, seq long").withColumn("at", F.to_timestamp("at"))
    made.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    return spark.readStream.schema(schema).parquet(f"{tmp_path}/log")


def test_windows_and_repeats(spark, tmp_path):
    rows = [("d", "processing", "2024-01-01 00:10:00", 1), ("d", "processing", "2024-01-01 00:10:00", 1), ("e", "failed", "2024-01-01 00:20:00", 2), ("d", "processed", "2024-01-01 01:05:00", 3)]
    stream = ingest.status_counts(_log(spark, tmp_path, rows))
    stream.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    late = [("z", "failed", "2024-01-01 12:00:00", 9)]
    stream = ingest.status_counts(_log(spark, tmp_path, late))
    q = stream.writeStream.format("memory").queryName("windows2").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    found = {(str(r.start), r.status): r.n for r in spark.table("windows2").collect()}
    assert found.get(("2024-01-01 00:00:00", "processing")) == 1


def test_latest_states(spark, tmp_path):
    rows = [("d", "processing", "2024-01-01 00:10:00", 1), ("d", "failed", "2024-01-01 00:10:00", 2)]
    ingest.latest_states(_log(spark, tmp_path, rows)).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [(r.document_id, r.status) for r in spark.table("latest").collect()] == [("d", "failed")]
