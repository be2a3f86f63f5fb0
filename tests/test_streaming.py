from datetime import datetime

from srcquarry.streaming.feed import slice_stream, write_batches

SCHEMA = "chunk_id long, type string, name string, signature string, body string, doc string, file_path string, start_line int, end_line int, language string, relative_path string, file_sha256 string, chunk_ordinal int, ingested_at timestamp"


def test_stream_counts_deliveries_once(spark, tmp_path):
    t = datetime(2030, 1, 1)
    row = lambda i, body, at: (i, "function", "f", "f()", body, "why", "/f", 1, 2, "python", "f", "s", i, at)
    for k, rows in enumerate([[row(1, "x" * 300, t)], [row(1, "x" * 300, t), row(2, "y", t)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = write_batches(slice_stream(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.chunk_id, r.source_field, r.char_start) for r in got.collect()) == [(1, "body", 0), (1, "body", 254), (1, "doc", 0), (2, "body", 0), (2, "doc", 0)]
    assert got.select("id").distinct().count() == 5
