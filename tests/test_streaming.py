import datetime as dt

from gristmill.streaming.ingest import document_stream, filtered, write


def test_stream_drops_repeats(spark, tmp_path):
    schema = "doc_id long, path string, text string, loaded_at timestamp"
    now = dt.datetime(2030, 1, 1)
    text = "The quick brown fox is on the mat and it was not there for the other one. " * 3
    spark.createDataFrame([(1, "a", text, now), (2, "b", text, now), (3, "c", "short", now)], schema).write.parquet(str(tmp_path / "in"))
    stream = filtered(document_stream(spark, str(tmp_path / "in"), schema), ["dedup", "language", "boilerplate"])
    write(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 1 and rows[0]["doc_id"] in (1, 2)
