from datetime import datetime, timedelta

import pytest

from somaframe.streaming.windows import window_features


def test_stream_equals_table(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    rows = [("a", begin + timedelta(seconds=i), 800.0 + i % 7) for i in range(1500)]
    spark.createDataFrame(rows, "subject_id string, ts timestamp, rr_ms double").repartition(3).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = window_features(stream).writeStream.outputMode("complete").format("memory").queryName("beats_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got, want = sorted(spark.table("beats_out").collect()), sorted(window_features(table).collect())
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for a, b in zip(got, want, strict=True):  # sums in another order differ in the last digit
        assert a[4:] == pytest.approx(b[4:], rel=1e-12)
    assert len(got) == 5
