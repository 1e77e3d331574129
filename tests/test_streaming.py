"""The stream of events against a batch aggregate, for a table in one file and one in a folder of parts."""

import pytest
from pyspark.sql import functions as F

from gustline.streaming.hourly import events_by_hour


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_reads_the_whole_table(spark, tmp_path, tmp_path_factory, parts):
    ts = F.timestamp_seconds(F.col("id") * 1800).cast("timestamp_ntz")
    rows = spark.range(100).select(F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"), F.col("id").cast("double").alias("value"))
    path = tmp_path / "events.parquet"
    if parts == 1:
        made = tmp_path_factory.mktemp("made") / "rows"
        rows.coalesce(1).write.parquet(str(made))
        next(made.glob("part-*.parquet")).rename(path)
    else:
        rows.repartition(parts).write.parquet(str(path))
    got = events_by_hour(spark, str(tmp_path))
    want = rows.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.agg(F.sum("n")).first()[0] == 100
    assert got.inputFiles()  # a table in the shared folder, not rows held by the driver
