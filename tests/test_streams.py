"""Streams against the batch operators."""

from pyspark.sql import functions as F

from quillspark.plans import catalog
from quillspark.streaming import streams as S

from .conftest import SF


def windows(df):
    return sorted((str(r["start"]), r["event_type"], r["n"], round(r["total"], 4)) for r in df.withColumn("start", F.col("start").cast("timestamp_ntz")).collect())


def test_event_windows_stream_is_whole(spark):
    assert windows(catalog.event_windows_stream(spark, SF)) == windows(catalog.event_windows(spark, SF))


def test_batches_drop_nothing(spark, tmp_path):
    """Files in falling order of time, one a batch: all but the first would be late."""
    path = str(tmp_path / "events")
    for day in (20, 10, 1):
        spark.sql(f"select timestamp'2024-01-{day:02d} 00:10:00' + make_interval(0, 0, 0, 0, cast(id as int)) as ts, if(id % 2 = 0, 'a', 'b') as event_type, cast(id as double) as value from range(30)").coalesce(1).write.mode("append").parquet(path)
    got = windows(S.run_to_table(S.event_counts(S.stream_table(spark, path, files=1), late=None), "complete"))
    assert got == windows(S.event_counts(spark.read.parquet(path))) and sum(r[2] for r in got) == 90


def test_no_files(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.sql("select timestamp'2024-01-01' as ts, 'a' as event_type, 1.0D as value limit 0").write.parquet(path)
    assert windows(S.run_to_table(S.event_counts(S.stream_table(spark, path), late=None), "complete")) == []
