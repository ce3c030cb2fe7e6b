from pyspark.sql import functions as F

from sigloom import streaming


def test_windows_and_sessions(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, f"2024-01-01 00:{m:02d}:00", float(m)) for m in (0, 3, 9, 12, 40)] + [(2, "2024-01-01 00:05:00", 7.0), (1, "2024-01-03 00:00:00", 0.0)]
    spark.createDataFrame(rows, "user_id int, t string, value double").select("user_id", F.to_timestamp_ntz("t").alias("ts"), "value").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    streaming.to_parquet(streaming.dwell_windows(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = {(r["user_id"], r["start"].minute): (r["n"], r["mean"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1, 0] == (3, 4.0) and got[1, 10] == (1, 12.0) and got[2, 0] == (1, 7.0)
    streaming.to_parquet(streaming.sessions(stream, gap="20 minutes"), str(tmp_path / "out2"), str(tmp_path / "state2")).awaitTermination(120)
    assert sorted((r["user_id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out2")).collect())[:3] == [(1, 1), (1, 4), (2, 1)]
