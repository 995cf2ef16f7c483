from datetime import datetime

from lociforge.streaming.runs import start, stream_metrics

SCHEMA = "run_id string, model_name string, key string, value double, at timestamp"


def test_stream_matches_batch(spark, tmp_path):
    rows = [(f"r{k}", "m", "test/f1", float(k), datetime(2024, 1, 1, k // 2)) for k in range(6)]
    rows += [rows[0], ("r9", "m", "nothing", 1.0, datetime(2024, 1, 1)), ("r10", "m", "test/f1", 0.0, datetime(2024, 1, 3))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    start(stream_metrics(source), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    got = sorted((r.start.hour, r.dataset, r.metric, r["mean"], r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, "test", "f1", 0.5, 2), (1, "test", "f1", 2.5, 2), (2, "test", "f1", 4.5, 2)]
