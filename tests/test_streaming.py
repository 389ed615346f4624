"""Stream = batch once the stream has closed its windows."""

import numpy as np
from pyspark.sql import functions as F

import meterspark as ms
from conftest import SF_SMALL
from meterspark.streaming import streams as S


def test_minute_mean_and_features_stream_equal_batch(spark, tmp_dir):
    r = ms.load_readings(spark, SF_SMALL).withColumn("_p", F.floor(F.dayofmonth("Time") / 5))
    for p in sorted(x[0] for x in r.select("_p").distinct().collect()):
        r.filter(F.col("_p") == p).drop("_p").write.parquet(f"{tmp_dir}/in/p{p:02d}")
    src = S.stream_readings(spark, f"{tmp_dir}/in/*", max_files_per_trigger=2)
    q = S.stream_minute_mean(src).writeStream.format("memory").queryName("t_mm").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("t_mm")
    batch = ms.downsample(ms.clean(ms.load_readings(spark, SF_SMALL)), "1 minute")
    missing = batch.select("house_id", "Time").exceptAll(got.select("house_id", "Time"))
    # only bins after the last watermark stay open
    last = batch.agg(F.max("Time")).first()[0]
    assert all((last - r.Time).total_seconds() <= 600 for r in missing.collect())
    assert got.select("house_id", "Time").exceptAll(batch.select("house_id", "Time")).count() == 0

    batch.write.parquet(f"{tmp_dir}/minute")
    ms_src = spark.readStream.schema(batch.schema).parquet(f"{tmp_dir}/minute")
    q = S.stream_features(ms_src).writeStream.format("memory").queryName("t_fs").outputMode("append").start()
    q.processAllAvailable()
    S.end_mark(batch).write.mode("append").parquet(f"{tmp_dir}/minute")
    q.processAllAvailable()
    q.stop()
    assert S.late_rows(q) == 0
    sf = spark.table("t_fs").toPandas().sort_values(["house_id", "Time"]).reset_index(drop=True)
    bf = ms.engineer_features(ms.add_time_features(batch)).toPandas().sort_values(["house_id", "Time"])
    bf = bf.reset_index(drop=True)
    assert len(sf) == len(bf)
    for c in ["rolling_mean", "rolling_std", "z_score", "diff_1", "diff_5", "pct_change"]:
        np.testing.assert_allclose(sf[c], bf[c], rtol=1e-7, atol=1e-7, equal_nan=True)


def test_stream_alerts_sink(spark, tmp_dir):
    f = ms.engineer_features(ms.add_time_features(
        ms.downsample(ms.clean(ms.load_readings(spark, SF_SMALL)), "1 minute")))
    f.select("house_id", "Time", "Aggregate", "rolling_mean", "rolling_std", "deviation", "z_score",
             "diff_1", "diff_5", "pct_change").write.parquet(f"{tmp_dir}/feat")
    src = spark.readStream.schema(spark.read.parquet(f"{tmp_dir}/feat").schema).parquet(f"{tmp_dir}/feat")
    q = S.write_batches(S.stream_alerts(src), f"{tmp_dir}/out", f"{tmp_dir}/ck")
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_dir}/out/alerts")
    from meterspark.operators.rules import alerts
    exp = alerts(f)
    assert got.count() == exp.count()
    assert spark.read.parquet(f"{tmp_dir}/out/batch_summary").agg(F.sum("alerts")).first()[0] == exp.count()


def test_late_rows_are_dropped_not_reordered(spark, tmp_dir):
    """A bin older than the watermark is late: dropped and counted."""
    from datetime import datetime, timedelta
    import pandas as pd
    t0 = datetime(2024, 1, 1)
    first = pd.DataFrame({"house_id": 1, "Time": [t0 + timedelta(minutes=i) for i in range(10)],
                          "Aggregate": [float(100 + i) for i in range(10)]})
    then = pd.DataFrame({"house_id": 1, "Time": [t0 + timedelta(minutes=10)], "Aggregate": [110.0]})
    late = pd.DataFrame({"house_id": 1, "Time": [t0 + timedelta(minutes=3), t0 + timedelta(minutes=11)],
                         "Aggregate": [999.0, 111.0]})
    for i, pdf in enumerate([first, then, late]):
        pdf["Time"] = pdf["Time"].astype("datetime64[us]")
        spark.createDataFrame(pdf).withColumn("Time", F.col("Time").cast("timestamp_ntz")).coalesce(1) \
            .write.parquet(f"{tmp_dir}/in/b{i}")
    schema = spark.read.parquet(f"{tmp_dir}/in/b0").schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/in/*")
    q = S.stream_features(src, watermark="0 seconds").writeStream.format("memory").queryName("t_late").outputMode("append").start()
    q.processAllAvailable()
    S.end_mark(spark.read.parquet(f"{tmp_dir}/in/b2")).write.parquet(f"{tmp_dir}/in/b3")
    q.processAllAvailable()
    q.stop()
    got = spark.table("t_late").orderBy("Time").toPandas()
    assert 999.0 not in set(got["Aggregate"])                 # the late 00:03 row is dropped
    assert S.late_rows(q) == 1
    assert got["Time"].is_monotonic_increasing and len(got) == 12 - 4
    last = got.iloc[-1]
    assert last["Aggregate"] == 111.0 and last["diff_1"] == 1.0   # state carried across batches
