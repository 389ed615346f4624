"""Chunked row windows equal the one-task-per-house plan; pandas parity."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import meterspark as ms
import meterspark.operators.views  # noqa: F401
from conftest import SF_SMALL
from meterspark.operators.windows import row_windows
from meterspark.plans import catalog


def _sorted(df):
    return df.toPandas().sort_values(["house_id", "Time"]).reset_index(drop=True)


def test_chunked_equals_single_task(spark):
    t = catalog.timed(spark, SF_SMALL).cache()
    a = _sorted(ms.engineer_features(t, chunk_rows=0))
    b = _sorted(ms.engineer_features(t, chunk_rows=37))      # many chunks, halo 29
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9)


def test_row_index_is_dense_per_house(spark):
    from meterspark.operators.windows import with_row_index
    t = catalog.minute(spark, SF_SMALL)
    x = with_row_index(t).groupBy("house_id").agg(F.min("_idx").alias("lo"), F.max("_idx").alias("hi"),
                                                   F.count("*").alias("n"), F.countDistinct("_idx").alias("d"))
    for r in x.collect():
        assert r.lo == 0 and r.hi == r.n - 1 and r.d == r.n


def test_pandas_parity_rolling_and_rate(spark):
    t = catalog.minute(spark, SF_SMALL).select("house_id", "Time", "Aggregate")
    got = _sorted(ms.add_rate_features(ms.add_rolling_features(t)))
    for h, g in got.groupby("house_id"):
        a = g["Aggregate"]
        r = a.rolling(30, min_periods=5)
        np.testing.assert_allclose(g["rolling_mean"], r.mean(), rtol=1e-9, equal_nan=True)
        np.testing.assert_allclose(g["rolling_std"], r.std(), rtol=1e-7, atol=1e-9, equal_nan=True)
        np.testing.assert_allclose(g["diff_5"], a.diff(5).clip(-5000, 5000), equal_nan=True)
        np.testing.assert_allclose(g["pct_change"], (a.pct_change(fill_method=None) * 100).clip(-500, 500),
                                   rtol=1e-12, equal_nan=True)


def test_z_bound_and_warmup(spark):
    f = catalog.features(spark, SF_SMALL)
    n = catalog.timed(spark, SF_SMALL).groupBy("house_id").count()
    m = f.groupBy("house_id").count().withColumnRenamed("count", "kept").join(n, "house_id")
    assert all(r["count"] - r.kept == min(4, r["count"]) for r in m.collect())
    zmax = f.agg(F.max(F.abs("z_score"))).first()[0]
    assert zmax <= 29 / np.sqrt(30) + 1e-9


def test_sliding_views_brute_force(spark):
    t = catalog.minute(spark, SF_SMALL).filter(F.col("house_id") <= 3)
    got = ms.operators.views.sliding_views(t, size=7, step=3).toPandas()
    pdf = t.toPandas().sort_values(["house_id", "Time"])
    rows = []
    for h, g in pdf.groupby("house_id"):
        a = g["Aggregate"].to_numpy()
        n = len(a)
        for i in range(-(-n // 3)):
            e = min(i * 3 + 7, n)
            w = a[max(0, e - 7):e]
            rows.append((h, i, len(w), w.mean(), w.max()))
    exp = pd.DataFrame(rows, columns=["house_id", "window_id", "rows", "avg_w", "peak_w"])
    got = got.sort_values(["house_id", "window_id"]).reset_index(drop=True)
    assert len(got) == len(exp)
    np.testing.assert_allclose(got["avg_w"], exp["avg_w"], rtol=1e-12)
    np.testing.assert_array_equal(got["rows"], exp["rows"])


def test_sliding_views_chunked(spark):
    from meterspark.operators.views import sliding_views
    t = catalog.minute(spark, SF_SMALL)
    a = sliding_views(t, size=10, step=4, chunk_rows=0).toPandas().sort_values(["house_id", "window_id"])
    b = sliding_views(t, size=10, step=4, chunk_rows=23).toPandas().sort_values(["house_id", "window_id"])
    c = sliding_views(t, size=10, step=4).toPandas().sort_values(["house_id", "window_id"])
    pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True))
    pd.testing.assert_frame_equal(a.reset_index(drop=True), c.reset_index(drop=True))


def test_row_views_equal_numbered_rows(spark):
    from meterspark.operators.views import row_batches, sliding_views, view_at
    t = catalog.minute(spark, SF_SMALL)
    rows = t.toPandas().sort_values(["house_id", "Time"]).reset_index(drop=True)
    rows["at"] = rows.groupby("house_id").cumcount()
    rows["total"] = rows.groupby("house_id")["at"].transform("size")
    want = rows.assign(batch_id=rows["at"] // 7).groupby(["house_id", "batch_id"]).agg(rows=("at", "size"), start_time=("Time", "min"), end_time=("Time", "max"), avg_w=("Aggregate", "mean"), peak_w=("Aggregate", "max")).reset_index()
    got = row_batches(t, 7).toPandas().sort_values(["house_id", "batch_id"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)
    steps = ((rows["total"] - 20) // 4).clip(lower=0)
    end = 20 + (3 % (steps + 1)) * 4
    want = rows[(rows["at"] >= end - 20) & (rows["at"] < end)]
    got = view_at(t, 3, size=20, step=4).toPandas().sort_values(["house_id", "Time"])
    assert got[["house_id", "Time", "row_idx"]].values.tolist() == want[["house_id", "Time", "at"]].values.tolist()
    assert sliding_views(t, size=1, step=1).count() == len(rows)


def test_views_start_no_jobs(spark):
    from meterspark.operators.views import row_batches, sliding_views, view_at
    t, sc = catalog.minute(spark, SF_SMALL), spark.sparkContext
    sc.setJobGroup("views", "plans only")
    try:
        sliding_views(t, size=10, step=4), row_batches(t, 7), view_at(t, 3, size=20, step=4)
        assert not list(sc.statusTracker().getJobIdsForGroup("views"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_chunks_keep_rows_without_a_time(spark):
    from meterspark.operators.windows import row_windows
    t = ms.downsample(ms.clean(ms.load_readings(spark, SF_SMALL))).filter("house_id <= 3").withColumn(
        "Time", F.when(F.col("Aggregate") > 1500, None).otherwise(F.col("Time")))
    assert t.filter("Time is null").count() > 0
    build = lambda w: [F.count(F.lit(1)).over(w.rowsBetween(-4, 0)).alias("k")]
    a, b = (row_windows(t, build, halo=4, chunk_rows=c) for c in (0, 10))
    assert a.count() == b.count() == t.count()
    assert a.groupBy("k").count().exceptAll(b.groupBy("k").count()).count() == 0


@pytest.mark.parametrize("halo", [1, 5, 29])
def test_days_with_carried_rows_equal_whole_houses(spark, halo):
    """Days of one row, of many, gaps, rows without a time, equal times: the same as one window for each house."""
    import random
    rng = random.Random(halo)
    rows = []
    for house, days, most in ((1, 40, 3), (2, 3, 80), (3, 1, 1), (4, 25, 12)):
        for d in range(days):
            if rng.random() < 0.7:
                rows += [(house, f"2024-0{1 + d // 28}-{1 + d % 28:02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00", float(rng.randrange(1000))) for _ in range(rng.randrange(1, most + 1))]
        rows += [(house, None, 5.0 + house), (house, None, 6.0)]
    df = spark.createDataFrame(rows, "house_id bigint, t string, Aggregate double").select("house_id", F.col("t").cast("timestamp_ntz").alias("Time"), "Aggregate").repartition(5)

    def build(w):
        frame = w.rowsBetween(-halo, 0)
        return [F.sum("Aggregate").over(frame).alias("s"), F.count("*").over(frame).alias("n"), F.collect_list("Aggregate").over(frame).alias("seen"), F.lag("Aggregate", halo).over(w).alias("back")]
    a, b = (sorted(map(repr, row_windows(df, build, halo, order=["Time", "Aggregate"], chunk_rows=c).collect())) for c in (None, 0))
    assert a == b and len(a) == len(rows)


def test_features_need_no_job_before_they_are_read(spark):
    df = ms.add_time_features(ms.downsample(ms.clean(ms.load_readings(spark, SF_SMALL)), "1 minute"))
    spark.sparkContext.setJobGroup("features", "none yet")
    try:
        out = ms.engineer_features(df, unique_time=True)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("features")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() > 0
