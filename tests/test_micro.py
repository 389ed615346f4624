"""Hand-written micro-fixtures: cleaning, calendar, rolling, rate clips,
gaps, rules truth table and alert order."""

import math
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

import meterspark as ms
from meterspark.operators.rules import alerts, standby_recommendations
from meterspark.sources.readings import APPLIANCES, READINGS_SCHEMA

T0 = datetime(2024, 1, 5, 0, 0)   # a Friday


def readings(spark, rows):
    full = []
    for r in rows:
        d = {"house_id": 1, "Time": T0, "Aggregate": 100.0, "Issues": 0, **{a: 0.0 for a in APPLIANCES}}
        d.update(r)
        full.append(tuple(d[f.name] for f in READINGS_SCHEMA.fields))
    return spark.createDataFrame(full, READINGS_SCHEMA)


def series(spark, values, start=T0, step=timedelta(minutes=1), house=1):
    return readings(spark, [{"house_id": house, "Time": start + i * step, "Aggregate": float(v)}
                            for i, v in enumerate(values)])


def test_dirty_cleaning(spark):
    aggs = [None, float("nan"), 0.0, -3.0, 5.0]
    df = readings(spark, [{"Time": T0 + timedelta(minutes=i), "Aggregate": a,
                           "Appliance1": [None, -1.0, 4.0, None, -1.0][i]} for i, a in enumerate(aggs)])
    # NaN must count as missing (Spark orders NaN above every number).
    df = df.select("house_id", "Time", F.nanvl("Aggregate", F.lit(None).cast("double")).alias("Aggregate"),
                   *APPLIANCES, "Issues")
    out = ms.clean(df).collect()
    assert [r.Aggregate for r in out] == [5.0]
    assert out[0].Appliance1 == 0.0
    assert "Issues" not in ms.clean(df).columns
    rep = ms.cleaning_report(df).collect()[0]
    assert (rep.rows_in, rep.rows_removed, rep.rows_kept) == (5, 4, 1)


def test_calendar_flags(spark):
    times = ["04:59", "05:00", "06:59", "07:00", "09:59", "10:00", "16:59", "17:00", "21:59", "22:00",
             "22:59", "23:00"]
    rows = []
    for day in (datetime(2024, 1, 5), datetime(2024, 1, 6)):
        for t in times:
            h, m = map(int, t.split(":"))
            rows.append({"Time": day.replace(hour=h, minute=m)})
    got = ms.add_time_features(readings(spark, rows)).orderBy("Time").collect()
    exp_night = [1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1] * 2
    exp_peak = [0, 0, 0, 1, 1, 0, 0, 1, 1, 0, 0, 0] * 2
    assert [r.is_night for r in got] == exp_night
    assert [r.is_peak for r in got] == exp_peak
    assert [r.day_of_week for r in got] == [4] * 12 + [5] * 12
    assert [r.is_weekend for r in got] == [0] * 12 + [1] * 12


def test_constant_series_has_zero_std_and_z(spark):
    out = ms.add_rolling_features(series(spark, [7.3] * 40)).orderBy("Time").collect()
    assert all(r.rolling_mean is None for r in out[:4])
    assert all(abs(r.rolling_std) < 1e-9 and abs(r.z_score) < 1e-6 for r in out[4:])


def test_step_z_score(spark):
    out = ms.add_rolling_features(series(spark, [100.0] * 29 + [1000.0])).orderBy("Time").collect()
    last = out[-1]
    std = pd.Series([100.0] * 29 + [1000.0]).std()
    assert math.isclose(last.z_score, (1000 - 130) / (std + 1e-5), rel_tol=1e-12)
    assert math.isclose(last.z_score, 29 / math.sqrt(30), rel_tol=1e-6)


def test_spike_clips(spark):
    out = ms.add_rate_features(series(spark, [10.0, 9000.0, 10.0])).orderBy("Time").collect()
    assert out[0].diff_1 is None and out[0].pct_change is None
    assert out[1].diff_1 == 5000.0 and out[1].pct_change == 500.0
    assert out[2].diff_1 == -5000.0
    assert math.isclose(out[2].pct_change, (10 / 9000 - 1) * 100)


def test_gap_rows_cross_gaps_and_empty_bins_dropped(spark):
    times = [T0 + timedelta(minutes=i) for i in range(10)] + \
            [T0 + timedelta(hours=3, minutes=10 + i) for i in range(10)]
    df = readings(spark, [{"Time": t, "Aggregate": float(i + 1)} for i, t in enumerate(times)])
    m = ms.downsample(df, "1 minute")
    assert m.count() == 20
    out = ms.add_rate_features(m).orderBy("Time").collect()
    assert out[10].diff_1 == 1.0          # row after the gap uses the row before it


def test_downsample_mean_and_label(spark):
    base = T0
    df = readings(spark, [{"Time": base + timedelta(seconds=8 * i), "Aggregate": float(i)} for i in range(16)])
    got = ms.downsample(df, "1min").orderBy("Time").collect()
    assert [r.Time for r in got] == [base, base + timedelta(minutes=1), base + timedelta(minutes=2)]
    assert got[0].Aggregate == sum(range(8)) / 8


def test_seven_minute_bins_start_at_first_midnight(spark):
    df = readings(spark, [{"Time": T0 + timedelta(minutes=8)}])
    got = ms.downsample(df, "7min").collect()[0]
    assert got.Time == T0 + timedelta(minutes=7)


def _rule_row(**kw):
    base = {"Aggregate": 500.0, "z_score": 0.0, "deviation": 0.0, "rolling_std": 100.0, "is_night": 0,
            "is_anomaly": 0, "cluster_distance": 0.0, "hour": 12}
    base.update(kw)
    return base


def _alerts_of(spark, rows):
    t = [T0 + timedelta(minutes=i) for i in range(len(rows))]
    pdf = pd.DataFrame([dict(house_id=1, Time=ti, **r) for ti, r in zip(t, rows)])
    pdf["Time"] = pdf["Time"].astype("datetime64[us]")
    df = spark.createDataFrame(pdf).withColumn("Time", F.col("Time").cast("timestamp_ntz"))
    got = alerts(df).orderBy("Time", "rule_pos").collect()
    return df, [(r.Time, r.rule, r.severity, r.icon) for r in got]


def test_rules_truth_table(spark):
    rows = [
        _rule_row(z_score=4.0),                                           # K1
        _rule_row(is_anomaly=1, is_night=1, hour=2),                      # K2
        _rule_row(is_anomaly=1, deviation=300.0),                         # K3
        _rule_row(is_anomaly=1),                                          # K4
        _rule_row(Aggregate=3500.0),                                      # K5
        _rule_row(is_anomaly=1, cluster_distance=3.0, deviation=0.0),     # K4 + K6
        _rule_row(z_score=-4.0, Aggregate=3100.0),                        # K1 + K5
        _rule_row(is_anomaly=1, is_night=1, cluster_distance=3.0),        # K2 + K6
        _rule_row(z_score=5.0, is_night=1, Aggregate=800.0),              # K1 (+ K7 advice only)
        _rule_row(is_anomaly=1, Aggregate=3300.0, cluster_distance=2.6),  # K4 + K5 + K6
        _rule_row(is_night=1, Aggregate=150.0),                           # K7 only: no alert
    ]
    df, got = _alerts_of(spark, rows)
    by_row = {}
    for t, rule, sev, icon in got:
        by_row.setdefault(t, []).append((rule, sev))
    t = [T0 + timedelta(minutes=i) for i in range(len(rows))]
    assert by_row[t[0]] == [(1, "critical")]
    assert by_row[t[1]] == [(2, "warning")]
    assert by_row[t[2]] == [(3, "warning")]
    assert by_row[t[3]] == [(4, "info")]
    assert by_row[t[4]] == [(5, "info")]
    assert by_row[t[5]] == [(4, "info"), (6, "info")]
    assert by_row[t[6]] == [(1, "critical"), (5, "info")]
    assert by_row[t[7]] == [(2, "warning"), (6, "info")]
    assert by_row[t[8]] == [(1, "critical")]
    assert by_row[t[9]] == [(4, "info"), (5, "info"), (6, "info")]
    assert t[10] not in by_row
    k7 = standby_recommendations(df).collect()
    assert sorted(r.Time for r in k7) == [t[8], t[10]]


def test_missing_columns_use_defaults(spark):
    df = series(spark, [3500.0]).drop(*APPLIANCES)
    got = alerts(df).collect()
    assert [(r.rule, r.severity) for r in got] == [(5, "info")]


def test_alert_order_newest_first_ties_keep_row_then_rule_order(spark):
    from meterspark.operators.rules import newest_first
    rows = [_rule_row(z_score=4.0, Aggregate=3200.0), _rule_row(is_anomaly=1)]
    pdf = pd.DataFrame([dict(house_id=1, Time=T0 + timedelta(seconds=10 * i), **r) for i, r in enumerate(rows)])
    pdf["Time"] = pdf["Time"].astype("datetime64[us]")
    df = spark.createDataFrame(pdf).withColumn("Time", F.col("Time").cast("timestamp_ntz"))
    got = [(r.rule, r.rule_pos) for r in newest_first(alerts(df)).collect()]
    assert got == [(1, 0), (5, 1), (4, 0)]


def test_message_numbers(spark):
    _, _ = _alerts_of(spark, [_rule_row(z_score=3.75)])
    df = series(spark, [1.0]).withColumn("z_score", F.lit(-3.75))
    msg = alerts(df).collect()[0].message
    assert "3.8" in msg and msg.startswith("🔴")


def test_equal_timestamps_get_a_fixed_order(spark):
    # raw readings (no resampling) may share a timestamp within a house
    rows = [{"Time": T0 + timedelta(minutes=i // 2), "Aggregate": float(v)}
            for i, v in enumerate([5, 3, 9, 1, 7, 2, 8, 4, 6, 10])]
    df = readings(spark, rows)
    a = ms.add_rate_features(df).orderBy("Time", "Aggregate").collect()
    b = ms.add_rate_features(df.repartition(5)).orderBy("Time", "Aggregate").collect()
    assert [r.diff_1 for r in a] == [r.diff_1 for r in b]
    assert a[1].diff_1 == 5.0 - 3.0      # within a timestamp: ascending Aggregate
