"""CSV scan (house from file name, ISO or epoch time, NaN as missing)."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

import meterspark as ms
from conftest import SF_SMALL


def _write_house_csvs(spark, d):
    r = ms.load_readings(spark, SF_SMALL).filter(F.col("house_id") <= 3).toPandas()
    for h, g in r.groupby("house_id"):
        g = g.drop(columns=["house_id"]).sort_values("Time")
        if h == 3:   # epoch seconds instead of ISO text
            g = g.assign(Unix=(g["Time"].astype("int64") // 1000) / 1e6).drop(columns=["Time"])
        else:
            g = g.assign(Time=g["Time"].dt.strftime("%Y-%m-%dT%H:%M:%S.%f"))
        g.to_csv(os.path.join(d, f"House_{h}.csv"), index=False, na_rep="NaN" if h == 1 else "")
    return r


def test_read_house_csvs(spark, tmp_dir):
    src = _write_house_csvs(spark, tmp_dir)
    got = ms.read_readings(spark, tmp_dir + "/House_1.csv")
    assert "Unix" not in got.columns
    p1 = got.toPandas().sort_values("Time").reset_index(drop=True)
    e1 = src[src.house_id == 1].sort_values("Time").reset_index(drop=True)
    assert (p1["house_id"] == 1).all() and len(p1) == len(e1)
    assert (p1["Time"].values == e1["Time"].values).all()
    # 'NaN' text must be missing (null), never a number
    assert p1["Aggregate"].isna().sum() == e1["Aggregate"].isna().sum()
    both = ms.read_readings(spark, tmp_dir).toPandas()
    assert sorted(both["house_id"].unique()) == [1, 2, 3]
    for h in (1, 2, 3):
        p = both[both.house_id == h].sort_values("Time").reset_index(drop=True)
        e = src[src.house_id == h].sort_values("Time").reset_index(drop=True)
        assert len(p) == len(e) and (abs(p["Time"] - e["Time"]) <= pd.Timedelta(microseconds=1)).all()
        for c in ("Aggregate", "Appliance1", "Appliance9"):
            assert p[c].fillna(-1).tolist() == pytest.approx(e[c].fillna(-1).tolist()), (h, c)
    assert ms.list_houses(ms.read_readings(spark, tmp_dir)).count() == 3
    assert ms.read_readings(spark, tmp_dir, house=2).select("house_id").distinct().count() == 1


def test_clean_counts_match_fixture_table(spark):
    # FIXTURES: sf0.001 has 1,000 raw rows, 15 houses and 20 dropped by cleaning
    r = ms.load_readings(spark, SF_SMALL)
    rep = ms.cleaning_report(r).agg(F.sum("rows_in"), F.sum("rows_removed"), F.count("*")).first()
    assert tuple(rep) == (1000, 20, 15)


def test_columns_go_by_name_in_each_file(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "House_1.csv"), "w") as f:
        f.write("Time,Aggregate,Appliance1\n2014-01-01 00:00:00,100,10\n")
    with open(os.path.join(tmp_dir, "House_2.csv"), "w") as f:
        f.write("Unix,Appliance1,Aggregate,Appliance2\n1388534400,20,200,2\n")
    got = {r["house_id"]: r for r in ms.read_readings(spark, tmp_dir).collect()}
    assert (got[1]["Aggregate"], got[1]["Appliance1"], got[1]["Appliance2"]) == (100.0, 10.0, None)
    assert (got[2]["Aggregate"], got[2]["Appliance1"], got[2]["Appliance2"]) == (200.0, 20.0, 2.0)
    assert got[1]["Time"] == got[2]["Time"]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, float("nan"), 1.0), (1, 5.0, float("nan")), (1, 6.0, -2.0)], "house_id bigint, Aggregate double, Appliance1 double")
    assert sorted((r["Aggregate"], r["Appliance1"]) for r in ms.clean(df).collect()) == [(5.0, 0.0), (6.0, 0.0)]
    assert ms.cleaning_report(df).first()["rows_removed"] == 1


def _write(folder, name, text):
    os.makedirs(os.path.dirname(os.path.join(folder, name)) or folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_every_csv_file_is_read(spark, tmp_dir):
    _write(tmp_dir, "CLEAN_House4.csv", "Time,Aggregate\n2014-01-01 00:00:00,4\n")
    _write(tmp_dir, "house_5.csv", "﻿\"Time\", Aggregate ,Room\r\n2014-01-01T00:00:00.5, 5 ,x\r\n")
    _write(tmp_dir, "house_id=6/part-00007-1.csv", "Unix,Aggregate\n1388534400.25,6\n")
    _write(tmp_dir, "more/meter8.csv", "Time,Unix,Aggregate\n2014-01-01 01:00:00+01:00,1,8")
    _write(tmp_dir, "House_9.csv", "Time,Aggregate\n")
    _write(tmp_dir, "_note.csv", "nothing\n")
    _write(tmp_dir, "note.txt", "nothing\n")
    got = {r["house_id"]: (str(r["Time"]), r["Aggregate"]) for r in ms.read_readings(spark, tmp_dir).collect()}
    assert got == {4: ("2014-01-01 00:00:00", 4.0), 5: ("2014-01-01 00:00:00.500000", 5.0), 6: ("2014-01-01 00:00:00.250000", 6.0), 8: ("2014-01-01 00:00:00", 8.0)}
    houses = ms.house_files(spark, tmp_dir)
    assert [r["house_id"] for r in ms.list_houses(houses.filter("house_id is not null")).collect()] == [4, 5, 6, 8, 9]
    assert [r["Room"] for r in ms.read_readings(spark, tmp_dir, house=5, extra=["Room"], bad_values=True).collect()] == [None]
    assert ms.read_readings(spark, tmp_dir, house=77).count() == 0


@pytest.mark.parametrize("text", ["timestamp,Aggregate\n2014-01-01,1\n", "", "Time,Time\n1,2\n", "Time,Aggregate\n2014-01-01 00:00:00,1,2\n"])
def test_files_that_cannot_be_read_are_named(spark, tmp_dir, text):
    _write(tmp_dir, "House_1.csv", "Time,Aggregate\n2014-01-01 00:00:00,1\n")
    _write(tmp_dir, "House_2.csv", text)
    with pytest.raises(Exception, match="House_2.csv"):
        ms.read_readings(spark, tmp_dir).collect()
    assert ms.read_readings(spark, tmp_dir, house=1).count() == 1


def test_bad_values_are_kept(spark, tmp_dir):
    _write(tmp_dir, "House_1.csv", "Time,Aggregate,Appliance1,Issues\n2014-02-31 00:00:00,abc,1,0\n2014-01-01 00:00:00,,NaN,1.0\n2014-01-01 00:00:01,inf,-1e3,2.5\nTime,2\n"
                                   "2014-01-01 00:00:02,1,2,3,4\n\n2014-01-01 00:00:03,\"7\",.5,99999999999\n")
    got = ms.read_readings(spark, tmp_dir, bad_values=True).select("Time", "Aggregate", "Appliance1", "Issues", "bad_values").collect()
    want = [(None, None, 1.0, 0, "Time=2014-02-31 00:00:00; Aggregate=abc"), ("2014-01-01 00:00:00", None, None, 1, None), ("2014-01-01 00:00:01", None, -1000.0, None, "Aggregate=inf; Issues=2.5"),
            ("2014-01-01 00:00:03", 7.0, 0.5, None, "Issues=99999999999"), (None, None, None, None, "line: Time,2"), (None, None, None, None, "line: 2014-01-01 00:00:02,1,2,3,4")]
    assert sorted([(None if r[0] is None else str(r[0]), *r[1:]) for r in got], key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("split, block", [(7, 5), (40, 16), (64, 1 << 20), (1 << 20, 33)])
def test_splits_hold_each_line_once(tmp_dir, split, block, monkeypatch):
    from meterspark.sources import house_files as hf
    monkeypatch.setattr(hf, "BLOCK_BYTES", block)
    text = "Time,Aggregate\n" + "".join(f"2014-01-01 00:{i // 60:02d}:{i % 60:02d},{'1' * (i % 9 + 1)}\n" for i in range(300))
    _write(tmp_dir, "House_1.csv", text + "2014-01-02 00:00:00,5")
    reader = hf.HouseReader({"path": tmp_dir, "split_bytes": str(split)}, hf.house_file_schema())
    parts = [b.to_pandas() for p in reader.partitions() for b in reader.read(p)]
    got = pd.concat(parts)
    assert len(got) == 301 and got["Time"].is_unique and got["Aggregate"].astype(int).astype(str).str.len().sum() == sum(i % 9 + 1 for i in range(300)) + 1


def test_no_job_before_the_scan_runs(spark, tmp_dir):
    _write(tmp_dir, "House_1.csv", "Time,Aggregate\n2014-01-01 00:00:00,1\n")
    spark.sparkContext.setJobGroup("sources", "none yet")
    try:
        ms.read_readings(spark, tmp_dir)
        ms.house_files(spark, tmp_dir)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("sources")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
