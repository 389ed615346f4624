"""Structured Streaming versions of the chain.

T-1 ``stream_readings``: readings files (Parquet or CSV) as a stream.
T-2 ``stream_minute_mean``: event-time tumbling means per house with a
    watermark; append mode emits each bin once it is closed.
T-3 ``stream_features``: rolling / lag features per house with
    ``applyInPandasWithState``; the state is the last ``window - 1`` values
    and the rows that the watermark has not passed yet.
T-4 ``stream_alerts``: stateless scoring, clustering and rules with the
    batch-fitted models (small model tables joined to the stream).
T-5 ``write_batches``: ``foreachBatch`` sink writing alerts and a per-batch
    summary.

Event time: ``withWatermark`` needs TIMESTAMP, the readings carry
TIMESTAMP_NTZ, so the stream works on ``_ts`` = the same wall-clock reading
taken as UTC. Run streams with ``spark.sql.session.timeZone=UTC`` (as
``build_session`` does) so no daylight-saving shift enters the conversion.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from meterspark.config import (DIFF_CLIP, PCT_CLIP, ROLLING_EPS, ROLLING_MIN_ROWS, ROLLING_WINDOW)
from meterspark.operators.resample import freq_seconds
from meterspark.sources.readings import HOUSE_FILE_COLUMNS, READINGS_SCHEMA, file_schema, parse_house_rows

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def to_event_time(ntz_col: str = "Time"):
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, `{ntz_col}`)"))


def from_event_time(ts_col: str):
    return F.expr(f"timestampadd(MICROSECOND, unix_micros(`{ts_col}`), {_EPOCH})")


def stream_readings(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None,
                    max_files_per_trigger: int | None = 1) -> DataFrame:
    """T-1: new files under ``path`` become micro-batches. CSV files are house
    files whose columns are those of ``schema``, by default HOUSE_FILE_COLUMNS;
    they are parsed as ``read_readings`` does, and a file with another header
    stops the stream."""
    csv = fmt == "csv"
    schema = schema or (file_schema(HOUSE_FILE_COLUMNS) if csv else READINGS_SCHEMA)
    r = spark.readStream.schema(file_schema(schema.names) if csv else schema).format(fmt)
    if csv:
        r = r.option("header", True).option("enforceSchema", False)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return parse_house_rows(r.load(path), schema.names) if csv else r.load(path)


def stream_minute_mean(readings: DataFrame, freq: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """T-2: clean, then mean per (house, ``freq`` bin); a bin is emitted once
    the watermark passes its end. ``freq`` must divide a day."""
    from meterspark.operators.cleaning import clean
    step = freq_seconds(freq)
    if 86400 % step:
        raise ValueError("streaming bins must divide a day")
    x = clean(readings).withColumn("_ts", to_event_time("Time"))
    numeric = [f.name for f in x.schema.fields
               if isinstance(f.dataType, T.NumericType) and f.name not in ("house_id",)]
    out = (x.withWatermark("_ts", watermark)
           .groupBy("house_id", F.window("_ts", f"{step} seconds").alias("w"))
           .agg(*[F.avg(c).alias(c) for c in numeric]))
    out = out.select("house_id", F.col("w.start").alias("_ws"), *numeric)
    return out.select("house_id", from_event_time("_ws").alias("Time"), *numeric)


FEATURE_STREAM_SCHEMA = T.StructType([
    T.StructField("house_id", T.LongType()), T.StructField("Time", T.TimestampNTZType()),
    T.StructField("Aggregate", T.DoubleType()), T.StructField("rolling_mean", T.DoubleType()),
    T.StructField("rolling_std", T.DoubleType()), T.StructField("deviation", T.DoubleType()),
    T.StructField("z_score", T.DoubleType()), T.StructField("diff_1", T.DoubleType()),
    T.StructField("diff_5", T.DoubleType()), T.StructField("pct_change", T.DoubleType()),
])
STATE_SCHEMA = T.StructType([
    T.StructField("vals", T.ArrayType(T.DoubleType())),          # the last released values
    T.StructField("wait_us", T.ArrayType(T.LongType())),         # rows not yet released: time, value
    T.StructField("wait", T.ArrayType(T.DoubleType())),
])


def _features_after(vals: np.ndarray, new: np.ndarray, window: int, min_rows: int) -> dict:
    """Rolling and lag features of ``new``, which follow ``vals``."""
    a = pd.Series(np.concatenate([vals, new]))
    roll = a.rolling(window, min_periods=min_rows)
    mean, std = roll.mean(), roll.std()
    dev = a - mean
    l1, l5 = a.shift(1), a.shift(5)
    with np.errstate(divide="ignore", invalid="ignore"):
        pct = ((a / l1) - 1) * 100
    cols = {"Aggregate": a, "rolling_mean": mean, "rolling_std": std, "deviation": dev,
            "z_score": dev / (std + ROLLING_EPS), "diff_1": (a - l1).clip(-DIFF_CLIP, DIFF_CLIP),
            "diff_5": (a - l5).clip(-DIFF_CLIP, DIFF_CLIP), "pct_change": pct.clip(-PCT_CLIP, PCT_CLIP)}
    return {c: v.to_numpy()[len(vals):] for c, v in cols.items()}


def _feature_fn(window: int, min_rows: int):
    keep = max(window - 1, 5)

    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        vals, wait_us, wait = (np.asarray(x) for x in state.get) if state.exists else ([], [], [])
        us, new = [np.asarray(wait_us, np.int64)], [np.asarray(wait, np.float64)]
        for pdf in pdfs:
            us.append(pdf["Time"].astype("datetime64[us]").astype("int64").to_numpy())
            new.append(pdf["Aggregate"].to_numpy(np.float64))
        us, new = np.concatenate(us), np.concatenate(new)
        order = np.argsort(us, kind="stable")
        us, new = us[order], new[order]
        watermark = state.getCurrentWatermarkMs()
        n = int(np.searchsorted(us, watermark * 1000, "right"))       # no row up to the watermark can follow
        vals = np.asarray(vals, np.float64)
        out = _features_after(vals, new[:n], window, min_rows)
        state.update((np.concatenate([vals, new[:n]])[-keep:].tolist(), us[n:].tolist(), new[n:].tolist()))
        if n < len(us):
            state.setTimeoutTimestamp(max(int(us[n]) // 1000, watermark + 1))
        if n:
            yield pd.DataFrame({"house_id": key[0], "Time": us[:n].astype("datetime64[us]"), **out})

    return fn


def stream_features(minute: DataFrame, window: int = ROLLING_WINDOW, min_rows: int = ROLLING_MIN_ROWS,
                    drop_warmup: bool = True, watermark: str = "10 minutes") -> DataFrame:
    """T-3: per-house rolling stats and rate features over arriving bins.

    Rows wait in the house's state until the watermark has passed them and
    leave it in order of time, so rows that arrive up to ``watermark`` out of
    order count as in batch. Later ones are dropped and counted (see
    ``late_rows``); rows without a time have no place in a stream. Warm-up rows
    (fewer than ``min_rows``) are dropped as in batch. The state of a house is
    ``window - 1`` values and the rows newer than the watermark."""
    rows = (minute.select("house_id", "Time", "Aggregate").filter(F.col("Time").isNotNull())
            .withColumn("_ts", to_event_time("Time")).withWatermark("_ts", watermark))
    out = rows.groupBy("house_id").applyInPandasWithState(
        _feature_fn(window, min_rows), FEATURE_STREAM_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    if drop_warmup:
        out = out.filter(F.col("rolling_mean").isNotNull() & F.col("rolling_std").isNotNull())
    return out


def late_rows(query) -> int:
    """Rows that a query dropped because they came after the watermark, over
    the progress reports that the session keeps."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress
               for op in json.loads(p.json if hasattr(p, "json") else json.dumps(p))["stateOperators"])


END_HOUSE = -1


def end_mark(rows: DataFrame) -> DataFrame:
    """One row of no house, two days after the last of ``rows``. Appended to a
    stream's input when nothing more will come, it moves the watermark past
    all rows, so that open bins and waiting rows come out. The mark itself
    stays behind the watermark and is never emitted."""
    last = rows.agg(F.max("Time").alias("Time"))
    return last.select(*[
        F.lit(END_HOUSE).cast(f.dataType).alias(f.name) if f.name == "house_id"
        else (F.col("Time") + F.expr("INTERVAL 2 DAYS")).alias("Time") if f.name == "Time"
        else F.lit(1).cast(f.dataType).alias(f.name) if isinstance(f.dataType, T.NumericType)     # a valid reading
        else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])


def stream_alerts(features: DataFrame, hourly: DataFrame | None = None, forest=None, kmeans=None,
                  thresholds: dict | None = None) -> DataFrame:
    """T-4: calendar columns, the (batch) hourly profile, model scores and
    clusters, then alert rows. Models are the batch-fitted tables."""
    from meterspark.operators.calendar import add_time_features
    from meterspark.operators.rules import alerts
    x = add_time_features(features)
    if hourly is not None:
        from meterspark.functions.lookup import lookup_join
        x = lookup_join(x, hourly, ["house_id", "hour"], "left")     # static side, size-checked
    if forest is not None:
        from meterspark.models.forest import score_forest
        x = score_forest(x, forest)
    if kmeans is not None:
        from meterspark.models.kmeans import assign_clusters
        x = assign_clusters(x, kmeans)
    return alerts(x, thresholds)


def write_batches(stream: DataFrame, out_path: str, checkpoint: str, trigger_once: bool = True):
    """T-5: each micro-batch's alerts as Parquet in a folder of its own
    (``batch_id=<id>``, which readers see as a column), plus counts per house
    and severity. A batch that is run again replaces what it wrote before."""
    def sink(batch: DataFrame, batch_id: int):
        alerts_path = f"{out_path}/alerts/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(alerts_path)
        (batch.sparkSession.read.schema(batch.schema).parquet(alerts_path).groupBy("house_id", "severity").agg(F.count(F.lit(1)).alias("alerts"))
         .write.mode("overwrite").parquet(f"{out_path}/batch_summary/batch_id={batch_id}"))

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
