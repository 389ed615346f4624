"""Registered queries over the driver's tables and their DuckDB oracle SQL.

Every query reads ``events`` (readings derived from it) at whatever scale
``sf_dir`` holds, over whole tables. Doubles are rounded to ``DIGITS``
decimals on both sides (through DECIMAL(38, 9)) before comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

import meterspark as ms
from meterspark.operators import reports as ms_reports
from meterspark.operators import rules as ms_rules
from meterspark.operators import views as ms_views
from meterspark.models import forest as ms_forest
from meterspark.models import kmeans as ms_kmeans
from meterspark.sources import readings as ms_sources
from meterspark.config import FOREST_FEATURES, KMEANS_FEATURES
from meterspark.sources.readings import APPLIANCES, ORACLE_READINGS_SQL

DIGITS = 6
QUERIES: dict = {}
ORACLE: dict = {}


def _round_col(name: str):
    # Through DECIMAL(38, 9) first: summation-order noise (~1e-13) is gone
    # before the half-up rounding, so exact decimal ties round alike.
    # NaN, infinities and values beyond the type come out as they are.
    return F.coalesce(F.round(F.expr(f"try_cast(`{name}` AS DECIMAL(38, 9))"), DIGITS).cast("double"), F.col(name))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_round_col(f.name).alias(f.name) if isinstance(f.dataType, DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def register(name: str, sql: str | None = None, doubles: list[str] | None = None):
    """Register a query; ``sql`` (a SELECT over CTEs defined in ``_CTES``)
    is wrapped so its ``doubles`` are rounded like ``rounded``."""
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = oracle(sql, doubles or [])
        return fn
    return deco


def oracle(select_sql: str, doubles: list[str]) -> str:
    rep = ", ".join(f"coalesce(CAST(round(TRY_CAST({c} AS DECIMAL(38, 9)), {DIGITS}) AS DOUBLE), {c}) AS {c}" for c in doubles)
    outer = f"SELECT * REPLACE ({rep}) FROM q" if doubles else "SELECT * FROM q"
    return f"WITH {_CTES},\nq AS (\n{select_sql}\n)\n{outer}"



# --- oracle building blocks (DuckDB SQL) -----------------------------------
_APP = ", ".join(APPLIANCES)
_APP_CLEAN = ", ".join(f"greatest(coalesce({a}, 0.0), 0.0) AS {a}" for a in APPLIANCES)
_APP_AVG = ", ".join(f"avg({a}) AS {a}" for a in APPLIANCES)
_APP_SUM = " + ".join(APPLIANCES)
_APP_ACTIVE = " + ".join(f"CAST({a} > 10 AS INTEGER)" for a in APPLIANCES)

def _clip(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest(least({x}, {hi}), {lo}) END"


def _feature_ctes(src: str, p: str = "", order: str = '"Time"') -> str:
    """timed -> win -> feat_all -> features over ``src`` (CTE names prefixed by ``p``)."""
    return f"""
{p}timed AS (
  SELECT *, CAST(hour("Time") AS INTEGER) AS hour, CAST(minute("Time") AS INTEGER) AS minute,
         CAST(isodow("Time") - 1 AS INTEGER) AS day_of_week, CAST(month("Time") AS INTEGER) AS month,
         CAST(isodow("Time") >= 6 AS INTEGER) AS is_weekend,
         CAST(hour("Time") >= 23 OR hour("Time") < 5 AS INTEGER) AS is_night,
         CAST(hour("Time") BETWEEN 7 AND 9 OR hour("Time") BETWEEN 17 AND 21 AS INTEGER) AS is_peak
  FROM {src}
),
{p}win AS (
  SELECT *,
    CASE WHEN count(Aggregate) OVER w30 >= 5 THEN avg(Aggregate) OVER w30 END AS rolling_mean,
    CASE WHEN count(Aggregate) OVER w30 >= 5 THEN stddev_samp(Aggregate) OVER w30 END AS rolling_std,
    lag(Aggregate, 1) OVER w AS lag1, lag(Aggregate, 5) OVER w AS lag5
  FROM {p}timed
  WINDOW w AS (PARTITION BY house_id ORDER BY {order}),
         w30 AS (PARTITION BY house_id ORDER BY {order} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
),
{p}feat_all AS (
  SELECT * EXCLUDE (lag1, lag5),
    Aggregate - rolling_mean AS deviation,
    (Aggregate - rolling_mean) / (rolling_std + 1e-5) AS z_score,
    {_clip("Aggregate - lag1", -5000.0, 5000.0)} AS diff_1,
    {_clip("Aggregate - lag5", -5000.0, 5000.0)} AS diff_5,
    {_clip("(Aggregate / lag1 - 1) * 100", -500.0, 500.0)} AS pct_change,
    {_APP_SUM} AS appliance_sum,
    greatest(Aggregate - ({_APP_SUM}), 0.0) AS unaccounted_load,
    CAST({_APP_ACTIVE} AS INTEGER) AS active_appliances,
    avg(Aggregate) OVER (PARTITION BY house_id, hour) AS hourly_avg
  FROM {p}win
),
{p}features AS (
  SELECT * EXCLUDE (hourly_avg), hourly_avg, CAST(coalesce(Aggregate > hourly_avg, false) AS INTEGER) AS above_hourly
  FROM {p}feat_all WHERE rolling_mean IS NOT NULL AND rolling_std IS NOT NULL
)"""


_CTES = f"""
readings AS ({ORACLE_READINGS_SQL}),
cleaned AS (
  SELECT house_id, "Time", Aggregate, {_APP_CLEAN}
  FROM readings WHERE Aggregate > 0
),
minute AS (
  SELECT house_id, time_bucket(INTERVAL 1 MINUTE, "Time") AS "Time", avg(Aggregate) AS Aggregate, {_APP_AVG}
  FROM cleaned GROUP BY ALL
),{_feature_ctes("minute")},{_feature_ctes("cleaned", "raw_", '"Time", Aggregate, ' + _APP)}"""

_TIME_COLS = ["hour", "minute", "day_of_week", "month", "is_weekend", "is_night", "is_peak"]
_FEATURE_DOUBLES = (["Aggregate"] + APPLIANCES + ["rolling_mean", "rolling_std", "deviation", "z_score",
                                                  "diff_1", "diff_5", "pct_change", "appliance_sum",
                                                  "unaccounted_load", "hourly_avg"])


# --- pipeline stages as cached builders --------------------------------------
def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.load_readings(spark, sf_dir)


def minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.downsample(ms.clean(readings(spark, sf_dir)), "1 minute")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.add_time_features(minute(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.engineer_features(timed(spark, sf_dir), unique_time=True)


# --- stage queries ---------------------------------------------------------
@register("clean_readings", 'SELECT * FROM cleaned', ["Aggregate"] + APPLIANCES)
def q_clean_readings(spark, sf_dir):
    return ms.clean(readings(spark, sf_dir))


@register("cleaning_report", """
SELECT house_id, count(*) AS rows_in,
       count(*) FILTER (WHERE NOT coalesce(Aggregate > 0, false)) AS rows_removed,
       count(*) FILTER (WHERE Aggregate > 0) AS rows_kept
FROM readings GROUP BY house_id""")
def q_cleaning_report(spark, sf_dir):
    return ms.cleaning_report(readings(spark, sf_dir))


@register("downsample_1min", "SELECT * FROM minute", ["Aggregate"] + APPLIANCES)
def q_downsample_1min(spark, sf_dir):
    return minute(spark, sf_dir)


@register("downsample_1h", f"""
SELECT house_id, time_bucket(INTERVAL 1 HOUR, "Time") AS "Time", avg(Aggregate) AS Aggregate, {_APP_AVG}
FROM cleaned GROUP BY ALL""", ["Aggregate"] + APPLIANCES)
def q_downsample_1h(spark, sf_dir):
    return ms.downsample(ms.clean(readings(spark, sf_dir)), "1 hour")


@register("downsample_7min", f"""
SELECT house_id, o + to_microseconds(CAST(floor(epoch_us("Time" - o) / 420000000) * 420000000 AS BIGINT)) AS "Time",
       avg(Aggregate) AS Aggregate, {_APP_AVG}
FROM (SELECT *, CAST(CAST(min("Time") OVER (PARTITION BY house_id) AS DATE) AS TIMESTAMP) AS o FROM cleaned)
GROUP BY ALL""", ["Aggregate"] + APPLIANCES)
def q_downsample_7min(spark, sf_dir):
    return ms.downsample(ms.clean(readings(spark, sf_dir)), "7min")


@register("time_features", "SELECT * FROM timed", ["Aggregate"] + APPLIANCES)
def q_time_features(spark, sf_dir):
    return timed(spark, sf_dir)


@register("rolling_features", """
SELECT house_id, "Time", Aggregate, rolling_mean, rolling_std,
       Aggregate - rolling_mean AS deviation, (Aggregate - rolling_mean) / (rolling_std + 1e-5) AS z_score
FROM win""", ["Aggregate", "rolling_mean", "rolling_std", "deviation", "z_score"])
def q_rolling_features(spark, sf_dir):
    return ms.add_rolling_features(minute(spark, sf_dir).select("house_id", "Time", "Aggregate"))


@register("rolling_features_chunked", """
SELECT house_id, "Time", Aggregate, rolling_mean, rolling_std,
       Aggregate - rolling_mean AS deviation, (Aggregate - rolling_mean) / (rolling_std + 1e-5) AS z_score
FROM win""", ["Aggregate", "rolling_mean", "rolling_std", "deviation", "z_score"])
def q_rolling_features_chunked(spark, sf_dir):
    """The plan for huge houses: chunks of rows with a halo, here of 64 rows."""
    return ms.add_rolling_features(minute(spark, sf_dir).select("house_id", "Time", "Aggregate"), chunk_rows=64)


@register("rate_features", "SELECT house_id, \"Time\", Aggregate, diff_1, diff_5, pct_change FROM feat_all",
          ["Aggregate", "diff_1", "diff_5", "pct_change"])
def q_rate_features(spark, sf_dir):
    return ms.add_rate_features(minute(spark, sf_dir).select("house_id", "Time", "Aggregate"))


@register("appliance_features",
          'SELECT house_id, "Time", Aggregate, appliance_sum, unaccounted_load, active_appliances FROM feat_all',
          ["Aggregate", "appliance_sum", "unaccounted_load"])
def q_appliance_features(spark, sf_dir):
    return ms.add_appliance_features(minute(spark, sf_dir)).select(
        "house_id", "Time", "Aggregate", "appliance_sum", "unaccounted_load", "active_appliances")


@register("hourly_pattern", """
SELECT house_id, "Time", Aggregate, hour, hourly_avg, CAST(coalesce(Aggregate > hourly_avg, false) AS INTEGER) AS above_hourly
FROM (SELECT *, avg(Aggregate) OVER (PARTITION BY house_id, hour) AS hourly_avg FROM timed)""",
          ["Aggregate", "hourly_avg"])
def q_hourly_pattern(spark, sf_dir):
    return ms.add_hourly_pattern(timed(spark, sf_dir).select("house_id", "Time", "Aggregate", "hour"))


@register("hourly_pattern_derived_hour", """
SELECT house_id, "Time", Aggregate, hour, hourly_avg, CAST(coalesce(Aggregate > hourly_avg, false) AS INTEGER) AS above_hourly
FROM (SELECT *, avg(Aggregate) OVER (PARTITION BY house_id, hour) AS hourly_avg FROM timed)""",
          ["Aggregate", "hourly_avg"])
def q_hourly_pattern_derived_hour(spark, sf_dir):
    """P12: a frame without an hour column gets it from Time."""
    return ms.add_hourly_pattern(minute(spark, sf_dir).select("house_id", "Time", "Aggregate"))


@register("features_without_appliances", 'SELECT * EXCLUDE (' + _APP + ', appliance_sum, unaccounted_load, active_appliances) FROM features',
          [c for c in _FEATURE_DOUBLES if c not in APPLIANCES and c not in ("appliance_sum", "unaccounted_load")])
def q_features_without_appliances(spark, sf_dir):
    """R4f: houses without appliance channels have no appliance features."""
    return ms.engineer_features(timed(spark, sf_dir).drop(*APPLIANCES), unique_time=True)


@register("engineered_features", "SELECT * FROM features", _FEATURE_DOUBLES)
def q_engineered_features(spark, sf_dir):
    return features(spark, sf_dir)


@register("warmup_report", """
SELECT house_id, count(*) FILTER (WHERE rolling_mean IS NULL OR rolling_std IS NULL) AS warmup_dropped
FROM feat_all GROUP BY house_id""")
def q_warmup_report(spark, sf_dir):
    t = timed(spark, sf_dir)
    return ms.warmup_report(ms.add_rolling_features(t))




# --- rules, summaries and dashboard datasets --------------------------------
# Stand-in model outputs (rule tests need no trained model):
# is_anomaly = |z| > 2 or minute % 10 == 0, cluster_distance = |z|.
_SCORED = """
scored AS (
  SELECT *, CAST(abs(z_score) > 2 OR minute % 10 = 0 AS INTEGER) AS is_anomaly, abs(z_score) AS cluster_distance
  FROM features
)"""


def scored_standin(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.withColumns({
        "is_anomaly": ((F.abs("z_score") > 2) | (F.col("minute") % 10 == 0)).cast("int"),
        "cluster_distance": F.abs("z_score"),
    })


def _alerts_sql(src: str, with_model: bool = True) -> str:
    R = {
        1: "Act on this first: the reading lies far outside its rolling band.",
        2: "Compare this hour with the same hour of earlier nights.",
        3: "See which channel rose together with the total.",
        4: "Watch whether the next readings are flagged as well.",
        5: "Move part of the load to another hour.",
        6: "Review the clusters of this house, or its meter.",
    }
    an = "is_anomaly <> 0" if with_model else "false"
    cd = "coalesce(cluster_distance > 2.5, false)" if with_model else "false"
    ts = "strftime(\"Time\", '%Y-%m-%d %H:%M')"
    w = "format('{:.0f}', Aggregate)"
    parts = [
        ("k1", "0", 1, "critical", "🔴",
         "'🔴 |z| = ' || format('{:.1f}', abs(z_score)) || ' in the rolling window'"),
        ("k2", "0", 2, "warning", "🌙",
         f"'🌙 flagged by night: ' || {w} || ' W in hour ' || lpad(CAST(hour AS VARCHAR), 2, '0')"),
        ("k3", "0", 3, "warning", "🔺",
         f"'🔺 flagged rise: ' || {w} || ' W, rolling mean ' || format('{{:.0f}}', Aggregate - deviation) || ' W, difference ' || format('{{:+.0f}}', deviation) || ' W'"),
        ("k4", "0", 4, "info", "⚠️", f"'⚠️ flagged reading: ' || {w} || ' W'"),
        ("k5", "CAST(k1 OR k2 OR k3 OR k4 AS INTEGER)", 5, "info", "💡",
         f"'💡 total ' || {w} || ' W, limit 3000 W'"),
        ("k6", "CAST(k1 OR k2 OR k3 OR k4 AS INTEGER) + CAST(k5 AS INTEGER)", 6, "info", "🔍",
         "'🔍 flagged reading far from its cluster center'"),
    ]
    sel = "\nUNION ALL\n".join(
        f"SELECT house_id, \"Time\", CAST({pos} AS INTEGER) AS rule_pos, CAST({r} AS INTEGER) AS rule, {ts} AS timestamp, "
        f"'{sev}' AS severity, {msg} AS message, '{R[r]}' AS recommendation, Aggregate AS value, '{icon}' AS icon "
        f"FROM f2 WHERE {k}" for k, pos, r, sev, icon, msg in parts)
    return f"""
flags AS (
  SELECT *, coalesce(abs(z_score) > 3.5, false) AS k1, {an} AS an, is_night <> 0 AS ni,
         coalesce(deviation > 2.0 * rolling_std, false) AS sp, coalesce(Aggregate > 3000, false) AS k5,
         {cd} AND {an} AS k6
  FROM {src}),
f2 AS (SELECT *, NOT k1 AND an AND ni AS k2, NOT k1 AND an AND NOT ni AND sp AS k3,
              NOT k1 AND an AND NOT ni AND NOT sp AS k4 FROM flags),
alerts AS ({sel})"""


_ALERT_DOUBLES = ["value"]


@register("rule_alerts", "WITH " + _SCORED.strip() + "," + _alerts_sql("scored") + "\nSELECT * FROM alerts",
          _ALERT_DOUBLES)
def q_rule_alerts(spark, sf_dir):
    return ms_rules.alerts(scored_standin(spark, sf_dir))


@register("critical_and_high_alerts", "WITH " + _alerts_sql("features", with_model=False).strip() + "\nSELECT * FROM alerts",
          _ALERT_DOUBLES)
def q_entry_alerts(spark, sf_dir):
    """Flagship slice: no model yet, so only K1 (critical z) and K5 (high usage)."""
    return ms_rules.newest_first(ms_rules.alerts(features(spark, sf_dir)))


@register("top_critical", "WITH " + _SCORED.strip() + "," + _alerts_sql("scored") + """
SELECT *, CAST(row_number() OVER (PARTITION BY house_id ORDER BY timestamp DESC, "Time", rule_pos) AS INTEGER) AS rank
FROM alerts WHERE severity = 'critical'
QUALIFY rank <= 5""", _ALERT_DOUBLES)
def q_top_critical(spark, sf_dir):
    return ms_rules.top_critical(ms_rules.alerts(scored_standin(spark, sf_dir)), 5)


@register("alert_counts", "WITH " + _SCORED.strip() + "," + _alerts_sql("scored") + """
SELECT s.house_id, CAST(coalesce(a.alerts, 0) AS BIGINT) AS alerts, s.anomalies
FROM (SELECT house_id, CAST(sum(is_anomaly) AS BIGINT) AS anomalies FROM scored GROUP BY house_id) s
LEFT JOIN (SELECT house_id, count(*) AS alerts FROM alerts GROUP BY house_id) a USING (house_id)""")
def q_alert_counts(spark, sf_dir):
    return ms_rules.alert_counts(scored_standin(spark, sf_dir))


@register("standby_recommendations", "WITH " + _SCORED.strip() + """
SELECT house_id, "Time", strftime("Time", '%Y-%m-%d %H:%M') AS timestamp, Aggregate AS value,
       '💤 night total ' || format('{:.0f}', Aggregate) || ' W, limit 100 W' AS recommendation
FROM scored WHERE is_night <> 0 AND NOT (is_anomaly <> 0) AND Aggregate > 100""", ["value"])
def q_standby(spark, sf_dir):
    return ms_rules.standby_recommendations(scored_standin(spark, sf_dir))


_SUMMARY_SQL = """
SELECT house_id, count(*) AS total_readings, CAST(sum(is_anomaly) AS BIGINT) AS anomaly_count,
       round_even(avg(is_anomaly) * 100 * 100.0, 0) / 100.0 AS anomaly_pct,
       round_even(avg(Aggregate) * 10.0, 0) / 10.0 AS avg_consumption_w,
       round_even(max(Aggregate) * 10.0, 0) / 10.0 AS peak_consumption_w,
       count(*) FILTER (WHERE is_anomaly = 1 AND is_night = 1) AS night_anomalies,
       count(*) FILTER (WHERE Aggregate > 3000) AS high_consumption,
       round_even(sum(Aggregate) * 1.0 / 1000 / 60 * 100.0, 0) / 100.0 AS estimated_kwh
FROM scored GROUP BY house_id"""


@register("house_summary", "WITH " + _SCORED.strip() + _SUMMARY_SQL,
          ["anomaly_pct", "avg_consumption_w", "peak_consumption_w", "estimated_kwh"])
def q_house_summary(spark, sf_dir):
    return ms_reports.summary(scored_standin(spark, sf_dir))


@register("detection_rate", "WITH " + _SCORED.strip() + """
SELECT house_id, CAST(sum(is_anomaly) AS BIGINT) AS flagged, count(*) AS total, avg(is_anomaly) * 100 AS detection_pct
FROM scored GROUP BY house_id""", ["detection_pct"])
def q_detection_rate(spark, sf_dir):
    return ms_reports.detection_rate(scored_standin(spark, sf_dir))


@register("date_range", 'SELECT house_id, min("Time") AS first_time, max("Time") AS last_time FROM features GROUP BY house_id')
def q_date_range(spark, sf_dir):
    return ms_reports.date_range(features(spark, sf_dir))


_UNPIV = ", ".join(APPLIANCES)


@register("appliance_breakdown", f"""
SELECT *, CAST(row_number() OVER (PARTITION BY house_id ORDER BY avg_w DESC, appliance) AS INTEGER) AS rank
FROM (SELECT house_id, appliance, avg(watts) AS avg_w
      FROM (UNPIVOT (SELECT house_id, {_UNPIV} FROM features) ON {_UNPIV} INTO NAME appliance VALUE watts)
      GROUP BY ALL HAVING avg(watts) > 1)""", ["avg_w"])
def q_appliance_breakdown(spark, sf_dir):
    return ms_reports.appliance_breakdown(features(spark, sf_dir))


_HEAT = ", ".join(f"avg(Aggregate) FILTER (WHERE hour = {h}) AS h{h:02d}" for h in range(24))


@register("hour_heatmap", f"""
SELECT house_id, day_of_week, ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][day_of_week + 1] AS day, {_HEAT}
FROM features GROUP BY house_id, day_of_week""", [f"h{h:02d}" for h in range(24)])
def q_hour_heatmap(spark, sf_dir):
    return ms_reports.hour_heatmap(features(spark, sf_dir))


@register("baseline_band", """
SELECT house_id, "Time", Aggregate, rolling_mean, rolling_mean - rolling_std AS band_low,
       rolling_mean + rolling_std AS band_high FROM features""",
          ["Aggregate", "rolling_mean", "band_low", "band_high"])
def q_baseline_band(spark, sf_dir):
    return ms_views.baseline_band(features(spark, sf_dir))


@register("anomaly_markers", "WITH " + _SCORED.strip() + """
SELECT house_id, "Time", Aggregate FROM scored WHERE is_anomaly = 1""", ["Aggregate"])
def q_anomaly_markers(spark, sf_dir):
    return ms_views.anomaly_markers(scored_standin(spark, sf_dir))


@register("recent_anomalies", "WITH " + _SCORED.strip() + """
SELECT house_id, "Time", Aggregate, z_score, is_anomaly FROM scored WHERE is_anomaly = 1
QUALIFY row_number() OVER (PARTITION BY house_id ORDER BY "Time" DESC) <= 6""", ["Aggregate", "z_score"])
def q_recent_anomalies(spark, sf_dir):
    return ms_views.recent_anomalies(scored_standin(spark, sf_dir), 6).select(
        "house_id", "Time", "Aggregate", "z_score", "is_anomaly")


@register("alert_panel", "WITH " + _SCORED.strip() + """,
recent AS (SELECT * FROM scored WHERE is_anomaly = 1
           QUALIFY row_number() OVER (PARTITION BY house_id ORDER BY "Time" DESC) <= 6),""" + _alerts_sql("recent") + """
SELECT *, strftime("Time", '%H:%M %d %b') AS display_time FROM alerts""", _ALERT_DOUBLES)
def q_alert_panel(spark, sf_dir):
    return ms_rules.alert_panel(scored_standin(spark, sf_dir), 6)


@register("latest_reading", """
SELECT * FROM features QUALIFY row_number() OVER (PARTITION BY house_id ORDER BY "Time" DESC) = 1""",
          _FEATURE_DOUBLES)
def q_latest_reading(spark, sf_dir):
    return ms_views.latest(features(spark, sf_dir))


_IDX = """
idx AS (SELECT *, row_number() OVER (PARTITION BY house_id ORDER BY "Time") - 1 AS j,
               count(*) OVER (PARTITION BY house_id) AS n FROM scored)"""


@register("sliding_views", "WITH " + _SCORED.strip() + "," + _IDX + """,
fr AS (SELECT *, count(*) OVER w AS rows, min("Time") OVER w AS start_time, avg(Aggregate) OVER w AS avg_w,
              max(Aggregate) OVER w AS peak_w, CAST(sum(is_anomaly) OVER w AS BIGINT) AS anomalies
       FROM idx WINDOW w AS (PARTITION BY house_id ORDER BY j ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
ids AS (SELECT house_id, n, unnest(range(0, CAST(ceil(n / 5.0) AS BIGINT))) AS i
        FROM (SELECT DISTINCT house_id, n FROM idx))
SELECT f.house_id, ids.i AS window_id, f.start_time, f."Time" AS end_time, f.rows, f.avg_w, f.peak_w, f.anomalies
FROM ids JOIN fr f ON f.house_id = ids.house_id AND f.j = least(ids.i * 5 + 100, ids.n) - 1""",
          ["avg_w", "peak_w"])
def q_sliding_views(spark, sf_dir):
    return ms_views.sliding_views(scored_standin(spark, sf_dir), size=100, step=5)


@register("row_batches", "WITH " + _SCORED.strip() + "," + _IDX + """
SELECT house_id, CAST(j // 10 AS BIGINT) AS batch_id, count(*) AS rows, min("Time") AS start_time,
       max("Time") AS end_time, avg(Aggregate) AS avg_w, max(Aggregate) AS peak_w,
       CAST(sum(is_anomaly) AS BIGINT) AS anomalies
FROM idx GROUP BY ALL""", ["avg_w", "peak_w"])
def q_row_batches(spark, sf_dir):
    return ms_views.row_batches(scored_standin(spark, sf_dir), 10)


@register("view_at", "WITH " + _SCORED.strip() + "," + _IDX + """
SELECT house_id, "Time", Aggregate, j AS row_idx FROM idx
WHERE j >= 200 + (7 % (greatest(floor((n - 200) / 5), 0) + 1)) * 5 - 200
  AND j < 200 + (7 % (greatest(floor((n - 200) / 5), 0) + 1)) * 5""", ["Aggregate"])
def q_view_at(spark, sf_dir):
    return ms_views.view_at(scored_standin(spark, sf_dir), 7, size=200, step=5).select(
        "house_id", "Time", "Aggregate", "row_idx")


@register("last_rows", "WITH " + _SCORED.strip() + "," + _IDX + """
SELECT house_id, "Time", Aggregate FROM idx WHERE j >= n - 200""", ["Aggregate"])
def q_last_rows(spark, sf_dir):
    return ms_views.last_rows(scored_standin(spark, sf_dir), 200).select("house_id", "Time", "Aggregate")


# --- models ----------------------------------------------------------------
# Fixed centers (scaled space; features Aggregate, hour, rolling_mean,
# is_weekend) so that assignment, labels and distances have an oracle.
FIXED_CENTERS = [
    [-0.8, -1.0, -0.8, -0.5],
    [0.0, 0.0, 0.0, 1.5],
    [1.5, 0.5, 1.0, -0.5],
    [-0.5, -1.4, -0.5, -0.5],
]


def _stats_sql(feats: list[str], name: str, fill: bool) -> str:
    v = (lambda c: f"coalesce(CAST({c} AS DOUBLE), 0.0)") if fill else (lambda c: f"CAST({c} AS DOUBLE)")
    cols = ", ".join(f"avg({v(c)}) AS m{i}, CASE WHEN coalesce(stddev_pop({v(c)}), 0) = 0 THEN 1.0 "
                     f"ELSE stddev_pop({v(c)}) END AS s{i}" for i, c in enumerate(feats))
    return f"{name} AS (SELECT house_id, count(*) AS n, {cols} FROM features GROUP BY house_id)"


def _z_sql(feats: list[str], stats: str) -> str:
    return ", ".join(f"(coalesce(CAST({c} AS DOUBLE), 0.0) - {stats}.m{i}) / {stats}.s{i} AS z{i}"
                     for i, c in enumerate(feats))


_KC = "VALUES " + ", ".join(f"({j}, " + ", ".join(repr(float(v)) for v in c) + ")" for j, c in enumerate(FIXED_CENTERS))
_KD = ", ".join("(" + " + ".join(f"pow(z{f} - {repr(float(c[f]))}, 2)" for f in range(4)) + f") AS d{j}"
                for j, c in enumerate(FIXED_CENTERS))
_KMEANS_CTES = f"""
{_stats_sql(KMEANS_FEATURES, 'kst', True)},
kcent AS (SELECT * FROM ({_KC}) t(cluster, c0, c1, c2, c3)),
kprof AS (SELECT kst.house_id, CAST(kcent.cluster AS INTEGER) AS cluster,
                 c0 * s0 + m0 AS Aggregate, c1 * s1 + m1 AS hour, c2 * s2 + m2 AS rolling_mean, c3 * s3 + m3 AS is_weekend
          FROM kst CROSS JOIN kcent),
klab AS (SELECT house_id, cluster,
                CASE WHEN rk = 0 THEN '💤 Standby / Idle' WHEN rk = last THEN '⚡ Peak Usage'
                     WHEN hour < 8 OR hour >= 22 THEN '🌙 Night Low' ELSE '🏠 Daytime Moderate' END AS cluster_label
         FROM (SELECT *, row_number() OVER (PARTITION BY house_id ORDER BY Aggregate, cluster) - 1 AS rk,
                      count(*) OVER (PARTITION BY house_id) - 1 AS last FROM kprof)),
kd AS (SELECT f.house_id, f."Time", {_KD}
       FROM (SELECT features.house_id, features."Time", {_z_sql(KMEANS_FEATURES, 'kst')}
             FROM features JOIN kst USING (house_id)) f),
kasg AS (SELECT house_id, "Time",
                CAST(CASE WHEN d0 <= d1 AND d0 <= d2 AND d0 <= d3 THEN 0 WHEN d1 <= d2 AND d1 <= d3 THEN 1
                          WHEN d2 <= d3 THEN 2 ELSE 3 END AS INTEGER) AS cluster,
                sqrt(least(d0, d1, d2, d3)) AS cluster_distance FROM kd)"""


def fixed_kmeans(spark, sf_dir):
    return ms_kmeans.fixed_model(features(spark, sf_dir), FIXED_CENTERS)


@register("scaler_stats", f"""WITH {_stats_sql(KMEANS_FEATURES, 'kst', True)}
SELECT house_id, n AS _n, {", ".join(f"m{i} AS {c}_mean, s{i} AS {c}_scale" for i, c in enumerate(KMEANS_FEATURES))}
FROM kst""", [f"{c}_{s}" for c in KMEANS_FEATURES for s in ("mean", "scale")])
def q_scaler_stats(spark, sf_dir):
    return fixed_kmeans(spark, sf_dir).scaler.drop("_nonconst")


@register("scaler_stats_available", f"""WITH {_stats_sql(["Aggregate", "rolling_mean"], 'kst', True)}
SELECT house_id, n AS _n, m0 AS "Aggregate_mean", s0 AS "Aggregate_scale", m1 AS rolling_mean_mean, s1 AS rolling_mean_scale
FROM kst""", ["Aggregate_mean", "Aggregate_scale", "rolling_mean_mean", "rolling_mean_scale"])
def q_scaler_stats_available(spark, sf_dir):
    """P13: a model is fitted on those of its features that the frame has."""
    f = features(spark, sf_dir).drop("hour", "is_weekend")
    return ms_kmeans.fixed_model(f, [c[:2] for c in FIXED_CENTERS]).scaler.drop("_nonconst")


@register("kmeans_assign_fixed", f"""WITH {_KMEANS_CTES.strip()}
SELECT kasg.house_id, kasg."Time", kasg.cluster, klab.cluster_label, kasg.cluster_distance
FROM kasg JOIN klab USING (house_id, cluster)""", ["cluster_distance"])
def q_kmeans_assign_fixed(spark, sf_dir):
    return ms_kmeans.assign_clusters(features(spark, sf_dir), fixed_kmeans(spark, sf_dir)).select(
        "house_id", "Time", "cluster", "cluster_label", "cluster_distance")


@register("cluster_auto_label", f"WITH {_KMEANS_CTES.strip()}\nSELECT * FROM klab")
def q_cluster_auto_label(spark, sf_dir):
    return ms_kmeans.auto_labels(fixed_kmeans(spark, sf_dir))


@register("centroid_profile", f"""WITH {_KMEANS_CTES.strip()}
SELECT house_id, cluster, {", ".join(f"round_even({c} * 10.0, 0) / 10.0 AS {c}" for c in KMEANS_FEATURES)}
FROM kprof""", list(KMEANS_FEATURES))
def q_centroid_profile(spark, sf_dir):
    return ms_kmeans.centroid_profile(fixed_kmeans(spark, sf_dir))


@register("cluster_distribution", f"""WITH {_KMEANS_CTES.strip()}
SELECT house_id, cluster, cluster_label, count, round_even(count / sum(count) OVER (PARTITION BY house_id) * 100 * 10.0, 0) / 10.0 AS pct
FROM (SELECT house_id, cluster, cluster_label, count(*) AS count FROM kasg JOIN klab USING (house_id, cluster) GROUP BY ALL)""",
          ["pct"])
def q_cluster_distribution(spark, sf_dir):
    a = ms_kmeans.assign_clusters(features(spark, sf_dir), fixed_kmeans(spark, sf_dir))
    return ms_reports.cluster_distribution(a)


def _lloyd_sql(k: int, iterations: int) -> str:
    """CTEs l<k>_0.. (centers after each iteration) and sse<k>: Lloyd from the first k fixed centers."""
    out = [f"l{k}_0 AS (SELECT house_id, cluster, c0, c1, c2, c3 FROM kst CROSS JOIN kcent WHERE cluster < {k})"]
    for t in range(iterations + 1):
        d = " + ".join(f"pow(z{f} - c{f}, 2)" for f in range(4))
        out.append(f"""a{k}_{t} AS (SELECT * FROM (SELECT kz.*, cluster, {d} AS d FROM kz JOIN l{k}_{t} USING (house_id))
        QUALIFY row_number() OVER (PARTITION BY house_id, "Time" ORDER BY d, cluster) = 1)""")
        if t < iterations:
            means = ", ".join(f"coalesce(avg(z{f}), max(c{f})) AS c{f}" for f in range(4))
            out.append(f"l{k}_{t + 1} AS (SELECT house_id, cluster, {means} FROM l{k}_{t} LEFT JOIN a{k}_{t} USING (house_id, cluster) GROUP BY house_id, cluster)")
    out.append(f"sse{k} AS (SELECT house_id, sum(d) AS inertia FROM a{k}_{iterations} GROUP BY house_id)")
    return ",\n".join(out)


_KZ = f"""{_stats_sql(KMEANS_FEATURES, 'kst', True)},
kcent AS (SELECT * FROM ({_KC}) t(cluster, c0, c1, c2, c3)),
kz AS (SELECT features.house_id, features."Time", {_z_sql(KMEANS_FEATURES, 'kst')} FROM features JOIN kst USING (house_id))"""


@register("kmeans_lloyd_fixed_init", f"""WITH {_KZ}, {_lloyd_sql(4, 3)}
SELECT house_id, CAST(cluster AS INTEGER) AS cluster, c0, c1, c2, c3, inertia FROM l4_3 JOIN sse4 USING (house_id)""",
          ["c0", "c1", "c2", "c3", "inertia"])
def q_kmeans_lloyd_fixed_init(spark, sf_dir):
    """Three Lloyd iterations from given centers."""
    m = ms_kmeans.fit_kmeans(features(spark, sf_dir), k=4, max_iter=3, tol=0.0, init=FIXED_CENTERS)
    return m.centers.join(m.inertia.select("house_id", "inertia"), "house_id")


def _uniform_sql(run: int, step: int, seed: int = 7) -> str:
    """The uniform of a row (minutes since 1970) for a run and a step, modulo 2147483647."""
    def part(salt):
        h = f"((minutes % 2147483647 * 48271 + {seed + salt}) % 2147483647)"
        h = f"(({h} * {h} + {step * 16807 + salt}) % 2147483647)"
        h = f"(({h} * {h} + {run * 69621 + salt}) % 2147483647)"
        return f"(({h} * {h} + 40692) % 2147483647)"
    return f"(({part(1)} * 2147483647 + {part(2)} + 0.5::DOUBLE) / 4611686014132420609.0::DOUBLE)"


def _seeds_sql(run: int, k: int) -> str:
    """CTEs: for each house the row of the least uniform, then rows that win -ln(u) / (squared distance to the nearest seed)."""
    out = []
    for s in range(k):
        if s == 0:
            score, source = _uniform_sql(run, 0), "kmin"
        else:
            near = "least(" + ", ".join("(" + " + ".join(f"pow(z{f} - p{j}.z{f}, 2)".replace(f"(z{f}", f"(kmin.z{f}") for f in range(4)) + ")" for j in range(s)) + ")"
            score = f"-ln({_uniform_sql(run, s)}) / nullif({near}, 0)"
            source = "kmin " + " ".join(f"JOIN s{run}_{j} p{j} ON p{j}.house_id = kmin.house_id" for j in range(s))
        out.append(f"""s{run}_{s} AS (SELECT kmin.house_id, arg_min(kmin.z0, {score}) AS z0, arg_min(kmin.z1, {score}) AS z1,
        arg_min(kmin.z2, {score}) AS z2, arg_min(kmin.z3, {score}) AS z3 FROM {source} GROUP BY kmin.house_id)""")
    one = " UNION ALL ".join(f"SELECT house_id, {s} AS cluster, z0 AS c0, z1 AS c1, z2 AS c2, z3 AS c3 FROM s{run}_{s}" for s in range(k))
    return ",\n".join(out) + f",\nl{run}_0 AS ({one})"


def _seeded_sql(runs: int, k: int, iterations: int) -> str:
    """CTEs of every run: seeds, Lloyd's iterations, error."""
    out = [f"kmin AS (SELECT *, epoch_us(\"Time\") // 60000000 AS minutes FROM kz)"]
    for run in range(runs):
        out += [_seeds_sql(run, k), _lloyd_sql(run, iterations).split(",\n", 1)[1]]
    return ",\n".join(out)


@register("kmeans_seeded_fit", f"""WITH {_KZ}, {_seeded_sql(2, 3, 2)},
runs AS (SELECT house_id, 0 AS restart, inertia FROM sse0 UNION ALL SELECT house_id, 1, inertia FROM sse1),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY house_id ORDER BY inertia, restart) = 1),
every AS (SELECT 0 AS restart, * FROM l0_2 UNION ALL SELECT 1, * FROM l1_2)
SELECT house_id, CAST(cluster AS INTEGER) AS cluster, c0, c1, c2, c3, inertia, CAST(restart AS INTEGER) AS restart
FROM every JOIN best USING (house_id, restart)""", ["c0", "c1", "c2", "c3", "inertia"])
def q_kmeans_seeded_fit(spark, sf_dir):
    """M5 with its own seeds: two restarts of three clusters, two iterations, the better one."""
    minutes = F.expr("timestampdiff(MINUTE, TIMESTAMP_NTZ'1970-01-01 00:00:00', Time)")
    m = ms_kmeans.fit_kmeans(features(spark, sf_dir), k=3, restarts=2, max_iter=2, tol=0.0, seed=7, rid=minutes)
    return m.centers.join(m.inertia.select("house_id", "inertia", "restart"), "house_id")


@register("elbow_fixed_init", f"""WITH {_KZ}, {", ".join(_lloyd_sql(k, 2) for k in (2, 3, 4))}
""" + " UNION ALL ".join(f"SELECT house_id, {k} AS k, inertia FROM sse{k}" for k in (2, 3, 4)), ["inertia"])
def q_elbow_fixed_init(spark, sf_dir):
    return ms_kmeans.elbow(features(spark, sf_dir), ks=[2, 3, 4], max_iter=2, tol=0.0, init=FIXED_CENTERS)


def _path_sql(size: int) -> str:
    """Mean path length of an unsuccessful search among ``size`` rows."""
    return f"(2.0::DOUBLE * (ln({size} - 1) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * ({size} - 1) / {size})"


def _tree_sql(tree: dict, node: int = 0) -> str:
    if node in tree["leaf"]:
        depth, size = tree["leaf"][node]
        return f"({depth} + {_path_sql(size)})"
    f, thr, lft, rgt = tree["inner"][node]
    return f"CASE WHEN z{f} <= {repr(float(thr))} THEN {_tree_sql(tree, lft)} ELSE {_tree_sql(tree, rgt)} END"


_FH = " + ".join(f"({_tree_sql(t)})" for t in ms_forest.FIXED_TREES)
_FOREST_SQL = f"""WITH {_stats_sql(FOREST_FEATURES, 'fst', False)},
fz AS (SELECT features.house_id, features."Time", {_z_sql(FOREST_FEATURES, 'fst')} FROM features JOIN fst USING (house_id)),
fs AS (SELECT house_id, "Time", -pow(2.0, -(({_FH}) / {len(ms_forest.FIXED_TREES)}.0) / {_path_sql(256)}) AS s FROM fz),
fr AS (SELECT s, house_id, row_number() OVER (PARTITION BY house_id ORDER BY s) - 1 AS rk,
              count(*) OVER (PARTITION BY house_id) AS n FROM fs),
fp AS (SELECT house_id, 0.05 * (n - 1) AS pos, floor(0.05 * (n - 1)) AS lo, ceil(0.05 * (n - 1)) AS hi FROM fr GROUP BY house_id, n),
fv AS (SELECT fp.house_id, fp.pos - fp.lo AS t,
              max(fr.s) FILTER (WHERE fr.rk = fp.lo) AS a, max(fr.s) FILTER (WHERE fr.rk = fp.hi) AS b
       FROM fp JOIN fr ON fr.house_id = fp.house_id GROUP BY fp.house_id, fp.pos, fp.lo),
foff AS (SELECT house_id, CASE WHEN t >= 0.5 THEN b - (b - a) * (1 - t) ELSE a + (b - a) * t END AS offset FROM fv)
SELECT fs.house_id, fs."Time", fs.s - foff.offset AS anomaly_score, CAST(fs.s - foff.offset < 0 AS INTEGER) AS is_anomaly
FROM fs JOIN foff USING (house_id)"""


_HEAD, _TAIL = _FOREST_SQL.rsplit("\nSELECT fs.house_id", 1)


@register("score_unseen_house", f"""{_HEAD},
seen AS (SELECT fs.house_id{_TAIL})
SELECT f.house_id, f."Time", s.anomaly_score, coalesce(s.is_anomaly, 0) AS is_anomaly
FROM features f LEFT JOIN (SELECT * FROM seen WHERE house_id <= 10) s ON f.house_id = s.house_id AND f."Time" = s."Time\"""", ["anomaly_score"])
def q_score_unseen_house(spark, sf_dir):
    """A model of houses 1 to 10 over all houses: no row is lost."""
    f = features(spark, sf_dir)
    return ms_forest.score_forest(f, ms_forest.fixed_forest(f.filter("house_id <= 10"))).select(
        "house_id", "Time", "anomaly_score", "is_anomaly")


@register("forest_score_fixed", _FOREST_SQL, ["anomaly_score"])
def q_forest_score_fixed(spark, sf_dir):
    f = features(spark, sf_dir)
    return ms_forest.score_forest(f, ms_forest.fixed_forest(f)).select("house_id", "Time", "anomaly_score", "is_anomaly")


@register("model_round_trip", f"""WITH k AS (WITH {_KMEANS_CTES.strip()} SELECT * FROM kasg JOIN klab USING (house_id, cluster)),
s AS ({_FOREST_SQL})
SELECT k.house_id, k."Time", s.anomaly_score, s.is_anomaly, k.cluster, k.cluster_label, k.cluster_distance
FROM k JOIN s ON k.house_id = s.house_id AND k."Time" = s."Time\"""", ["anomaly_score", "cluster_distance"])
def q_model_round_trip(spark, sf_dir):
    """Models saved to the shared folder, loaded again and applied."""
    from meterspark.sources.model_store import load_model, save_model
    f = features(spark, sf_dir)
    wd = _stream_dir(spark)
    save_model(ms_forest.fixed_forest(f), f"{wd}/forest")
    save_model(fixed_kmeans(spark, sf_dir), f"{wd}/kmeans")
    scored = ms_forest.score_forest(f, load_model(spark, f"{wd}/forest"))
    return ms_kmeans.assign_clusters(scored, load_model(spark, f"{wd}/kmeans")).select(
        "house_id", "Time", "anomaly_score", "is_anomaly", "cluster", "cluster_label", "cluster_distance")


@register("model_fingerprint", """
SELECT count(*) AS n_rows, CAST(sum(CAST(concat('0x', substr(d, 1, 15)) AS BIGINT)) AS VARCHAR) AS sum1,
       CAST(sum(CAST(concat('0x', substr(d, 16, 15)) AS BIGINT)) AS VARCHAR) AS sum2
FROM (SELECT md5(concat(house_id, '|', epoch_us(Time), '|', CAST(CAST(Aggregate AS DECIMAL(38, 6)) AS VARCHAR), '|',
                        CAST(CAST(Appliance9 AS DECIMAL(38, 6)) AS VARCHAR), '|', Issues)) AS d FROM readings)""")
def q_model_fingerprint(spark, sf_dir):
    """S6: what tells the rows of a saved model from others."""
    from meterspark.sources.model_store import fingerprint
    return fingerprint(readings(spark, sf_dir).repartition(7), ["house_id", "Time", "Aggregate", "Appliance9", "Issues"])


@register("forest_fit_report", """
SELECT house_id, n AS "rows", CAST(200 AS BIGINT) AS trees, least(256, n) AS psi, CAST(ceil(log2(greatest(least(256, n), 2))) AS INTEGER) AS max_depth,
       CASE WHEN least(256, n) > 2 THEN 2.0::DOUBLE * (ln(least(256, n) - 1) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * (least(256, n) - 1) / least(256, n)
            WHEN n = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c_psi,
       true AS whole_trees, true AS share_as_asked
FROM (SELECT house_id, count(*) AS n FROM features GROUP BY house_id)""", ["c_psi"])
def q_forest_fit_report(spark, sf_dir):
    """A fitted forest of each house: its size and depth, whether each tree is
    a whole binary tree, and whether no more rows are flagged than the
    contamination asks for and none is missed but by a tie."""
    model, scored = ms_forest.fit_score_forest(features(spark, sf_dir), contamination=0.05, trees=200, seed=42)
    inner = F.col("feature") >= 0
    by_tree = model.nodes.groupBy("house_id", "tree").agg((F.count_if(~inner) == F.count_if(inner) + 1).alias("whole"))
    trees = by_tree.groupBy("house_id").agg(F.count("*").alias("trees"), F.every("whole").alias("whole_trees"))
    found = scored.groupBy("house_id").agg(F.count("*").alias("rows"), F.sum("is_anomaly").alias("flagged"),
                                           F.count_if(F.col("anomaly_score") <= 1e-12).alias("reached"))
    asked = F.ceil(0.05 * (F.col("rows") - 1))
    return (found.join(trees, "house_id").join(model.params, "house_id")
            .select("house_id", "rows", "trees", "psi", "max_depth", "c_psi", "whole_trees",
                    ((F.col("flagged") <= asked) & (F.col("reached") >= asked)).alias("share_as_asked")))


# --- fitted models and the whole pipeline (no SQL oracle: randomised fits;
# checked by invariants in tests) --------------------------------------------
@register("kmeans_fit")
def q_kmeans_fit(spark, sf_dir):
    m = ms_kmeans.fit_kmeans(features(spark, sf_dir), k=4, restarts=10, max_iter=300, seed=42)
    return ms_kmeans.centroid_profile(m).join(ms_kmeans.auto_labels(m), ["house_id", "cluster"])


@register("elbow_table")
def q_elbow_table(spark, sf_dir):
    return ms_kmeans.elbow(features(spark, sf_dir), ks=range(2, 9), restarts=10, seed=42)


@register("forest_fit_score")
def q_forest_fit_score(spark, sf_dir):
    f = features(spark, sf_dir)
    _, scored = ms_forest.fit_score_forest(f, contamination=0.05, trees=200, seed=42)
    return scored.select("house_id", "Time", "Aggregate", "anomaly_score", "is_anomaly")


@register("full_pipeline")
def q_full_pipeline(spark, sf_dir):
    from meterspark.plans.pipeline import run_pipeline
    return run_pipeline(readings(spark, sf_dir), contamination=0.05, k=4)


# --- remaining dashboard pieces ------------------------------------------------
@register("house_list", "SELECT DISTINCT house_id FROM readings")
def q_house_list(spark, sf_dir):
    return ms.list_houses(readings(spark, sf_dir))


@register("preview", """
SELECT house_id, "Time", Aggregate, hour, is_night, is_peak FROM timed
QUALIFY row_number() OVER (PARTITION BY house_id ORDER BY "Time") <= 3""", ["Aggregate"])
def q_preview(spark, sf_dir):
    return ms_views.preview(timed(spark, sf_dir).select("house_id", "Time", "Aggregate", "hour", "is_night",
                                                         "is_peak"), 3)


@register("cluster_series", f"""WITH {_KMEANS_CTES.strip()}
SELECT kasg.house_id, kasg."Time", f.Aggregate, kasg.cluster, klab.cluster_label
FROM kasg JOIN klab USING (house_id, cluster) JOIN features f ON f.house_id = kasg.house_id AND f."Time" = kasg."Time\"""",
          ["Aggregate"])
def q_cluster_series(spark, sf_dir):
    a = ms_kmeans.assign_clusters(features(spark, sf_dir), fixed_kmeans(spark, sf_dir))
    return ms_views.cluster_series(a)


@register("kmeans_assign_fixed_labels", f"""WITH {_KMEANS_CTES.strip()}
SELECT house_id, "Time", cluster,
       coalesce(CASE cluster WHEN 0 THEN '🌙 Night Low' WHEN 1 THEN '🏠 Daytime Moderate'
                             WHEN 2 THEN '⚡ Peak Usage' WHEN 3 THEN '💤 Standby / Idle' END, 'Unknown') AS cluster_label
FROM kasg""")
def q_kmeans_assign_fixed_labels(spark, sf_dir):
    a = ms_kmeans.assign_clusters(features(spark, sf_dir), fixed_kmeans(spark, sf_dir), labels="fixed")
    return a.select("house_id", "Time", "cluster", "cluster_label")


@register("metric_row", "WITH " + _SCORED.strip() + "," + _IDX + """,
vw AS (SELECT * FROM idx WHERE j >= n - 200),
lastrow AS (SELECT house_id, "Time" AS latest_time, Aggregate AS current_w, deviation AS current_deviation_w
            FROM vw QUALIFY row_number() OVER (PARTITION BY house_id ORDER BY "Time" DESC) = 1),
summ AS (""" + _SUMMARY_SQL.replace("FROM scored", "FROM vw") + """)
SELECT * FROM lastrow JOIN summ USING (house_id)""",
          ["current_w", "current_deviation_w", "anomaly_pct", "avg_consumption_w", "peak_consumption_w",
           "estimated_kwh"])
def q_metric_row(spark, sf_dir):
    return ms_views.metric_row(ms_views.last_rows(scored_standin(spark, sf_dir), 200))


# --- streaming, run to completion (availableNow) ------------------------------
# Inputs land as files under the session's checkpoint folder (shared on a
# cluster); the streams read them, write Parquet sinks there, and the query
# returns the sink read back as a batch DataFrame.
def _stream_dir(spark) -> str:
    import uuid
    from meterspark.config import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/meterspark-stream-{uuid.uuid4().hex}"


ARRIVALS = 3


def _run_to_parquet(stream_df, wd: str, name: str, mode: str = "append"):
    q = (stream_df.writeStream.format("parquet").outputMode(mode)
         .option("path", f"{wd}/{name}").option("checkpointLocation", f"{wd}/{name}_ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stream_df.sparkSession.read.schema(stream_df.schema).parquet(f"{wd}/{name}")


def _run_as_it_arrives(rows, arrived, stream_of, wd: str, name: str):
    """Deliver ``rows`` in ARRIVALS parts by the time ``arrived``, and then the
    end mark; after each the query ``stream_of(source)`` runs on from its checkpoint."""
    from meterspark.streaming import streams as S
    spark = rows.sparkSession
    rows.withColumn("_arrived", arrived).write.parquet(f"{wd}/{name}_all")
    every = spark.read.parquet(f"{wd}/{name}_all")
    first, last = every.select(F.unix_micros(F.min("_arrived").cast("timestamp")), F.unix_micros(F.max("_arrived").cast("timestamp"))).first()
    step = ((last or 0) - (first or 0)) / ARRIVALS + 1
    part = F.floor((F.unix_micros(F.col("_arrived").cast("timestamp")) - F.lit(first or 0)) / F.lit(step))
    parts = [every.filter(part == i).drop("_arrived") for i in range(ARRIVALS)] + [S.end_mark(every.drop("_arrived"))]
    for i, df in enumerate(parts):
        df.write.parquet(f"{wd}/{name}_in/{i}")
        src = S.stream_readings(spark, f"{wd}/{name}_in/*", schema=rows.schema, max_files_per_trigger=None)
        found = _run_to_parquet(stream_of(src), wd, name)
    return found


@register("stream_minute_mean", "SELECT * FROM minute", ["Aggregate"] + APPLIANCES)
def q_stream_minute_mean(spark, sf_dir):
    """T-1 + T-2: readings files as a stream, watermarked 1-minute means."""
    from meterspark.streaming import streams as S
    return _run_as_it_arrives(readings(spark, sf_dir), F.col("Time"), S.stream_minute_mean, _stream_dir(spark), "minute")


_STREAM_FEATURES = ["house_id", "Time", "Aggregate", "rolling_mean", "rolling_std", "deviation", "z_score",
                    "diff_1", "diff_5", "pct_change"]


def _stream_features(spark, sf_dir, wd, late_seconds: int = 0):
    """Minute rows, each up to ``late_seconds`` after its time, through T-3."""
    from meterspark.streaming import streams as S
    m = minute(spark, sf_dir)
    delay = F.pmod(F.xxhash64("house_id", "Time"), F.lit(late_seconds + 1)).cast("int")
    return _run_as_it_arrives(m, F.col("Time") + F.make_dt_interval(secs=delay), S.stream_features, wd, "features")


@register("stream_features", "SELECT " + ", ".join(f'"{c}"' for c in _STREAM_FEATURES) + " FROM features",
          [c for c in _STREAM_FEATURES if c not in ("house_id", "Time")])
def q_stream_features(spark, sf_dir):
    """T-3: per-house rolling / lag state with applyInPandasWithState."""
    return _stream_features(spark, sf_dir, _stream_dir(spark))


@register("stream_features_multi", "SELECT " + ", ".join(f'"{c}"' for c in _STREAM_FEATURES) + " FROM features",
          [c for c in _STREAM_FEATURES if c not in ("house_id", "Time")])
def q_stream_features_multi(spark, sf_dir):
    """T-3 over rows that arrive up to 9 minutes late and out of order."""
    return _stream_features(spark, sf_dir, _stream_dir(spark), late_seconds=540)


@register("stream_alerts", "WITH " + _alerts_sql("(SELECT *, CAST(hour(\"Time\") AS INTEGER) AS hour, "
                                                 "CAST(hour(\"Time\") >= 23 OR hour(\"Time\") < 5 AS INTEGER) AS is_night "
                                                 "FROM features)", with_model=False).strip()
          + "\nSELECT * FROM alerts", _ALERT_DOUBLES)
def q_stream_alerts(spark, sf_dir):
    """T-3 -> T-4 -> T-5: streamed features, rules, foreachBatch sink."""
    from meterspark.streaming import streams as S
    wd = _stream_dir(spark)
    feats = _stream_features(spark, sf_dir, wd)
    src = S.stream_readings(spark, f"{wd}/features", schema=feats.schema, max_files_per_trigger=None)
    S.write_batches(S.stream_alerts(src), f"{wd}/out", f"{wd}/out_ckpt").awaitTermination()
    return spark.read.parquet(f"{wd}/out/alerts").drop("batch_id")


_MODEL_SCORED = f"""
fsc AS ({_FOREST_SQL}),
ksc AS (WITH {_KMEANS_CTES.strip()} SELECT * FROM kasg),
scored AS (SELECT f.*, fsc.is_anomaly, ksc.cluster_distance FROM features f
           JOIN fsc ON f.house_id = fsc.house_id AND f."Time" = fsc."Time"
           JOIN ksc ON f.house_id = ksc.house_id AND f."Time" = ksc."Time")"""


@register("stream_scored_alerts", "WITH " + _MODEL_SCORED.strip() + "," + _alerts_sql("scored") + "\nSELECT * FROM alerts", _ALERT_DOUBLES)
def q_stream_scored_alerts(spark, sf_dir):
    """T-2 -> T-5 with models: readings arrive in parts, minute means, features,
    scores and clusters by models of given trees and centers, rules K1-K6, sink."""
    from meterspark.streaming import streams as S
    wd = _stream_dir(spark)
    f = features(spark, sf_dir)
    forest, kmeans = ms_forest.fixed_forest(f), fixed_kmeans(spark, sf_dir)
    minutes = _run_as_it_arrives(readings(spark, sf_dir), F.col("Time"), S.stream_minute_mean, wd, "minute")
    feats = _run_as_it_arrives(minutes, F.col("Time"), S.stream_features, wd, "features")
    src = S.stream_readings(spark, f"{wd}/features", schema=feats.schema, max_files_per_trigger=8)
    S.write_batches(S.stream_alerts(src, forest=forest, kmeans=kmeans), f"{wd}/out", f"{wd}/out_ckpt").awaitTermination()
    return spark.read.parquet(f"{wd}/out/alerts").drop("batch_id")


@register("csv_round_trip", "SELECT * FROM readings", ["Aggregate"] + APPLIANCES)
def q_csv_round_trip(spark, sf_dir):
    """S1: readings written as house CSV files to the shared folder and read back."""
    wd = _stream_dir(spark)
    ms_sources.write_house_csv(readings(spark, sf_dir), f"{wd}/houses")
    return ms.read_readings(spark, f"{wd}/houses")


@register("stream_csv_readings", "SELECT * FROM readings", ["Aggregate"] + APPLIANCES)
def q_stream_csv_readings(spark, sf_dir):
    """T-1 over house CSV files."""
    from meterspark.streaming import streams as S
    wd = _stream_dir(spark)
    rows = readings(spark, sf_dir)
    ms_sources.write_house_csv(rows, f"{wd}/houses")
    schema = ms_sources.file_schema([c for c in rows.columns if c != "house_id"])
    src = S.stream_readings(spark, f"{wd}/houses/house_id=*", fmt="csv", schema=schema, max_files_per_trigger=200)
    return _run_to_parquet(src.drop("bad_values"), wd, "readings")


def _write_csv(rows, path):
    rows.repartition("house_id").write.partitionBy("house_id").option("header", True).csv(path)


def _time_text():
    return F.date_format("Time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("Time")


@register("csv_mixed_files", """
SELECT house_id, Time, Aggregate, Appliance1, Appliance2,
       CASE WHEN house_id % 3 < 2 THEN Appliance3 END AS Appliance3, CASE WHEN house_id % 3 < 2 THEN Appliance4 END AS Appliance4,
       CASE WHEN house_id % 3 < 2 THEN Appliance5 END AS Appliance5, CASE WHEN house_id % 3 < 2 THEN Appliance6 END AS Appliance6,
       CASE WHEN house_id % 3 < 2 THEN Appliance7 END AS Appliance7, CASE WHEN house_id % 3 < 2 THEN Appliance8 END AS Appliance8,
       CASE WHEN house_id % 3 < 2 THEN Appliance9 END AS Appliance9, CASE WHEN house_id % 3 < 2 THEN Issues ELSE -1 END AS Issues
FROM readings""", ["Aggregate"] + APPLIANCES)
def q_csv_mixed_files(spark, sf_dir):
    """S1-S4: files of three layouts in one folder: ISO times, epoch seconds with
    the columns in another order, and fewer columns beside one that no reading has."""
    wd = _stream_dir(spark)
    rows = readings(spark, sf_dir)
    unix = (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', Time)").cast("decimal(26,6)") / 1000000).cast("decimal(20,6)").alias("Unix")
    layouts = [["house_id", _time_text(), "Aggregate", *APPLIANCES, "Issues"], ["house_id", "Issues", *reversed(APPLIANCES), "Aggregate", unix],
               ["house_id", "Appliance2", "Appliance1", F.lit("x").alias("Room"), _time_text(), "Aggregate", unix]]
    for i, cols in enumerate(layouts):
        _write_csv(rows.filter(F.col("house_id") % 3 == i).select(*cols), f"{wd}/houses/layout{i}")
    return ms.read_readings(spark, f"{wd}/houses").fillna(-1, ["Issues"])


@register("csv_bad_values", """
SELECT house_id, CASE WHEN minute(Time) % 7 = 3 THEN NULL ELSE Time END AS Time,
       CASE WHEN minute(Time) % 5 = 1 THEN NULL ELSE Aggregate END AS Aggregate, Appliance1,
       CASE WHEN minute(Time) % 11 = 2 THEN -1 ELSE Issues END AS Issues,
       nullif(concat_ws('; ', CASE WHEN minute(Time) % 7 = 3 THEN 'Time=yesterday' END,
                        CASE WHEN minute(Time) % 5 = 1 THEN 'Aggregate=1,5 W' END,
                        CASE WHEN minute(Time) % 11 = 2 THEN 'Issues=0.5' END), '') AS bad_values
FROM readings""", ["Aggregate", "Appliance1"])
def q_csv_bad_values(spark, sf_dir):
    """S1: values of the wrong type are null in their columns and kept as text."""
    wd = _stream_dir(spark)
    minute = F.minute("Time")
    rows = readings(spark, sf_dir).select("house_id", F.when(minute % 7 == 3, F.lit("yesterday")).otherwise(_time_text()).alias("Time"),
                                          F.when(minute % 5 == 1, F.lit("1,5 W")).otherwise(F.col("Aggregate").cast("string")).alias("Aggregate"), "Appliance1",
                                          F.when(minute % 11 == 2, F.lit("0.5")).otherwise(F.col("Issues").cast("string")).alias("Issues"))
    _write_csv(rows, f"{wd}/houses")
    return ms.read_readings(spark, f"{wd}/houses", bad_values=True).select("house_id", "Time", "Aggregate", "Appliance1", "Issues", "bad_values").fillna(-1, ["Issues"])


@register("csv_house_files", "SELECT DISTINCT house_id FROM readings")
def q_csv_house_files(spark, sf_dir):
    """S2: the house list from the files' names."""
    wd = _stream_dir(spark)
    _write_csv(readings(spark, sf_dir).select("house_id", _time_text(), "Aggregate"), f"{wd}/houses")
    return ms.list_houses(ms.house_files(spark, f"{wd}/houses"))


@register("raw_features", "SELECT * FROM raw_features", _FEATURE_DOUBLES)
def q_raw_features(spark, sf_dir):
    """Features without resampling (every cleaned reading is a row)."""
    return ms.engineer_features(ms.add_time_features(ms.clean(readings(spark, sf_dir))))
