"""The whole chain for every house at once, and its training report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meterspark.config import ensure_checkpoint_dir
from meterspark.models.forest import fit_score_forest, score_forest
from meterspark.models.kmeans import assign_clusters, fit_kmeans
from meterspark.operators.calendar import add_time_features
from meterspark.operators.cleaning import clean
from meterspark.operators.features import engineer_features
from meterspark.operators.reports import (cluster_distribution, date_range, detection_rate, summary)
from meterspark.operators.resample import downsample, freq_seconds
from meterspark.operators.rules import alert_counts, alerts, standby_recommendations, top_critical


def prepare(readings: DataFrame, freq: str | None = "1 minute", window: int = 30,
            materialize: bool = False) -> DataFrame:
    """clean -> downsample (optional) -> calendar -> features.

    ``materialize`` checkpoints the cleaned (and downsampled) table first:
    the feature step reads its input twice (size pass, then windows), and
    this way the raw readings are scanned and aggregated once."""
    x = clean(readings)
    if freq:
        x = downsample(x, freq)
    if materialize:
        x = x.checkpoint(eager=True)
    return engineer_features(add_time_features(x), window, unique_time=bool(freq))


def run_pipeline(readings: DataFrame, contamination: float = 0.05, k: int = 4, freq: str | None = "1 minute",
                 window: int = 30, scope: str = "house", seed: int = 42, trees: int = 200,
                 restarts: int = 10, model_path: str | None = None, overwrite: bool = False) -> DataFrame:
    """Readings -> scored frame (features + anomaly_score, is_anomaly, cluster,
    cluster_label, cluster_distance). The feature table is checkpointed once
    (shared checkpoint folder) since both fits and both scorings read it.
    With ``model_path`` models are reused per (kind, scope, parameters, freq,
    window)."""
    ensure_checkpoint_dir(readings.sparkSession)
    feats = prepare(readings, freq, window, materialize=True).checkpoint(eager=True)
    fp = dict(contamination=contamination, trees=trees, seed=seed, scope=scope)
    kp = dict(k=k, restarts=restarts, seed=seed, scope=scope)
    made = {"freq": (freq or "raw").replace(" ", "-"), "window": window}
    if model_path:
        from meterspark.sources.model_store import fit_or_load
        forest = fit_or_load(feats, model_path, "forest", overwrite, made, **fp)
        scored = score_forest(feats, forest)
    else:
        forest, scored = fit_score_forest(feats, **fp)
    if model_path:
        km = fit_or_load(scored, model_path, "kmeans", overwrite, made, **kp)
    else:
        km = fit_kmeans(scored, **kp)
    return assign_clusters(scored, km)


def report(scored: DataFrame, freq: str | None = "1 minute", top_n: int = 5) -> dict[str, DataFrame]:
    """Training report as tables: summary, date range, detection rate, alert
    counts, cluster distribution, top critical alerts, standby advice."""
    minutes = freq_seconds(freq) / 60.0 if freq else 1.0
    al = alerts(scored)
    return {
        "summary": summary(scored, minutes_per_row=minutes),
        "date_range": date_range(scored),
        "detection_rate": detection_rate(scored),
        "alert_counts": alert_counts(scored),
        "cluster_distribution": cluster_distribution(scored),
        "top_critical": top_critical(al, top_n),
        "standby": standby_recommendations(scored),
    }


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each report table as Parquet under ``path`` (S7)."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
