"""Fixed values the results depend on, plus session helpers.

Everything under "fixed values" must stay equal to the behaviour being
reproduced: thresholds, feature lists, calendar bounds and label texts.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# ---------------------------------------------------------------------------
# Fixed values (must stay as they are for equal results)
# ---------------------------------------------------------------------------
THRESHOLDS = {
    "high_consumption_w": 3000,
    "spike_multiplier": 2.0,
    "z_score_critical": 3.5,
    "cluster_distance_high": 2.5,
    "standby_waste_w": 100,
}

FOREST_FEATURES = [
    "Aggregate", "rolling_mean", "rolling_std",
    "deviation", "z_score", "hour", "diff_1", "pct_change",
]

KMEANS_FEATURES = ["Aggregate", "hour", "rolling_mean", "is_weekend"]

# Default cluster id -> name table and the four pattern names.
CLUSTER_LABELS = {
    0: "🌙 Night Low",
    1: "🏠 Daytime Moderate",
    2: "⚡ Peak Usage",
    3: "💤 Standby / Idle",
}
LABEL_STANDBY = "💤 Standby / Idle"
LABEL_PEAK = "⚡ Peak Usage"
LABEL_NIGHT = "🌙 Night Low"
LABEL_DAYTIME = "🏠 Daytime Moderate"
LABEL_UNKNOWN = "Unknown"

DAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]

# Rolling window: 30 rows, values from the 5th row on.
ROLLING_WINDOW = 30
ROLLING_MIN_ROWS = 5
DIFF_CLIP = 5000.0
PCT_CLIP = 500.0
ROLLING_EPS = 1e-5
ACTIVE_APPLIANCE_W = 10
APPLIANCE_MARKER = "Appliance"
# ---------------------------------------------------------------------------

# Largest lookup table (rows) that is broadcast; bigger ones use a shuffle
# join, where AQE's skew handling splits hot keys.
DEFAULT_BROADCAST_ROWS = 2_000_000


def build_session(master: str = "local[*]", app: str = "meterspark",
                  shuffle_partitions: int = 8, **conf) -> SparkSession:
    """Session used by tests, bench and examples. On a cluster, pass the
    cluster's own session to the library functions instead."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only where none is configured (tests,
    local runs), ``fallback`` or a folder beside the warehouse is set."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = fallback or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d
