"""Model tables in Parquet (scaler, centers, forest nodes, thresholds) and
fit-or-load keyed by model kind, scope, parameters and the rows they were fitted on."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.config import FOREST_FEATURES, KMEANS_FEATURES
from meterspark.models.forest import ForestModel, fit_forest
from meterspark.models.kmeans import KMeansModel, fit_kmeans

_TABLES = {"kmeans": ["scaler", "centers", "inertia"], "forest": ["scaler", "nodes", "params"]}


def _kind(model) -> str:
    return "kmeans" if isinstance(model, KMeansModel) else "forest"


def _meta(model) -> dict:
    m = {"kind": _kind(model), "keys": model.keys, "features": model.features, "scope": model.scope}
    if isinstance(model, KMeansModel):
        m["k"] = model.k
    else:
        m["trees"], m["contamination"] = model.trees, model.contamination
    return m


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_model(model, path: str) -> None:
    """Write each model table as Parquet in a new folder under ``path``, then
    the meta record that names the folder: a reader sees one model whole."""
    spark = model.scaler.sparkSession
    version = f"tables-{uuid.uuid4().hex}"
    for name in _TABLES[_kind(model)]:
        getattr(model, name).write.parquet(f"{path}/{version}/{name}")
    (spark.createDataFrame([(json.dumps(_meta(model) | {"version": version}),)], "meta string")
     .coalesce(1).write.mode("overwrite").text(f"{path}/meta"))


def load_model(spark: SparkSession, path: str):
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    t = {name: spark.read.parquet(f"{path}/{meta['version']}/{name}") for name in _TABLES[meta["kind"]]}
    if meta["kind"] == "kmeans":
        return KMeansModel(meta["keys"], meta["features"], meta["k"], meta["scope"],
                           t["scaler"], t["centers"], t["inertia"])
    return ForestModel(meta["keys"], meta["features"], meta["scope"], meta["trees"], meta["contamination"],
                       t["scaler"], t["nodes"], t["params"])


def model_key(kind: str, params: dict) -> str:
    return kind + "".join(f"_{k}={params[k]}" for k in sorted(params))


def fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """n_rows and the sums of two halves of the rows' MD5s (as text): the same in
    any order and partitioning, another with any row added, lost or changed.

    A row's text is its columns, numbers to six decimals (so that the order of a
    mean's summation does not matter), times in microseconds, nulls empty."""
    def text(c):
        kind = df.schema[c].dataType.typeName()
        if kind in ("double", "float"):
            return F.expr(f"CAST(try_cast(`{c}` AS DECIMAL(38, 6)) AS STRING)")
        if kind.startswith("timestamp"):
            return F.expr(f"CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{c}` AS TIMESTAMP_NTZ)) AS STRING)")
        return F.col(c).cast("string")
    digest = F.md5(F.concat_ws("|", *[F.coalesce(text(c), F.lit("")) for c in cols]))
    halves = [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(h), F.lit(0)).cast("string").alias(f"sum{i + 1}") for i, h in enumerate(halves)])


def fit_or_load(df: DataFrame, path: str, kind: str, overwrite: bool = False, prepared: dict | None = None, **params):
    """Reuse the model saved for (kind, scope, parameters, how the rows were
    ``prepared``, and the rows themselves by their ``fingerprint``) unless ``overwrite`` (the
    retrain button); otherwise fit, save and return it. One pass over the rows tells whether they are the same."""
    spark = df.sparkSession
    wanted = params.get("features") or (KMEANS_FEATURES if kind == "kmeans" else FOREST_FEATURES)
    rows = fingerprint(df, [c for c in ["house_id", "Time", *wanted] if c in df.columns]).first()
    data = f"{rows['n_rows']}-{int(rows['sum1']):x}-{int(rows['sum2']):x}"
    target = f"{path.rstrip('/')}/{model_key(kind, params | (prepared or {}) | {'data': data})}"
    if not overwrite and path_exists(spark, f"{target}/meta/_SUCCESS"):
        return load_model(spark, target)
    model = fit_kmeans(df, **params) if kind == "kmeans" else fit_forest(df, **params)
    save_model(model, target)
    return load_model(spark, target)
