"""K-means per model scope (default: one model per house) as Spark jobs.

Fit: k-means++ seeding (D^2 sampling with the exponential-race trick) and Lloyd
iterations; every restart, and every k of an elbow table, is a run in the same
pass over blocks of rows (``lloyd``), until it has converged. Several steps make
up one job; then the small table of centers is checkpointed. The
restart with the least inertia wins."""

from __future__ import annotations

import dataclasses

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterspark.config import (CLUSTER_LABELS, KMEANS_FEATURES, LABEL_DAYTIME, LABEL_NIGHT,
                               LABEL_PEAK, LABEL_STANDBY, LABEL_UNKNOWN, ensure_checkpoint_dir)
from meterspark.functions.columns import round_half_even
from meterspark.functions.lookup import lookup_join
from meterspark.models.lloyd import Steps, to_blocks
from meterspark.models.scaler import apply_scaler, available, fit_scaler, scope_keys, with_scope


@dataclasses.dataclass
class KMeansModel:
    keys: list[str]
    features: list[str]
    k: int
    scope: str
    scaler: DataFrame      # keys, _n, _nonconst, <f>_mean, <f>_scale
    centers: DataFrame     # keys, cluster, c0..c{d-1} (scaled space)
    inertia: DataFrame     # keys, inertia, iterations, restart

    @property
    def d(self) -> int:
        return len(self.features)


def _z(d: int) -> list[Column]:
    return [F.col(f"_z{f}") for f in range(d)]


#: Steps in one job. Then their state is written, and looked at whether any run still moves; runs that have converged stay as they are.
LOOK_EVERY = 6


def _d2(j: int, d: int, arr: str = "_cf") -> Column:
    """Squared distance to center ``j`` of a flat array; null beyond its end."""
    return sum((F.col(f"_z{f}") - F.get(F.col(arr), F.lit(j * d + f))) ** 2 for f in range(d))


def _argmin(ds: list[Column]) -> tuple[Column, Column]:
    m = F.least(*ds) if len(ds) > 1 else ds[0]
    idx = F.lit(len(ds) - 1)
    for j in range(len(ds) - 2, -1, -1):
        idx = F.when(ds[j] == m, F.lit(j)).otherwise(idx)
    return idx, m


def _checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _flat_centers(centers: DataFrame, keys: list[str], d: int) -> DataFrame:
    """keys, _cf: the centers of a scope as one flat array."""
    cs = F.struct("cluster", F.array(*[F.col(f"c{f}") for f in range(d)]).alias("cs"))
    rows = centers.groupBy(*keys).agg(F.sort_array(F.collect_list(cs)).alias("_it"))
    return rows.select(*keys, F.flatten(F.transform("_it", lambda s: s["cs"])).alias("_cf"))


def _prepare(df: DataFrame, features: list[str] | None, scope: str, rid: Column | None = None) -> dict:
    """Scaler fit and the scaled rows in blocks, which every step reads."""
    keys = scope_keys(scope)
    src = with_scope(df, scope)
    feats = available(src, features or KMEANS_FEATURES)
    d = len(feats)
    filled = src.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feats],
                        *([rid.cast("bigint").alias("_rid")] if rid is not None else []), *([F.col("Time")] if "Time" in src.columns else []))
    filled = filled.persist(StorageLevel.MEMORY_AND_DISK)     # read by the scaler and the scaled copy
    scaler = _checkpoint(fit_scaler(filled, feats, keys))
    n_groups = scaler.count()
    # Row identity from the raw inputs (not from scaled values, whose last
    # bits depend on summation order), so fits do not depend on partitioning.
    if rid is None:
        filled = filled.withColumn("_rid", F.xxhash64(*[F.col(c) for c in keys + feats + (["Time"] if "Time" in filled.columns else [])]))
    z = apply_scaler(filled, scaler, feats, keys, known_rows=n_groups)
    z = lookup_join(z, scaler.select(*keys, "_n"), keys, "inner", known_rows=n_groups)
    blocks = _checkpoint(to_blocks(z.select(*keys, "_rid", "_n", *_z(d)), keys, d))
    filled.unpersist()
    return dict(keys=keys, feats=feats, d=d, scaler=scaler, blocks=blocks, n_groups=n_groups, scope=scope)


def _lloyd(p: dict, ks: list[int], restarts: int, max_iter: int, tol: float, seed: int,
           init: list[list[float]] | None) -> tuple[DataFrame, DataFrame]:
    """Runs of Lloyd's iterations for every k and restart of every scope, in
    the same steps. A run's seeds are drawn by its restart alone, so those of a smaller k are the
    first ones of a larger. Returns best (keys, k, restart, inertia, iterations) and centers (keys, k, cluster, c0...)."""
    keys, d = p["keys"], p["d"]
    restarts = 1 if init is not None else restarts
    steps = Steps(p["blocks"], keys, d, [k for k in ks for _ in range(restarts)], restarts, seed, p["n_groups"])
    state = steps.first_state(p["scaler"].select(*keys, (F.lit(float(tol)) * F.col("_nonconst") / d).alias("_tol")), init)
    if init is None:
        for s in range(max(ks)):
            state = steps.seed_step(state, s)
    for it in range(1, max_iter + 1):
        state = steps.move_step(state, it)
        if it % LOOK_EVERY == 0:
            state = _checkpoint(state)
            if state.filter("live > 0").isEmpty():
                break
    best = _checkpoint(steps.result(state))
    one = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(
        j.alias("cluster"), *[F.get(F.col("cf"), j * d + f).alias(f"c{f}") for f in range(d)]))
    return best.drop("cf"), best.select(*keys, "k", F.explode(one).alias("c")).select(*keys, "k", "c.*")


def fit_kmeans(df: DataFrame, k: int = 4, restarts: int = 10, max_iter: int = 300, tol: float = 1e-4,
               seed: int = 42, features: list[str] | None = None, scope: str = "house",
               init: list[list[float]] | None = None, rid: Column | None = None) -> KMeansModel:
    """Fit k-means on scaled features (nulls as 0, population std).

    Each Lloyd iteration is one pass over blocks of rows, all runs at once, for
    houses of any size alike (see ``lloyd``). A
    run stops once its squared center shift is within ``tol`` x the mean feature
    variance; a cluster without rows keeps its center. ``init`` gives the
    first centers (scaled space) of a single run instead of seeding; ``rid`` (an
    integer for each row) is what seeds are drawn by instead of a hash of the row."""
    p = _prepare(df, features, scope, rid)
    best, centers = _lloyd(p, [k], restarts, max_iter, tol, seed, init)
    return KMeansModel(p["keys"], p["feats"], k, scope, p["scaler"], centers.drop("k"), best.drop("k"))


def centroid_profile(model: KMeansModel, digits: int | None = 1) -> DataFrame:
    """Centers in original units (``center * scale + mean``), rounded to 1 dp."""
    s = model.scaler
    x = model.centers.join(s, model.keys, "inner")
    cols = []
    for f, name in enumerate(model.features):
        v = F.col(f"c{f}") * F.col(f"{name}_scale") + F.col(f"{name}_mean")
        cols.append((round_half_even(v, digits) if digits is not None else v).alias(name))
    return x.select(*model.keys, "cluster", *cols)


def auto_labels(model: KMeansModel) -> DataFrame:
    """Name clusters from their centers: lowest load -> standby, highest ->
    peak, others night when the center's hour is before 8 or from 22 on,
    else daytime. Without an 'hour' feature the hour counts as 12."""
    prof = centroid_profile(model, digits=None)
    agg = model.features[model.features.index("Aggregate")] if "Aggregate" in model.features else model.features[0]
    hour = F.col("hour") if "hour" in model.features else F.lit(12.0)
    w = Window.partitionBy(*model.keys).orderBy(F.col(agg), "cluster")
    x = prof.withColumn("_rank", F.row_number().over(w) - 1).withColumn(
        "_last", F.count(F.lit(1)).over(Window.partitionBy(*model.keys)) - 1)
    label = (F.when(F.col("_rank") == 0, F.lit(LABEL_STANDBY))
             .when(F.col("_rank") == F.col("_last"), F.lit(LABEL_PEAK))
             .when((hour < 8) | (hour >= 22), F.lit(LABEL_NIGHT))
             .otherwise(F.lit(LABEL_DAYTIME)))
    return x.select(*model.keys, "cluster", label.alias("cluster_label"))


def fixed_label(cluster: Column) -> Column:
    """The fixed id -> name table; ids outside it are 'Unknown'."""
    m = F.create_map(*[x for i, name in CLUSTER_LABELS.items() for x in (F.lit(i), F.lit(name))])
    return F.coalesce(F.element_at(m, cluster), F.lit(LABEL_UNKNOWN))


def assign_clusters(df: DataFrame, model: KMeansModel, labels: str = "auto") -> DataFrame:
    """Add cluster (nearest center), cluster_label and cluster_distance
    (Euclidean, scaled space). Nearest-center search is a Column argmin over
    the scope's k centers, fetched as one flat array per scope key. Rows of a
    scope that the model has not seen stay, without a cluster and 'Unknown'."""
    keys, d, k = model.keys, model.d, model.k
    src = with_scope(df, model.scope)
    x = apply_scaler(src, model.scaler, model.features, keys, how="left")
    x = lookup_join(x, _flat_centers(model.centers, keys, d), keys, "left")
    j, m = _argmin([_d2(jj, d) for jj in range(k)])
    known = F.col("_cf").isNotNull()
    x = x.withColumn("cluster", F.when(known, j)).withColumn("cluster_distance", F.when(known, F.sqrt(m)))
    drop = ["_cf"] + [f"_z{f}" for f in range(d)] + ([k_ for k_ in keys if k_ not in df.columns])
    if labels == "auto":
        x = lookup_join(x, auto_labels(model), keys + ["cluster"], "left")
        x = x.withColumn("cluster_label", F.coalesce(F.col("cluster_label"), F.lit(LABEL_UNKNOWN)))
    elif labels == "fixed":
        x = x.withColumn("cluster_label", fixed_label(F.col("cluster")))
    else:
        raise ValueError("labels must be 'auto' or 'fixed'")
    out = [c for c in df.columns] + ["cluster", "cluster_label", "cluster_distance"]
    return x.drop(*drop).select(*out)


def elbow(df: DataFrame, ks=range(2, 9), restarts: int = 10, max_iter: int = 300, tol: float = 1e-4,
          seed: int = 42, features: list[str] | None = None, scope: str = "house",
          init: list[list[float]] | None = None) -> DataFrame:
    """Inertia of the best restart for each k. All ks run in the same
    iterations; each starts from the first k seeds (or ``init`` centers)."""
    p = _prepare(df, features, scope)
    best, _ = _lloyd(p, list(ks), restarts, max_iter, tol, seed, init)
    return best.select(*p["keys"], "k", "inertia")


def fixed_model(df: DataFrame, centers: list[list[float]], features: list[str] | None = None,
                scope: str = "house") -> KMeansModel:
    """A model with given centers (scaled space) and a scaler fitted on ``df``:
    for checking assignment, labels and distances against an oracle."""
    keys = scope_keys(scope)
    src = with_scope(df, scope)
    feats = available(src, features or KMEANS_FEATURES)
    filled = src.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feats])
    scaler = _checkpoint(fit_scaler(filled, feats, keys))
    items = F.array(*[F.struct(F.lit(j).alias("cluster"), *[F.lit(float(v)).alias(f"c{f}") for f, v in enumerate(c)])
                      for j, c in enumerate(centers)])
    cdf = scaler.select(*keys, F.explode(items).alias("_c")).select(*keys, "_c.*")
    inertia = scaler.select(*keys, F.lit(None).cast("double").alias("inertia"))
    return KMeansModel(keys, feats, len(centers), scope, scaler, cdf, inertia)
