"""Model invariants: percentile, forest, k-means (local and distributed)."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import meterspark as ms
from conftest import SF_SMALL
from meterspark.functions.percentile import exact_percentile
from meterspark.models import forest as FO
from meterspark.models import kmeans as KM
from meterspark.models import lloyd
from meterspark.plans import catalog


def test_exact_percentile_matches_numpy(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.repeat([1, 2, 3], [1, 57, 5000]),
                        "v": np.concatenate([[3.0], rng.normal(size=57), rng.exponential(size=5000)])})
    pdf.loc[5:9, "v"] = 0.25                        # ties
    df = spark.createDataFrame(pdf)
    for p in (0.0, 0.05, 0.5, 0.95, 1.0):
        got = {r.g: r.percentile for r in exact_percentile(df, ["g"], "v", p, accuracy=100).collect()}
        for g, sub in pdf.groupby("g"):
            assert got[g] == pytest.approx(np.percentile(sub["v"], 100 * p), rel=1e-12, abs=1e-15)


def test_percentile_of_ties_and_extremes(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": np.repeat([1, 2, 3], [20000, 300, 2]),
                        "v": np.concatenate([np.full(20000, 0.5), rng.integers(0, 4, 300) / 4.0, [-np.inf, 1.0]])})
    df = spark.createDataFrame(pdf)
    for p in (0.05, 0.5, 1.0):
        got = {r.g: r.percentile for r in exact_percentile(df, ["g"], "v", p, accuracy=100).collect()}
        for g, sub in pdf[pdf["g"] < 3].groupby("g"):
            assert got[g] == pytest.approx(np.percentile(sub["v"], 100 * p), rel=1e-12, abs=1e-15)


def test_every_row_may_join_a_tree(spark):
    """Each tree draws from all rows, and trees draw independently."""
    n, trees = 20000, 100
    z = spark.range(n).selectExpr("1 AS house_id", "xxhash64(id) AS _rid", "CAST(32 AS BIGINT) AS _psi", "5 AS _depth",
                                  f"CAST({n} AS BIGINT) AS _n", "CAST(id AS DOUBLE) AS _z0")
    s = FO._sample(z, ["house_id"], 1, trees, 3).toPandas()
    mean = 1.5 * 32 + 32
    per_tree = s.groupby("tree").size()
    assert set(per_tree.index) == set(range(trees)) and abs(per_tree.mean() - mean) < 0.1 * mean
    assert per_tree.min() >= 40 and not s.duplicated(["tree", "_rid"]).any()
    per_row = s.groupby("_rid").size()                     # Poisson with mean trees * mean / n = 0.4
    assert abs(len(per_row) / n - (1 - np.exp(-trees * mean / n))) < 0.02
    again = FO._sample(z.repartition(5), ["house_id"], 1, trees, 3).toPandas()
    assert set(zip(again["tree"], again["_rid"])) == set(zip(s["tree"], s["_rid"]))


def _blob_frame(spark, seed=0):
    rng = np.random.default_rng(seed)
    centers = np.array([[0, 0, 0, 0], [8, 8, 0, 0], [0, 8, 8, 0], [8, 0, 8, 8]], float)
    pts = np.concatenate([c + rng.normal(scale=0.3, size=(150, 4)) for c in centers])
    pdf = pd.DataFrame(pts, columns=["Aggregate", "hour", "rolling_mean", "is_weekend"])
    pdf["house_id"] = 1
    pdf["truth"] = np.repeat(np.arange(4), 150)
    pdf["Time"] = pd.date_range("2024-01-01", periods=len(pdf), freq="min").astype("datetime64[us]")
    return spark.createDataFrame(pdf).withColumn("Time", F.col("Time").cast("timestamp_ntz"))


def test_kmeans_recovers_blobs(spark):
    df = _blob_frame(spark)
    m = KM.fit_kmeans(df, k=4, restarts=3, max_iter=50, seed=7)
    a = KM.assign_clusters(df, m).toPandas()
    # every true blob maps to exactly one cluster
    assert a.groupby("truth")["cluster"].nunique().max() == 1
    assert a["cluster"].nunique() == 4
    labels = KM.auto_labels(m).toPandas()
    assert sorted(labels["cluster_label"]) == sorted(
        ["💤 Standby / Idle", "⚡ Peak Usage", "🏠 Daytime Moderate", "🌙 Night Low"]) or \
        labels["cluster_label"].nunique() >= 3
    assert (a["cluster_distance"] >= 0).all()


def test_kmeans_same_seed_same_result_under_repartitioning(spark):
    df = _blob_frame(spark, seed=3)
    a = KM.fit_kmeans(df, k=3, restarts=2, max_iter=30, seed=5).centers.toPandas().sort_values("cluster")
    b = KM.fit_kmeans(df.repartition(7), k=3, restarts=2, max_iter=30, seed=5).centers.toPandas()
    b = b.sort_values("cluster")
    np.testing.assert_allclose(a.filter(like="c").to_numpy(), b.filter(like="c").to_numpy())


def test_elbow_inertia_non_increasing(spark):
    df = _blob_frame(spark, seed=4)
    e = KM.elbow(df, ks=range(2, 6), restarts=4, max_iter=100, seed=1).toPandas().sort_values("k")
    assert (np.diff(e["inertia"].to_numpy()) <= 1e-6).all()


def _outlier_frame(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 8))
    x = np.vstack([x, np.full((1, 8), 9.0)])
    pdf = pd.DataFrame(x, columns=FO.FOREST_FEATURES)
    pdf["house_id"] = 1
    pdf["Time"] = pd.date_range("2024-01-01", periods=len(pdf), freq="min").astype("datetime64[us]")
    return spark.createDataFrame(pdf).withColumn("Time", F.col("Time").cast("timestamp_ntz"))


def test_forest_flags_planted_outlier_and_contamination(spark):
    df = _outlier_frame(spark)
    m = FO.fit_forest(df, contamination=0.05, trees=50, seed=3)
    s = FO.score_forest(df, m).toPandas()
    far = s[s["Aggregate"] == 9.0].iloc[0]
    assert far["anomaly_score"] == s["anomaly_score"].min()
    assert far["is_anomaly"] == 1
    assert abs(s["is_anomaly"].mean() - 0.05) < 0.01
    nodes = m.nodes.groupBy("tree").count().toPandas()
    assert len(nodes) == 50 and nodes["count"].max() <= 511


def test_forest_cogroup_path_equals_broadcast(spark, monkeypatch):
    df = _outlier_frame(spark)
    m = FO.fit_forest(df, contamination=0.05, trees=20, seed=3)
    a = FO.score_forest(df, m).toPandas().sort_values("Time")
    monkeypatch.setattr(FO, "MAX_BROADCAST_NODES", 0)
    monkeypatch.setattr(FO, "COGROUP_CHUNK_ROWS", 100)
    b = FO.score_forest(df, m).toPandas().sort_values("Time")
    np.testing.assert_allclose(a["anomaly_score"].to_numpy(), b["anomaly_score"].to_numpy(), rtol=1e-12)


def test_forest_sample_sizes(spark):
    f = catalog.features(spark, SF_SMALL)
    m = FO.fit_forest(f, trees=30, seed=1)
    p = m.params.toPandas()
    n = f.groupBy("house_id").count().toPandas().set_index("house_id")["count"]
    for r in p.itertuples():
        assert r.psi == min(256, n[r.house_id])


def test_model_store_round_trip(spark, tmp_dir):
    from meterspark.sources.model_store import fit_or_load
    df = _blob_frame(spark)
    m1 = fit_or_load(df, tmp_dir, "kmeans", k=2, restarts=2, seed=1)
    m2 = fit_or_load(df, tmp_dir, "kmeans", k=2, restarts=2, seed=1)
    a = m1.centers.toPandas().sort_values("cluster").reset_index(drop=True)
    b = m2.centers.toPandas().sort_values("cluster").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)
    f1 = fit_or_load(_outlier_frame(spark), tmp_dir, "forest", trees=10, seed=2)
    assert f1.nodes.count() > 0 and f1.params.count() == 1


def test_saved_models_go_with_their_rows(spark, tmp_dir):
    """Other rows are fitted anew, the same rows in another order are not."""
    from meterspark.sources.model_store import fingerprint, fit_or_load
    df = _blob_frame(spark)
    fit = lambda rows: fit_or_load(rows, tmp_dir, "kmeans", k=2, restarts=1, seed=1, max_iter=3)
    fit(df)
    fit(df.repartition(5))
    assert len([d for d in os.listdir(tmp_dir) if d.startswith("kmeans")]) == 1
    fit(df.withColumn("Aggregate", F.col("Aggregate") + F.when(F.rand(3) < 0.01, 1.0).otherwise(0.0)))
    fit(df.limit(df.count() - 1))
    assert len([d for d in os.listdir(tmp_dir) if d.startswith("kmeans")]) == 3
    odd = spark.createDataFrame([(1, None, float("nan")), (1, None, None), (None, "x", float("inf"))], "house_id bigint, s string, v double")
    a, b = fingerprint(odd, odd.columns).first(), fingerprint(odd.filter("s is null"), odd.columns).first()
    assert a["n_rows"] == 3 and b["n_rows"] == 2 and a["sum1"] != b["sum1"]
    assert tuple(fingerprint(odd.limit(0), odd.columns).first()) == (0, "0", "0")


def test_fit_score_equals_fit_then_score(spark):
    df = _outlier_frame(spark)
    m, scored = FO.fit_score_forest(df, contamination=0.05, trees=20, seed=3)
    a = scored.toPandas().sort_values("Time")
    b = FO.score_forest(df, m).toPandas().sort_values("Time")
    np.testing.assert_allclose(a["anomaly_score"].to_numpy(), b["anomaly_score"].to_numpy(), rtol=1e-12)
    assert list(a["is_anomaly"]) == list(b["is_anomaly"])


def test_global_scope_models(spark):
    df = _blob_frame(spark).unionByName(_blob_frame(spark, seed=9).withColumn("house_id", F.lit(2)))
    km = KM.fit_kmeans(df, k=4, restarts=2, max_iter=50, seed=1, scope="global")
    assert km.centers.count() == 4
    a = KM.assign_clusters(df, km)
    assert a.count() == df.count() and "_scope" not in a.columns
    f = _outlier_frame(spark)
    fm = FO.fit_forest(f.unionByName(f.withColumn("house_id", F.lit(2))), trees=10, seed=1, scope="global")
    assert fm.params.count() == 1
    s = FO.score_forest(f, fm)
    assert s.count() == f.count() and "_scope" not in s.columns


def test_kmeans_without_broadcast(spark, monkeypatch):
    """Centers too large to broadcast meet the rows in a shuffle join."""
    monkeypatch.setattr(lloyd, "BROADCAST_BYTES", 0)
    df = _blob_frame(spark)
    m = KM.fit_kmeans(df, k=4, restarts=2, max_iter=30, seed=7)
    a = KM.assign_clusters(df, m).toPandas()
    assert a.groupby("truth")["cluster"].nunique().max() == 1
    assert a["cluster"].nunique() == 4
    assert m.inertia.count() == 1


def test_pipeline_report_and_model_reuse(spark, tmp_dir):
    import meterspark as ms
    from meterspark.plans.pipeline import report, run_pipeline, write_report
    r = ms.load_readings(spark, SF_SMALL)
    scored = run_pipeline(r, trees=20, restarts=2, model_path=f"{tmp_dir}/models")
    cols = set(scored.columns)
    assert {"anomaly_score", "is_anomaly", "cluster", "cluster_label", "cluster_distance"} <= cols
    n = scored.count()
    write_report(report(scored), f"{tmp_dir}/report")
    summ = spark.read.parquet(f"{tmp_dir}/report/summary")
    assert summ.agg(F.sum("total_readings")).first()[0] == n
    again = run_pipeline(r, trees=20, restarts=2, model_path=f"{tmp_dir}/models")   # reuses saved models
    a = scored.select("house_id", "Time", "anomaly_score").toPandas().sort_values(["house_id", "Time"])
    b = again.select("house_id", "Time", "anomaly_score").toPandas().sort_values(["house_id", "Time"])
    np.testing.assert_allclose(a["anomaly_score"].to_numpy(), b["anomaly_score"].to_numpy(), rtol=1e-12)


def test_another_window_or_bin_refits(spark, tmp_dir):
    import os
    from meterspark.plans.pipeline import run_pipeline
    r = ms.load_readings(spark, SF_SMALL).filter("house_id <= 2")
    for window in (30, 10):
        run_pipeline(r, model_path=tmp_dir, trees=5, restarts=1, k=2, window=window)
    assert len([d for d in os.listdir(tmp_dir) if d.startswith("forest")]) == 2


def test_unseen_houses_stay(spark):
    from meterspark.models.forest import fit_forest, score_forest
    from meterspark.models.kmeans import assign_clusters, fit_kmeans
    from meterspark.plans.pipeline import prepare
    f = prepare(ms.load_readings(spark, SF_SMALL)).cache()
    seen = f.filter("house_id <= 5")
    scored = score_forest(f, fit_forest(seen, trees=5))
    assert scored.count() == f.count()
    assert scored.filter("house_id > 5 and (anomaly_score is not null or is_anomaly <> 0)").count() == 0
    assert scored.filter("house_id <= 5 and anomaly_score is null").count() == 0
    placed = assign_clusters(f, fit_kmeans(seen, k=2, restarts=1))
    assert placed.count() == f.count()
    assert {r["cluster_label"] for r in placed.filter("house_id > 5").select("cluster_label").distinct().collect()} == {"Unknown"}


def _plain_kmeans(z, rid, k, restarts, max_iter, tol, seed):
    """Seeds and Lloyd's iterations of one scope, row by row: (inertia, restart, iterations, centers) of the best run."""
    found = []
    for run in range(restarts):
        u = [lloyd.hashed_uniform(rid, seed, np.array([run]), s)[:, 0] for s in range(k)]
        c = [z[u[0].argmin()]]
        for s in range(1, k):
            least = np.array([min(((x - y) ** 2).sum() for y in c) for x in z])
            c.append(z[np.where(least > 0, -np.log(u[s]) / np.maximum(least, 1e-300), np.inf).argmin()] if least.any() else c[0])
        c, it = np.array(c), 0
        for it in range(1, max_iter + 1):
            near = np.array([((x - c) ** 2).sum(axis=1).argmin() for x in z])
            fresh = np.array([z[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
            moved, c = ((fresh - c) ** 2).sum(), fresh
            if moved <= tol:
                break
        found.append((sum(((x - c) ** 2).sum(axis=1).min() for x in z), run, it, c))
    return min(found, key=lambda f: f[:2])


@pytest.mark.parametrize("slice_rows, block_rows, look", [(1 << 17, 1 << 13, 6), (16, 5, 1)])
def test_kmeans_brute(spark, monkeypatch, slice_rows, block_rows, look):
    """Whole fits of several scopes against plain loops; rows dealt over many slices and blocks give the same."""
    monkeypatch.setattr(lloyd, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(lloyd, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(KM, "LOOK_EVERY", look)
    rng = np.random.default_rng(3)
    rows = [(h, i, float(x), float(y)) for h, n in ((1, 90), (2, 40), (3, 2), (4, 5)) for i, (x, y) in enumerate(rng.normal(size=(n, 2)) * (0 if h == 4 else 1) + rng.integers(0, 4, (n, 1)) * (0 if h == 4 else 3))]
    df = spark.createDataFrame(rows, "house_id bigint, rid bigint, Aggregate double, hour double")
    m = KM.fit_kmeans(df, k=3, restarts=3, max_iter=25, seed=9, features=["Aggregate", "hour"], rid=F.col("rid"))
    got = {r["house_id"]: r for r in m.inertia.collect()}
    centers = m.centers.toPandas().sort_values(["house_id", "cluster"])
    for h in (1, 2, 3, 4):
        x = np.array([r[2:] for r in rows if r[0] == h])
        sd = x.std(axis=0)
        z = (x - x.mean(axis=0)) / np.where(sd == 0, 1, sd)
        inertia, run, it, c = _plain_kmeans(z, np.array([r[1] for r in rows if r[0] == h]), 3, 3, 25, 1e-4 * (sd > 0).sum() / 2, 9)
        assert got[h]["inertia"] == pytest.approx(inertia, abs=1e-9) and (got[h]["restart"], got[h]["iterations"]) == (run, it)
        assert np.allclose(centers[centers.house_id == h][["c0", "c1"]].to_numpy(), c)


def _steps(ks, restarts, d):
    s = object.__new__(lloyd.Steps)
    s.ks, s.most, s.d, s.restarts, s.seed, s.keys = np.array([k for k in ks for _ in range(restarts)]), max(ks), d, restarts, 5, ["house_id"]
    return s


def test_kmeans_step_compares_few_rows(monkeypatch):
    """Rows are added in groups where a whole group has one nearest center; ties, copies of rows and of centers as row by row."""
    rng = np.random.default_rng(8)
    n = 20000
    z = np.column_stack([rng.exponential(size=n), rng.integers(0, 24, n) / 7, rng.normal(size=n), rng.integers(0, 2, n)])
    z[:3000] = z[0]
    z[3000:4000] = np.round(z[3000:4000])
    z = z[lloyd._near_order(z)]
    steps, compared = _steps([2, 3, 6], 2, 4), []
    c = np.full((6, 6, 4), np.nan)
    for r, k in enumerate(steps.ks):
        c[r, :k] = z[rng.choice(n, k, replace=False)]
    c[5, 3] = c[5, 1]                                    # the same center twice: the first has the rows
    c[0, :2] = [[0, 0, 0, 0], [2, 0, 0, 0]]              # rounded rows are as far from one as from the other
    plain = lloyd._nearest
    monkeypatch.setattr(lloyd, "_nearest", lambda zt, c: compared.append(zt.shape[1]) or plain(zt, c))
    conv = np.zeros(6, bool)
    conv[3] = True
    got = steps._sums("move", 1, None, z, c.tobytes(), conv.tobytes())
    assert not got[3].any()
    for r in (0, 1, 2, 4, 5):
        near = np.array([((x - c[r, :steps.ks[r]]) ** 2).sum(axis=1).argmin() for x in z])
        for j in range(steps.ks[r]):
            assert got[r, j, -1] == (near == j).sum()
            assert np.allclose(got[r, j, :-1], z[near == j].sum(axis=0))
    assert sum(compared) < 0.5 * 5 * n                   # of five runs that move


def test_kmeans_step_of_no_or_only_sure_groups():
    """Every row between two centers that are the same; every group on one side; rows and centers that are not numbers."""
    z = np.tile([[0.5, 0.25]], (1000, 1))
    assert lloyd._Groups(z).sums(np.array([[1.0, 1], [1, 1]])).tolist() == [[500, 250, 1000], [0, 0, 0]]
    assert lloyd._Groups(z).sums(np.array([[9.0, 9], [1, 1]])).tolist() == [[0, 0, 0], [500, 250, 1000]]
    assert lloyd._Groups(z).sums(np.array([[np.nan, np.nan], [1, 1]])).tolist() == [[0, 0, 0], [500, 250, 1000]]
    assert lloyd._Groups(z).sums(np.array([[1.0, 1]])).tolist() == [[500, 250, 1000]]
    z[:, 1] = np.nan
    got = lloyd._Groups(z[lloyd._near_order(z)]).sums(np.array([[1.0, 1], [0.5, 1]]))
    assert got[:, ::2].tolist() == [[500, 1000], [0, 0]] and np.isnan(got[0, 1])


def test_kmeans_seeds_are_drawn_once_a_restart(monkeypatch):
    rng = np.random.default_rng(2)
    z, rid, drawn = rng.normal(size=(700, 2)), np.arange(700), []
    plain = lloyd.hashed_uniform
    monkeypatch.setattr(lloyd, "hashed_uniform", lambda rid, seed, run, step: drawn.append(len(rid) * len(run)) or plain(rid, seed, run, step))
    steps = _steps(range(2, 9), 10, 2)
    c = np.full((70, 8, 2), np.nan)
    got = steps._sums("seed", 0, rid, z, c.tobytes(), np.zeros(70, bool).tobytes())
    assert got.shape == (10, 3) and sum(drawn) == 7000
    assert (got[:, 1:] == z[plain(rid, 5, np.arange(10), 0).argmin(axis=0)]).all()


def test_kmeans_blocks_span_batches(spark):
    """One block for a scope of more rows than a batch has, with all its rows; scopes stay apart."""
    rows = spark.range(25000).selectExpr("IF(id < 24990, 1, 2) AS house_id", "id AS _rid", "CAST(IF(id < 24990, 24990, 10) AS BIGINT) AS _n", "CAST(id % 97 AS DOUBLE) AS _z0", "CAST(id AS DOUBLE) AS _z1")
    got = {}
    for r in lloyd.to_blocks(rows, ["house_id"], 2).collect():
        got.setdefault(r["house_id"], []).append((np.frombuffer(r["rid"], np.int64), np.frombuffer(r["z"]).reshape(-1, 2)))
    assert {h: len(b) for h, b in got.items()} == {1: 1, 2: 1}
    for h, n in ((1, range(24990)), (2, range(24990, 25000))):
        rid, z = got[h][0]
        assert sorted(rid) == list(n) and (z[:, 1] == rid).all() and (z[:, 0] == rid % 97).all()


def test_elbow_of_grouped_rows_brute(spark):
    """Scopes of enough rows to be grouped, several ks at once, against plain loops."""
    rng = np.random.default_rng(6)
    rows = [(h, float(x), float(y)) for h in (1, 2) for x, y in rng.exponential(size=(1200, 2)) + rng.integers(0, 3, (1200, 1)) * h]
    df = spark.createDataFrame(rows, "house_id bigint, Aggregate double, hour double")
    got = {(r["house_id"], r["k"]): r["inertia"] for r in KM.elbow(df, ks=[2, 4], restarts=2, max_iter=8, tol=0.0, seed=3, features=["Aggregate", "hour"]).collect()}
    rids = df.select("house_id", F.xxhash64("house_id", "Aggregate", "hour").alias("r")).toPandas()
    for h in (1, 2):
        x = np.array([r[1:] for r in rows if r[0] == h])
        z, rid = (x - x.mean(axis=0)) / x.std(axis=0), rids[rids.house_id == h]["r"].to_numpy()
        for k in (2, 4):
            assert got[h, k] == pytest.approx(_plain_kmeans(z, rid, k, 2, 8, 0.0, 3)[0], rel=1e-9)
