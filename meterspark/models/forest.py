"""Isolation forest per model scope (default: one forest per house).

Fit, as Spark jobs:
1. scale features (population std; nulls as 0);
2. sample: every row joins each tree of its key with one probability, which
   gives a tree ~1.5 * psi candidates; the trees a row joins are drawn by
   geometric gaps from hashes of its content (rows that join none are left
   out before any Python, and partitioning changes nothing). Each tree keeps the
   psi candidates with the smallest second uniform: a uniform psi-row sample
   of all rows per tree, independent of the other trees, psi = min(max_samples, rows);
3. build the trees ``TREES_PER_TASK`` at a time with ``applyInPandas``
   grouped by (key, block of trees): groups hold about
   1.5 * psi * TREES_PER_TASK candidate rows;
4. threshold: the ``contamination`` percentile of the training scores, an
   exact per-key percentile (``functions.percentile``).

Score: a scalar pandas UDF walks all trees of the row's key over Arrow
batches. The forest is broadcast when its node count is within
``MAX_BROADCAST_NODES`` (checked); beyond it rows and trees meet in a
cogroup by (key, row chunk), chunks sized so no group is unbounded.
"""

from __future__ import annotations

import dataclasses
import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterspark.config import FOREST_FEATURES, ensure_checkpoint_dir
from meterspark.functions.isotree import PackedForest, average_path_length, build_trees
from meterspark.functions.lookup import lookup_join
from meterspark.functions.percentile import exact_percentile
from meterspark.functions.random import uniform
from meterspark.models.scaler import apply_scaler, available, fit_scaler, scope_keys, with_scope

MAX_BROADCAST_NODES = 5_000_000
COGROUP_CHUNK_ROWS = 500_000
TREES_PER_TASK = 20


@dataclasses.dataclass
class ForestModel:
    keys: list[str]
    features: list[str]
    scope: str
    trees: int
    contamination: float
    scaler: DataFrame   # keys, _n, <f>_mean, <f>_scale
    nodes: DataFrame    # keys, tree, node, feature, threshold, left, right, value
    params: DataFrame   # keys, psi, max_depth, c_psi, offset
    broadcast: object = dataclasses.field(default=None, repr=False, compare=False)


def _checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _node_schema(keys: list[str], key_types) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in zip(keys, key_types)] + [
        T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
        T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
        T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
        T.StructField("value", T.DoubleType())])


def _key_seed(v) -> int:
    return int(v) & 0x7FFFFFFF if isinstance(v, (int, np.integer)) else abs(hash(str(v))) & 0x7FFFFFFF


def _builder(keys: list[str], d: int, seed: int):
    zc = [f"_z{f}" for f in range(d)]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        """All trees of one (key, block of trees), grown together."""
        pdf = pdf.sort_values(["tree", "_h", "_rid"], kind="mergesort")
        psi = int(pdf["_psi"].iloc[0])
        pdf = pdf[pdf.groupby("tree", sort=False).cumcount() < psi]      # psi smallest _h per tree
        blk = int(pdf["_blk"].iloc[0])
        rng = np.random.default_rng([seed, blk] + [_key_seed(pdf[k].iloc[0]) for k in keys])
        tree, node, feat, thr, left, right, value = build_trees(
            pdf[zc].to_numpy(np.float64), pdf["tree"].to_numpy(np.int64), rng, int(pdf["_depth"].iloc[0]))
        out = {k: np.repeat(pdf[k].iloc[0], tree.size) for k in keys}
        out.update(tree=tree.astype(np.int32), node=node.astype(np.int32), feature=feat.astype(np.int32),
                   threshold=thr, left=left.astype(np.int32), right=right.astype(np.int32), value=value)
        return pd.DataFrame(out)

    return build


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tree_picker(trees: int, seed: int):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def pick(rid: pd.Series, q: pd.Series, first: pd.Series) -> pd.Series:
        """The trees a row joins, each with probability q: the gaps between
        them are geometric, so the work is one step per joined tree."""
        ids = rid.to_numpy(np.int64).view(np.uint64)
        with np.errstate(divide="ignore"):
            rate = np.log1p(-q.to_numpy(np.float64))            # -inf where q is 1: no gaps
        at, row = first.to_numpy(np.int64), np.arange(len(rid))
        rows, picked, step = [], [], 0
        while len(row):
            rows.append(row)
            picked.append(at)
            step += 1
            salt = np.uint64((seed * 0x9E3779B97F4A7C15 + step * 0xD1B54A32D192ED03) % 2**64)
            u = ((_mixed(ids[row] ^ salt) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            at = at + 1 + np.minimum(np.floor(np.log(u) / rate[row]), trees).astype(np.int64)
            row, at = row[at < trees], at[at < trees]
        if not rows:
            return pd.Series([], dtype=object)
        rows, picked = np.concatenate(rows), np.concatenate(picked)
        order = np.argsort(rows, kind="stable")
        ends = np.cumsum(np.bincount(rows, minlength=len(rid)))[:-1]
        return pd.Series(np.split(picked[order].astype(np.int32), ends))

    return pick


def _sample(z: DataFrame, keys: list[str], d: int, trees: int, seed: int) -> DataFrame:
    """Per (key, tree) a uniform sample of psi rows (see module doc)."""
    q = F.least(F.lit(1.0), (F.lit(1.5) * F.col("_psi") + 32) / F.col("_n").cast("double"))
    first = F.coalesce(F.floor(F.log(uniform(F.lit(seed), F.lit(-1), F.col("_rid"))) / F.log1p(-q)), F.lit(0))
    rows = z.withColumn("_q", q).withColumn("_first", first).filter(F.col("_first") < trees)
    joined = _tree_picker(trees, seed)(F.col("_rid"), F.col("_q"), F.col("_first"))
    cand = rows.select(*keys, "_rid", "_psi", "_depth", *[f"_z{f}" for f in range(d)], F.explode(joined).alias("tree"))
    # each tree then keeps its psi candidates with the smallest _h (in the build task)
    return cand.withColumn("_h", uniform(F.lit(seed + 7919), F.col("tree"), F.col("_rid")))


def _params(scaler: DataFrame, keys: list[str], max_samples: int) -> DataFrame:
    psi = F.least(F.lit(max_samples).cast("bigint"), F.col("_n"))
    # height limit ceil(log2 psi) and c(psi), computed in SQL
    c = F.when(psi > 2, 2.0 * (F.log(psi - 1.0) + 0.5772156649015329) - 2.0 * (psi - 1.0) / psi) \
        .when(psi == 2, F.lit(1.0)).otherwise(F.lit(0.0))
    depth = F.ceil(F.log2(F.greatest(psi, F.lit(2)).cast("double"))).cast("int")
    return scaler.select(*keys, "_n", psi.alias("psi"), depth.alias("max_depth"), c.alias("c_psi"))


def fit_forest(df: DataFrame, contamination: float = 0.05, trees: int = 200, max_samples: int = 256,
               seed: int = 42, features: list[str] | None = None, scope: str = "house") -> ForestModel:
    return fit_score_forest(df, contamination, trees, max_samples, seed, features, scope, keep_scores=False)[0]


def fit_score_forest(df: DataFrame, contamination: float = 0.05, trees: int = 200, max_samples: int = 256,
                     seed: int = 42, features: list[str] | None = None, scope: str = "house",
                     keep_scores: bool = True):
    """Fit, and score the training rows once: their scores give the
    threshold and, with ``keep_scores``, the returned scored frame (the same
    as ``score_forest(df, model)``, without a second scoring pass)."""
    keys = scope_keys(scope)
    src = with_scope(df, scope)
    feats = available(src, features or FOREST_FEATURES)
    d = len(feats)
    extra = ["Time"] if "Time" in src.columns else []
    # The fit reads its input several times (scaler, sample, scores): keep it
    # (lost blocks are recomputed from lineage) and release it at the end.
    src = src.persist(StorageLevel.MEMORY_AND_DISK) if keep_scores else src
    x = src.select(*keys, *extra, *[F.col(c).cast("double").alias(c) for c in feats])
    if not keep_scores:
        x = x.persist(StorageLevel.MEMORY_AND_DISK)
    scaler = _checkpoint(fit_scaler(x, feats, keys))
    n_groups = scaler.count()
    params = _checkpoint(_params(scaler, keys, max_samples))
    # Row identity from the raw inputs, so the sample does not depend on
    # partitioning (scaled values differ in their last bits by summation order).
    x = x.withColumn("_rid", F.xxhash64(*[F.col(c) for c in keys + extra + feats]))
    z = apply_scaler(x, scaler, feats, keys, known_rows=n_groups)
    z = lookup_join(z, params.select(*keys, F.col("_n"), F.col("psi").alias("_psi"), F.col("max_depth").alias("_depth")),
                    keys, "inner", known_rows=n_groups)
    sample = _sample(z, keys, d, trees, seed)
    key_types = [scaler.schema[k].dataType for k in keys]
    # Trees are built TREES_PER_TASK at a time: groups hold at most
    # TREES_PER_TASK * psi rows.
    blocks = -(-trees // TREES_PER_TASK)
    parts = max(1, min(n_groups * blocks, 4 * df.sparkSession.sparkContext.defaultParallelism))
    nodes = (sample.withColumn("_blk", (F.col("tree") / TREES_PER_TASK).cast("int"))
             .repartition(parts, *keys, "_blk")
             .groupBy(*keys, "_blk")
             .applyInPandas(_builder(keys, d, seed), _node_schema(keys, key_types)))
    nodes = _checkpoint(nodes)
    model = ForestModel(keys, feats, scope, trees, contamination, scaler, nodes,
                        params.select(*keys, "psi", "max_depth", "c_psi", F.lit(0.0).alias("offset")))
    if keep_scores:
        full = src.withColumn("_rid", F.xxhash64(*[F.col(c) for c in keys + extra + feats]))
        full = apply_scaler(full, scaler, feats, keys, known_rows=n_groups)
        scored = _checkpoint(_score_samples(full, model, known_groups=n_groups))
    else:
        scored = _checkpoint(_score_samples(z.drop("_n", "_psi", "_depth"), model, known_groups=n_groups)
                             .select(*keys, "_score"))
    biggest = scaler.agg(F.max("_n")).first()[0]
    offset = exact_percentile(scored, keys, "_score", contamination, out="offset", max_group_rows=biggest)
    model.params = _checkpoint(params.select(*keys, "psi", "max_depth", "c_psi").join(offset, keys, "inner"))
    (x if not keep_scores else src).unpersist()
    if not keep_scores:
        return model, None
    return model, _finish_scores(scored, df, model, n_groups)


def _finish_scores(scored: DataFrame, df: DataFrame, model: ForestModel, n_groups: int | None = None) -> DataFrame:
    s = lookup_join(scored, model.params.select(*model.keys, "offset"), model.keys, "left", known_rows=n_groups)
    score = F.nanvl("_score", F.lit(None).cast("double"))
    out = s.select(*df.columns, (score - F.col("offset")).alias("anomaly_score"))
    return out.withColumn("is_anomaly", F.coalesce(F.col("anomaly_score") < 0, F.lit(False)).cast("int"))


def _packed(model: ForestModel) -> dict:
    """Forest per scope key as packed arrays (driver side, size-checked)."""
    keys = model.keys
    nodes = model.nodes.toPandas()
    par = {tuple(r[k] for k in keys): r for r in model.params.collect()}
    out = {}
    for key, g in nodes.groupby(keys, sort=False):
        key = key if isinstance(key, tuple) else (key,)
        p = par[key]
        out[key] = PackedForest.from_nodes(
            g["tree"].to_numpy(), g["node"].to_numpy(), g["feature"].to_numpy(), g["threshold"].to_numpy(),
            g["left"].to_numpy(), g["right"].to_numpy(), g["value"].to_numpy(), p["max_depth"], p["c_psi"])
    return out


def _score_samples(z: DataFrame, model: ForestModel, known_groups: int | None = None) -> DataFrame:
    """Add ``_score`` (= -2^(-E[h]/c(psi))) to scaled rows ``z``."""
    keys, d = model.keys, len(model.features)
    n_nodes = model.nodes.count() if model.broadcast is None else 0
    if model.broadcast is not None or n_nodes <= MAX_BROADCAST_NODES:
        if model.broadcast is None:
            model.broadcast = z.sparkSession.sparkContext.broadcast(_packed(model))
        bc = model.broadcast
        nk = len(keys)

        @F.pandas_udf(T.DoubleType())
        def score(k: pd.DataFrame, x: pd.DataFrame) -> pd.Series:
            forests = bc.value
            xs = x.to_numpy(np.float64)
            kv = [k.iloc[:, i].to_numpy() for i in range(nk)]
            out = np.full(len(x), np.nan)
            keyframe = pd.DataFrame({f"k{i}": kv[i] for i in range(nk)})
            for key, idx in keyframe.groupby(list(keyframe.columns), sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                forest = forests.get(tuple(v.item() if hasattr(v, "item") else v for v in key))
                if forest is not None:
                    out[idx] = forest.score_samples(xs[idx])
            return pd.Series(out)

        return z.withColumn("_score", score(F.struct(*[F.col(k) for k in keys]),
                                            F.struct(*[F.col(f"_z{f}") for f in range(d)])))
    return _score_cogroup(z, model)


def _score_cogroup(z: DataFrame, model: ForestModel) -> DataFrame:
    """Forest too large to broadcast: rows are cut into chunks of at most
    ``COGROUP_CHUNK_ROWS`` per key, each chunk meets its key's trees."""
    keys, d = model.keys, len(model.features)
    counts = _checkpoint(z.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))         # of the rows to score
    nch = F.ceil(F.col("_n") / COGROUP_CHUNK_ROWS)
    rows = lookup_join(z, counts, keys, "inner").withColumn("_chunk", F.pmod(F.col("_rid"), nch)).drop("_n")
    trees = (model.nodes.join(model.params, keys, "inner").join(counts, keys, "inner")
             .withColumn("_chunk", F.explode(F.sequence(F.lit(0), (nch - 1).cast("long")))).drop("_n"))
    schema = T.StructType(rows.schema.fields + [T.StructField("_score", T.DoubleType())])
    zc = [f"_z{f}" for f in range(d)]

    def run(rpdf: pd.DataFrame, tpdf: pd.DataFrame) -> pd.DataFrame:
        if rpdf.empty:
            return rpdf.assign(_score=pd.Series(dtype="float64"))
        if tpdf.empty:                       # a scope that the model has not seen
            return rpdf.assign(_score=np.nan)
        f = PackedForest.from_nodes(tpdf["tree"].to_numpy(), tpdf["node"].to_numpy(), tpdf["feature"].to_numpy(),
                                    tpdf["threshold"].to_numpy(), tpdf["left"].to_numpy(), tpdf["right"].to_numpy(),
                                    tpdf["value"].to_numpy(), tpdf["max_depth"].iloc[0], tpdf["c_psi"].iloc[0])
        return rpdf.assign(_score=f.score_samples(rpdf[zc].to_numpy(np.float64)))

    return (rows.groupBy(*keys, "_chunk").cogroup(trees.groupBy(*keys, "_chunk"))
            .applyInPandas(run, schema).drop("_chunk"))


def score_forest(df: DataFrame, model: ForestModel) -> DataFrame:
    """Add anomaly_score (score - threshold; lower = more anomalous, < 0 flagged)
    and is_anomaly (1 when anomaly_score < 0). Nulls count as 0. Rows of a
    scope that the model has not seen stay, without a score and not flagged."""
    keys = model.keys
    src = with_scope(df, model.scope)
    time = ["Time"] if "Time" in src.columns else []
    src = src.withColumn("_rid", F.xxhash64(*[F.col(c) for c in keys + time + model.features]))
    z = apply_scaler(src, model.scaler, model.features, keys, how="left")
    return _finish_scores(_score_samples(z, model), df, model)


# --- a fixed forest, for checking scoring and thresholds against SQL ---------
# Each tree: {node: (feature, threshold, left, right)} for inner nodes and
# {node: (depth, size)} for leaves; features index FOREST_FEATURES.
FIXED_TREES = [
    {"inner": {0: (4, 1.5, 1, 2), 1: (0, 0.5, 3, 4)}, "leaf": {2: (1, 6), 3: (2, 200), 4: (2, 40)}},
    {"inner": {0: (6, -1.0, 1, 2), 2: (5, 0.0, 3, 4)}, "leaf": {1: (1, 5), 3: (2, 120), 4: (2, 131)}},
    {"inner": {0: (2, 1.0, 1, 2), 1: (7, 2.0, 3, 4)}, "leaf": {2: (1, 16), 3: (2, 230), 4: (2, 10)}},
]
FIXED_PSI = 256


def fixed_forest(df: DataFrame, contamination: float = 0.05, scope: str = "house") -> ForestModel:
    """A model with the trees above and a scaler and threshold fitted on ``df``."""
    keys = scope_keys(scope)
    src = with_scope(df, scope)
    feats = list(FOREST_FEATURES)
    x = src.select(*keys, *[F.col(c).cast("double").alias(c) for c in feats])
    scaler = _checkpoint(fit_scaler(x, feats, keys))
    n_groups = scaler.count()
    rows = []
    for t, tr in enumerate(FIXED_TREES):
        for node, (f, thr, lft, rgt) in tr["inner"].items():
            rows.append((t, node, f, float(thr), lft, rgt, 0.0))
        for node, (depth, size) in tr["leaf"].items():
            rows.append((t, node, -1, 0.0, -1, -1, depth + float(average_path_length([size])[0])))
    items = F.array(*[F.struct(F.lit(r[0]).alias("tree"), F.lit(r[1]).alias("node"), F.lit(r[2]).alias("feature"),
                               F.lit(r[3]).alias("threshold"), F.lit(r[4]).alias("left"), F.lit(r[5]).alias("right"),
                               F.lit(r[6]).alias("value")) for r in rows])
    nodes = scaler.select(*keys, F.explode(items).alias("n")).select(*keys, "n.*")
    c = float(average_path_length([FIXED_PSI])[0])
    params = scaler.select(*keys, F.lit(FIXED_PSI).alias("psi"), F.lit(2).alias("max_depth"), F.lit(c).alias("c_psi"),
                           F.lit(0.0).alias("offset"))
    model = ForestModel(keys, feats, scope, len(FIXED_TREES), contamination, scaler, nodes, params)
    z = apply_scaler(x, scaler, feats, keys, known_rows=n_groups)
    z = z.withColumn("_rid", F.xxhash64(*feats))
    scored = _checkpoint(_score_samples(z, model, known_groups=n_groups).select(*keys, "_score"))
    biggest = scaler.agg(F.max("_n")).first()[0]
    offset = exact_percentile(scored, keys, "_score", contamination, out="offset", max_group_rows=biggest)
    model.params = _checkpoint(params.drop("offset").join(offset, keys, "inner"))
    return model


