"""K-means steps on blocks of rows.

The scaled rows are packed once into blocks: up to ``BLOCK_ROWS`` rows of one
scope (a house) as a matrix, near rows side by side. A step is one pass over the blocks: each meets its
scope's state (the centers of all runs: every restart, and every k of an elbow table),
tasks add up partial sums for each scope, and one row for each scope
and task goes on to be summed and turned into the next state. A scope of any size
goes the same way; its rows are dealt over slices by a hash. State rows are joined, not
collected, and the runs of a scope that have converged cost nothing but their row.

A group of neighbouring rows whose box lies wholly on one center's side is added as
one sum (the filtering of k-d tree k-means); only the rows of the other groups are compared
with the centers one by one. Seeds are drawn once for each restart, for all ks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterspark.functions.lookup import lookup_join

SLICE_ROWS = 1 << 17        # rows of a scope that go to one partition together
BLOCK_ROWS = 1 << 17
GROUP_ROWS = 32             # most rows of a group
FEW_ROWS = 1 << 9           # blocks of fewer rows are not grouped
CHUNK_ROWS = 1 << 13        # rows compared with centers at once
TASK_SCOPES = 2000          # scopes whose sums a task holds at once
#: Largest state table, in bytes, that is broadcast to the blocks.
BROADCAST_BYTES = 64 << 20
PRIME = 2**31 - 1


def hashed_uniform(rid: np.ndarray, seed: int, run: np.ndarray, step: int) -> np.ndarray:
    """Uniforms in (0, 1) for (row, run), by squaring modulo a prime; the same in any SQL with 64-bit integers."""
    parts = []
    for salt in (1, 2):
        h = (rid % PRIME * 48271 + seed + salt) % PRIME
        h = (h * h + step * 16807 + salt) % PRIME
        h = (h[:, None] * h[:, None] + run[None] * 69621 + salt) % PRIME
        parts.append((h * h + 40692) % PRIME)
    return (parts[0] * PRIME + parts[1] + 0.5) / float(PRIME * PRIME)


def _runs_of(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of neighbouring rows with equal keys."""
    change = np.zeros(batch.num_rows, bool)
    change[:1] = True
    for i in range(n_keys):
        v = batch.column(i).to_numpy(zero_copy_only=False)
        change[1:] |= v[1:] != v[:-1]
    begin = np.flatnonzero(change)
    yield from zip(begin.tolist(), [*begin[1:].tolist(), batch.num_rows])


def _group_cuts(n: int, level: int) -> np.ndarray:
    """Where n rows are cut by halving them ``level`` times: begins, and the end."""
    return n * np.arange((1 << level) + 1) >> level


def _levels(n: int) -> int:
    return max(0, int(np.ceil(np.log2(n / GROUP_ROWS))))


def _near_order(z: np.ndarray) -> np.ndarray:
    """An order in which near rows are neighbours: halved by the widest feature, down to groups."""
    order = np.arange(len(z))
    for level in range(_levels(len(z))):
        cuts = _group_cuts(len(z), level + 1).tolist()
        for a, half, b in zip(cuts[:-1:2], cuts[1::2], cuts[2::2]):
            x = z[order[a:b]]
            widest = (x.max(axis=0) - x.min(axis=0)).argmax()
            order[a:b] = order[a:b][np.argpartition(x[:, widest], half - a)]
    return order


def _pack(n_keys: int, block_rows: int, batches):
    held, key, n = [], None, 0

    def block():
        rows = pa.Table.from_batches(held)
        rid = rows.column(n_keys).to_numpy()
        z = np.column_stack([c.to_numpy() for c in rows.columns[n_keys + 1:]])
        order = _near_order(z)
        columns = [pa.array([k], held[0].schema.field(i).type) for i, k in enumerate(key)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([rid[order].tobytes()], pa.binary()), pa.array([z[order].tobytes()], pa.binary())],
                                          [*held[0].schema.names[:n_keys], "rid", "z"])
    for batch in batches:
        for a, b in _runs_of(batch, n_keys):
            own = tuple(batch.column(i)[a].as_py() for i in range(n_keys))
            while a < b:
                if held and (own != key or n == block_rows):
                    yield block()
                    held, n = [], 0
                key, more = own, min(b - a, block_rows - n)
                held.append(batch.slice(a, more))
                a, n = a + more, n + more
    if held:
        yield block()


def _nearest(zt: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest center of each column of zt; of equal ones the first."""
    dist = _distances(zt, c)
    best, near, less = dist[0].copy(), np.zeros(zt.shape[1], np.int64), np.empty(zt.shape[1], bool)
    for j in range(1, len(c)):
        np.less(dist[j], best, out=less)
        np.copyto(near, j, where=less)
        np.minimum(best, dist[j], out=best)
    return dist.argmin(axis=0) if np.isnan(best).any() else near


def _distances(zt: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(center, column of zt): squared distances but for |z|^2, the same for all centers; a missing center is at no distance."""
    far = np.isnan(c[:, 0])
    c = np.where(far[:, None], 0.0, c)
    dist = (c * c).sum(axis=1)[:, None] - 2.0 * (c @ zt)
    dist[far] = np.inf
    return dist


def _sums_by(near: np.ndarray, one_t: np.ndarray, k: int) -> np.ndarray:
    return np.array([np.bincount(near, weights=w, minlength=k) for w in one_t], np.float64).T     # without rows bincount's are integers


class _Groups:
    """A block's groups of neighbouring rows: their boxes and sums."""

    def __init__(self, z: np.ndarray):
        self.z, self.one = z, np.hstack([z, np.ones((len(z), 1))])
        cuts = _group_cuts(len(z), _levels(len(z)))
        self.rows = np.diff(cuts)
        low, high = np.minimum.reduceat(z, cuts[:-1]), np.maximum.reduceat(z, cuts[:-1])
        self.mid_t, self.half = ((low + high) / 2).T.copy(), (high - low) / 2
        self.size = (np.maximum(abs(low), abs(high)) ** 2).sum(axis=1)
        self.sums_t = np.add.reduceat(self.one, cuts[:-1]).T.copy()

    def sums(self, c: np.ndarray) -> np.ndarray:
        """(center, feature and count): sums of the rows that are nearest to each center.

        Of centers a and b, all of a box is nearer to a if its middle is, by more than the
        difference of the two squared distances can change within the box (linear, as |z|^2 cancels)."""
        dist, every = _distances(self.mid_t, c), np.arange(len(self.rows))
        near = dist.argmin(axis=0)
        apart = abs(c[:, None] - c[None])
        ahead = dist - dist[near, every] - 2.0 * np.einsum("gd,gjd->jg", self.half, apart[near])
        ahead[near, every] = np.inf
        sure = ahead.min(axis=0) > 1e-12 * ((c * c).sum(axis=1).max() + self.size)      # well above what rounding can do
        out = _sums_by(near[sure], self.sums_t[:, sure], len(c))
        rest = np.flatnonzero(np.repeat(~sure, self.rows))
        for at in range(0, len(rest), CHUNK_ROWS):
            one_t = self.one[rest[at:at + CHUNK_ROWS]].T.copy()
            out += _sums_by(_nearest(one_t[:-1], c), one_t, len(c))
        return out


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)


def to_blocks(rows: DataFrame, keys: list[str], d: int) -> DataFrame:
    """keys, rid, z from rows (keys, _rid, _n, _z0...); _n is the scope's number of rows."""
    slices = F.ceil(F.col("_n") / SLICE_ROWS)
    dealt = rows.repartition(*keys, F.pmod(F.col("_rid"), slices)).sortWithinPartitions(*keys, "_rid")
    return (dealt.select(*keys, "_rid", *[f"_z{f}" for f in range(d)])
            .mapInArrow(partial(_pack, len(keys), BLOCK_ROWS), f"{_key_schema(rows, keys)}, rid binary, z binary"))


def _on_table(call):
    """With the type hints by which Spark tells the kind of function."""
    def run(table: pa.Table) -> pa.Table:
        return call(table)
    return run


class Steps:
    """The steps for runs of given numbers of clusters. A state row holds keys, cf
    (centers, runs x most clusters x d, NaN beyond a run's own), conv and it (by run), tol, live
    (runs that still move)."""

    def __init__(self, blocks: DataFrame, keys: list[str], d: int, run_ks: list[int], restarts: int, seed: int, n_groups: int):
        self.blocks, self.keys, self.d, self.restarts, self.seed, self.n_groups = blocks, keys, d, restarts, seed, n_groups
        self.ks, self.most = np.array(run_ks), max(run_ks)
        self.schema = f"{_key_schema(blocks, keys)}, cf binary, conv binary, it binary, tol double, live int"

    # Inside tasks

    def _centers(self, cf: bytes) -> np.ndarray:
        return np.frombuffer(cf).reshape(len(self.ks), self.most, self.d)

    def _seeded(self) -> np.ndarray:
        """The runs of the most clusters, by restart: their seeds are those of the other runs too."""
        return np.flatnonzero(self.ks == self.most)[:self.restarts]

    def _race(self, step: int, rid: np.ndarray, z: np.ndarray, c: np.ndarray) -> np.ndarray:
        """(restart, row): the row of the least becomes the restart's next seed."""
        u = hashed_uniform(rid, self.seed, np.arange(self.restarts), step).T
        if not step:
            return u
        least = np.full(u.shape, np.inf)
        for j in range(step):
            d2 = np.zeros(u.shape)
            for f in range(self.d):
                d2 += (z[None, :, f] - c[:, j, f, None]) ** 2
            least = np.minimum(least, d2)
        with np.errstate(divide="ignore"):
            return np.where(least > 0, -np.log(u) / least, np.inf)

    def _sums(self, kind: str, step: int, rid: np.ndarray | None, z: np.ndarray, cf: bytes, conv: bytes) -> np.ndarray | None:
        """What a block adds: sums and counts by (run, cluster), the runs' errors, or the restarts' best candidates for a seed."""
        c = self._centers(cf)
        chunks = [slice(at, at + CHUNK_ROWS) for at in range(0, len(z), CHUNK_ROWS)]
        if kind == "seed":
            race = np.hstack([self._race(step, rid[s], z[s], c[self._seeded()]) for s in chunks])
            least = race.min(axis=1)
            row = np.where(race == least[:, None], rid[None], np.iinfo(np.int64).max).argmin(axis=1)    # of equal ones the least rid
            return np.hstack([least[:, None], z[row]])
        if kind == "error":
            error = np.zeros(len(self.ks))
            for s in chunks:
                zt = z[s].T.copy()
                for r, k in enumerate(self.ks):
                    error[r] += ((zt - c[r].T[:, _nearest(zt, c[r, :k])]) ** 2).sum()
            return error
        moving = np.flatnonzero(~np.frombuffer(conv, bool))
        if not len(moving):
            return None
        out = np.zeros((len(self.ks), self.most, self.d + 1))
        if len(z) < FEW_ROWS:
            one = np.hstack([z, np.ones((len(z), 1))])
            near = _distances(z.T, c[moving].reshape(-1, self.d)).reshape(len(moving), self.most, len(z)).argmin(axis=1)
            out[moving] = (near[:, None] == np.arange(self.most)[:, None]).astype(np.float64) @ one
        else:
            groups = _Groups(z)
            for r in moving:
                out[r, :self.ks[r]] = groups.sums(c[r, :self.ks[r]])
        return out

    def _add(self, kind: str, a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
        if a is None or b is None:
            return b if a is None else a
        return np.where(b[:, :1] < a[:, :1], b, a) if kind == "seed" else a + b

    def _partials(self, kind: str, step: int, batches):
        n_keys, held = len(self.keys), {}

        def flush():
            rows = list(held.items())
            held.clear()
            columns = [pa.array([key[i] for key, _ in rows], kinds[i]) for i in range(n_keys)]
            columns += [pa.array([None if s is None else s.tobytes() for _, (s, _) in rows], pa.binary())]
            columns += [pa.array([state[i] for _, (_, state) in rows], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, [*self.keys, "sums", "cf", "conv", "it", "tol", "live"])
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(n_keys)]
            for i in range(batch.num_rows):
                *key, z, cf, conv, it, tol, live = (c[i].as_py() for c in batch.columns[:n_keys + 6])
                rid = np.frombuffer(batch.column("rid")[i].as_py(), np.int64) if kind == "seed" else None
                sums = self._sums(kind, step, rid, np.frombuffer(z).reshape(-1, self.d), cf, conv)
                before = held.get(tuple(key))
                held[tuple(key)] = (self._add(kind, before and before[0], sums), (cf, conv, it, tol, live))
                if len(held) >= TASK_SCOPES:
                    yield flush()
        if held:
            yield flush()

    def _total(self, kind: str, table: pa.Table):
        """Keys, the sums of all tasks, and the state of a scope."""
        row = table.slice(0, 1).to_pylist()[0]
        total = None
        for s in table.column("sums").to_pylist():
            shape = {"seed": (self.restarts, self.d + 1), "error": (len(self.ks),), "move": (len(self.ks), self.most, self.d + 1)}[kind]
            total = self._add(kind, total, None if s is None else np.frombuffer(s).reshape(shape))
        return {k: row[k] for k in self.keys}, total, row

    def _state(self, kinds: pa.Schema, key: dict, c: np.ndarray, conv: np.ndarray, it: np.ndarray, tol: float) -> pa.Table:
        row = {**key, "cf": c.tobytes(), "conv": conv.tobytes(), "it": it.tobytes(), "tol": tol, "live": int((~conv).sum())}
        types = {**{k: kinds.field(k).type for k in self.keys}, "cf": pa.binary(), "conv": pa.binary(), "it": pa.binary(), "tol": pa.float64(), "live": pa.int32()}
        return pa.table({k: pa.array([v], types[k]) for k, v in row.items()})

    def _next_seed(self, step: int, table: pa.Table) -> pa.Table:
        """Each run's next center: the row that wins its restart's race; the first again where all rows are centers."""
        key, best, row = self._total("seed", table)
        c = self._centers(row["cf"]).copy()
        fresh = np.where(np.isfinite(best[:, :1]), best[:, 1:], c[self._seeded(), 0])[np.arange(len(self.ks)) % self.restarts]
        c[self.ks > step, step] = fresh[self.ks > step]
        return self._state(table.schema, key, c, np.frombuffer(row["conv"], bool), np.frombuffer(row["it"], np.int32), row["tol"])

    def _move(self, step: int, table: pa.Table) -> pa.Table:
        """Means in place of centers; a cluster without rows keeps its own."""
        key, sums, row = self._total("move", table)
        c, conv, it = self._centers(row["cf"]).copy(), np.frombuffer(row["conv"], bool).copy(), np.frombuffer(row["it"], np.int32).copy()
        if sums is not None:
            n = sums[:, :, -1:]
            fresh = np.where(n > 0, sums[:, :, :-1] / np.maximum(n, 1), c)
            moved = np.nansum((fresh - c) ** 2, axis=(1, 2))
            going = ~conv
            c[going], it[going] = fresh[going], step
            conv |= moved <= row["tol"]
        return self._state(table.schema, key, c, conv, it, row["tol"])

    def _result(self, table: pa.Table) -> pa.Table:
        """For each k the run of least error, of equal ones the first."""
        key, error, row = self._total("error", table)
        c, it, out = self._centers(row["cf"]), np.frombuffer(row["it"], np.int32), []
        for k in dict.fromkeys(self.ks.tolist()):
            own = np.flatnonzero(self.ks == k)
            best = int(error[own].argmin())
            out.append({**key, "k": k, "restart": best, "inertia": float(error[own[best]]), "iterations": int(it[own[best]]), "cf": c[own[best], :k].ravel().tolist()})
        types = {**{k: table.schema.field(k).type for k in self.keys}, "k": pa.int32(), "restart": pa.int32(), "inertia": pa.float64(), "iterations": pa.int32(), "cf": pa.list_(pa.float64())}
        return pa.table({name: pa.array([r[name] for r in out], t) for name, t in types.items()})

    # On Spark

    def _pass(self, state: DataFrame, kind: str, step: int):
        size = 8 * len(self.ks) * self.most * self.d + 100
        x = lookup_join(self.blocks, state, self.keys, "inner", known_rows=self.n_groups, max_broadcast_rows=BROADCAST_BYTES // size)
        x = x.select(*self.keys, "z", "cf", "conv", "it", "tol", "live", *(["rid"] if kind == "seed" else []))
        rows = x.mapInArrow(partial(self._light()._partials, kind, step), f"{_key_schema(self.blocks, self.keys)}, sums binary, " + self.schema.split(", ", len(self.keys))[-1])
        return rows.groupBy(*self.keys)

    def _light(self) -> Steps:
        """The tasks' side, without the DataFrame."""
        light = object.__new__(Steps)
        light.__dict__.update({k: v for k, v in self.__dict__.items() if k != "blocks"})
        return light

    def first_state(self, scopes: DataFrame, centers: list[list[float]] | None = None) -> DataFrame:
        """scopes: keys, _tol. Without given centers there are none yet."""
        c = np.full((len(self.ks), self.most, self.d), np.nan)
        for r, k in enumerate(self.ks if centers is not None else ()):
            c[r, :k] = np.array(centers)[:k]
        n = len(self.ks)
        return scopes.select(*self.keys, F.lit(c.tobytes()).alias("cf"), F.lit(np.zeros(n, bool).tobytes()).alias("conv"),
                             F.lit(np.zeros(n, np.int32).tobytes()).alias("it"), F.col("_tol").alias("tol"), F.lit(n).alias("live"))

    def seed_step(self, state: DataFrame, step: int) -> DataFrame:
        return self._pass(state, "seed", step).applyInArrow(_on_table(partial(self._light()._next_seed, step)), self.schema)

    def move_step(self, state: DataFrame, step: int) -> DataFrame:
        return self._pass(state, "move", step).applyInArrow(_on_table(partial(self._light()._move, step)), self.schema)

    def result(self, state: DataFrame) -> DataFrame:
        schema = f"{_key_schema(self.blocks, self.keys)}, k int, restart int, inertia double, iterations int, cf array<double>"
        return self._pass(state, "error", 0).applyInArrow(_on_table(self._light()._result), schema)
