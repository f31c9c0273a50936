"""Exact k-means over integer vectors with Drake's adaptive bounds.

Vectors are floor(scale * x) of sound rows: exactly `size` components (any one length where size is None, the rows of
others take no part), none null or non-finite. Everything is exact: distances are squared Euclidean ones in integers,
ties go to the smaller centroid number, and a new centroid is the componentwise floor of its vectors' mean; an empty one stays.

A vector carries, from round to round, its centroid, an upper bound of the distance to it, lower bounds of the
distances to its `near` next centroids in order, and one more lower bound for all the rest. When centroids move,
the upper bound grows by its centroid's step, each lower one shrinks by its own centroid's, the last by the largest.
A vector whose upper bound is below all the lower ones keeps its centroid unseen. Else the upper bound is made exact;
then only as many of the nearest are measured as could still be nearer, and if the last bound can't be ruled out, all
centroids are. Bounds are doubles with a margin for rounding, and a decision is taken from them only where the order is
strict, so ties are always measured. near adapts as in Drake's method: it starts at a quarter of the centroids and
comes down to what the last round needed, not below an eighth.

Each round reads the last one's table from the shared folder and writes its own there, whereupon the last one goes, so
a lost executor costs its tasks only. Sums of a cluster come as one row per component and task, in limbs of 40 bits,
so no sum can overflow however large finite components are; what reaches the driver is bounded by centroids and
components. A distance or inertia beyond 64 bits is given as the largest 64-bit integer.

Rows are vectors of their own, also where ids or rows repeat; start centroids are the rows with the smallest hashes of
"seed:id", null ids hashed as empty, equal ids in the order of their packed vectors. Fewer rows than centroids give as
many centroids as rows, no sound row gives no rows. Columns other than the id and the vector aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinmark.llm.common import fresh_path, remove, ship

K, ROUNDS, SIZE, SCALE, SEED = 16, 3, 64, 64.0, 1
ROWS = 2048  # vectors in hand at once
LIMB = 40
SAFE = 2**22  # components below it: squared distances of up to 2**7 components are exact in doubles
MOST = 2**63 - 1
STATE = "vec_id long, vector binary, wide boolean, at int, upper double, who array<int>, lower array<double>, rest double"


def _pack(m: list[int]) -> tuple[bytes, bool]:
    """A vector of integers as bytes: 64-bit ones, or decimal digits where one is beyond those."""
    if all(-SAFE < x < SAFE for x in m):
        return np.array(m, "<i4").tobytes(), False
    return ",".join(map(str, m)).encode(), True


def _unpack(raw: bytes, wide: bool) -> list[int]:
    return [int(x) for x in raw.split(b",")] if wide else np.frombuffer(raw, "<i4").tolist()


def integers(batches: Iterator[pa.RecordBatch], scale: float, size: int | None) -> Iterator[pa.RecordBatch]:
    """vec_id, vector, wide of the sound rows."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            col = b.column("vector").cast(pa.large_list(pa.float64()))
            ends, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)  # nulls become NaN
            n = np.diff(ends)
            rows = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False) & (n == size if size is not None else n > 0))
            packed, wide, kept = [], [], []
            for i in rows.tolist():
                x = flat[ends[i] : ends[i + 1]]
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    m = np.floor(x * scale)
                if (np.abs(m) < SAFE).all():
                    raw, w = m.astype("<i4").tobytes(), False
                else:
                    raw, w = _pack([math.floor(Fraction(v) * Fraction(scale)) for v in x.tolist()])
                packed.append(raw)
                wide.append(w)
                kept.append(i)
            if kept:
                yield pa.record_batch([b.column("vec_id").take(pa.array(kept)), pa.array(packed, pa.binary()), pa.array(wide)], ["vec_id", "vector", "wide"])


class Measure:
    """Exact squared distances of a batch of vectors to the centroids, in doubles where those are exact, else in integers of any length."""

    def __init__(self, raw: pa.Array, wide: np.ndarray, centroids: list[list[int]]):
        plain = not wide.any() and len(centroids[0]) <= 128 and all(-SAFE < x < SAFE for c in centroids for x in c)
        if plain:
            self.v = np.frombuffer(b"".join(raw.to_pylist()), "<i4").reshape(len(wide), -1).astype(np.float64)
            self.c = np.array(centroids, np.float64)
        else:
            whole = lambda rows: np.array([[*x, 0] for x in rows], object)[:, :-1]
            self.v = whole([_unpack(x, w) for x, w in zip(raw.to_pylist(), wide.tolist(), strict=True)])
            self.c = whole(centroids)
        self.measured = 0

    def every(self, rows: np.ndarray) -> np.ndarray:
        """rows x centroids."""
        v, c = self.v[rows], self.c
        self.measured += len(rows) * len(c)
        return (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]

    def some(self, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        """rows x which.shape[1], which holding each row's centroids."""
        self.measured += which.size
        out = np.empty(which.shape, self.v.dtype)
        v = self.v[rows]
        for j in range(which.shape[1]):
            d = v - self.c[which[:, j]]
            out[:, j] = (d * d).sum(1)
        return out


def _root(d: np.ndarray) -> np.ndarray:
    """Distances from squared ones, as doubles; a squared one beyond doubles counts as infinitely far, which no bound certifies."""
    if d.dtype == object:
        d = np.array([float(x) if x < 1 << 1023 else np.inf for x in d.ravel().tolist()]).reshape(d.shape)
    return np.sqrt(d)


def _below(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a is surely less than b, rounding of either allowed for."""
    with np.errstate(invalid="ignore"):
        return a * (1 + 1e-9) + 1e-9 < b


def _ordered(d: np.ndarray, which: np.ndarray) -> np.ndarray:
    """For each row the columns by distance, then by centroid number."""
    by_number = np.argsort(which, axis=1, kind="stable")
    return np.take_along_axis(by_number, np.argsort(np.take_along_axis(d, by_number, 1), axis=1, kind="stable"), 1)


class Bounds:
    """A batch's centroid numbers and bounds."""

    def __init__(self, at: np.ndarray, upper: np.ndarray, who: np.ndarray, lower: np.ndarray, rest: np.ndarray):
        self.at, self.upper, self.who, self.lower, self.rest = at, upper, who, lower, rest

    @classmethod
    def scanned(cls, m: Measure, n: int, near: int) -> Bounds:
        out = cls(np.zeros(n, np.int64), np.zeros(n), np.zeros((n, near), np.int64), np.zeros((n, near)), np.full(n, np.inf))
        out.rescan(m, np.arange(n))
        return out

    def rescan(self, m: Measure, rows: np.ndarray) -> None:
        """All centroids measured."""
        if not len(rows):
            return
        d = m.every(rows)
        which = np.broadcast_to(np.arange(d.shape[1]), d.shape)
        order, near = _ordered(d, which), self.who.shape[1]
        far = _root(np.take_along_axis(d, order, 1))
        self.at[rows], self.upper[rows] = order[:, 0], far[:, 0]
        self.who[rows], self.lower[rows] = order[:, 1 : near + 1], far[:, 1 : near + 1]
        self.rest[rows] = far[:, near + 1] if far.shape[1] > near + 1 else np.inf

    def moved(self, steps: np.ndarray, near: int) -> None:
        """The centroids have gone these distances; only `near` lower bounds are kept on."""
        self.upper += steps[self.at]
        with np.errstate(invalid="ignore"):
            self.lower -= steps[self.who]
            self.rest -= steps.max()
        for x in (self.lower, self.rest):
            x[np.isnan(x)] = -np.inf
        if near < self.who.shape[1]:
            self.rest = np.minimum(self.rest, self.lower[:, near:].min(1))
            self.who, self.lower = self.who[:, :near], self.lower[:, :near]

    def settle(self, m: Measure) -> int:
        """Every vector's nearest centroid; how many of the near ones any vector had to measure."""
        near = self.who.shape[1]
        nearest = np.minimum(self.rest, self.lower.min(1)) if near else self.rest
        open_ = np.flatnonzero(~_below(self.upper, nearest))
        if not len(open_):
            return 0
        self.upper[open_] = _root(m.some(open_, self.at[open_, None]))[:, 0]
        open_ = open_[~_below(self.upper[open_], nearest[open_])]
        lost = ~_below(self.upper[open_], self.rest[open_])
        self.rescan(m, open_[lost])
        open_ = open_[~lost]
        doubt = ~_below(self.upper[open_, None], self.lower[open_])
        need = np.where(doubt, np.arange(1, near + 1), 0).max(1) if near else np.zeros(0, int)  # up to the last one in doubt
        for z in np.unique(need).tolist():
            rows = open_[need == z]
            which = np.concatenate([self.at[rows, None], self.who[rows, :z]], 1)
            d = m.some(rows, which)
            order = _ordered(d, which)
            which, far = np.take_along_axis(which, order, 1), _root(np.take_along_axis(d, order, 1))
            self.at[rows], self.upper[rows] = which[:, 0], far[:, 0]
            self.who[rows, :z], self.lower[rows, :z] = which[:, 1:], far[:, 1:]
        return int(max(need.max(initial=0), near if lost.any() else 0))


def _limbs(x: int) -> Iterator[tuple[int, int]]:
    sign, x, at = (-1 if x < 0 else 1), abs(x), 0
    while x:
        yield at, sign * (x & ((1 << LIMB) - 1))
        x, at = x >> LIMB, at + 1


def _sums(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows cluster, component (-1: the number of vectors), limb, n."""
    plain: np.ndarray | None = None
    count, wide = [0] * k, {}
    for b in batches:
        at, w = b.column("at").to_numpy(), b.column("wide").to_numpy(zero_copy_only=False)
        raw = b.column("vector").to_pylist()
        for c, n in zip(*np.unique(at, return_counts=True), strict=True):
            count[c] += int(n)
        rows = np.flatnonzero(~w)
        if len(rows):
            m = np.frombuffer(b"".join([raw[i] for i in rows.tolist()]), "<i4").reshape(len(rows), -1)
            plain = np.zeros((k, m.shape[1]), np.int64) if plain is None else plain
            for c in np.unique(at[rows]):
                plain[c] += m[at[rows] == c].sum(0, dtype=np.int64)
        for i in np.flatnonzero(w).tolist():
            for j, x in enumerate(_unpack(raw[i], True)):
                wide[int(at[i]), j] = wide.get((int(at[i]), j), 0) + x
    if plain is not None:
        for c, j in zip(*np.nonzero(plain), strict=True):
            wide[int(c), int(j)] = wide.get((int(c), int(j)), 0) + int(plain[c, j])
    out = [(c, -1, 0, n) for c, n in enumerate(count) if n] + [(c, j, at, v) for (c, j), x in wide.items() for at, v in _limbs(x)]
    if out:
        c, j, at, v = zip(*out, strict=True)
        yield pa.record_batch([pa.array(c, pa.int32()), pa.array(j, pa.int32()), pa.array(at, pa.int32()), pa.array(v, pa.int64())], ["cluster", "component", "limb", "n"])


def _means(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids moved to their vectors' floored means."""
    k = len(centroids)
    rows = state.select("vector", "wide", "at").mapInArrow(lambda it: _sums(it, k), "cluster int, component int, limb int, n long")
    total: dict[tuple[int, int], int] = {}
    for r in rows.groupBy("cluster", "component", "limb").agg(F.sum("n").alias("n")).collect():  # bounded by centroids and components
        total[r.cluster, r.component] = total.get((r.cluster, r.component), 0) + (r.n << (LIMB * r.limb))
    return [[total.get((c, j), 0) // n for j in range(len(old))] if (n := total.get((c, -1), 0)) else old for c, old in enumerate(centroids)]


def _round(old: list[list[int]] | None, new: list[list[int]], near: int):
    """The batches' next state: scanned where there are no old centroids, else from the bounds kept."""
    steps = None if old is None else np.array([math.sqrt(s) if (s := sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) < 1 << 1023 else np.inf for x, y in zip(old, new, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                m = Measure(b.column("vector"), b.column("wide").to_numpy(zero_copy_only=False), new)
                if steps is None:
                    s, need = Bounds.scanned(m, b.num_rows, near), 0
                else:
                    table = lambda name, kind: np.array(b.column(name).to_pylist(), kind).reshape(b.num_rows, -1)  # noqa: B023, E731
                    s = Bounds(b.column("at").to_numpy().astype(np.int64), b.column("upper").to_numpy().copy(), table("who", np.int64), table("lower", np.float64), b.column("rest").to_numpy().copy())
                    s.moved(steps, near)
                    need = s.settle(m)
                lists = lambda x, kind: pa.array(list(x), kind)
                yield pa.record_batch(
                    [b.column("vec_id"), b.column("vector"), b.column("wide"), pa.array(s.at, pa.int32()), pa.array(s.upper), lists(s.who, pa.list_(pa.int32())), lists(s.lower, pa.list_(pa.float64())), pa.array(s.rest), pa.array(np.full(b.num_rows, need), pa.int32()), pa.array(np.full(b.num_rows, m.measured / max(b.num_rows, 1)))],
                    ["vec_id", "vector", "wide", "at", "upper", "who", "lower", "rest", "need", "measured"],
                )

    return run


def _final(centroids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                m = Measure(b.column("vector"), b.column("wide").to_numpy(zero_copy_only=False), centroids)
                at = b.column("at").to_numpy().astype(np.int64)
                d = [min(int(x), MOST) for x in m.some(np.arange(b.num_rows), at[:, None])[:, 0].tolist()]
                yield pa.record_batch([b.column("vec_id"), pa.array(at, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


class Clustering:
    """What cluster() found: centroids, and assigned (vec_id, cluster, distance). vectors measured per round: measured, as distances a vector."""

    def __init__(self, centroids: list[list[int]], assigned: DataFrame | None, measured: list[float]):
        self.centroids, self.assigned, self.measured = centroids, assigned, measured


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, size: int | None = SIZE, scale: float = SCALE, seed: int = SEED, vec_id: str = "vec_id", vector: str = "embedding") -> Clustering:
    """k-means of the rows' vectors: start centroids by hash, `rounds` rounds of assigning and moving, one more assignment.
    Its tables stay in the shared folder: the result is read from there."""
    spark = rows.sparkSession
    ship(spark)
    given = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    if size is None:
        first = given.where(F.size("vector") > 0).select(F.size("vector").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
        size = first.n if first else 1
    sound = given.mapInArrow(lambda it: integers(it, scale, size), "vec_id long, vector binary, wide boolean")
    at = fresh_path(spark, "clusters")
    sound.write.parquet(at)
    table = spark.read.parquet(at)
    start = table.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), "vector").limit(k).collect()
    centroids = [_unpack(bytes(r.vector), r.wide) for r in start]
    if not centroids:
        return Clustering([], None, [])
    near, old, measured = min(max(1, len(centroids) // 4), len(centroids) - 1), None, []
    for n in range(rounds + 1):
        step = fresh_path(spark, "clusters")
        table.mapInArrow(_round(old, centroids, near), f"{STATE}, need int, measured double").write.parquet(step)
        remove(spark, at)
        at, table = step, spark.read.parquet(step)
        told = table.agg(F.max("need").alias("need"), F.avg("measured").alias("measured")).first()
        measured.append(told.measured)
        if n < rounds:
            if old is not None:
                near = min(near, max(told.need, len(centroids) // 8, 1))
            old, centroids = centroids, _means(table, centroids)
    last = fresh_path(spark, "clusters")
    table.select("vec_id", "vector", "wide", "at").mapInArrow(_final(centroids), "vec_id long, cluster int, distance long").write.parquet(last)
    remove(spark, at)
    return Clustering(centroids, spark.read.parquet(last), measured)


def assess(rows: DataFrame, **how) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every sound row; how: as for cluster()."""
    spark = rows.sparkSession
    found = cluster(rows, **how)
    if found.assigned is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    sums = {r.cluster: int(r.s) for r in found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row a centroid
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    told = [(c, min(sums[c], MOST), min(sum(sums.values()), MOST), digest(found.centroids[c])) for c in sorted(sums)]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: float = SCALE, seed: int = SEED) -> str:
    """The same rows in SQL, each round by measuring every vector against every centroid."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
        a{n} as materialized (
            select row, k, d from (
                select v.row, c.k, v.s - 2 * list_dot_product(v.q, c.q) + list_dot_product(c.q, c.q) as d,
                       row_number() over (partition by v.row order by v.s - 2 * list_dot_product(v.q, c.q) + list_dot_product(c.q, c.q), c.k) as nth
                from v cross join c{n} c
            ) where nth = 1
        )""")
        if n < rounds:
            steps.append(f"""
        m{n} as (select k, list(m order by j) as q from (select a.k, e.j, floor(sum(e.x) / count(*)) as m from a{n} a join e on a.row = e.row group by a.k, e.j) group by k),
        c{n + 1} as materialized (select c.k, coalesce(m.q, c.q) as q from c{n} c left join m{n} m on c.k = m.k)""")
    return f"""
    with v as materialized (
        select *, list_dot_product(q, q) as s from (
            select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor({scale:g} * x::double)) as q
            from embeddings where len(embedding) = {size} and len(list_filter(embedding, lambda x: isfinite(x))) = {size}
        )
    ), e as materialized (select row, unnest(q) as x, generate_subscripts(q, 1) as j from v),
    c0 as materialized (
        select k, q from (select row_number() over (order by sha256(concat('{seed}:', cast(vec_id as varchar)))) - 1 as k, q from v) where k < {k}
    ), {",".join(steps)}
    select v.vec_id, cast(a.k as integer) as cluster, cast(a.d as bigint) as distance,
           cast(sum(a.d) over (partition by a.k) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia,
           sha256(array_to_string(list_transform(c.q, lambda x: cast(cast(x as bigint) as varchar)), ',')) as centroid_sha256
    from a{rounds} a join v on a.row = v.row join c{rounds} c on a.k = c.k
    """


SQL = sql()
