"""Exact top-k search by distributed histogram selection.

Everything is scored, three times over. Round one counts, for each query, scores in coarse bins;
the global counts say which bin holds the kth highest score. Round two counts single scores inside
that bin and so finds the kth score itself. Round three keeps what scores at least that much; of
those that tie with the kth, each partition gives its smallest ids only, since no other can be
among the k. Ranks come from one window over at most k + k per partition rows a query.

A partition reports, for each query, its highest bins down to where its own count reaches k: the
global kth is never below a partition's own. So what is shuffled is bounded by k, the number of
queries and of partitions, also where a third of all vectors are equal. Queries travel in blocks
of a fixed number, held by the executors while the whole table passes by in bounded batches.

Scores are integers, exact for every finite vector: components are floor(scale * x), products are taken in
doubles where those are exact, else in 64-bit integers, else in integers of any length; a score beyond 64
bits counts as the largest or smallest one. Vectors that are null, or hold nulls or non-finite components,
take no part, neither do pairs of different lengths. A row is never its own candidate, but every other
row is, whatever its id: rows that repeat are queries and candidates each, so rows of one id give their
ranks as often as there are rows. Null ids take no part. Columns other than vec_id and the vector aren't
read. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinmark.llm.common import cut, ship

K, SCALE, BLOCK, ROWS = 5, 256.0, 8192, 4096
NONE, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def vectors(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, integers) of the batch's sound rows, for each length of vector. Integers are doubles,
    or Python's own where one is beyond those."""
    col = batch.column("vector")
    col = col.cast(pa.large_list(pa.float64()))
    ids = batch.column("vec_id")
    ends = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    size = np.diff(ends)
    sound = col.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy()
    for n in np.unique(size[sound]):
        rows = np.flatnonzero(sound & (size == n))
        raw = flat[ends[rows][:, None] + np.arange(n)]
        ok = np.isfinite(raw).all(1)
        if n and ok.any():
            raw = raw[ok]
            with np.errstate(over="ignore"):
                m = np.floor(raw * scale)
            if not np.isfinite(m).all():
                m = np.array([[math.floor(Fraction(x) * Fraction(scale)) for x in r] for r in raw.tolist()], object)
            yield ids[rows[ok]], raw, m


def products(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of integers, as 64-bit integers."""
    top = lambda x: max((abs(int(v)) for v in (x.max(initial=0), x.min(initial=0))), default=0)
    bound = top(m) * top(q) * m.shape[1]
    if bound < 2**53:
        kind = np.float32 if bound < 2**24 else np.float64
        return (m.astype(kind) @ q.astype(kind).T).astype(np.int64)
    if bound < 2**63 and max(top(m), top(q)) < 2**63:
        return m.astype(np.int64) @ q.astype(np.int64).T
    whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object)
    s = whole(m) @ whole(q).T
    return np.array([[min(max(v, -MOST), MOST) for v in r] for r in s.tolist()], np.int64).reshape(s.shape)


class Queries:
    """One block of queries, numbered: ids, how many rows each stands for, and by length of vector the
    numbers, vectors and integers."""

    def __init__(self, rows: pa.Table, scale: float):
        self.ids: list[int] = []
        self.copies: list[int] = []
        self.own: list[int] = []  # a query's score with its like
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rows = rows.combine_chunks()
        for batch in rows.to_batches():
            held = dict(zip(batch.column("at").to_pylist(), batch.column("n").to_pylist(), strict=True))
            named = pa.record_batch([batch.column("at"), batch.column("vector")], ["vec_id", "vector"])
            ids = dict(zip(batch.column("at").to_pylist(), batch.column("vec_id").to_pylist(), strict=True))
            for at, raw, m in vectors(named, scale):
                first = len(self.ids)
                self.ids += [ids[x] for x in at.tolist()]
                self.copies += [held[x] for x in at.tolist()]
                self.own += [int(products(x[None, :], x[None, :])[0, 0]) for x in m]
                number = np.arange(first, len(self.ids))
                if (old := self.by_length.get(m.shape[1])) is not None:
                    number, raw, m = (np.concatenate(x) for x in zip(old, (number, raw, m), strict=True))
                self.by_length[m.shape[1]] = number, raw, m

    def scores(self, batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query numbers, candidate ids, scores with NONE for the query itself and its like), ROWS candidates at a time."""
        every = np.array(self.ids, np.int64)
        for ids, raw, m in vectors(batch, scale):
            if (q := self.by_length.get(m.shape[1])) is None:
                continue
            for at in range(0, len(ids), ROWS):
                s = products(m[at : at + ROWS], q[2])
                i = ids[at : at + ROWS]
                r, c = np.nonzero(i[:, None] == every[q[0]][None, :])
                like = (raw[at + r] == q[1][c]).all(1)
                s[r[like], c[like]] = NONE
                yield q[0], i, s

    def like(self, k: int) -> list[tuple[int, int, int, int]]:
        """Of queries that stand for several rows: number, id, score, and how many like it are its candidates."""
        return [(q, self.ids[q], self.own[q], min(n - 1, k)) for q, n in enumerate(self.copies) if n > 1]


def _kept_bins(bins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a (rows, queries) array of bins with NONE for nothing, per query the highest bins down to a count of k."""
    rows = min(k, bins.shape[0])
    least = np.partition(bins, bins.shape[0] - rows, axis=0)[bins.shape[0] - rows]
    col, val, n = [], [], []
    for j in range(bins.shape[1]):
        b = bins[:, j]
        u, c = np.unique(b[b >= least[j]], return_counts=True)
        ok = u != NONE
        col.append(np.full(ok.sum(), j))
        val.append(u[ok])
        n.append(c[ok])
    return np.concatenate(col), np.concatenate(val), np.concatenate(n)


def _histogram(held, k: int, scale: float, width: int):
    """Counts of score bins; held: (queries, (lowest, highest) bounds of wanted scores by query number or None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, within = held.value
        sums: dict[int, dict[int, int]] = {}
        for b in batches:
            for numbers, _, s in queries.scores(b, scale):
                if within is not None:
                    s[(s < within[0][numbers]) | (s > within[1][numbers])] = NONE
                for j, v, n in zip(*(x.tolist() for x in _kept_bins(np.where(s == NONE, NONE, s // width), k)), strict=True):
                    own = sums.setdefault(int(numbers[j]), {})
                    own[v] = own.get(v, 0) + n
        out = []
        for q, own in sums.items():
            count = 0
            for v in sorted(own, reverse=True):
                out.append((q, v, own[v]))
                count += own[v]
                if count >= k:
                    break
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query", "bin", "n"])

    return run


def _kth_bins(rows: DataFrame, need: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Per query of the block: the bin that holds its kth score, and how many lie above it."""
    w = Window.partitionBy("query").orderBy(F.desc("bin"))
    counts = rows.groupBy("query", "bin").agg(F.sum("n").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(w))
    want = F.lit(max(need.values(), default=0))
    if len(set(need.values())) > 1:
        table = rows.sparkSession.createDataFrame(list(need.items()), "query long, need long")
        upto, want = upto.join(F.broadcast(table), "query"), F.col("need")  # at most a block of queries
    found = upto.where(F.col("upto") - F.col("n") < want).groupBy("query").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("above")), "bin").alias("at"))
    return {r["query"]: (r["at"]["bin"], r["at"]["above"]) for r in found.collect()}  # one row a query of the block


def _select(held, k: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, kth = held.value
        best: dict[int, list[tuple[int, int]]] = {}
        for b in batches:
            for numbers, ids, s in queries.scores(b, scale):
                r, c = np.nonzero((s >= kth[numbers]) & (s != NONE))
                got = pd.DataFrame({"q": numbers[c], "s": s[r, c], "v": ids[r]}).sort_values(["q", "s", "v"], ascending=[True, False, True])
                for q, sc, v in got.groupby("q", sort=False).head(k).itertuples(index=False):
                    best.setdefault(q, []).append((-sc, v))
                for q in set(got["q"]):
                    best[q] = sorted(best[q])[:k]
        out = [(q, v, -s) for q, own in best.items() for s, v in own]
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["query", "vec_id", "score"])

    return run


def search(rows: DataFrame, is_query, vector: str = "embedding", k: int = K, scale: float = SCALE, block: int = BLOCK, width: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest of each query, ties to smaller ids.

    is_query: a column expression over rows (vec_id and the vector). block: queries that travel at
    once; memory on driver and executors is bounded by it. width: of round one's bins.
    """
    spark = rows.sparkSession
    ship(spark)
    table = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    parts: DataFrame | None = None
    asked = table.where(is_query).where("vec_id is not null and vector is not null").groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("n"))
    for queries in _blocks(asked.withColumn("h", F.xxhash64("vector")), block, scale):
        like, some = queries.like(k), range(len(queries.ids))
        more = lambda values, names: spark.createDataFrame(values, ", ".join(f"{x} long" for x in names))

        def counted(held, width: int, within=None):
            found = table.mapInArrow(_histogram(held, k, scale, width), "query long, bin long, n long")
            own = [(q, s // width, n) for q, _, s, n in like if within is None or within[0][q] <= s <= within[1][q]]
            return found.unionByName(more(own, ("query", "bin", "n"))) if own else found

        sent = [spark.sparkContext.broadcast((queries, None))]
        coarse = _kth_bins(counted(sent[0], width), dict.fromkeys(some, k))
        # without any candidate no score is wanted
        low = np.array([max(coarse[q][0] * width, -MOST) if q in coarse else MOST for q in some], np.int64)
        high = np.array([min(coarse[q][0] * width + width - 1, MOST) if q in coarse else -MOST for q in some], np.int64)
        sent.append(spark.sparkContext.broadcast((queries, (low, high))))
        need = {q: k - above for q, (_, above) in coarse.items()}
        fine = _kth_bins(counted(sent[1], 1, (low, high)), need)
        sent.append(spark.sparkContext.broadcast((queries, np.array([fine[q][0] if q in fine else MOST for q in some], np.int64))))
        own = table.mapInArrow(_select(sent[2], k, scale), "query long, vec_id long, score long")
        if like:
            own = own.unionByName(more([(q, i, s) for q, i, s, n in like for _ in range(n)], ("query", "vec_id", "score")))
        w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        best = own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        names = more([(q, i, n) for q, (i, n) in enumerate(zip(queries.ids, queries.copies, strict=True))], ("query", "query_id", "copies"))
        best = best.join(F.broadcast(names), "query")  # at most a block of queries
        best = cut(best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", "rank", "vec_id", "score"))
        parts = best if parts is None else parts.unionByName(best)  # k rows a query, so many blocks stay light
        for b in sent:
            b.unpersist()
    if parts is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return parts


def _blocks(asked: DataFrame, block: int, scale: float) -> Iterator[Queries]:
    """The different queries in order of id and vector, `block` at a time."""
    rest = asked
    while True:
        got = rest.orderBy("vec_id", "h").limit(block).toArrow()
        if not got.num_rows:
            return
        queries = Queries(got.append_column("at", pa.array(range(got.num_rows), pa.int64())), scale)
        if queries.ids:
            yield queries
        low, h = got.column("vec_id")[-1].as_py(), got.column("h")[-1].as_py()
        rest = asked.where((F.col("vec_id") > low) | (F.col("vec_id") == low) & (F.col("h") > h))
