"""Paired statistics: exact tests, step-down correction, agreement, power, bootstrap intervals.

Formulas of a few numbers are columns where SQL can say them. Power and the effects it finds are searched for all groups
of a table at once, in Arrow batches. Bootstrap draws come from a hash of (seed, replicate, draw), so that any engine can
repeat them; where pairs are many, draws are counted by the kinds of pairs there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinmark.operators import split


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs: doubled lower tail, at most 1. In logarithms,
    rounded at the twelfth digit."""
    n, k = b + c, F.least(b, c)
    log_choose = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k.cast("long")),
        F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct(
            F.when(i == 0, 0.0).otherwise(acc["log"] + F.log((n - i + 1).cast("double")) - F.log(F.greatest(i, F.lit(1)).cast("double"))).alias("log"),
            (acc["sum"] + F.exp(F.when(i == 0, 0.0).otherwise(acc["log"] + F.log((n - i + 1).cast("double")) - F.log(F.greatest(i, F.lit(1)).cast("double"))) - n * math.log(2))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return F.round(F.least(F.lit(1.0), log_choose * 2), 12)


def holm(df: DataFrame, p: str = "p_value", by: list[str] = (), order: str | None = None) -> DataFrame:
    """df with p_holm: step-down corrected within each group; ties keep the given order."""
    keys = [F.lit(0)] if not by else [F.col(c) for c in by]
    w = Window.partitionBy(*keys).orderBy(p, *([order] if order else []))
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rank = F.row_number().over(w)
    df = df.withColumn("_step", F.col(p) * (m - rank + 1))
    return df.withColumn("p_holm", F.least(F.lit(1.0), F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_step")


def kappa(df: DataFrame, a: str, b: str, by: list[str], chance_one: float | None = None, labels: list[str] | None = None) -> DataFrame:
    """Per group: n, agreements, raw agreement and Cohen's kappa. Only labels listed count, if any are.

    Where chance alone would agree always, kappa is chance_one (null unless given); null without rows."""
    if labels is not None:
        df = df.where(F.col(a).isin(*labels) & F.col(b).isin(*labels))
    shown, by = list(by), list(by) or ["_all"]
    df = df if shown else df.withColumn("_all", F.lit(0))
    cells = df.groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    none = F.lit(0).cast("long")
    hit = F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(none)
    side = lambda label, na, nb, agree: F.struct(label.alias("label"), na.alias("na"), nb.alias("nb"), agree.alias("agree"))
    each = F.explode(F.array(side(F.col("_a"), F.col("_n"), none, hit), side(F.col("_b"), none, F.col("_n"), none)))
    margin = cells.select(*by, each.alias("m")).groupBy(*by, "m.label").agg(*(F.sum(f"m.{c}").alias(c) for c in ("na", "nb", "agree")))
    both = margin.groupBy(*by).agg(F.sum("na").alias("n"), F.sum(F.col("na") * F.col("nb")).alias("same"), F.sum("agree").alias("agreements"))
    po, pe = F.col("agreements") / F.col("n"), F.col("same") / (F.col("n") * F.col("n"))
    k = F.when(F.abs(1 - pe) < 1e-12, F.lit(chance_one).cast("double")).otherwise(F.try_divide(po - pe, 1 - pe))
    return both.select(*shown, "n", "agreements", po.alias("raw_agreement"), k.alias("kappa"))


def paired_metrics(pairs: DataFrame) -> list[Column]:
    """Aggregates of base and adapted accuracy by language, overall, their gaps and the gaps' change."""
    m = {c: F.avg(c) for c in ("base_en", "base_az", "adapted_en", "adapted_az")}
    gap = {"base_gap": m["base_en"] - m["base_az"], "adapted_gap": m["adapted_en"] - m["adapted_az"]}
    over = {"base_overall": (F.sum("base_en") + F.sum("base_az")) / (2 * F.count(F.lit(1))), "adapted_overall": (F.sum("adapted_en") + F.sum("adapted_az")) / (2 * F.count(F.lit(1)))}
    return [v.alias(k) for k, v in (m | over | gap | {"gap_change": gap["adapted_gap"] - gap["base_gap"]}).items()]


def draw(seed: int, replicate: Column, at: Column, n: Column) -> Column:
    """A place from 1 to n for a replicate's draw: the first 32 bits of an MD5, modulo n."""
    digest = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), replicate.cast("string"), at.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n + 1


def bootstrap(pairs: DataFrame, metrics: list[Column], replicates: int = 10_000, seed: int = 17, alpha: float = 0.05, order: str = "pair_id", most: int = 100_000) -> DataFrame:
    """metric, low, high: percentile intervals of aggregates over pairs drawn with replacement.

    The draws are generated rows, replicates times pairs, and are summed by replicate on the map side. Up to
    `most` pairs travel to them as a broadcast, counted beforehand; beyond, draws and pairs meet by a shuffle."""
    n = pairs.count()
    if n == 0:
        raise ValueError("no pairs")
    places = split.numbered(pairs, [order], "_at")
    draws = pairs.sparkSession.range(replicates * n).select((F.expr(f"id div {n}") + 1).alias("replicate"), (F.col("id") % n + 1).alias("i"))
    draws = draws.select("replicate", draw(seed, F.col("replicate"), F.col("i"), F.lit(n)).alias("_at"))
    drawn = draws.join(F.broadcast(places) if n <= most else places, "_at").groupBy("replicate").agg(*metrics)
    return _intervals(drawn, replicates, alpha)


def _intervals(drawn: DataFrame, replicates: int, alpha: float) -> DataFrame:
    """metric, low, high of a table with one row a replicate."""
    names = [c for c in drawn.columns if c != "replicate"]
    low, high = int(alpha / 2 * replicates), int((1 - alpha / 2) * replicates) - 1
    long = drawn.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names))).alias("m")).select("m.*")
    ranked = long.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy("value")) - 1)
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("value")))
    return ranked.groupBy("metric").agg(at(low).alias("low"), at(high).alias("high"))


def bootstrap_by_kind(pairs: DataFrame, columns: list[str], metrics: list[Column], replicates: int = 10_000, seed: int = 17, alpha: float = 0.05, most: int = 4096) -> DataFrame:
    """metric, low, high, as bootstrap() gives them up to its random stream, at a cost that the number of pairs doesn't raise.

    Pairs with equal columns are one kind: a replicate is how often each kind is drawn, which is multinomial, so it takes a
    draw a kind, not a draw a pair. metrics: aggregates that depend on means of the columns only, as paired_metrics()
    are. At most `most` kinds (there are 16 of four marks); more are an error, and bootstrap() is the way then."""
    kinds = pairs.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).limit(most + 1).collect()
    if not kinds:
        raise ValueError("no pairs")
    if len(kinds) > most:
        raise ValueError(f"more than {most} kinds of pairs")
    kinds = sorted(kinds, key=lambda r: tuple(float(r[c]) for c in columns))
    n, share, value = sum(r["_n"] for r in kinds), np.array([r["_n"] for r in kinds], float), np.array([[float(r[c]) for c in columns] for r in kinds])
    share = share / share.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            times = np.array([np.random.Generator(np.random.Philox(key=[seed, int(i)])).multinomial(n, share) for i in ids]).reshape(len(ids), len(share))
            means = times @ value / n
            yield pa.record_batch([pa.array(ids), *(pa.array(means[:, j]) for j in range(len(columns)))], ["replicate", *columns])

    drawn = pairs.sparkSession.range(1, replicates + 1).mapInArrow(run, ", ".join(["replicate long", *(f"`{c}` double" for c in columns)]))
    return _intervals(drawn.groupBy("replicate").agg(*metrics), replicates, alpha)


def single_metrics() -> list[Column]:
    """One model's accuracy by language and the gap between them."""
    en, az = F.avg("base_en"), F.avg("base_az")
    return [en.alias("en_accuracy"), az.alias("az_accuracy"), (en - az).alias("en_az_gap")]


def _pmf(n: int, p: float) -> list[float]:
    if p in (0.0, 1.0):
        return [float(k == n * p) for k in range(n + 1)]
    lg = math.lgamma
    return [math.exp(lg(n + 1) - lg(k + 1) - lg(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(n + 1)]


def binomial_p(k: int, n: int) -> float:
    """Exact two-sided p of k out of n at a half: all outcomes that are no likelier."""
    fair = [math.comb(n, i) / 2**n for i in range(n + 1)]
    return min(1.0, sum(x for x in fair if x <= fair[k] + 1e-15))


def mcnemar_power(n: int, discordance: float, difference: float, alpha: float = 0.05) -> float:
    """Chance that the exact test rejects, for a true difference among n pairs."""
    if n <= 0 or not 0 < discordance <= 1 or not 0 <= difference <= discordance or not 0 < alpha < 1:
        raise ValueError("parameters out of range")
    share = (discordance + difference) / (2 * discordance)
    total = 0.0
    for m, chance in enumerate(_pmf(n, discordance)):
        if chance:
            hit = [k for k in range(m + 1) if _rejects(k, m, alpha)]
            if hit:
                split = _pmf(m, share)
                total += chance * sum(split[k] for k in hit)
    return total


_known: dict[tuple[int, float], int] = {}


def _rejects(k: int, m: int, alpha: float) -> bool:
    """Whether k of m rejects: from the largest tail that does, worked out once for each m."""
    if (m, alpha) not in _known:
        edge = -1
        while edge + 1 <= m // 2 and binomial_p(edge + 1, m) <= alpha:
            edge += 1
        _known[m, alpha] = edge
    return min(k, m - k) <= _known[m, alpha]


def minimum_detectable_effect(n: int, discordance: float, power: float = 0.8, alpha: float = 0.05) -> float:
    """The smallest difference that the test finds with the power, by bisection; fails if none does."""
    if not 0 < power < 1:
        raise ValueError("power must be between 0 and 1")
    if mcnemar_power(n, discordance, discordance, alpha) < power:
        raise ValueError("no difference reaches the power")
    low, high = 0.0, discordance
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if mcnemar_power(n, discordance, mid, alpha) >= power else (mid, high)
    return high


def binomial_test(k: Column, n: Column) -> Column:
    """binomial_p of columns: at a half, the outcomes that are no likelier are both tails."""
    return mcnemar(k, n - k)


class Power:
    """The exact test's power among n pairs of which a share is discordant, as a function of the true difference.

    Numbers of discordant pairs that are all but impossible (less than 1e-15 together) are left out, so about the square root of n
    of them count; of each, the largest tail that rejects is found once, from the cumulated binomial."""

    def __init__(self, n: int, discordance: float, alpha: float):
        if n <= 0 or not 0 < discordance <= 1 or not 0 < alpha < 1:
            raise ValueError("parameters out of range")
        self.discordance = discordance
        self.log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])  # logarithms of factorials
        m = np.arange(n + 1)
        chance = np.exp(self._logs(np.array([n]), m, discordance)[0])
        order = np.argsort(chance)
        some = np.sort(order[np.cumsum(chance[order]) >= 1e-15])
        self.m, self.chance, edge = some, chance[some], []
        for x in some.tolist():
            tail = 2 * np.cumsum(np.exp(self._logs(np.array([x]), np.arange(x // 2 + 1), 0.5)[0]))
            if x % 2 == 0:
                tail[-1] = 1.0  # the middle is in both tails
            edge.append(int(np.searchsorted(tail, alpha + 1e-15, side="right")) - 1)
        self.edge = np.array(edge)

    def _logs(self, m: np.ndarray, k: np.ndarray, p: float) -> np.ndarray:
        """Logarithm of the chance of k among m, for each m and k."""
        with np.errstate(divide="ignore", invalid="ignore"):
            left = m[:, None] - k[None, :]
            ways = self.log[m][:, None] - self.log[k][None, :] - self.log[np.maximum(left, 0)]
            out = ways + np.where(k > 0, k * np.log(p), 0.0)[None, :] + np.where(left > 0, left * np.log1p(-p), 0.0)
        return np.where(left >= 0, out, -np.inf)

    def __call__(self, difference: float) -> float:
        share, total = (self.discordance + difference) / (2 * self.discordance), 0.0
        for at in range(0, len(self.m), 256):
            m, edge, chance = self.m[at : at + 256], self.edge[at : at + 256], self.chance[at : at + 256]
            if (top := edge.max(initial=-1)) < 0:
                continue
            k = np.arange(top + 1)
            inside = k[None, :] <= edge[:, None]
            for p in (share, 1 - share):  # few of the one kind, or few of the other
                total += float((chance[:, None] * np.where(inside, np.exp(self._logs(m, k, min(max(p, 0.0), 1.0))), 0.0)).sum())
        return total

    def least_difference(self, power: float) -> float | None:
        """The smallest difference found with the power, by bisection; None if none is."""
        if self(self.discordance) < power:
            return None
        low, high = 0.0, self.discordance
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if self(mid) >= power else (mid, high)
        return high


def power_of(n: Column, discordant: Column, difference: Column, alpha: float = 0.05) -> Column:
    """Power of the exact test for groups of n pairs, of which so many are discordant, and a true difference; null without discordant pairs."""

    @F.pandas_udf("double")
    def power(n: pd.Series, discordant: pd.Series, difference: pd.Series) -> pd.Series:
        return pd.Series([Power(int(a), b / a, alpha)(d) if a and b and d <= b / a else None for a, b, d in zip(n, discordant, difference, strict=True)], dtype="float64")

    return power(n.cast("long"), discordant.cast("long"), difference.cast("double"))


def effect_of(n: Column, discordant: Column, power: float = 0.8, alpha: float = 0.05) -> Column:
    """The smallest difference that the exact test finds with the power in groups of n pairs, of which so many are discordant; null
    where none does."""
    if not 0 < power < 1:
        raise ValueError("power must be between 0 and 1")

    @F.pandas_udf("double")
    def effect(n: pd.Series, discordant: pd.Series) -> pd.Series:
        return pd.Series([Power(int(a), b / a, alpha).least_difference(power) if a and b else None for a, b in zip(n, discordant, strict=True)], dtype="float64")

    return effect(n.cast("long"), discordant.cast("long"))
