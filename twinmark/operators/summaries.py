"""Grouped metrics: every dimension of a summary in one pass over the rows, by grouping sets.

A summary is a tidy table (dimension, key, metrics...); sinks nest it.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinmark.functions.reliability import FAILURES, OUTCOMES, STATUSES

MISSING = "__missing__"


def by_dimensions(df: DataFrame, dimensions: dict[str, list[str]], metrics: list[Column]) -> DataFrame:
    """One row for each key of each dimension (a list of columns; none for the overall row)."""
    columns = list(dict.fromkeys(c for d in dimensions.values() for c in d))
    if not columns:
        return df.agg(*metrics).select(F.lit("overall").alias("dimension"), F.lit("all").alias("key"), "*")
    shown = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in columns})
    grouped = shown.groupingSets([[F.col(c) for c in d] for d in dimensions.values()], *columns)
    bit = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    out = grouped.agg(F.grouping_id().alias("_set"), *metrics)
    name, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d, cols in dimensions.items():
        own = functools.reduce(operator.or_, (bit[c] for c in columns if c not in cols), 0)
        name = F.when(F.col("_set") == own, d).otherwise(name)
        key = F.when(F.col("_set") == own, F.concat_ws("|", *cols) if cols else F.lit("all")).otherwise(key)
    return out.select(name.alias("dimension"), key.alias("key"), *(c for c in out.columns if c not in {*columns, "_set"}))


STANDARD = {"overall": [], "language": ["language"], "task": ["task"], "category": ["category"], "difficulty": ["difficulty"], "language_task": ["language", "task"]}


def capability(score: str = "correct") -> list[Column]:
    s, n = F.col(score), F.count(score)
    return [n.alias("total"), F.sum(s).cast("long").alias("correct_count"), (n - F.sum(s)).cast("long").alias("incorrect_count"), F.try_divide(F.sum(s), n).alias("accuracy")]


def gap(df: DataFrame, metrics: dict[str, Column], source: str = "en", target: str = "az", required: bool = False) -> DataFrame:
    """metric, source, target and their difference; where a language has no rows null, or an error if required.

    metrics: aggregates over one language's rows."""
    sides = df.where(F.col("language").isin(source, target)).groupBy("language").agg(*(m.alias(n) for n, m in metrics.items()))
    if required and (lacking := {source, target} - {r.language for r in sides.select("language").collect()}):  # two rows at most
        raise ValueError(f"no rows of language {', '.join(sorted(lacking))}")
    long = sides.select("language", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in metrics))).alias("m")).select("language", "m.*")
    side = lambda lang: F.max(F.when(F.col("language") == lang, F.col("value")))
    return long.groupBy("metric").agg(side(source).alias("source"), side(target).alias("target"), (side(source) - side(target)).alias("gap"))


def statuses(column: str = "status") -> list[Column]:
    n = F.count(F.lit(1))
    c = lambda s: F.count_if(F.col(column) == s)
    return [n.alias("total"), *(c(s).alias(s) for s in STATUSES), *(F.try_divide(c(s), n).alias(f"{s}_rate") for s in STATUSES)]


def reliability(outcome: str = "outcome", answerable: str = "is_answerable") -> list[Column]:
    """Counts of outcomes and their rates; a rate without rows to divide by is 0."""
    n = F.count(F.lit(1))
    c = {o: F.count_if(F.col(outcome) == o) for o in OUTCOMES}
    yes, no = F.count_if(F.col(answerable)), F.count_if(~F.col(answerable))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    right = rate(c["correct_answer"] + c["correct_abstention"], n)
    return [
        n.alias("total"),
        yes.alias("answerable_total"),
        no.alias("unanswerable_total"),
        *(v.alias(o) for o, v in c.items()),
        right.alias("decision_accuracy"),
        right.alias("abstention_accuracy"),
        rate(c["over_answering"], no).alias("over_answering_rate"),
        rate(c["under_answering"], yes).alias("under_answering_rate"),
        rate(c["empty_response"], n).alias("empty_response_rate"),
    ]


def failures(column: str = "failure_type") -> list[Column]:
    n = F.count(F.lit(1))
    return [n.alias("total"), *(F.count_if(F.col(column) == f).alias(f) for f in FAILURES), F.try_divide(F.count_if(F.col(column) != "correct"), n).alias("failure_rate")]


def counts(df: DataFrame, dimensions: dict[str, list[str]], distinct: str | None = None) -> DataFrame:
    """How many rows (and distinct values of a column) each key of each dimension has."""
    more = [F.count_distinct(distinct).alias(f"distinct_{distinct}")] if distinct else []
    return by_dimensions(df, dimensions, [F.count(F.lit(1)).alias("total"), *more])


def status_counts(df: DataFrame, status: str, allowed: list[str], key: str) -> DataFrame:
    """How many rows have each status; an error if one isn't allowed."""
    from twinmark.operators.validate import allowed as rule
    from twinmark.operators.validate import check

    check(rule(df, key, status, allowed))
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("total"))


def seed_spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample standard deviation over seeds; a single seed has none."""
    return df.groupBy(*by).agg(F.count(value).alias("n_seeds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
