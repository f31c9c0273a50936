"""Quotas: what is asked for, what banks can give, and which entry each request gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinmark.operators.split import expand, numbered


def quota_violations(quotas: DataFrame, totals: DataFrame, total: int) -> DataFrame:
    """rule, key, detail where quotas (language, task, count) don't add up to the languages' totals (language, count) or
    those to the whole, where a language has no total or no quota, or a count is negative."""
    out = lambda df, rule, key, detail: df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))
    by = quotas.groupBy("language").agg(F.sum("count").alias("asked"))
    both = by.join(totals.select("language", F.col("count").alias("total")), "language", "full")
    told = lambda a, b: F.concat_ws(" of ", a.cast("string"), b.cast("string"))
    whole = quotas.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("asked"))
    parts = [
        out(both.where("total is null"), "language_not_declared", F.col("language"), F.col("asked")),
        out(both.where("total is not null and coalesce(asked, 0) <> total"), "language_quota", F.col("language"), told(F.coalesce("asked", F.lit(0)), F.col("total"))),
        out(whole.where(F.col("asked") != total), "total_quota", F.lit("all"), told(F.col("asked"), F.lit(total))),
        out(quotas.where("count < 0"), "negative_quota", F.concat_ws("|", "language", "task"), F.col("count")),
    ]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df


def candidates(quotas: DataFrame, order: list[str], prefix: str) -> DataFrame:
    """One row for each record that quotas (language, task, count) ask for: language, task, task_index from 1 within its quota,
    and item_id, numbered through all quotas in the given order with four digits or as many as it takes."""
    rows = expand(quotas.withColumn("count", F.col("count").cast("int"))).withColumnRenamed("index", "task_index")
    rows = numbered(rows, [*order, "task_index"], "_at")
    return rows.select(F.concat(F.lit(prefix), F.format_string("%04d", F.col("_at"))).alias("item_id"), "language", "task", "task_index")


def overflow(groups: DataFrame, order: str, lane: str | None = None) -> DataFrame:
    """groups (asked, capacity in the given order, within each lane) with taken: what the group's bank gives, and over: what moves on to the
    next group after it. As in a queue: over is the sum of asked less capacity so far, less the least that it has been. One row a group, so the
    windows are short."""
    w = Window.partitionBy(*([lane] if lane else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*([lane] if lane else [])).orderBy(order)
    df = groups.withColumn("_net", F.sum(F.col("asked") - F.col("capacity")).over(w))
    df = df.withColumn("over", F.col("_net") - F.least(F.lit(0), F.min("_net").over(w)))
    waiting = F.coalesce(F.lag("over").over(before), F.lit(0))
    return df.withColumn("taken", F.col("asked") + waiting - F.col("over")).drop("_net")


def unused(bank: DataFrame, key: Column, order: str, used: DataFrame | None = None, used_key: Column | None = None) -> DataFrame:
    """The bank's rows with texts of their own: the first row of each key in the given order, without keys that rows used before have."""
    rows = bank.withColumn("_key", F.md5(key))
    first = rows.groupBy("_key").agg(F.min_by(F.struct(*bank.columns), order).alias("_row"))
    if used is not None:
        first = first.join(used.select(F.md5(used_key).alias("_key")), "_key", "left_anti")
    return first.select("_row.*")


def assign(demand: DataFrame, bank: DataFrame, order: str, item: str) -> tuple[DataFrame, DataFrame]:
    """(filled, short): demand (group, asked) met from a bank (group, item, ...), groups in the given order of `group`.

    A bank's entries go in order of `item`; what a group lacks moves on to the next ones. Requests and entries are numbered by
    prefix sums, in ranges, and the nth request gets the nth entry that is taken. filled: group asked for, index within it, and the
    entry with its own group as from_group; short: what no later group could give, one row if there is any."""
    sizes = bank.groupBy(order).agg(F.count(F.lit(1)).alias("capacity"))
    groups = demand.select(order, F.col("asked").cast("long").alias("asked")).join(sizes, order, "full").select(order, F.coalesce("asked", F.lit(0)).alias("asked"), F.coalesce("capacity", F.lit(0)).alias("capacity"))
    told = overflow(groups, order)
    requests = numbered(expand(told.select(order, F.col("asked").cast("int").alias("count"))).select(order, "index"), [order, "index"], "_nth")
    placed = numbered(bank, [item], "_place", [order])
    entries = placed.join(told.select(order, "taken"), order).where(F.col("_place") <= F.col("taken"))
    entries = numbered(entries.drop("taken", "_place"), [order, item], "_nth").withColumnRenamed(order, f"from_{order}")
    last = told.orderBy(F.desc(order)).limit(1).where("over > 0").select(F.col("over").alias("short"))
    return requests.join(entries, "_nth").drop("_nth"), last
