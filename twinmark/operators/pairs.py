"""Putting an item's two language versions side by side: one conditional aggregation, no self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE, TARGET = "en", "az"


def _side(language: str, values: list[str], order: str | None, last: bool) -> Column:
    row = F.when(F.col("language") == language, F.struct(*values))
    if order is None:
        return F.max(row)
    pick = F.max_by if last else F.min_by
    return pick(row, F.when(F.col("language") == language, F.col(order)))


def pair_up(df: DataFrame, values: list[str], keep: list[str] = (), duplicates: str = "error", order: str | None = None, source: str = SOURCE, target: str = TARGET) -> DataFrame:
    """pair_id, the structs source and target of values, n_source, n_target, and the columns kept,
    which must agree in the pair: n_<column> counts their values.

    duplicates: "error" leaves it to complete() to judge; "last" and "first" take one row a side by order.
    """
    by = df.where(F.col("language").isin(source, target)).groupBy("pair_id")
    if duplicates == "error":
        one = lambda lang: _side(lang, values, None, True)
    else:
        one = lambda lang: _side(lang, values, order, duplicates == "last")
    return by.agg(
        one(source).alias("source"),
        one(target).alias("target"),
        F.count_if(F.col("language") == source).alias("n_source"),
        F.count_if(F.col("language") == target).alias("n_target"),
        *(F.min(c).alias(c) for c in keep),
        *(F.min(c).eqNullSafe(F.max(c)).alias(f"same_{c}") for c in keep),
    )


def complete(pairs: DataFrame, exact: bool = True) -> Column:
    """Whether a pair has both sides (exactly one row each if exact) and its kept columns agree."""
    there = (F.col("n_source") == 1) & (F.col("n_target") == 1) if exact else (F.col("n_source") >= 1) & (F.col("n_target") >= 1)
    for c in pairs.columns:
        if c.startswith("same_"):
            there = there & F.col(c)
    return there


def transition_summary(pairs: DataFrame, column: str = "transition", suffix: str = "correct", by: list[str] = ()) -> DataFrame:
    """Counts of the four transitions and their rates; null rates without pairs."""
    none = f"both_in{suffix}" if suffix == "correct" else f"both_un{suffix}"
    labels = [f"both_{suffix}", f"source_only_{suffix}", f"target_only_{suffix}", none]
    n = lambda x: F.count_if(F.col(column) == x)
    total = F.count(F.lit(1))
    return pairs.groupBy(*by).agg(
        total.alias("total_pairs"),
        *(n(x).alias(x) for x in labels),
        F.try_divide(n(labels[1]), total).alias("degradation_rate"),
        F.try_divide(n(labels[2]), total).alias("recovery_rate"),
        F.try_divide(n(labels[0]) + n(none), total).alias("consistency_rate"),
    )


def failure_transition(source: Column, target: Column) -> Column:
    return F.when(source & target, "preserved_behavior").when(source, "language_degradation").when(target, "language_recovery").otherwise("shared_failure")


def failure_summary(pairs: DataFrame, by: list[str] = (), column: str = "transition") -> DataFrame:
    labels = ["preserved_behavior", "language_degradation", "language_recovery", "shared_failure"]
    rates = ["behavior_preservation_rate", "degradation_rate", "recovery_rate", "shared_failure_rate"]
    n = lambda x: F.count_if(F.col(column) == x)
    total = F.count(F.lit(1))
    return pairs.groupBy(*by).agg(total.alias("total_pairs"), *(n(x).alias(x) for x in labels), *(F.try_divide(n(x), total).alias(r) for x, r in zip(labels, rates, strict=True)))


def compare_models(base: DataFrame, adapted: DataFrame, source: str = SOURCE, target: str = TARGET) -> DataFrame:
    """pair_id, base_en, base_az, adapted_en, adapted_az of items that both models answered, one row a
    pair; n_unmatched counts items that one model lacks or that disagree in pair or language."""
    a = base.select("item_id", F.col("pair_id").alias("a_pair"), F.col("language").alias("a_lang"), F.col("correct").alias("base"))
    b = adapted.select("item_id", F.col("pair_id").alias("b_pair"), F.col("language").alias("b_lang"), F.col("correct").alias("adapted"))
    both = a.join(b, "item_id", "full")
    agree = F.col("a_pair").eqNullSafe(F.col("b_pair")) & F.col("a_lang").eqNullSafe(F.col("b_lang"))
    pick = lambda c, lang: F.max(F.when(F.col("a_lang") == lang, F.col(c))).alias(f"{c}_{lang}")
    return both.groupBy(F.coalesce("a_pair", "b_pair").alias("pair_id")).agg(pick("base", source), pick("base", target), pick("adapted", source), pick("adapted", target), F.count_if(~agree).alias("n_unmatched"))


def approved_pairs(df: DataFrame, status: str = "review_status", approved: str = "approved") -> DataFrame:
    """All rows of pairs whose every row is approved; a null status rejects its pair."""
    good = df.groupBy("pair_id").agg(F.min(F.coalesce(F.col(status) == approved, F.lit(False))).alias("ok")).where("ok").drop("ok")
    return df.join(good, "pair_id", "left_semi")


def with_status(df: DataFrame, value: str, status: str = "review_status") -> DataFrame:
    """The rows of one review status."""
    return df.where(F.col(status) == value)


def set_status(df: DataFrame, key: str, value, status: str, new: str) -> DataFrame:
    """The status of the rows whose key has the value (all rows if it is None) set to new; fails if there is none."""
    hit = F.lit(True) if value is None else F.col(key) == value
    if not df.where(hit).take(1):
        raise ValueError(f"no row with {key} = {value!r}")
    return df.withColumn(status, F.when(hit, new).otherwise(F.col(status)))


def promote(reviewed: DataFrame, rules: DataFrame, languages: tuple[str, str] = (SOURCE, TARGET)) -> DataFrame:
    """Pairs whose every row is approved, once nothing is against them: there are some, ids are unique, each
    pair has one row a language and one task, every task has rules and its rows keep them."""
    from twinmark.operators import validate as va

    good = approved_pairs(reviewed)
    if not good.take(1):
        raise va.ConstraintError("no approved records")
    va.check(va.every(va.unique(good, "item_id"), va.unique(good, "pair_id", "language"), va.complete_pairs(good, list(languages)), va.one_per_pair(good, "task"), va.known(good, "item_id", "task", rules.select("task")), va.metadata_rules(good, rules)))
    return good
