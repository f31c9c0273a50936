"""Constraints as queries: each gives rows (rule, key, detail) of what breaks it; check() raises on any."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """Some rows break a rule; the message shows the first ones."""


def check(violations: DataFrame, show: int = 5) -> None:
    """Raise if there is any violation; only the first few reach the driver."""
    if rows := violations.limit(show).collect():
        raise ConstraintError("; ".join(f"{r.rule}: {r.key} ({r.detail})" for r in rows))


def _out(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def where(df: DataFrame, rule: str, broken: Column, key: str, detail: Column | None = None) -> DataFrame:
    """Rows where broken is true; null counts as broken."""
    return _out(df.where(F.coalesce(broken, F.lit(True))), rule, F.col(key), detail if detail is not None else F.lit(""))


def every(*violations: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, violations)


def not_blank(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One pass over the rows for all columns."""
    bad = F.array_compact(F.array(*(F.when(F.coalesce(F.regexp_replace(F.col(c), r"(?U)\s", "") == "", F.lit(True)), F.lit(c)) for c in columns)))
    return _out(df.withColumn("_bad", F.explode(bad)), "not_blank", F.col(key), F.col("_bad"))


def allowed(df: DataFrame, key: str, column: str, values: list) -> DataFrame:
    return where(df, f"allowed_{column}", ~F.col(column).isin(*values), key, F.coalesce(F.col(column).cast("string"), F.lit("null")))


def unique(df: DataFrame, *columns: str) -> DataFrame:
    many = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return _out(many, "unique_" + "_".join(columns), F.concat_ws("|", *columns), F.col("_n"))


def complete_pairs(df: DataFrame, languages: list[str]) -> DataFrame:
    have = F.array_sort(F.collect_set("language"))
    odd = df.groupBy("pair_id").agg(have.alias("_have")).where(F.col("_have") != F.array(*map(F.lit, sorted(languages))))
    return _out(odd, "complete_pairs", F.col("pair_id"), F.array_join("_have", ","))


def one_per_pair(df: DataFrame, column: str) -> DataFrame:
    """Pairs in which a column has more than one value."""
    odd = df.groupBy("pair_id").agg(F.min(column).alias("_a"), F.max(column).alias("_b")).where("_a <> _b")
    return _out(odd, f"one_{column}_per_pair", F.col("pair_id"), F.concat_ws(",", "_a", "_b"))


def known(df: DataFrame, key: str, column: str, values: DataFrame) -> DataFrame:
    """Rows whose value isn't in a table's first column."""
    ref = values.select(F.col(values.columns[0]).alias(column)).distinct()
    return _out(df.join(ref, column, "left_anti"), f"known_{column}", F.col(key), F.col(column))


def metadata_rules(df: DataFrame, rules: DataFrame, key: str = "item_id") -> DataFrame:
    """Rows that break their task's rules (task, required, categories, difficulties: arrays, null: free)."""
    both = df.join(rules, "task", "left")
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    breaks = F.array_compact(
        F.array(
            F.when(F.array_contains("required", "category") & blank("category"), "required:category"),
            F.when(F.array_contains("required", "difficulty") & blank("difficulty"), "required:difficulty"),
            F.when(~F.array_contains("categories", F.col("category")), F.concat(F.lit("category:"), "category")),
            F.when(~F.array_contains("difficulties", F.col("difficulty")), F.concat(F.lit("difficulty:"), "difficulty")),
        )
    )
    return _out(both.withColumn("_bad", F.explode(breaks)), "metadata_rules", F.col(key), F.col("_bad"))


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two tables has."""
    a = _out(left.join(right, key, "left_anti"), "aligned", F.col(key), F.lit("left_only"))
    b = _out(right.join(left, key, "left_anti"), "aligned", F.col(key), F.lit("right_only"))
    return a.unionByName(b)


def split_integrity(split: DataFrame, source: DataFrame, names: tuple[str, ...] = ("train", "dev", "test"), key: str = "item_id") -> DataFrame:
    """Unknown split names, pairs in several splits, repeated ids, ids lost or added."""
    return every(allowed(split, key, "split", list(names)), one_per_pair(split, "split"), unique(split, key), aligned(split.select(key), source.select(key), key))


def benchmark(df: DataFrame, languages: list[str], tasks: list[str], texts: bool = True) -> DataFrame:
    """All rules of a benchmark table at once."""
    columns = ["item_id", "pair_id", *(("question", "reference_answer") if texts else ())]
    return every(not_blank(df, "item_id", *columns), allowed(df, "item_id", "language", languages), allowed(df, "item_id", "task", tasks), unique(df, "item_id"), unique(df, "pair_id", "language"), complete_pairs(df, languages), one_per_pair(df, "task"))


def by_file(df: DataFrame, languages: list[str], tasks: list[str], file: str = "file") -> DataFrame:
    """The benchmark rules within each candidate file, keys prefixed by it: pairs and ids are a file's own."""
    own = df.withColumns({"item_id": F.concat_ws(":", file, "item_id"), "pair_id": F.concat_ws(":", file, "pair_id")})
    blank = not_blank(df, "item_id", "item_id", "pair_id")
    return every(blank, *(f for f in (allowed(own, "item_id", "language", languages), allowed(own, "item_id", "task", tasks), unique(own, "item_id"), unique(own, "pair_id", "language"), complete_pairs(own, languages), one_per_pair(own, "task"))))


def different(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    return where(df, f"{a}_differs_from_{b}", F.col(a) == F.col(b), key)


def word_limits(df: DataFrame, key: str, column: str, low: int, high: int) -> DataFrame:
    from twinmark.functions.text import word_count

    n = word_count(F.col(column))
    return where(df, f"words_{column}", ~n.between(low, high), key, n)


def exact_counts(df: DataFrame, column: str, wanted: dict[str, int]) -> DataFrame:
    """Values that don't occur as often as wanted, those not wanted at all included."""
    want = df.sparkSession.createDataFrame(list(wanted.items()), "_value string, _wanted long")
    have = df.groupBy(F.col(column).cast("string").alias("_value")).agg(F.count(F.lit(1)).alias("_have"))
    both = have.join(want, "_value", "full").where("coalesce(_have, 0) <> coalesce(_wanted, 0)")
    return _out(both, f"exact_counts_{column}", F.col("_value"), F.concat_ws(" of ", F.coalesce("_have", F.lit(0)), F.coalesce("_wanted", F.lit(0))))


def adaptation(df: DataFrame, language: str, categories: dict[str, list[str]], most_instruction: int | None = None, most_response: int | None = None) -> DataFrame:
    """All rules of an adaptation table (item_id, language, category, instruction, response, source, and the
    metadata columns subcategory, generation_status, review_status): fields, category and subcategory,
    word limits, fresh statuses; ids, instructions and instruction-response pairs are unique once
    normalised. categories: subcategories by category."""
    from twinmark.functions.text import normalize_answer

    subs = [x for c, s in categories.items() for x in (F.lit(c), F.array(*map(F.lit, s)))]
    found = [
        not_blank(df, "item_id", "item_id", "language", "category", "instruction", "response", "source"),
        allowed(df, "item_id", "language", [language]),
        allowed(df, "item_id", "category", list(categories)),
        allowed(df, "item_id", "generation_status", ["generated"]),
        allowed(df, "item_id", "review_status", ["pending"]),
        where(df, "subcategory", ~F.array_contains(F.create_map(*subs)[F.col("category")], F.col("subcategory")), "item_id", F.coalesce("subcategory", F.lit("null"))),
        unique(df, "item_id"),
    ]
    norm = df.select("item_id", normalize_answer(F.col("instruction")).alias("instruction_text"), normalize_answer(F.col("response")).alias("response_text"))
    found += [unique(norm, "instruction_text"), unique(norm, "instruction_text", "response_text")]
    found += [word_limits(df, "item_id", c, 0, n) for c, n in (("instruction", most_instruction), ("response", most_response)) if n is not None]
    return every(*found)


def design(config: dict) -> list[str]:
    """What is wrong with a benchmark design: totals of tasks, categories, difficulties and splits, and
    whether tasks say if they are answerable. Driver-side: a design is a small document."""
    wrong, tasks = [], config.get("tasks", {})
    total = config.get("total_pairs", 0)
    if sum(t.get("pairs", 0) for t in tasks.values()) != total:
        wrong.append("tasks don't sum to total_pairs")
    for name, t in tasks.items():
        if (c := t.get("categories")) and sum(c.values()) != t.get("pairs", 0):
            wrong.append(f"categories of {name} don't sum to its pairs")
        if not isinstance(t.get("is_answerable"), bool):
            wrong.append(f"{name} doesn't say whether it is answerable")
    if abs(sum(config.get("difficulty", {}).values()) - 1) > 1e-9:
        wrong.append("difficulty doesn't sum to 1")
    if config.get("total_records", total * 2) != total * 2:
        wrong.append("total_records isn't two a pair")
    if (s := config.get("splits")) and sum(s.values()) != total:
        wrong.append("splits don't sum to total_pairs")
    return wrong
