"""The evaluation of a prediction table from end to end.

One wide table holds every score of an item, made in one pass; item tables are its columns, summaries
its grouping sets, pair tables one aggregation by pair. The wide table is cut from its lineage once,
since all of them read it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinmark.functions import reliability as rel
from twinmark.functions import scorers
from twinmark.functions.text import nfc
from twinmark.operators import pairs as pr
from twinmark.operators import summaries as sm
from twinmark.operators.storage import cut
from twinmark.operators.validate import ConstraintError, check, where


def flat(predictions: DataFrame) -> DataFrame:
    """Texts composed, and metadata fields that metrics use as columns; a key that is there with null shows as None."""
    def shown(name: str):
        raw = F.map_contains_key("metadata_raw", F.lit(name)) if "metadata_raw" in predictions.columns else F.lit(False)
        return F.coalesce(F.col(f"metadata.{name}"), F.when(raw, "None"))

    predictions = nfc(predictions, "prediction", "reference_answer", "question")
    return predictions.withColumns({"category": shown("category"), "difficulty": shown("difficulty"), "is_answerable": F.col("metadata.is_answerable")})


def score(df: DataFrame, decisions: DataFrame | None = None, binary_decisions: DataFrame | None = None) -> DataFrame:
    """All scores, status, outcome and failure of each item. Decisions (item_id, decision) are joined;
    Spark broadcasts them only if they are small."""
    for name, d in (("decision", decisions), ("binary_decision", binary_decisions)):
        df = df.withColumn(name, F.lit(None).cast("int")) if d is None else df.join(d.select("item_id", F.col("decision").alias(name)), "item_id", "left")
    p, r, q = F.col("prediction"), F.col("reference_answer"), F.col("question")
    df = df.withColumns(
        {
            "exact_match": scorers.exact(p, r),
            "short_answer_match": F.when(F.col("task").isin("factual_knowledge", "reasoning"), scorers.short_answer(p, r)),
            "semantic_match": F.when(F.col("task") == "linguistic_understanding", scorers.semantic(p, r)),
            "instruction_match": F.when(F.col("task") == "instruction_following", scorers.instruction(p, r, F.col("category"))),
            "evaluator": scorers.evaluator(F.col("task"), F.col("category"), r),
            "correct": scorers.task_aware(F.col("task"), F.col("category"), p, r, q, F.col("decision"), F.col("binary_decision")),
            "status": rel.status(p),
        }
    )
    df = df.withColumn("outcome", rel.outcome(F.col("is_answerable"), F.col("status")))
    return df.withColumn("failure_type", rel.failure(F.col("outcome"), F.col("correct")))


def violations(scored: DataFrame) -> DataFrame:
    """What the evaluation can't go on with: tasks that no scorer takes, and decisions that are missing."""
    task = F.col("task")
    unknown = where(scored, "unsupported", (task != "unanswerable") & F.col("evaluator").isNull(), "item_id", task)
    missing = where(scored, "missing_decision", F.col("evaluator").isNotNull() & F.col("correct").isNull(), "item_id", F.coalesce("evaluator", F.lit("")))
    return unknown.unionByName(missing).unionByName(where(scored, "is_answerable", F.col("is_answerable").isNull(), "item_id"))


# Fixed names: the artifacts of a published bundle, by the tables and summaries that hold them.
PUBLISHED_TABLES = {
    "exact_match_results": "exact_match_results",
    "paired_capability_results": "exact_match_pairs",
    "abstention_results": "abstention_results",
    "paired_reliability_results": "reliability_pairs",
    "short_answer_results": "short_answer_results",
    "semantic_answer_results": "semantic_results",
    "task_aware_results": "capability_results",
    "paired_task_aware_results": "capability_pairs",
    "instruction_following_results": "instruction_results",
    "failure_analysis_results": "failure_results",
    "paired_failure_analysis_results": "failure_pairs",
}
PUBLISHED_SUMMARIES = {
    "capability_summary": ["exact_match_summary", "exact_match_gap"],
    "paired_capability_summary": ["exact_match_pair_summary"],
    "reliability_summary": ["reliability_summary", "reliability_gap"],
    "paired_reliability_summary": ["reliability_pair_summary"],
    "short_answer_summary": ["short_answer_summary"],
    "semantic_answer_summary": ["semantic_summary"],
    "task_aware_summary": ["capability_summary", "capability_gap"],
    "paired_task_aware_summary": ["capability_pair_summary"],
    "primary_capability_summary": ["capability_summary", "capability_gap"],
    "primary_paired_capability_summary": ["capability_pair_summary"],
    "instruction_following_summary": ["instruction_summary"],
    "failure_analysis_summary": ["failure_summary"],
    "paired_failure_analysis_summary": ["failure_pair_summary"],
}


@dataclass
class Evaluation:
    tables: dict[str, DataFrame]
    summaries: dict[str, DataFrame]
    more: dict[str, DataFrame]  # summaries that only the published bundle has

    def published(self) -> tuple[dict[str, DataFrame], dict[str, list[DataFrame]]]:
        """The bundle's 11 tables and 13 summaries under their published names."""
        held = self.summaries | self.more
        return {n: self.tables[t] for n, t in PUBLISHED_TABLES.items()}, {n: [held[x] for x in parts] for n, parts in PUBLISHED_SUMMARIES.items()}


def evaluate(predictions: DataFrame, decisions: DataFrame | None = None, binary_decisions: DataFrame | None = None, source: str = "en", target: str = "az") -> Evaluation:
    """Eleven row tables and thirteen summaries of a prediction table (see sources.readers.predictions). Pairs without
    one row a side are an error, and so is a pair whose scored rows lack a language, or gaps without rows of one."""
    if not predictions.take(1):
        raise ConstraintError("no predictions")
    df = cut(score(flat(predictions), decisions, binary_decisions))
    check(violations(df))
    order = "position" if "position" in df.columns else "item_id"  # of the files, where rows come from files
    base = ["item_id", "pair_id", "language", "task", "prediction", "reference_answer"]
    exact = pr.pair_up(df, ["item_id", "exact_match"], ["task"], source=source, target=target)
    check(where(exact, "pairs", ~pr.complete(exact), "pair_id"))
    right = lambda side, c: F.col(f"{side}.{c}") == 1
    exact_pairs = exact.select("pair_id", "task", F.col("source.item_id").alias("source_item_id"), F.col("target.item_id").alias("target_item_id"), F.col("source.exact_match").alias("source_exact_match"), F.col("target.exact_match").alias("target_exact_match"), rel.transition(right("source", "exact_match"), right("target", "exact_match")).alias("transition"))
    scored = df.where("correct is not null")
    aware = pr.pair_up(scored, ["correct"], ["task"], "last", order, source, target)
    check(where(aware, "scored_pairs", ~pr.complete(aware, exact=False), "pair_id"))
    aware = aware.select("pair_id", "task", F.col("source.correct").alias("source_correct"), F.col("target.correct").alias("target_correct"), rel.transition(right("source", "correct"), right("target", "correct")).alias("transition"))
    reliable = pr.pair_up(df, ["item_id", "outcome"], ["task", "is_answerable"], source=source, target=target)
    ok = lambda s: rel.reliable(F.col(f"{s}.outcome"))
    reliable = reliable.select("pair_id", "task", "is_answerable", F.col("source.outcome").alias("source_outcome"), F.col("target.outcome").alias("target_outcome"), rel.transition(ok("source"), ok("target"), "reliable").alias("transition"))
    fails = pr.pair_up(df, ["failure_type", "category", "difficulty"], ["task"], "first", order, source, target).where("n_source > 0 and n_target > 0")
    good = lambda s: F.col(f"{s}.failure_type") == "correct"
    fails = fails.select("pair_id", "task", F.col("source").alias("source_side"), F.col("target").alias("target_side"), pr.failure_transition(good("source"), good("target")).alias("transition"))
    dims = sm.STANDARD
    few = {k: dims[k] for k in ("overall", "language", "task")}
    accuracy = {"accuracy": F.avg("correct")}
    rel_gap = {n: c for n, c in zip(("decision_accuracy", "over_answering_rate", "under_answering_rate", "empty_response_rate"), (sm.reliability()[i] for i in (8, 10, 11, 12)), strict=True)}
    tables = {
        "exact_match_results": df.select(*base, "exact_match"),
        "short_answer_results": df.where("short_answer_match is not null").select(*base, "short_answer_match"),
        "semantic_results": df.where("semantic_match is not null").select(*base, "semantic_match"),
        "instruction_results": df.where("instruction_match is not null").select(*base, "instruction_match"),
        "capability_results": scored.select(*base, "evaluator", "correct"),
        "abstention_results": df.select(*base, "is_answerable", "status", "outcome"),
        "failure_results": df.select(*base, "outcome", "correct", "failure_type"),
        "exact_match_pairs": exact_pairs,
        "capability_pairs": aware,
        "reliability_pairs": reliable,
        "failure_pairs": fails,
    }
    summaries = {
        "exact_match_summary": sm.by_dimensions(df, dims, sm.capability("exact_match")),
        "short_answer_summary": sm.by_dimensions(df.where("short_answer_match is not null"), few, sm.capability("short_answer_match")),
        "semantic_summary": sm.by_dimensions(df.where("semantic_match is not null"), few, sm.capability("semantic_match")),
        "instruction_summary": sm.by_dimensions(df.where("instruction_match is not null"), few, sm.capability("instruction_match")),
        "capability_summary": sm.by_dimensions(scored, dims, sm.capability()),
        "capability_gap": sm.gap(scored, accuracy, source, target, required=scored.take(1) != []).withColumnsRenamed({"metric": "key"}).withColumn("dimension", F.lit("language_gap")),
        "status_summary": sm.by_dimensions(df, few, sm.statuses()),
        "reliability_summary": sm.by_dimensions(df, dims, sm.reliability()),
        "reliability_gap": sm.gap(df, rel_gap, source, target).withColumnsRenamed({"metric": "key"}).withColumn("dimension", F.lit("language_gap")),
        "exact_match_pair_summary": pr.transition_summary(exact_pairs),
        "capability_pair_summary": pr.transition_summary(aware),
        "reliability_pair_summary": pr.transition_summary(reliable, suffix="reliable"),
        "failure_summary": sm.by_dimensions(df, few, sm.failures()),
    }
    as_gap = lambda g: g.withColumnsRenamed({"metric": "key"}).withColumn("dimension", F.lit("language_gap"))
    more = {"exact_match_gap": as_gap(sm.gap(df, {"accuracy": F.avg("exact_match")}, source, target, required=True)), "failure_pair_summary": pr.failure_summary(fails)}
    return Evaluation(tables, summaries, more)
