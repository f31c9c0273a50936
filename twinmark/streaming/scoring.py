"""The scorers on streams: stateless columns, and pairs that wait for their other side under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinmark.plans.evaluate import score


def score_stream(predictions: DataFrame) -> DataFrame:
    """Scores of a stream of flat prediction rows; no state is kept."""
    return score(predictions)


def pair_stream(scored: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "1 hour", source: str = "en", target: str = "az") -> DataFrame:
    """pair_id with both sides' scores, for pairs whose sides arrive within a window; state is dropped
    when the watermark passes the window."""
    side = lambda lang: F.max(F.when(F.col("language") == lang, F.col("correct")))
    both = scored.withWatermark(ts, late).groupBy(F.window(ts, window), "pair_id").agg(side(source).alias("source_correct"), side(target).alias("target_correct"))
    return both.where("source_correct is not null and target_correct is not null")
