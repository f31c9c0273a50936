"""Whether a model answered or abstained, whether it should have, and what went wrong."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinmark.functions.text import normalize_response, strip

# Phrases by which an answer abstains.
ABSTENTIONS = (
    "i don't know",
    "i do not know",
    "i'm not sure",
    "i am not sure",
    "i cannot determine",
    "i can't determine",
    "i cannot answer",
    "i can't answer",
    "i cannot calculate",
    "i can't calculate",
    "we cannot determine",
    "we can't determine",
    "we cannot calculate",
    "we can't calculate",
    "cannot be determined",
    "cannot be calculated",
    "insufficient information",
    "not enough information",
    "there is not enough information",
    "the information provided is insufficient",
    "without knowing",
    "without additional information",
    "without more information",
    "bilmirəm",
    "əmin deyiləm",
    "müəyyən edə bilmirəm",
    "müəyyən etmək mümkün deyil",
    "hesablamaq mümkün deyil",
    "cavab verə bilmirəm",
    "kifayət qədər məlumat yoxdur",
    "yetərli məlumat yoxdur",
    "verilən məlumat kifayət deyil",
    "məlumat çatışmır",
    "məlum olmadığı üçün",
)
STATUSES = ("empty", "answered", "abstained")
OUTCOMES = ("correct_answer", "correct_abstention", "over_answering", "under_answering", "empty_response")
FAILURES = ("correct", "capability_failure", "over_answering", "under_answering", "empty_response")


def abstains(response: Column) -> Column:
    return F.rlike(normalize_response(response), F.lit(rf"(?U)\b(?:{'|'.join(ABSTENTIONS)})\b"))


def status(prediction: Column) -> Column:
    return F.when(strip(prediction) == "", "empty").when(abstains(prediction), "abstained").otherwise("answered")


def outcome(is_answerable: Column, response_status: Column) -> Column:
    answered = response_status == "answered"
    return (
        F.when(response_status == "empty", "empty_response")
        .when(is_answerable, F.when(answered, "correct_answer").otherwise("under_answering"))
        .otherwise(F.when(answered, "over_answering").otherwise("correct_abstention"))
    )


def reliable(outcome_: Column) -> Column:
    return outcome_.isin("correct_answer", "correct_abstention")


def failure(outcome_: Column, score: Column) -> Column:
    """What went wrong, the outcome's fault first; a right abstention without a score is correct."""
    return F.when(outcome_.isin("over_answering", "under_answering", "empty_response"), outcome_).when(score == 0, "capability_failure").otherwise("correct")


def transition(source: Column, target: Column, suffix: str = "correct") -> Column:
    """Of two booleans: both, source_only, target_only or neither (as labels with the suffix)."""
    return F.when(source & target, f"both_{suffix}").when(source, f"source_only_{suffix}").when(target, f"target_only_{suffix}").otherwise(f"both_in{suffix}" if suffix == "correct" else f"both_un{suffix}")
