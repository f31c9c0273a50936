"""Answer scorers: pure functions of columns, 1 for right, 0 for wrong, null for not scored.

Scorers take texts as they are and normalise them; expressions that repeat are shared by the
optimiser within one projection, or bound where functions of array elements use them. Texts are composed
(text.nfc) before they are scored, see plans.evaluate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinmark.functions.text import bound, match_tokens, normalize_answer, strip

# Endings that an Azerbaijani answer may carry after the reference word.
SUFFIXES = (
    "n a ə ya yə ı i u ü nı ni nu nü da də nda ndə dan dən ndan ndən ın in un ün nın nin nun nün la lə yla ylə "
    "lar lər dır dir dur dür tır tir tur tür ların lərin larda lərdə lardan lərdən ları ləri "
    "ında ində unda ündə ından indən undan ündən"
).split()
# Phrases accepted for a reference, and phrases that contradict.
ALIASES = {
    "came to or achieved": ("came to", "achieved", "come to", "reached", "came to a conclusion", "come to a conclusion"),
    "razılıq əldə etdilər": ("razılığa gəldilər", "razılıq əldə etdilər", "razılığa nail oldular"),
}
CONTRADICTIONS = ("became angry", "means angry", "anger")
POSITIVE, NEGATIVE = ("yes", "bəli"), ("no", "xeyr")
ADJUDICATED = ("contextual_meaning", "lexical_disambiguation", "discourse_understanding")
STRICT = ("transformation", "format_following", "constraint_following", "multi_step_instruction")


def _word(*words: str) -> str:
    return rf"(?U)\b(?:{'|'.join(words)})\b"


def exact(prediction: Column, reference: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(reference)).cast("int")


def inflected(reference: Column, word: Column) -> Column:
    """Whether a word is the reference word, or it with an accepted ending."""
    ending = F.substring(word, F.length(reference) + 1, F.length(word))
    return (word == reference) | ((F.length(reference) >= 3) & F.startswith(word, reference) & ending.isin(*SUFFIXES))


def contains_sequence(prediction: Column, reference: Column) -> Column:
    """Whether the reference's tokens stand in a row in the prediction, each bare or inflected. Both normalised.
    Texts are cut into tokens once, so the work is in proportion to the tokens of both."""

    def there(t: Column) -> Column:
        p, r = t["p"], t["r"]
        n = F.size(r)
        starts = F.sequence(F.lit(0), F.size(p) - n)
        hit = F.exists(starts, lambda i: F.forall(F.sequence(F.lit(0), n - 1), lambda j: inflected(F.get(r, j), F.get(p, i + j))))
        return F.when((n > 0) & (F.size(p) >= n), hit).otherwise(False)

    return bound(F.struct(match_tokens(prediction).alias("p"), match_tokens(reference).alias("r")), there)


def contradicts(prediction: Column, reference: Column) -> Column:
    """Whether the reference is given and then taken back: a word of doubt after its first place. Both normalised."""
    doubt = F.lit(_word("but", "however", "actually"))
    at = F.regexp_instr(prediction, F.concat(F.lit(r"(?U)\b\Q"), reference, F.lit(r"\E\b")))
    after = F.substring(prediction, at + F.length(reference), F.length(prediction))
    return F.when((reference != "") & F.rlike(prediction, doubt), (at > 0) & F.rlike(after, doubt)).otherwise(False)


def short_answer(prediction: Column, reference: Column) -> Column:
    def score(t: Column) -> Column:
        p, r = t["p"], t["r"]
        return F.when(p == r, 1).when(r == "", 0).when(contradicts(p, r), 0).when(contains_sequence(p, r), 1).otherwise(0)

    return bound(F.struct(normalize_answer(prediction).alias("p"), normalize_answer(reference).alias("r")), score)


def options(question: Column) -> Column:
    """The two options a question quotes last, if it quotes three spans or more; else empty."""
    spans = F.transform(F.regexp_extract_all(question, F.lit("'([^']+)'"), F.lit(1)), lambda s: F.regexp_replace(strip(s), r"\.+$", ""))
    return F.when(F.size(spans) >= 3, F.slice(spans, -2, 2)).otherwise(F.array().cast("array<string>"))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether a normalised phrase stands in a normalised text as whole words."""
    return (phrase != "") & (F.instr(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" "))) > 0)


def option(prediction: Column, reference: Column, question: Column) -> Column:
    p, r = normalize_answer(prediction), normalize_answer(reference)
    rivals = F.filter(F.transform(options(question), normalize_answer), lambda o: o != r)
    rival = F.when(F.size(rivals) == 1, contains_phrase(p, F.get(rivals, 0))).otherwise(False)
    return (contains_phrase(p, r) & ~rival).cast("int")


def is_binary(reference: Column) -> Column:
    return normalize_answer(reference).isin(*POSITIVE, *NEGATIVE)


def reference_polarity(reference: Column) -> Column:
    n = normalize_answer(reference)
    return F.when(n.isin(*POSITIVE), "positive").when(n.isin(*NEGATIVE), "negative")


def stated_polarity(prediction: Column) -> Column:
    """The polarity that a prediction states; null for none or both."""
    n = normalize_answer(prediction)
    yes, no = F.rlike(n, F.lit(_word(*POSITIVE))), F.rlike(n, F.lit(_word(*NEGATIVE)))
    return F.when(yes & ~no, "positive").when(no & ~yes, "negative")


def binary(prediction: Column, reference: Column, decision: Column | None = None) -> Column:
    """By stated polarity, else by a human decision; null if one is needed and missing."""
    own = (stated_polarity(prediction) == reference_polarity(reference)).cast("int")
    return F.coalesce(own, decision) if decision is not None else own


def instruction(prediction: Column, reference: Column, category: Column) -> Column:
    p, r = normalize_answer(prediction), normalize_answer(reference)
    ok = F.when(category == "extraction", F.contains(p, r)).when(category.isin(*STRICT), strip(prediction) == strip(reference)).otherwise(p == r)
    return ok.cast("int")


def semantic(prediction: Column, reference: Column) -> Column:
    p, r = normalize_answer(prediction), normalize_answer(reference)
    known = F.lit(False)
    for ref, phrases in ALIASES.items():
        hit = F.lit(False)
        for x in phrases:
            hit = hit | F.contains(p, normalize_answer(F.lit(x)))
        known = known | ((r == normalize_answer(F.lit(ref))) & hit)
    return F.when(p == r, 1).when(F.rlike(p, F.lit(_word(*CONTRADICTIONS))), 0).when(known, 1).otherwise(0)


def needs_decision(task: Column, category: Column) -> Column:
    return (task == "linguistic_understanding") & F.coalesce(category.isin(*ADJUDICATED), F.lit(False))


def evaluator(task: Column, category: Column, reference: Column) -> Column:
    """Which scorer the task asks for; null for unanswerable and for what no scorer takes."""
    return (
        F.when(task.isin("factual_knowledge", "reasoning"), F.when(is_binary(reference), "binary_answer").otherwise("short_answer"))
        .when((task == "linguistic_understanding") & (category == "reference_resolution"), "short_answer")
        .when((task == "linguistic_understanding") & (category == "paraphrase_understanding"), "option_match")
        .when(needs_decision(task, category), "semantic_adjudication")
        .when(task == "instruction_following", "instruction_following")
    )


def task_aware(task: Column, category: Column, prediction: Column, reference: Column, question: Column, decision: Column | None = None, binary_decision: Column | None = None) -> Column:
    """The score by the task's own scorer; null where evaluator() is, or where a needed decision is missing."""
    which = evaluator(task, category, reference)
    return (
        F.when(which == "binary_answer", binary(prediction, reference, binary_decision))
        .when(which == "short_answer", short_answer(prediction, reference))
        .when(which == "option_match", option(prediction, reference, question))
        .when(which == "semantic_adjudication", decision if decision is not None else F.lit(None).cast("int"))
        .when(which == "instruction_following", instruction(prediction, reference, category))
    )
