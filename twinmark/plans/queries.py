"""Every query of the core engine by name, with its SQL twin.

Queries run over the driver's tables in the shapes of views.py; where those hold nothing to show (word
endings, abstentions, contradictions), rows of our own stand in both the query and the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinmark.functions import reliability as rel
from twinmark.functions import scorers as sc
from twinmark.functions import text as tx
from twinmark.operators import adjudicate as ad
from twinmark.operators import build, overlap, split, stats
from twinmark.operators import pairs as pr
from twinmark.operators import summaries as sm
from twinmark.operators import validate as va
from twinmark.plans.infer import infer
from twinmark.plans.views import OUTCOME, PAIRS, PRED, label_sql, norm_sql, predictions, transition_sql
from twinmark.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple]) -> str:
    def show(v) -> str:
        if v is None:
            return "null"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "(values " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


# -- scorers ---------------------------------------------------------------------------------------------

_GAP = """select metric, source, target, source - target as gap from (
    select '{0}' as metric, {1} filter (where language = 'en') as source, {1} filter (where language = 'az') as target from {2})"""


COMPOSED = [("c1", "en", "go\u0308l", "göl", 1), ("c2", "az", "GU\u0308L.", "gül", 1), ("c3", "en", "s\u0327əhər", "şəhər", 1), ("c4", "az", "gol", "göl", 0), ("c5", "az", "\u212b", "å", 1)]


@query(f"with {PRED}, s as (select language, cast({norm_sql('prediction')} = {norm_sql('reference_answer')} as integer) as hit from pred union all select language, hit from {_values([(r[1], r[4]) for r in COMPOSED])} as v(language, hit)) " + _GAP.format("accuracy", "avg(hit)", "s"))
def exact_match_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["language", "prediction", "reference_answer"]
    own = _literal(spark, [r[1:4] for r in COMPOSED], ", ".join(f"{c} string" for c in names))
    df = tx.nfc(predictions(spark, sf_dir).select(*names).unionByName(own), "prediction", "reference_answer")
    return sm.gap(df.withColumn("hit", sc.exact(F.col("prediction"), F.col("reference_answer"))), {"accuracy": F.avg("hit")})


SHORT = [
    ("exact", "Seven.", "seven", 1),
    ("prefix", "nothing", "not", 0),
    ("suffix", "Gəncədə", "Gəncə", 1),
    ("fraction", "12", "1/2", 1),
    ("taken back", "Rome, but it may be Milan", "Rome", 0),
    ("both empty", "", "", 1),
    ("empty reference", "x", "", 0),
    ("two words", "It is New Yorkda now", "New York", 1),
    ("gap in words", "New old York", "New York", 0),
    ("unknown ending", "Gəncəqqq", "Gəncə", 0),
    ("plural", "kitabların", "kitab", 1),
    ("regex signs", "a+b (c)", "a+b (c)", 1),
    ("however", "Rome however Milan", "rome", 0),
    ("spaces", "  Yes!  It is\t", "yes it is", 1),
    ("decomposed", "Go\u0308ldə", "göl", 1),
    ("doubt before", "But it is Rome", "Rome", 1),
    ("doubt between", "Rome, no, actually Rome", "Rome", 0),
    ("other digits", "it is ٤٢ now", "٤٢", 1),
]
_SUFFIXES = ", ".join(f"'{s}'" for s in sc.SUFFIXES)
_TOKENS = "regexp_extract_all({}, '\\p{{Nd}}+(?:/\\p{{Nd}}+)?|[a-zəğıöşüç]+')"


@query(
    f"""with {PRED}, n as (select item_id, {norm_sql('prediction')} as p, {norm_sql('reference_answer')} as r from pred),
    t as (select *, {_TOKENS.format('p')} as pt, {_TOKENS.format('r')} as rt from n),
    s as (select item_id, case when p = r then 1 when r = '' then 0
        when regexp_matches(p, '\\b' || regexp_escape(r) || '\\b.*\\b(but|however|actually)\\b', 's') then 0
        when len(rt) > 0 and len(pt) >= len(rt) and list_bool_or(list_transform(range(0, len(pt) - len(rt) + 1), lambda i:
            list_bool_and(list_transform(range(1, len(rt) + 1), lambda j: pt[i + j] = rt[j] or (len(rt[j]) >= 3 and starts_with(pt[i + j], rt[j])
                and substr(pt[i + j], len(rt[j]) + 1) in ({_SUFFIXES})))))) then 1 else 0 end as score from t)
    select item_id, score from s union all select id, score from {_values([(a, d) for a, _, _, d in SHORT])} as v(id, score)"""
)
def short_answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).select("item_id", "prediction", "reference_answer")
    own = _literal(spark, [r[:3] for r in SHORT], "item_id string, prediction string, reference_answer string")
    return tx.nfc(rows.unionByName(own), "prediction", "reference_answer").select("item_id", sc.short_answer(F.col("prediction"), F.col("reference_answer")).alias("score"))


OPTION = [
    ("both named", "Both 'x' and: 'red one.' or 'blue one'?", "red one, blue one", "red one", 0),
    ("right one", "Both 'x' and: 'red one.' or 'blue one'?", "the red one", "red one", 1),
    ("unparseable", "Which?", "the red one", "red one", 1),
    ("missing", "Which?", "blue", "red one", 0),
]


@query(
    f"""with {PRED}, n as (select item_id, {norm_sql('prediction')} as p, {norm_sql('reference_answer')} as r,
        list_filter(list_transform(regexp_extract_all(question, '''([^'']+)''', 1)[-2:], lambda o: {norm_sql("regexp_replace(trim(o), '\\.+$', '')")}), lambda o: true) as o,
        len(regexp_extract_all(question, '''([^'']+)''', 1)) as quoted from pred),
    v as (select *, list_filter(o, lambda x: x <> r) as rivals from n)
    select item_id, cast(r <> '' and contains(' ' || p || ' ', ' ' || r || ' ')
        and not (quoted >= 3 and len(rivals) = 1 and rivals[1] <> '' and contains(' ' || p || ' ', ' ' || rivals[1] || ' ')) as integer) as score from v
    union all select id, score from {_values([(r[0], r[4]) for r in OPTION])} as v(id, score)"""
)
def option_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).select("item_id", "question", "prediction", "reference_answer")
    own = _literal(spark, [r[:4] for r in OPTION], "item_id string, question string, prediction string, reference_answer string")
    return rows.unionByName(own).select("item_id", sc.option(F.col("prediction"), F.col("reference_answer"), F.col("question")).alias("score"))


BINARY = [("both", "yes and no", "Yes", None), ("polarity", "Xeyr", "No", 1), ("wrong", "No, never", "Bəli", 0), ("right", "bəli.", "yes", 1), ("none", "maybe", "no", None), ("inside", "nobody knows", "No", None)]


def _says(words: tuple[str, ...]) -> str:
    return f"regexp_matches(' ' || {norm_sql('prediction')} || ' ', '[^\\pL\\pN_](" + "|".join(words) + ")[^\\pL\\pN_]')"


@query(
    f"""with {PRED}, s as (select item_id, ord, {_says(sc.POSITIVE)} as yes, {_says(sc.NEGATIVE)} as no from pred)
    select item_id, case when yes = no then null when yes = (ord % 4 < 2) then 1 else 0 end as score from s
    union all select id, score from {_values([(a, d) for a, _, _, d in BINARY])} as v(id, score)"""
)
def binary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).select("item_id", F.col("prediction").alias("p"), F.when(F.col("ord") % 4 < 2, "Yes").otherwise("Xeyr").alias("r"))
    own = _literal(spark, [r[:3] for r in BINARY], "item_id string, p string, r string")
    return rows.unionByName(own).select("item_id", sc.binary(F.col("p"), F.col("r")).alias("score"))


INSTRUCTION = [("extraction", "nobody", "no", "extraction", 1), ("strict", "red ", "red", "format_following", 1), ("case", "Red", "red", "format_following", 0), ("plain", "Red.", "red", "other", 1), ("no category", "Red", "red", None, 1)]


@query(
    f"""with {PRED} select item_id, cast(case when category = 'extraction' then contains({norm_sql('prediction')}, {norm_sql('reference_answer')})
        when category in ('transformation', 'format_following', 'constraint_following', 'multi_step_instruction')
            then regexp_replace(prediction, '^\\s+|\\s+$', '', 'g') = regexp_replace(reference_answer, '^\\s+|\\s+$', '', 'g')
        else {norm_sql('prediction')} = {norm_sql('reference_answer')} end as integer) as score from pred
    union all select id, score from {_values([(r[0], r[4]) for r in INSTRUCTION])} as v(id, score)"""
)
def instruction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).select("item_id", "prediction", "reference_answer", "category")
    own = _literal(spark, [r[:4] for r in INSTRUCTION], "item_id string, prediction string, reference_answer string, category string")
    return rows.unionByName(own).select("item_id", sc.instruction(F.col("prediction"), F.col("reference_answer"), F.col("category")).alias("score"))


SEMANTIC = [("same", "Came to or achieved", "came to or achieved", 1), ("alias", "They reached it", "came to or achieved", 1), ("anger", "reached anger", "came to or achieved", 0), ("other", "left", "came to or achieved", 0), ("az", "onlar razılığa gəldilər", "razılıq əldə etdilər", 1)]


_GOAL = "came to or achieved"
_NAMES = " or ".join(f"contains(p, '{x}')" for x in sc.ALIASES[_GOAL])


@query(
    f"""with {PRED}, n as (select item_id, {norm_sql('prediction')} as p from pred)
    select item_id, case when p = '{_GOAL}' then 1 when regexp_matches(' ' || p || ' ', '[^\\pL\\pN_]({'|'.join(sc.CONTRADICTIONS)})[^\\pL\\pN_]') then 0 when {_NAMES} then 1 else 0 end as score from n
    union all select id, score from {_values([(a, d) for a, _, _, d in SEMANTIC])} as v(id, score)"""
)
def semantic_alias_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).select("item_id", F.col("prediction").alias("p"), F.lit(_GOAL).alias("r"))
    own = _literal(spark, [r[:3] for r in SEMANTIC], "item_id string, p string, r string")
    return rows.unionByName(own).select("item_id", sc.semantic(F.col("p"), F.col("r")).alias("score"))


@query(
    f"""with {PRED}, e as (select *, case
        when task in ('factual_knowledge', 'reasoning') then case when {norm_sql('reference_answer')} in ('yes', 'bəli', 'no', 'xeyr') then 'binary_answer' else 'short_answer' end
        when task = 'linguistic_understanding' and category = 'reference_resolution' then 'short_answer'
        when task = 'linguistic_understanding' and category = 'paraphrase_understanding' then 'option_match'
        when task = 'linguistic_understanding' and category in ('contextual_meaning', 'lexical_disambiguation', 'discourse_understanding') then 'semantic_adjudication'
        when task = 'instruction_following' then 'instruction_following' end as evaluator from pred)
    select task, category, coalesce(evaluator, 'none') as evaluator, count(*) as n from e group by all"""
)
def task_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = sc.evaluator(F.col("task"), F.col("category"), F.col("reference_answer"))
    return predictions(spark, sf_dir).withColumn("evaluator", F.coalesce(which, F.lit("none"))).groupBy("task", "category", "evaluator").agg(F.count(F.lit(1)).alias("n"))


# -- reliability -----------------------------------------------------------------------------------------

STATUS = [("blank", "", "empty"), ("white", "  \n", "empty"), ("en", "I don't know.", "abstained"), ("az", "Bilmirəm", "abstained"), ("plain", "Four", "answered"), ("curly", "I don’t know", "answered"), ("inside", "withoutknowing it", "answered"), ("long", "Well,  WITHOUT more\ninformation no", "abstained")]


@query(
    f"""with {PRED} select item_id, case when trim(prediction) = '' then 'empty' else 'answered' end as status from pred
    union all select id, status from {_values([(a, c) for a, _, c in STATUS])} as v(id, status)"""
)
def response_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).select("item_id", "prediction")
    own = _literal(spark, [r[:2] for r in STATUS], "item_id string, prediction string")
    return rows.unionByName(own).select("item_id", rel.status(F.col("prediction")).alias("status"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predictions(spark, sf_dir)
    df = df.withColumn("outcome", rel.outcome(F.col("is_answerable"), F.col("status")))
    return df.withColumn("failure_type", rel.failure(F.col("outcome"), F.when(F.col("is_answerable"), F.col("correct"))))


_OUT = f"out as (select *, {OUTCOME} as outcome from pred)"


@query(f"with {PRED}, {_OUT} select outcome, count(*) as n, cast(count(*) filter (where is_answerable) as bigint) as answerable from out group by outcome")
def abstention_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_answerable").alias("answerable"))


_DIMS = {"overall": [], "language": ["language"], "task": ["task"], "category": ["category"], "difficulty": ["difficulty"], "language_task": ["language", "task"]}


def _sets(metrics: str, source: str, dims: dict[str, list[str]] = _DIMS) -> str:
    """A tidy summary in SQL: one select for each dimension."""
    key = lambda c: "'all'" if not c else " || '|' || ".join(f"coalesce(cast({x} as varchar), '__missing__')" for x in c)
    return " union all ".join(f"select '{d}' as dimension, {key(c)} as key, {metrics} from {source}" + (f" group by {key(c)}" if c else "") for d, c in dims.items())


_REL = ", ".join(
    ["count(*) as total", "count(*) filter (where is_answerable) as answerable_total", "count(*) filter (where not is_answerable) as unanswerable_total"]
    + [f"count(*) filter (where outcome = '{o}') as {o}" for o in rel.OUTCOMES]
    + [
        "count(*) filter (where outcome in ('correct_answer', 'correct_abstention')) / count(*) as decision_accuracy",
        "count(*) filter (where outcome in ('correct_answer', 'correct_abstention')) / count(*) as abstention_accuracy",
        "coalesce(count(*) filter (where outcome = 'over_answering') / nullif(count(*) filter (where not is_answerable), 0), 0.0) as over_answering_rate",
        "coalesce(count(*) filter (where outcome = 'under_answering') / nullif(count(*) filter (where is_answerable), 0), 0.0) as under_answering_rate",
        "count(*) filter (where outcome = 'empty_response') / count(*) as empty_response_rate",
    ]
)


@query(f"with {PRED}, {_OUT} {_sets(_REL, 'out')}")
def reliability_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.by_dimensions(_outcomes(spark, sf_dir), sm.STANDARD, sm.reliability())


_GAPS = {
    "decision_accuracy": "avg(cast(outcome in ('correct_answer', 'correct_abstention') as integer))",
    "over_answering_rate": "avg(case when not is_answerable then cast(outcome = 'over_answering' as integer) end)",
    "under_answering_rate": "avg(case when is_answerable then cast(outcome = 'under_answering' as integer) end)",
    "empty_response_rate": "avg(cast(outcome = 'empty_response' as integer))",
}


@query(f"with {PRED}, {_OUT} " + " union all ".join(_GAP.format(m, e, "out") for m, e in _GAPS.items()))
def reliability_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda o: (F.col("outcome") == o).cast("int")
    metrics = {"decision_accuracy": F.avg(rel.reliable(F.col("outcome")).cast("int")), "over_answering_rate": F.avg(F.when(~F.col("is_answerable"), is_("over_answering"))), "under_answering_rate": F.avg(F.when(F.col("is_answerable"), is_("under_answering"))), "empty_response_rate": F.avg(is_("empty_response"))}
    return sm.gap(_outcomes(spark, sf_dir), metrics)


@query(f"with {PRED} {_sets(', '.join(['count(*) as total', *(f'count(*) filter (where status = {s!r}) as {s}' for s in rel.STATUSES), *(f'count(*) filter (where status = {s!r}) / count(*) as {s}_rate' for s in rel.STATUSES)]), 'pred', {'overall': [], 'language': ['language']})}")
def status_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.by_dimensions(predictions(spark, sf_dir), {"overall": [], "language": ["language"]}, sm.statuses())


_CAP = "count(correct) as total, cast(sum(correct) as bigint) as correct_count, cast(count(correct) - sum(correct) as bigint) as incorrect_count, avg(correct) as accuracy"


@query(f"with {PRED}, cap as (select * from pred where task <> 'unanswerable') {_sets(_CAP, 'cap')}")
def capability_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.by_dimensions(predictions(spark, sf_dir).where("task <> 'unanswerable'"), sm.STANDARD, sm.capability())


@query(f"with {PRED} select language, {', '.join(f'avg(correct) filter (where task = {t!r}) as {t}' for t in ('factual_knowledge', 'reasoning', 'linguistic_understanding', 'instruction_following', 'unanswerable'))} from pred group by language")
def language_task_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).groupBy("language").pivot("task", ["factual_knowledge", "reasoning", "linguistic_understanding", "instruction_following", "unanswerable"]).agg(F.avg("correct"))


# -- pairs -----------------------------------------------------------------------------------------------


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pr.pair_up(predictions(spark, sf_dir), ["correct"], ["task"])
    both = both.where(pr.complete(both))
    right = lambda s: F.col(f"{s}.correct") == 1
    return both.select("pair_id", "task", F.col("source.correct").alias("en"), F.col("target.correct").alias("az"), rel.transition(right("source"), right("target")).alias("transition"))


@query(f"with {PRED}, {PAIRS}, t as (select *, {label_sql('correct', 'en = 1', 'az = 1')} as transition from pairs) select {transition_sql('correct')} from t")
def pair_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.transition_summary(_paired(spark, sf_dir))


@query(
    f"""with {PRED}, {_OUT}, p as (select pair_id, min(task) as task, bool_and(outcome in ('correct_answer', 'correct_abstention')) filter (where language = 'en') as en,
        bool_and(outcome in ('correct_answer', 'correct_abstention')) filter (where language = 'az') as az from out group by pair_id
        having count(*) filter (where language = 'en') = 1 and count(*) filter (where language = 'az') = 1),
    t as (select *, {label_sql('reliable', 'en', 'az')} as transition from p) select task, {transition_sql('reliable')} from t group by task"""
)
def paired_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pr.pair_up(_outcomes(spark, sf_dir), ["outcome"], ["task", "is_answerable"])
    both = both.where(pr.complete(both))
    ok = lambda s: rel.reliable(F.col(f"{s}.outcome"))
    return pr.transition_summary(both.withColumn("transition", rel.transition(ok("source"), ok("target"), "reliable")), suffix="reliable", by=["task"])


_FAIL = f"""fail as (select *, case when outcome in ('over_answering', 'under_answering', 'empty_response') then outcome
    when is_answerable and correct = 0 then 'capability_failure' else 'correct' end as failure_type from (select *, {OUTCOME} as outcome from pred))"""
_FAIL_METRICS = ", ".join(["count(*) as total", *(f"count(*) filter (where failure_type = '{f}') as {f}" for f in rel.FAILURES), "count(*) filter (where failure_type <> 'correct') / count(*) as failure_rate"])


@query(f"with {PRED}, {_FAIL} {_sets(_FAIL_METRICS, 'fail', {'overall': [], 'language': ['language'], 'task': ['task']})}")
def failure_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.by_dimensions(_outcomes(spark, sf_dir), {"overall": [], "language": ["language"], "task": ["task"]}, sm.failures())


_FP = ["preserved_behavior", "language_degradation", "language_recovery", "shared_failure"]
_FR = ["behavior_preservation_rate", "degradation_rate", "recovery_rate", "shared_failure_rate"]


@query(
    f"""with {PRED}, {_FAIL}, p as (select pair_id, min(task) as task, bool_and(failure_type = 'correct') filter (where language = 'en') as en,
        bool_and(failure_type = 'correct') filter (where language = 'az') as az from fail group by pair_id having count(distinct language) = 2),
    t as (select *, case when en and az then 'preserved_behavior' when en then 'language_degradation' when az then 'language_recovery' else 'shared_failure' end as transition from p)
    select task, count(*) as total_pairs, {', '.join(f"count(*) filter (where transition = '{x}') as {x}, count(*) filter (where transition = '{x}') / count(*) as {r}" for x, r in zip(_FP, _FR, strict=True))} from t group by task"""
)
def paired_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pr.pair_up(_outcomes(spark, sf_dir), ["failure_type"], ["task"], "first", "ord").where("n_source > 0 and n_target > 0")
    good = lambda s: F.col(f"{s}.failure_type") == "correct"
    return pr.failure_summary(both.withColumn("transition", pr.failure_transition(good("source"), good("target"))), ["task"])


def _crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rows a side: pairs of eight neighbouring documents."""
    return predictions(spark, sf_dir).withColumn("pair_id", F.floor(F.col("ord") / 8).cast("long"))


_CROWD = "crowd as (select * replace (cast(floor(ord / 8) as bigint) as pair_id) from pred)"


def _wins(which: str) -> str:
    return f"""with {PRED}, {_CROWD} select pair_id, arg_{which}(item_id, ord) filter (where language = 'en') as source_item, arg_{which}(item_id, ord) filter (where language = 'az') as target_item
        from crowd group by pair_id having count(distinct language) = 2"""


@query(_wins("max"))
def pair_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pr.pair_up(_crowded(spark, sf_dir), ["item_id"], [], "last", "ord").where("n_source > 0 and n_target > 0")
    return both.select("pair_id", F.col("source.item_id").alias("source_item"), F.col("target.item_id").alias("target_item"))


@query(_wins("min"))
def pair_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pr.pair_up(_crowded(spark, sf_dir), ["item_id"], [], "first", "ord").where("n_source > 0 and n_target > 0")
    return both.select("pair_id", F.col("source.item_id").alias("source_item"), F.col("target.item_id").alias("target_item"))


# -- overlap ---------------------------------------------------------------------------------------------

_OV = "regexp_extract_all(lower(text), '[0-9a-zəğıöşüç]+')"


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")


MIXED = [(-1, "gpt4 is here"), (-2, "gpt 4 is here"), (-3, "GPT4 -- is here!"), (-4, "...")]
_MIXED = f"(select id as doc_id, text from {_values(MIXED)} as v(id, text) union all select doc_id, text from documents)"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir)[0].unionByName(_literal(spark, MIXED, "id long, text string"))


@query(f"""with a as (select doc_id, array_to_string({_OV}, ' ') as k from {_MIXED}),
    b as (select cast(item_id as varchar) as item_id, array_to_string({_OV}, ' ') as k from (select cast(item_id as varchar) as item_id, text from benchmark union all values ('mixed', 'Gpt4 is here.'), ('none', '')))
    select doc_id as left_id, item_id as right_id from a join b using (k)""")
def exact_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the benchmark, with rows of our own that differ in their runs of digits and letters."""
    own = _literal(spark, [("mixed", "Gpt4 is here."), ("none", "")], "id string, text string")
    bench = _texts(spark, sf_dir)[1].select(F.col("id").cast("string").alias("id"), "text").unionByName(own)
    return overlap.exact(_mixed(spark, sf_dir), bench)


@query(f"""with k as (select doc_id, md5(array_to_string({_OV}, ' ')) as k from {_MIXED}), c as (select k, min(doc_id) as class_id, count(*) as class_size from k group by k having count(*) > 1)
    select doc_id as id, class_id, class_size from k join c using (k)""")
def overlap_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.classes(_mixed(spark, sf_dir))


@query(
    f"""with a as (select doc_id, list_distinct({_OV}) as s, array_to_string({_OV}, ' ') as k from documents),
    b as (select item_id, list_distinct({_OV}) as s, array_to_string({_OV}, ' ') as k from benchmark),
    j as (select doc_id as left_id, item_id as right_id, len(list_intersect(a.s, b.s)) as n, len(a.s) + len(b.s) as m from a, b where a.k <> b.k)
    select left_id, right_id, n / (m - n) as similarity from j where n / nullif(m - n, 0) >= 0.2"""
)
def jaccard_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.similar(*_texts(spark, sf_dir), 0.2)


@query(
    """with q as (select vec_id, cast(embedding as double[]) as v from embeddings), s as (
        select a.vec_id as query_id, b.vec_id as id, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) as similarity
        from q a, q b where a.vec_id % 100 = 0 and b.vec_id <> a.vec_id),
    r as (select *, row_number() over (partition by query_id order by similarity desc, id) as rank from s)
    select query_id, id, round(similarity, 6) as similarity, cast(rank as integer) as rank from r where rank <= 3 and similarity >= 0.2"""
)
def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    best = overlap.embedding_top_k(e.where("id % 100 = 0"), e, 3, 0.2, others=True)
    return best.select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    f"""with k as (select doc_id, array_to_string({_OV}, ' ') as k from documents), w as (select *, lag(doc_id) over (partition by k order by doc_id) as earlier_id from k)
    select doc_id, md5(k) as dup_key, earlier_id from w where earlier_id is not null"""
)
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return overlap.duplicates(docs.withColumn("ord", F.col("doc_id")), tx.overlap_key(F.col("text")), "ord", "doc_id")


@query()
def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = _texts(spark, sf_dir)
    return overlap.leaks(docs, bench, sequence=0.5, jaccard=0.25)


# -- alignment, review, adjudication ---------------------------------------------------------------------


@query("select cast(doc_id as varchar) as key, 'left_only' as detail, 'aligned' as rule from documents anti join labels using (doc_id) union all select cast(doc_id as varchar), 'right_only', 'aligned' from labels anti join documents using (doc_id)")
def plan_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.aligned(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


def _raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes = lambda c: F.when(c == 1, "yes").otherwise("no")
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 3).alias("field"), yes(F.col("quality")).alias("a"), yes(1 - F.col("toxic")).alias("b"))


_RATERS = "raters as (select doc_id, doc_id % 3 as field, case when quality = 1 then 'yes' else 'no' end as a, case when toxic = 0 then 'yes' else 'no' end as b from labels)"


@query(
    f"""with {_RATERS}, m as (select field, count(*) as n, count(*) filter (where a = b) as agreements,
        count(*) filter (where a = 'yes') * count(*) filter (where b = 'yes') + count(*) filter (where a = 'no') * count(*) filter (where b = 'no') as same from raters group by field)
    select field, n, agreements, agreements / n as raw_agreement, case when same = n * n then null else (agreements / n - same / (n * n)) / (1 - same / (n * n)) end as kappa from m"""
)
def reviewer_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.kappa(_raters(spark, sf_dir), "a", "b", ["field"])


@query(f"with {_RATERS} select doc_id, field, a, b from raters where a <> b")
def reviewer_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.disagreements(_raters(spark, sf_dir))


@query(
    """with r as (select doc_id, case when quality = 1 then 'yes' else 'no' end as x, case when toxic = 0 then 'yes' else 'no' end as y,
        case doc_id % 3 when 0 then 'yes' when 1 then 'no' else 'uncertain' end as t, case when doc_id % 3 = 2 then case doc_id % 5 when 0 then 'yes' when 1 then 'no' else 'uncertain' end end as f from labels),
    c as (select *, case when x = y then x when f is not null then case when f in ('yes', 'no') then f end when t in ('yes', 'no') then t end as label,
        case when x = y then 'initial_agreement' when f is not null then case when f in ('yes', 'no') then 'fourth_review' else 'unresolved_fourth_uncertain' end when t in ('yes', 'no') then 'third_review' else 'unresolved' end as stage from r)
    select stage, coalesce(label, 'open') as label, count(*) as n from c group by all"""
)
def label_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir).groupBy("stage", F.coalesce("label", F.lit("open")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labels")
    yes = lambda c: F.when(c == 1, "yes").otherwise("no")
    pick = lambda m: F.when(F.col("doc_id") % m == 0, "yes").when(F.col("doc_id") % m == 1, "no").otherwise("uncertain")
    value, stage = ad.cascade(yes(F.col("quality")), yes(1 - F.col("toxic")), pick(3), F.when(F.col("doc_id") % 3 == 2, pick(5)))
    return df.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("az").alias("language"), value.alias("label"), stage.alias("stage"))


@query(
    """with c as (select doc_id, case when doc_id % 2 = 0 then 'en' else 'az' end as language, case when quality = 1 - toxic then case when quality = 1 then 'yes' else 'no' end
        when doc_id % 3 = 2 then case doc_id % 5 when 0 then 'yes' when 1 then 'no' end when doc_id % 3 = 0 then 'yes' else 'no' end as label from labels)
    select language, count(*) as total, count(*) filter (where label = 'yes') as yes, count(*) filter (where label = 'no') as no, count(*) filter (where label is null) as unresolved,
        count(*) filter (where label = 'yes') / count(*) as lower_rate, count(*) filter (where label = 'yes' or label is null) / count(*) as upper_rate from c group by language"""
)
def abstention_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.bounds(_cascade(spark, sf_dir), ["language"])


_CHOOSE_ALL = "list_sum(list_transform(range(0, least(b, c) + 1), lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))))"
_STATES = """c as (select doc_id, case when quality = 1 - toxic then case when quality = 1 then 'yes' else 'no' end
        when doc_id % 3 = 2 then case doc_id % 5 when 0 then 'yes' when 1 then 'no' end when doc_id % 3 = 0 then 'yes' else 'no' end as label from labels),
    p as (select cast(floor(e.doc_id / 2) as bigint) % 3 as model, e.label as en, a.label as az from c e join c a on e.doc_id + 1 = a.doc_id where e.doc_id % 2 = 0),
    n as (select model, count(*) filter (where en is not null and az is not null) as complete_pairs, count(*) filter (where en is null or az is null) as uncertain_pairs,
        count(*) filter (where en = 'yes' and az = 'no') as b0, count(*) filter (where en = 'no' and az = 'yes') as c0,
        count(*) filter (where (en is null and az = 'no') or (en = 'yes' and az is null)) as u, count(*) filter (where (en is null and az = 'yes') or (en = 'no' and az is null)) as v,
        count(*) filter (where en is null and az is null) as w from p group by model),
    i as (select *, unnest(range(0, u + w + 1)) as i from n), s as (select *, unnest(range(0, v + least(w, u + w - i) + 1)) as j from i),
    q as (select model, complete_pairs, uncertain_pairs, b0 + i as b, c0 + j as c from s)"""


@query(f"with {_STATES}, t as (select *, least(1.0, 2 * {_CHOOSE_ALL}) as p from q) select model, max(complete_pairs) as complete_pairs, max(uncertain_pairs) as uncertain_pairs, round(min(p), 9) as min_p, round(max(p), 9) as max_p from t group by model")
def mcnemar_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _cascade(spark, sf_dir).select(F.floor(F.col("doc_id") / 2).alias("pair"), "language", "label")
    side = lambda lang: F.max(F.when(F.col("language") == lang, F.struct("label")))
    both = df.groupBy("pair").agg(side("en").alias("e"), side("az").alias("a")).where("e is not null and a is not null")
    return ad.p_value_bounds(both.select((F.col("pair") % 3).alias("model"), F.col("e.label").alias("en"), F.col("a.label").alias("az")), "model").withColumns({"min_p": F.round("min_p", 9), "max_p": F.round("max_p", 9)})


@query("select substr(sha256('salt|' || cast(doc_id % 3 as varchar) || '|' || cast(doc_id as varchar)), 1, 16) as audit_id, doc_id from labels")
def blind_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = tx.blind_id("salt", (F.col("doc_id") % 3).cast("string"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "labels").select(key.alias("audit_id"), "doc_id")


# -- statistics ------------------------------------------------------------------------------------------

DISCORDANT = [(7, 11), (9, 6), (15, 19), (0, 0), (8, 8), (3, 2), (0, 10), (200, 150)]
_CHOOSE = "list_sum(list_transform(range(0, least(b, c) + 1), lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))))"


@query(
    f"""with {PRED}, {PAIRS}, k as (select min(category) as category, pair_id from pred group by pair_id),
    d as (select count(*) filter (where en = 1 and az = 0) as b, count(*) filter (where en = 0 and az = 1) as c from pairs join k using (pair_id) group by task, category)
    select b, c, round(least(1.0, 2 * {_CHOOSE}), 9) as p_value from (select b, c from d union all select b, c from {_values(DISCORDANT)} as v(b, c))"""
)
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = predictions(spark, sf_dir).groupBy("pair_id").agg(F.min("category").alias("category"))
    cells = _paired(spark, sf_dir).select("pair_id", "task", "en", "az").join(category, "pair_id").groupBy("task", "category")
    cells = cells.agg(F.count_if((F.col("en") == 1) & (F.col("az") == 0)).alias("b"), F.count_if((F.col("en") == 0) & (F.col("az") == 1)).alias("c"))
    return cells.select("b", "c").unionByName(_literal(spark, DISCORDANT, "b long, c long")).select("b", "c", F.round(stats.mcnemar(F.col("b"), F.col("c")), 9).alias("p_value"))


@query(
    f"""with {PRED}, {PAIRS}, d as (select task, count(*) filter (where en = 1 and az = 0) as b, count(*) filter (where en = 0 and az = 1) as c from pairs group by task),
    p as (select *, round(least(1.0, 2 * {_CHOOSE}), 12) as p_value from d),
    h as (select *, p_value * (count(*) over () - row_number() over (order by p_value, task) + 1) as step from p)
    select task, b, c, round(p_value, 9) as p_value, round(least(1.0, max(step) over (order by p_value, task rows unbounded preceding)), 9) as p_holm from h"""
)
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _paired(spark, sf_dir).groupBy("task").agg(F.count_if((F.col("en") == 1) & (F.col("az") == 0)).alias("b"), F.count_if((F.col("en") == 0) & (F.col("az") == 1)).alias("c"))
    p = d.withColumn("p_value", stats.mcnemar(F.col("b"), F.col("c")))
    return stats.holm(p, order="task").select("task", "b", "c", F.round("p_value", 9).alias("p_value"), F.round("p_holm", 9).alias("p_holm"))


def _two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predictions(spark, sf_dir)
    both = pr.compare_models(df.select("item_id", "pair_id", "language", "correct"), df.select("item_id", "pair_id", "language", (1 - F.col("toxic")).alias("correct")))
    return both.dropna(subset=["base_en", "base_az"])


_MODELS = """models as (select pair_id, max(correct) filter (where language = 'en') as base_en, max(correct) filter (where language = 'az') as base_az,
    max(1 - toxic) filter (where language = 'en') as adapted_en, max(1 - toxic) filter (where language = 'az') as adapted_az from pred group by pair_id having count(distinct language) = 2)"""
_METRICS = {
    "base_en": "avg(base_en)",
    "base_az": "avg(base_az)",
    "adapted_en": "avg(adapted_en)",
    "adapted_az": "avg(adapted_az)",
    "base_overall": "(sum(base_en) + sum(base_az)) / (2 * count(*))",
    "adapted_overall": "(sum(adapted_en) + sum(adapted_az)) / (2 * count(*))",
    "base_gap": "avg(base_en) - avg(base_az)",
    "adapted_gap": "avg(adapted_en) - avg(adapted_az)",
    "gap_change": "(avg(adapted_en) - avg(adapted_az)) - (avg(base_en) - avg(base_az))",
}


@query(f"with {PRED}, {_MODELS} select {', '.join(f'{v} as {k}' for k, v in _METRICS.items())} from models")
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _two_models(spark, sf_dir)
    return df.agg(*stats.paired_metrics(df))


REPLICATES = 10_000


@query(
    f"""with {PRED}, {_MODELS}, m as (select *, row_number() over (order by pair_id) as at, count(*) over () as n from models),
    d as (select r.r as replicate, m.n, ('0x' || substr(md5('17|' || r.r || '|' || i.i), 1, 8))::bigint % m.n + 1 as at
        from range(1, {REPLICATES + 1}) as r(r), m cross join lateral (select m.at as i) as i),
    b as (select replicate, {', '.join(f'{v} as {k}' for k, v in _METRICS.items())} from d join m on d.at = m.at group by replicate),
    l as (unpivot b on {', '.join(_METRICS)} into name metric value value),
    o as (select *, row_number() over (partition by metric order by value) - 1 as k from l)
    select metric, round(max(value) filter (where k = {int(0.025 * REPLICATES)}), 9) as low, round(max(value) filter (where k = {int(0.975 * REPLICATES) - 1}), 9) as high from o group by metric"""
)
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _two_models(spark, sf_dir)
    return stats.bootstrap(df, stats.paired_metrics(df), REPLICATES).select("metric", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(
    f"""with {PRED}, s as (select task, language, pair_id % 3 as seed, avg(correct) as accuracy from pred group by all)
    select task, language, count(*) as n_seeds, round(avg(accuracy), 9) as mean, round(stddev_samp(accuracy), 9) as sd from s group by task, language"""
)
def seed_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = predictions(spark, sf_dir).groupBy("task", "language", (F.col("pair_id") % 3).alias("seed")).agg(F.avg("correct").alias("accuracy"))
    return sm.seed_spread(runs, ["task", "language"], "accuracy").select("task", "language", "n_seeds", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"))


_MDE = 1000
"""Steps that a whole difference of 1 is shown in."""


@query(
    f"""with {PRED}, {PAIRS}, g as (select task, count(*) as n, count(*) filter (where en <> az) as k from pairs group by task),
    cells as (select m, unnest(range(0, m + 1)) as k from (select unnest(range(0, (select max(n) + 1 from g))) as m)),
    hits as (select m, k from cells where least(1.0, 2 * list_sum(list_transform(range(0, least(k, m - k) + 1), lambda j: exp(lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) - m * ln(2))))) <= 0.05 + 1e-12),
    x as (select task, n, k / n as d, unnest(range(0, k * {_MDE} // n + 1)) / {_MDE}.0 as x from g where k > 0),
    p as (select task, x, sum(exp(lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) + m * ln(d) + case when m = n then 0 when d >= 1 then -1e9 else (n - m) * ln(1 - d) end)
        * exp(lgamma(m + 1) - lgamma(h.k + 1) - lgamma(m - h.k + 1) + h.k * ln((d + x) / (2 * d)) + case when m = h.k then 0 when x >= d then -1e9 else (m - h.k) * ln(1 - (d + x) / (2 * d)) end)) as power
        from x join hits h on m <= n group by task, x)
    select g.task, g.n, g.k, (select min(p.x) from p where p.task = g.task and p.power >= 0.8) as effect from g"""
)
def power_mde(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest difference found with a power of 0.8 by each task's pairs, in steps of a thousandth; null where none is."""
    both = _paired(spark, sf_dir).groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("en") != F.col("az")).alias("k"))
    step = F.ceil(stats.effect_of(F.col("n"), F.col("k")) * _MDE - 1e-9)
    return both.select("task", "n", "k", F.when(step * F.col("n") <= F.col("k") * _MDE, step.cast("double") / _MDE).alias("effect"))


# -- splits and generation -------------------------------------------------------------------------------


@query(
    f"""with {PRED}, p as (select distinct pair_id from pred), o as (select pair_id, row_number() over (order by md5('17|' || pair_id), pair_id) as place, count(*) over () as n from p)
    select item_id, split from pred join (select pair_id, case when place <= floor(n * 0.7) then 'train' when place <= floor(n * 0.7) + floor(n * 0.15) then 'dev' else 'test' end as split from o) using (pair_id)"""
)
def pair_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.pair_split(predictions(spark, sf_dir), 0.7, 0.15, 0.15, 17).select("item_id", "split")


@query(
    f"""with {PRED}, o as (select item_id, category, row_number() over (partition by category order by md5('17|' || item_id), item_id) as place, count(*) over (partition by category) as n from pred)
    select item_id, category, case when place <= greatest(1, round_even(n * 0.1, 0)) then 'valid' else 'train' end as split from o"""
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(predictions(spark, sf_dir), "item_id", "category", 0.1, 17).select("item_id", "category", "split")


SHARES = [("a", 0.35, 1), ("b", 0.35, 2), ("c", 0.30, 3)]


@query(f"""select name, count from {_values([('a', 4), ('b', 3), ('c', 3)])} as v(name, count) union all select 'conversations', cast(count(*) as integer) from conversations""")
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten records by shares of our own, and as many as there are turns of conversations to a single share."""
    turns = table(spark, sf_dir, "conversations").count()
    own = split.allocate_rows(_literal(spark, SHARES, "name string, share double, ord int"), 10)
    return own.unionByName(split.allocate_rows(_literal(spark, [("conversations", 1.0, 1)], "name string, share double, ord int"), turns))


@query(f"with {PRED} select item_id, cast(row_number() over w - 1 as integer) as place, cast((row_number() over w - 1) % 4 as integer) as subcategory, cast((row_number() over w - 1) // 4 as integer) as variant from pred window w as (partition by category order by ord)")
def category_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.rotate(predictions(spark, sf_dir), "category", "ord", 4).select("item_id", "place", "subcategory", "variant")


@query(f"with {PRED} select item_id, format('batch_{{:03d}}', cast(ceil(row_number() over (order by ord) / 25) as integer)) as batch from pred")
def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.batches(predictions(spark, sf_dir), ["ord"], 25).select("item_id", "batch")


@query(
    f"""with {PRED} select item_id || '_' || language as item_id, language, question, reference_answer from (
        select item_id, unnest(['en', 'az']) as language, unnest([question, prediction]) as question, unnest([reference_answer, status]) as reference_answer from pred)"""
)
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = predictions(spark, sf_dir).select(F.col("item_id").alias("pair_id"), F.col("question").alias("source_question"), F.col("reference_answer").alias("source_answer"), F.col("prediction").alias("target_question"), F.col("status").alias("target_answer"))
    return build.to_long(wide).select("item_id", "language", "question", "reference_answer")


@query("""with t as (select *, lead(role) over w as next_role, lead(text) over w as answer from conversations window w as (partition by conv_id order by turn))
    select conv_id, turn, 'user' as role, text as question, answer from t where role = 'user' and next_role = 'assistant'""")
def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = build.chat(build.turns(table(spark, sf_dir, "conversations")), "question", "answer")
    return rows.select("conv_id", "turn", F.col("messages")[0]["role"].alias("role"), F.col("messages")[0]["content"].alias("question"), F.col("messages")[1]["content"].alias("answer"))


WORDS = ["zebra", "əlma", "elm", "Iraq", "İran", "çay", "cib", "gül", "ğ", "ördək", "oda", "şar", "sal", "42"]


@query(
    f"""with w as (select distinct word from (select unnest(string_split(text, ' ')) as word from documents union all select word from {_values([(w,) for w in WORDS])} as v(word)) where word <> ''),
    k as (select word, list_transform(string_split(lower(translate(word, 'İI', 'iı')), ''), lambda x: case when instr('{tx.ALPHABET}', x) > 0 then instr('{tx.ALPHABET}', x) else {len(tx.ALPHABET) + 1} end) as key from w)
    select word, row_number() over (order by key, word) as place from k"""
)
def alphabet_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).unionByName(_literal(spark, [(w,) for w in WORDS], "word string"))
    keyed = words.where("word <> ''").distinct().withColumn("key", tx.collation_key(F.col("word")))
    return split.numbered(keyed, ["key", "word"], "place").select("word", "place")


# -- constraints -----------------------------------------------------------------------------------------


@query(f"with {PRED} select 'complete_pairs' as rule, cast(pair_id as varchar) as key, string_agg(distinct language, ',' order by language) as detail from pred group by pair_id having count(distinct language) < 2")
def incomplete_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.complete_pairs(predictions(spark, sf_dir), ["en", "az"])


RULES = [("reasoning", ["category"], ["extraction", "other"], None), ("factual_knowledge", ["difficulty"], None, ["easy", "hard"])]


@query(
    f"""with {PRED} select 'metadata_rules' as rule, item_id as key, 'category:' || category as detail from pred where task = 'reasoning' and category not in ('extraction', 'other')
    union all select 'metadata_rules', item_id, 'difficulty:' || difficulty from pred where task = 'factual_knowledge' and difficulty not in ('easy', 'hard')"""
)
def metadata_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.metadata_rules(predictions(spark, sf_dir), _literal(spark, RULES, "task string, required array<string>, categories array<string>, difficulties array<string>"))


@query(f"with {PRED} select item_id, pair_id from pred where pair_id in (select pair_id from pred group by pair_id having bool_and(status = 'answered'))")
def review_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.approved_pairs(predictions(spark, sf_dir), "status", "answered").select("item_id", "pair_id")


@query(
    f"""with {PRED}, s as (select *, case when ord % 7 = 0 then 'extra' else 'train' end as split from pred)
    select 'allowed_split' as rule, item_id as key, split as detail from s where split = 'extra'
    union all select 'one_split_per_pair', cast(pair_id as varchar), min(split) || ',' || max(split) from s group by pair_id having min(split) <> max(split)"""
)
def split_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predictions(spark, sf_dir)
    return va.split_integrity(df.withColumn("split", F.when(F.col("ord") % 7 == 0, "extra").otherwise("train")), df)


@query(_sets("count(*) as total, count(distinct pair_id) as distinct_pair_id", "pred", {"overall": [], "task_category": ["task", "category"], "difficulty": ["difficulty"]}).replace("select", f"with {PRED} select", 1))
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.counts(predictions(spark, sf_dir), {"overall": [], "task_category": ["task", "category"], "difficulty": ["difficulty"]}, "pair_id")


# -- functions that SQL can't follow ---------------------------------------------------------------------


@query()
def nfc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return tx.nfc(docs, "text").select("doc_id", tx.normalize_answer(F.col("text")).alias("text"))


@query("select item_id, text as question, 'A: ' || text as prediction from benchmark")
def inference_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    return infer(rows, lambda: lambda questions: [f"A: {q}" for q in questions])


# -- further joins, reports and generation ---------------------------------------------------------------


def _two_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predictions(spark, sf_dir)
    row = lambda model, c: df.select("item_id", F.lit(model).alias("model"), "prediction", c.alias("correct"))
    return row("base", F.col("correct")).unionByName(row("adapted", 1 - F.col("toxic")))


@query(f"with {PRED} select item_id, question, reference_answer, 1 - toxic as adapted, correct as base, cast(2 as integer) as models from pred")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of several models folded into one row an item."""
    folded = ad.fold_models(_two_results(spark, sf_dir), predictions(spark, sf_dir))
    score = lambda m: F.col("answers")[m]["correct"].alias(m)
    return folded.select("item_id", "question", "reference_answer", score("adapted"), score("base"), F.size("answers").alias("models"))


@query(f"""with {PRED}, d as (select doc_id, quality from labels where toxic = 0)
    select p.item_id, d.quality as decision, p.task = 'linguistic_understanding' and d.quality is null as missing from pred p left join d on p.ord = d.doc_id""")
def decision_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human decisions looked up where there are any; missing where one is needed and there is none."""
    decisions = table(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").cast("string").alias("item_id"), F.col("quality").alias("decision"))
    both = predictions(spark, sf_dir).join(decisions, "item_id", "left")
    return both.select("item_id", "decision", ((F.col("task") == "linguistic_understanding") & F.col("decision").isNull()).alias("missing"))


@query(f"with {_RATERS} select field, count(*) filter (where a <> '' and b <> '') as complete, count(*) filter (where a = '' or b = '') as missing, count(*) filter (where a = b) as agreements, count(*) filter (where a = b) / count(*) as raw_agreement from (select case when field = 0 then 'x' when field = 1 then 'y' else 'z' end as field, a, b from raters) group by field")
def agreement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _raters(spark, sf_dir).withColumn("field", F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("field") + 1).cast("int")))
    return ad.agreement(df).drop("kappa")


@query(f"""with {_RATERS}, l as (select field, 'first' as reviewer, a as label from raters union all select field, 'second', b from raters) select field, reviewer, label, count(*) as n from l group by all""")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.distribution(_raters(spark, sf_dir))


@query(f"""with {PRED} select language, count(*) as total, count(*) filter (where correct = 1) / count(*) as human_rate, count(*) filter (where status = 'abstained') / count(*) as rule_rate,
    count(*) filter (where (correct = 1) <> (status = 'abstained')) as mismatches from pred group by language""")
def human_against_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predictions(spark, sf_dir).select("language", F.when(F.col("correct") == 1, "yes").otherwise("no").alias("human"), F.col("status").alias("rule_status"))
    return ad.against_rules(df, ["language"])


@query(f"""with {PRED} select (select count(*) from documents) as left_records, (select count(*) from benchmark) as right_records,
    (select count(*) from documents d join benchmark b on array_to_string(regexp_extract_all(lower(d.text), '[0-9a-zəğıöşüç]+'), ' ') = array_to_string(regexp_extract_all(lower(b.text), '[0-9a-zəğıöşüç]+'), ' ')) as exact_overlaps,
    (select count(*) from (select list_distinct({_OV}) as s, array_to_string({_OV}, ' ') as k from documents) a, (select list_distinct({_OV}) as s, array_to_string({_OV}, ' ') as k from benchmark) b
        where a.k <> b.k and len(list_intersect(a.s, b.s)) / nullif(len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)), 0) >= 0.25) as similar_overlaps, cast(0.25 as double) as threshold""")
def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.report(*_texts(spark, sf_dir), 0.25)


@query(f"with {PRED}, c as (select *, status = 'answered' as there from pred) " + " union all ".join(f"select '{d}' as dimension, {k} as key, count(*) as requested, count(*) filter (where there) as generated, count(*) filter (where there) / count(*) as coverage from c" + (f" group by {k}" if d != "overall" else "") for d, k in (("overall", "'all'"), ("task", "task"), ("difficulty", "difficulty"))))
def content_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predictions(spark, sf_dir).withColumn("pair_id", F.col("item_id"))
    return build.coverage(df, df.where("status = 'answered'"), ["task", "difficulty"])


GUIDE = {"task": {"reasoning": "Think. ", "factual_knowledge": "Recall. "}, "difficulty": {"easy": "Simply.", "hard": "In depth."}}


@query(f"""with {PRED} select item_id, 'Write: ' || case task when 'reasoning' then 'Think. ' when 'factual_knowledge' then 'Recall. ' else '' end
    || case difficulty when 'easy' then 'Simply.' when 'hard' then 'In depth.' else '' end as instruction from pred""")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.prompts(predictions(spark, sf_dir), GUIDE, "Write: {task}{difficulty}").select("item_id", "instruction")


@query("""with b as (select item_id, row_number() over (order by item_id) - 1 as slot, text from benchmark), n as (select count(*) as slots from b), r as (select unnest(range(0, 100)) as index)
    select cast(r.index as integer) as index, b.text from r, n join b on true where b.slot = r.index % n.slots""")
def template_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = split.numbered(table(spark, sf_dir, "benchmark"), ["item_id"], "slot", start=0).select(F.lit("c").alias("category"), F.col("slot").cast("int").alias("slot"), "text")
    return build.templates(_literal(spark, [("c", 100)], "category string, count int"), bank).select("index", "text")


@query("""with b as (select row_number() over (order by item_id) as index, item_id from benchmark), r as (select unnest(range(1, 51)) as index)
    select cast(r.index as integer) as index, b.item_id, b.item_id is null as missing from r left join b on r.index = b.index""")
def bank_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = split.numbered(table(spark, sf_dir, "benchmark"), ["item_id"], "index").select(F.lit("t").alias("task"), F.col("index").cast("int").alias("index"), "item_id")
    asked = split.expand(_literal(spark, [("t", 50)], "task string, count int"))
    return build.from_bank(asked, bank).select("index", "item_id", "missing")


@query(f"with {PRED} select item_id, ord from pred order by ord limit 20 offset 10")
def resumed_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 10 to 29 in order: the limit is what a resumed run asks for."""
    return split.piece(predictions(spark, sf_dir), ["ord"], 10, 20).select("item_id", "ord")


@query(f"with {PRED} select 'exact_counts_task' as rule, task as key, count(*) || ' of 7' as detail from pred where task = 'reasoning' group by task having count(*) <> 7 union all select 'exact_counts_task', task, count(*) || ' of 0' from pred where task <> 'reasoning' group by task")
def exact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.exact_counts(predictions(spark, sf_dir), "task", {"reasoning": 7})


@query(f"""with {PRED}, {_MODELS} select count(*) as n, round(avg(base_en), 9) as en_accuracy, round(avg(base_az), 9) as az_accuracy, round(avg(base_en) - avg(base_az), 9) as en_az_gap from models""")
def single_model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _two_models(spark, sf_dir)
    r = lambda c: F.round(c, 9)
    return df.agg(F.count(F.lit(1)).alias("n"), r(F.avg("base_en")).alias("en_accuracy"), r(F.avg("base_az")).alias("az_accuracy"), r(F.avg("base_en") - F.avg("base_az")).alias("en_az_gap"))


@query("""with a as (select doc_id, case when quality = 1 then 'yes' else 'no' end as ok, case when toxic = 0 then 'yes' else '' end as fine from labels),
    b as (select doc_id, case when n_chars > 1000 then 'yes' else 'no' end as ok, case when lang = 'en' then 'yes' else 'no' end as fine from documents),
    j as (select * from a join b using (doc_id)), l as (select doc_id, 'ok' as field, a.ok as a, b.ok as b from a join b using (doc_id) union all select doc_id, 'fine', a.fine, b.fine from a join b using (doc_id))
    select doc_id, field, a, b from l where a <> b and a <> '' and b <> ''""")
def reviewer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reviewers' tables aligned by key, their label fields made long, and where they differ."""
    first = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, " Yes").otherwise("no").alias("ok"), F.when(F.col("toxic") == 0, "YES ").alias("fine"))
    second = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, "yes").otherwise("No").alias("ok"), F.when(F.col("lang") == "en", "yes").otherwise("no").alias("fine"))
    return ad.disagreements(ad.long_labels(ad.align(first, second, "doc_id"), "doc_id", ["ok", "fine"]))


@query(f"""with {PRED}, p as (select substr(sha256('salt|m|' || item_id), 1, 16) as audit_id, item_id from pred)
    select audit_id, item_id, row_number() over (order by md5('29|' || audit_id), audit_id) as place from p""")
def blind_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    packet = ad.blind_packet(predictions(spark, sf_dir).withColumn("model", F.lit("m")), "salt", 29)
    return split.numbered(packet, ["shuffle_key", "audit_id"], "place").select("audit_id", "item_id", "place")


@query(f"""with {PRED} select item_id, case language when 'en' then question when 'az' then reference_answer end as shown from pred""")
def language_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.by_language(predictions(spark, sf_dir), {"shown": {"en": "question", "az": "reference_answer"}}).select("item_id", "shown")
