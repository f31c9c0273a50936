"""The driver's tables in the shapes the engine works on, as DataFrames and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinmark.functions.text import capitals
from twinmark.session import table

TASKS = ("factual_knowledge", "reasoning", "linguistic_understanding", "instruction_following", "unanswerable")
CATEGORIES = ("extraction", "transformation", "reference_resolution", "other")
DIFFICULTIES = ("easy", "medium", "hard")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as predictions: even ids are English, odd ones their other-language twins. The
    question holds the whole text; so does the prediction of every third pair."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    df = docs.join(labels, "doc_id").withColumn("pair_id", F.floor(F.col("doc_id") / 2).cast("long"))
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.col("pair_id") % by + 1).cast("int"))
    words = F.split("text", " ")
    word = lambda i: F.coalesce(F.get(words, i), F.lit(""))
    df = df.select(
        F.col("doc_id").cast("string").alias("item_id"),
        "pair_id",
        F.when(F.col("doc_id") % 2 == 0, "en").otherwise("az").alias("language"),
        pick(TASKS, 5).alias("task"),
        pick(CATEGORIES, 4).alias("category"),
        pick(DIFFICULTIES, 3).alias("difficulty"),
        (F.col("pair_id") % 5 != 4).alias("is_answerable"),
        F.col("quality").cast("int").alias("correct"),
        F.col("toxic").cast("int").alias("toxic"),
        F.when(F.col("toxic") == 1, "abstained").when(F.col("quality") == 0, "empty").otherwise("answered").alias("status"),
        F.concat(F.coalesce("text", F.lit("")), F.lit(" Is it '"), word(0), F.lit("', '"), word(1), F.lit("' or '"), word(2), F.lit("'?")).alias("question"),
        word(1).alias("reference_answer"),
        F.when(F.col("pair_id") % 3 == 0, F.concat(capitals(word(1)), F.lit(".")))
        .when(F.col("pair_id") % 3 == 1, F.col("text"))
        .otherwise(word(2))
        .alias("prediction"),
        F.col("doc_id").alias("ord"),
        F.col("lang").alias("text_lang"),
    )
    return df


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


PRED = f"""pred as (
    select * exclude (text), case when pair_id % 3 = 0 then upper(reference_answer) || '.'
                   when pair_id % 3 = 1 then text else coalesce(w[3], '') end as prediction
    from (
        select cast(doc_id as varchar) as item_id, cast(floor(doc_id / 2) as bigint) as pair_id,
               case when doc_id % 2 = 0 then 'en' else 'az' end as language,
               {_list(TASKS)}[cast(floor(doc_id / 2) as bigint) % 5 + 1] as task,
               {_list(CATEGORIES)}[cast(floor(doc_id / 2) as bigint) % 4 + 1] as category,
               {_list(DIFFICULTIES)}[cast(floor(doc_id / 2) as bigint) % 3 + 1] as difficulty,
               cast(floor(doc_id / 2) as bigint) % 5 <> 4 as is_answerable,
               cast(quality as integer) as correct, cast(toxic as integer) as toxic,
               case when toxic = 1 then 'abstained' when quality = 0 then 'empty' else 'answered' end as status,
               text, string_split(text, ' ') as w,
               coalesce(text, '') || ' Is it ''' || coalesce(string_split(text, ' ')[1], '') || ''', ''' || coalesce(string_split(text, ' ')[2], '')
                   || ''' or ''' || coalesce(string_split(text, ' ')[3], '') || '''?' as question,
               coalesce(string_split(text, ' ')[2], '') as reference_answer, doc_id as ord, lang as text_lang
        from documents join labels using (doc_id)
    )
)"""

OUTCOME = """case when status = 'empty' then 'empty_response'
    when is_answerable then case when status = 'answered' then 'correct_answer' else 'under_answering' end
    when status = 'answered' then 'over_answering' else 'correct_abstention' end"""

PAIRS = """pairs as (
    select pair_id, min(task) as task, max(correct) filter (where language = 'en') as en, max(correct) filter (where language = 'az') as az
    from pred group by pair_id having count(*) filter (where language = 'en') = 1 and count(*) filter (where language = 'az') = 1
)"""


def norm_sql(x: str) -> str:
    """normalize_answer in SQL, for texts with ASCII white space."""
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+', ' ', 'g'))"


def transition_sql(suffix: str, column: str = "transition", prefix: str = "") -> str:
    """The aggregates of operators.pairs.transition_summary."""
    none = f"both_in{suffix}" if suffix == "correct" else f"both_un{suffix}"
    labels = [f"both_{suffix}", f"source_only_{suffix}", f"target_only_{suffix}", none]
    n = {x: f"count(*) filter (where {column} = '{x}')" for x in labels}
    return ", ".join(
        [f"{prefix}count(*) as total_pairs", *(f"{v} as {x}" for x, v in n.items())]
        + [f"{n[labels[1]]} / count(*) as degradation_rate", f"{n[labels[2]]} / count(*) as recovery_rate", f"({n[labels[0]]} + {n[none]}) / count(*) as consistency_rate"]
    )


def label_sql(suffix: str, a: str, b: str) -> str:
    none = f"both_in{suffix}" if suffix == "correct" else f"both_un{suffix}"
    return f"case when {a} and {b} then 'both_{suffix}' when {a} then 'source_only_{suffix}' when {b} then 'target_only_{suffix}' else '{none}' end"
