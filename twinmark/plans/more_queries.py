"""Queries over constraints, files and statistics that queries.py has no room for, with their SQL twins.

Constraints run over the driver's tables with violations that the tables themselves hold once some ids,
languages or texts are bent; files are written, read back and removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinmark.functions import reliability as rel
from twinmark.functions import text as tx
from twinmark.operators import build, stats
from twinmark.operators import pairs as pr
from twinmark.operators import validate as va
from twinmark.operators.split import numbered
from twinmark.operators.storage import cut, shared_dir
from twinmark.plans.queries import _literal, _paired, _values, query
from twinmark.plans.views import PAIRS, PRED, norm_sql, predictions
from twinmark.session import table
from twinmark.sources import readers, sinks

_BENT = """bent as (select * replace (case when ord % 11 = 0 then ' ' else question end as question, case when ord % 13 = 0 then 'de' else language end as language,
    case when ord % 17 = 0 then 'poetry' else task end as task) from pred)"""


def _bent(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("ord")
    return predictions(spark, sf_dir).withColumns({"question": F.when(n % 11 == 0, " ").otherwise(F.col("question")), "language": F.when(n % 13 == 0, "de").otherwise(F.col("language")), "task": F.when(n % 17 == 0, "poetry").otherwise(F.col("task"))})


_RULE = "'{0}' as rule, cast({1} as varchar) as key, cast({2} as varchar) as detail"
_BLANK = " union all ".join(f"select {_RULE.format('not_blank', 'item_id', repr(c))} from bent where trim({c}) = ''" for c in ("question", "reference_answer"))
_LANGUAGE = f"select {_RULE.format('allowed_language', 'item_id', 'language')} from bent where language not in ('en', 'az')"
_TASK = f"select {_RULE.format('allowed_task', 'item_id', 'task')} from bent where task not in ('factual_knowledge', 'reasoning', 'linguistic_understanding', 'instruction_following', 'unanswerable')"
_TWICE = f"select {_RULE.format('unique_pair_id_language', chr(39) + chr(39), 'n').replace(chr(39) * 2, 'pair_id || ' + chr(39) + '|' + chr(39) + ' || language')} from (select pair_id, language, count(*) as n from bent group by all having count(*) > 1)"
_COMPLETE = f"select {_RULE.format('complete_pairs', 'pair_id', 'l')} from (select pair_id, string_agg(distinct language, ',' order by language) as l from bent group by pair_id) where l <> 'az,en'"
_ONE = f"select {_RULE.format('one_task_per_pair', 'pair_id', 'a || ' + repr(',') + ' || b')} from (select pair_id, min(task) as a, max(task) as b from bent group by pair_id) where a <> b"


@query(f"with {PRED}, {_BENT} {_BLANK}")
def blank_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.not_blank(_bent(spark, sf_dir), "item_id", "question", "reference_answer")


@query(f"with {PRED}, {_BENT} {_LANGUAGE} union all {_TASK}")
def allowed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _bent(spark, sf_dir)
    return va.every(va.allowed(df, "item_id", "language", ["en", "az"]), va.allowed(df, "item_id", "task", ["factual_knowledge", "reasoning", "linguistic_understanding", "instruction_following", "unanswerable"]))


@query(f"with {PRED}, {_BENT} {_BLANK} union all {_LANGUAGE} union all {_TASK} union all {_TWICE} union all {_COMPLETE} union all {_ONE}")
def benchmark_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of a benchmark table at once."""
    return va.benchmark(_bent(spark, sf_dir), ["en", "az"], ["factual_knowledge", "reasoning", "linguistic_understanding", "instruction_following", "unanswerable"])


@query(f"with {PRED}, c as (select cast(floor(ord / 8) as bigint) as pair_id, language from pred) select {_RULE.format('unique_pair_id_language', 'pair_id || ' + repr('|') + ' || language', 'n')} from (select pair_id, language, count(*) as n from c group by all having count(*) > 1)")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.unique(predictions(spark, sf_dir).withColumn("pair_id", F.floor(F.col("ord") / 8).cast("long")), "pair_id", "language")


@query(f"with {PRED} select {_RULE.format('known_task', 'item_id', 'task')} from pred where task not in ('reasoning', 'unanswerable')")
def enabled_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.known(predictions(spark, sf_dir), "item_id", "task", _literal(spark, [("reasoning",), ("unanswerable",)], "task string"))


@query(f"with {PRED} select {_RULE.format('prediction_differs_from_reference_answer', 'item_id', repr(''))} from pred where prediction = reference_answer")
def texts_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.different(predictions(spark, sf_dir), "item_id", "prediction", "reference_answer")


@query(f"with w as (select doc_id, len(regexp_extract_all(text, '\\S+')) as n from documents) select {_RULE.format('words_text', 'doc_id', 'n')} from w where n not between 20 and 200")
def word_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.word_limits(table(spark, sf_dir, "documents"), "doc_id", "text", 20, 200)


_FILES = "filed as (select * replace (ord % 3 || ':' || item_id as item_id, ord % 3 || ':' || pair_id as pair_id) from pred)"


@query(f"with {PRED}, {_FILES} select {_RULE.format('complete_pairs', 'pair_id', 'l')} from (select pair_id, string_agg(distinct language, ',' order by language) as l from filed group by pair_id) where l <> 'az,en'")
def candidate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules within each of three files: pairs are dealt over them, so each holds halves."""
    df = predictions(spark, sf_dir).withColumn("file", (F.col("ord") % 3).cast("string"))
    return va.by_file(df, ["en", "az"], ["factual_knowledge", "reasoning", "linguistic_understanding", "instruction_following", "unanswerable"])


_ADAPT = f"""a as (select cast(doc_id as varchar) as item_id, case when doc_id % 19 = 0 then 'en' else 'az' end as language, 'c' || doc_id % 3 as category, text as instruction, text as response, 'x' as source,
    's' || doc_id % 4 as subcategory, 'generated' as generation_status, case when doc_id % 23 = 0 then 'done' else 'pending' end as review_status from documents), n as (select {norm_sql('instruction')} as i from a)"""


@query(f"""with {_ADAPT} select {_RULE.format('not_blank', 'item_id', 'c')} from (select item_id, unnest(['instruction', 'response']) as c from a where regexp_matches(instruction, '^\\s*$'))
    union all select {_RULE.format('allowed_language', 'item_id', 'language')} from a where language <> 'az'
    union all select {_RULE.format('allowed_category', 'item_id', 'category')} from a where category = 'c2'
    union all select {_RULE.format('allowed_review_status', 'item_id', 'review_status')} from a where review_status <> 'pending'
    union all select {_RULE.format('subcategory', 'item_id', 'subcategory')} from a where not coalesce((category = 'c0' and subcategory in ('s0', 's1', 's2', 's3')) or (category = 'c1' and subcategory = 's1'), false)
    union all select 'unique_instruction_text', i, cast(count(*) as varchar) from n group by i having count(*) > 1
    union all select 'unique_instruction_text_response_text', i || '|' || i, cast(count(*) as varchar) from n group by i having count(*) > 1""")
def adaptation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    df = table(spark, sf_dir, "documents").select(n.cast("string").alias("item_id"), F.when(n % 19 == 0, "en").otherwise("az").alias("language"), F.concat(F.lit("c"), n % 3).alias("category"), F.col("text").alias("instruction"), F.col("text").alias("response"), F.lit("x").alias("source"), F.concat(F.lit("s"), n % 4).alias("subcategory"), F.lit("generated").alias("generation_status"), F.when(n % 23 == 0, "done").otherwise("pending").alias("review_status"))
    return va.adaptation(df, "az", {"c0": ["s0", "s1", "s2", "s3"], "c1": ["s1"]})


@query(f"with {PRED} select item_id, pair_id, task from pred where task <> 'reasoning' and pair_id in (select pair_id from pred group by pair_id having bool_and(status = 'answered') and count(distinct language) = 2)")
def promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved pairs that keep every rule, as they go into the final benchmark."""
    df = predictions(spark, sf_dir).where("task <> 'reasoning'").withColumn("review_status", F.when(F.col("status") == "answered", "approved").otherwise("pending"))
    rules = _literal(spark, [(t, ["category"], None, None) for t in ("factual_knowledge", "linguistic_understanding", "instruction_following", "unanswerable")], "task string, required array<string>, categories array<string>, difficulties array<string>")
    whole = df.groupBy("pair_id").agg(F.count_distinct("language").alias("n")).where("n = 2").drop("n")
    return pr.promote(df.join(whole, "pair_id", "left_semi"), rules).select("item_id", "pair_id", "task")


@query(f"with {PRED} select item_id, case when pair_id = 3 then 'approved' else status end as status from pred")
def status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.set_status(predictions(spark, sf_dir), "pair_id", 3, "status", "approved").select("item_id", "status")


@query(f"with {PRED} select pair_id, row_number() over (order by pair_id desc) as ord, text_lang from pred where language = 'en'")
def request_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predictions(spark, sf_dir).where("language = 'en'").withColumn("back", -F.col("pair_id"))
    requests = numbered(df.select("pair_id", "back"), ["back"], "ord").select("pair_id", "ord")
    return build.in_request_order(requests, df.select("pair_id", "text_lang")).select("pair_id", "ord", "text_lang")


@query(f"""with {PRED}, s as (select task, category, ord, is_answerable, format('{{}}_{{:04d}}', task, row_number() over (partition by task order by ord)) as pair_id from pred where language = 'en')
    select s.pair_id, s.task, s.category, p.difficulty, s.is_answerable, s.ord from s join pred p using (ord)""")
def plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predictions(spark, sf_dir).where("language = 'en'")
    return build.plan(df.select("task", "category", "ord", "is_answerable"), df.select("ord", "difficulty"))


@query(f"""with {PRED} select item_id, 2 as n, 'user' as last, question as content from pred""")
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = build.messages(F.col("question"))
    return predictions(spark, sf_dir).select("item_id", F.size(m).alias("n"), F.get(m, 1)["role"].alias("last"), F.get(m, 1)["content"].alias("content"))


# -- files: written, read back, removed ------------------------------------------------------------------


def _there_and_back(spark: SparkSession, write, read) -> DataFrame:
    import uuid

    at = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    write(at)
    back = cut(read(at))
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return back


def _meta() -> Column:
    return F.struct("category", "difficulty", "is_answerable").alias("metadata")


@query(f"with {PRED} select item_id, pair_id::varchar as pair_id, language, task, question, reference_answer, prediction, category, difficulty from pred")
def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as JSON lines, a folder for each language, and back through the strict reader."""
    df = predictions(spark, sf_dir).select("item_id", F.col("pair_id").cast("string").alias("pair_id"), "language", F.col("language").alias("part"), "task", "question", "reference_answer", "prediction", _meta())
    back = _there_and_back(spark, lambda at: sinks.rows(df, at, by=["part"]), lambda at: readers.predictions(spark, at))
    return back.select("item_id", "pair_id", "language", "task", "question", "reference_answer", "prediction", "metadata.category", "metadata.difficulty")


@query(f"with {PRED} select item_id, prediction from pred where is_answerable")
def answerable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predictions(spark, sf_dir).select("item_id", F.col("pair_id").cast("string").alias("pair_id"), "language", "task", "question", "reference_answer", "prediction", _meta())
    return _there_and_back(spark, lambda at: sinks.rows(df, at, nulls=True), lambda at: readers.answerable(spark, at)).select("item_id", "prediction")


@query("select cast(doc_id as varchar) as item_id, cast(quality as integer) as decision from labels")
def decision_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("item_id"), F.col("quality").cast("string").alias("decision"))
    return _there_and_back(spark, lambda at: sinks.rows(df, at), lambda at: readers.decisions(spark, at)).select("item_id", "decision")


@query("select cast(doc_id as varchar) as key, case when quality = 1 then 'yes' else 'no' end as label, lower(lang) as note from documents join labels using (doc_id)")
def review_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("key"), F.when(F.col("quality") == 1, " Yes ").otherwise("NO").alias("label"), F.col("lang").alias("note"))
    return _there_and_back(spark, lambda at: sinks.csv(df, at), lambda at: readers.review_csv(spark, at, ["key", "label", "note"], "key"))


@query(f"with {PRED} select format('batch_{{:03d}}', cast(ceil(n / 40) as integer)) as batch, count(*) as n from (select row_number() over (order by ord) as n from pred) group by 1")
def batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predictions(spark, sf_dir).select("item_id", "ord")
    return _there_and_back(spark, lambda at: sinks.in_batches(df, at, 40, ["ord"]), lambda at: spark.read.json(at)).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {PRED} select language as run, cast(count(*) as varchar) as total, cast(count(*) filter (where status = 'answered') as varchar) as answered from pred group by language")
def summary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries as JSON documents, one for each language, read back as a table."""
    rows = predictions(spark, sf_dir).groupBy("language").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "answered").alias("answered")).collect()  # two rows

    def write(at: str) -> None:
        for r in rows:
            sinks.document({"overall": {"total": r.total, "answered": r.answered}}, f"{at}/{r.language}/summary.json")

    return _there_and_back(spark, write, lambda at: readers.summaries(spark, f"{at}/*/summary.json", {"total": "$.overall.total", "answered": "$.overall.answered"}))


# -- statistics ------------------------------------------------------------------------------------------

FLIPS = [(k, n) for n in (1, 2, 9, 20, 33) for k in range(0, n + 1, 3)]


@query(f"""with {PRED}, {PAIRS}, f as (select k, n from {_values(FLIPS)} as v(k, n) union all select count(*) filter (where en > az), count(*) filter (where en <> az) from pairs group by task, pair_id % 3)
    select k, n, round(least(1.0, list_sum(list_filter(list_transform(range(0, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))),
    lambda x: x <= exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)) * (1 + 1e-9)))), 9) as p_value from f""")
def binomial_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the discordant pairs of each task and third part from a half, and cases of our own."""
    apart = _paired(spark, sf_dir).groupBy("task", (F.col("pair_id") % 3).alias("third")).agg(F.count_if(F.col("en") > F.col("az")).alias("k"), F.count_if(F.col("en") != F.col("az")).alias("n"))
    rows = apart.select("k", "n").unionByName(_literal(spark, FLIPS, "k long, n long"))
    return rows.select("k", "n", F.round(stats.binomial_test(F.col("k"), F.col("n")), 9).alias("p_value"))


@query(f"with {PRED} select item_id, is_answerable and status = 'answered' or not is_answerable and status = 'abstained' as reliable from pred")
def reliable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = predictions(spark, sf_dir)
    return df.select("item_id", rel.reliable(rel.outcome(F.col("is_answerable"), F.col("status"))).alias("reliable"))


@query("select doc_id, len(regexp_extract_all(text, '\\S+')) as n from documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.word_count(F.col("text")).alias("n"))
