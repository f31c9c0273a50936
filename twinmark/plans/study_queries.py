"""Queries over files in their order, third reviews, quotas, power and intervals, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinmark.functions import text as tx
from twinmark.operators import adjudicate as ad
from twinmark.operators import overlap, quota, split, stats
from twinmark.operators import pairs as pr
from twinmark.operators import summaries as sm
from twinmark.plans.more_queries import _meta, _there_and_back
from twinmark.plans.queries import _MODELS, _OV, REPLICATES, _crowded, _paired, _texts, _two_models, query
from twinmark.plans.views import PAIRS, PRED, norm_sql, predictions
from twinmark.session import table
from twinmark.sources import readers, sinks

# -- files in their order --------------------------------------------------------------------------------

_FILED = "filed as (select * replace (cast(floor(ord / 8) as bigint) as pair_id), (ord // 3) % 4 as part, ((ord // 3) % 4) * 1000000000 + ord as place from pred)"


def _filed(spark: SparkSession, sf_dir: str, key: str = "item_id") -> tuple[DataFrame, list[str]]:
    """Predictions dealt over four folders, in the order of ord within each; repeated keys stand in several files."""
    df = _crowded(spark, sf_dir).withColumn("part", F.floor(F.col("ord") / 3) % 4)
    df = df.withColumn("key", F.col(key).cast("string"))
    return df.repartitionByRange(4, "part", "ord").sortWithinPartitions("part", "ord"), ["part"]


def _filed_rows(df: DataFrame, by: list[str]):
    record = df.select(F.col("key").alias("item_id"), F.col("pair_id").cast("string").alias("pair_id"), "language", "task", "question", "reference_answer", F.col("item_id").alias("prediction"), _meta(), *by)
    return lambda at: sinks.rows(record, at, by=by)


def _in_order(which: str) -> str:
    return f"""with {PRED}, {_FILED} select cast(pair_id as varchar) as pair_id, arg_{which}(item_id, place) filter (where language = 'en') as source_item, arg_{which}(item_id, place) filter (where language = 'az') as target_item
        from filed group by pair_id having count(distinct language) = 2"""


def _by_files(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    back = _there_and_back(spark, _filed_rows(*_filed(spark, sf_dir)), lambda at: readers.predictions(spark, at))
    both = pr.pair_up(back, ["prediction"], [], which, "position").where("n_source > 0 and n_target > 0")
    return both.select("pair_id", F.col("source.prediction").alias("source_item"), F.col("target.prediction").alias("target_item"))


@query(_in_order("max"))
def file_order_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose sides stand in several files several times: the last row of each side, as the files go."""
    return _by_files(spark, sf_dir, "last")


@query(_in_order("min"))
def file_order_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_files(spark, sf_dir, "first")


@query(f"with {PRED}, {_FILED} select cast(pair_id as varchar) as item_id, arg_max(item_id, place) as last_row, count(*) as n from filed where is_answerable group by pair_id")
def answerable_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answerable rows, keyed: where a key comes again, in the same file or another, its last row counts."""

    def read(at: str) -> DataFrame:
        n = readers.answerable(spark, at).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
        return readers.answerable_by_item(spark, at).join(n, "item_id").select("item_id", F.col("prediction").alias("last_row"), "n")

    return _there_and_back(spark, _filed_rows(*_filed(spark, sf_dir, "pair_id")), read)


@query(f"with {PRED} select cast(language as varchar) as part, row_number() over (partition by language order by ord) * 2 as line, item_id from pred")
def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that each record stands on, where every second line is blank."""
    df = predictions(spark, sf_dir).select(F.concat(F.lit("\n"), F.col("item_id")).alias("value"), F.col("language").alias("part"), "ord")

    def write(at: str) -> None:
        one = df.repartition(2, "part").sortWithinPartitions("part", "ord")
        one.select("value", "part").write.partitionBy("part").text(at)

    def read(at: str) -> DataFrame:
        rows = readers.numbered_lines(readers.lines(spark, at))
        return rows.where("value <> ''").select(F.regexp_extract("position.path", "part=([a-z]+)", 1).alias("part"), "line", F.col("value").alias("item_id"))

    return _there_and_back(spark, write, read)


@query(f"with {PRED}, s as (select language, avg(correct) as accuracy from pred group by language) select item_id, language, s.accuracy from pred join s using (language)")
def bundle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table and its summary as one bundle, written twice over, read back as one."""
    df = predictions(spark, sf_dir).select("item_id", "language", "correct")

    def write(at: str) -> None:
        sinks.bundle({"rows": df.limit(1)}, {}, at)
        sinks.bundle({"rows": df}, {"summary": [sm.by_dimensions(df, {"language": ["language"]}, sm.capability())]}, at, overwrite=True)

    def read(at: str) -> DataFrame:
        got = sinks.read_bundle(spark, at)
        told = spark.createDataFrame([(k, v["accuracy"]) for k, v in got["summary"]["language"].items()], "language string, accuracy double")
        return got["rows"].join(told, "language").select("item_id", "language", "accuracy")

    return _there_and_back(spark, write, read)


# -- third review ----------------------------------------------------------------------------------------

_THIRD = """first as (select doc_id, case when doc_id % 7 = 0 then 'uncertain' when quality = 1 then 'yes' else 'no' end as label, text as shown from documents join labels using (doc_id)),
    second as (select doc_id, case when toxic = 0 then 'yes' else 'no' end as label, case when doc_id % 53 = 0 then 'other' else text end as shown from documents join labels using (doc_id) where doc_id % 59 <> 0),
    asked as (select doc_id, a.label as r1, b.label as r2 from first a join second b using (doc_id) where a.label <> b.label or a.label = 'uncertain'),
    given as (select doc_id, case when doc_id % 43 = 0 then 'no' else r1 end as r1, r2, case when doc_id % 9 = 0 then 'no' else '' end as before from asked where doc_id % 41 <> 0),
    third as (select doc_id, case when doc_id % 47 = 0 then 'changed' else f.shown end as shown, case doc_id % 4 when 0 then 'yes' when 1 then 'no' when 2 then 'uncertain' else 'maybe' end as label, case when doc_id % 3 = 0 then '' else 'note' end as note
        from asked join first f using (doc_id) where doc_id % 37 <> 0)"""


def _reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("doc_id")
    yes = lambda c: F.when(c, "Yes ").otherwise(" no")
    first = docs.select("doc_id", F.when(n % 7 == 0, "uncertain").otherwise(yes(F.col("quality") == 1)).alias("label"), F.col("text").alias("shown"))
    second = docs.where(n % 59 != 0).select("doc_id", yes(F.col("toxic") == 0).alias("label"), F.when(n % 53 == 0, "other").otherwise(F.col("text")).alias("shown"))
    asked = ad.packet(first, second, "doc_id", "label", ["shown"])
    given = asked.where(n % 41 != 0).select("doc_id", F.when(n % 43 == 0, "no").otherwise(F.col("reviewer1")).alias("reviewer1"), "reviewer2", F.when(n % 9 == 0, "no").otherwise("").alias("final_adjudication"))
    said = F.when(n % 4 == 0, "YES").when(n % 4 == 1, "no").when(n % 4 == 2, "uncertain").otherwise("maybe")
    third = asked.where(n % 37 != 0).select("doc_id", F.when(n % 47 == 0, "changed").otherwise(F.col("shown")).alias("shown"), said.alias("final_adjudication"), F.when(n % 3 == 0, " ").otherwise("note").alias("reviewer_notes"))
    return first, second, given, third


_APART = "select doc_id, '{0}' as rule from (select doc_id, 1 as a, 0 as b from {1} union all select doc_id, 0, 1 from {2}) group by doc_id having sum(a) <> sum(b)"


@query(
    f"""with {_THIRD} {_APART.format('reviewers_differ_in_keys', 'first', 'second')} union all {_APART.format('third_differs_in_keys', 'given', 'third')}
    union all {_APART.format('packet_differs_in_keys', 'asked', 'given')}
    union all select doc_id, 'label_of_label' from third where label = 'maybe'
    union all select doc_id, 'second_text_differs' from first a join second b using (doc_id) where a.shown <> b.shown
    union all select doc_id, 'third_text_differs' from first a join third b using (doc_id) where a.shown <> b.shown
    union all select doc_id, 'packet_differs_in_labels' from given g join asked a using (doc_id) where g.r1 <> a.r1 or g.r2 <> a.r2
    union all select doc_id, 'uncertain_without_note' from third where label = 'uncertain' and note = ''
    union all select doc_id, 'earlier_decision' from given join third using (doc_id) where before <> '' and before <> label"""
)
def third_review_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third reviewer's file against the packet asked for, with keys, labels and texts that differ."""
    return ad.third_review(*_reviews(spark, sf_dir), "doc_id", "label", ["shown"])[0]


@query(f"with {_THIRD} select doc_id, r1 as reviewer1, r2 as reviewer2, case when label in ('yes', 'no') then label else '' end as final, label in ('yes', 'no') as resolved from given join third using (doc_id)")
def third_review_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.third_review(*_reviews(spark, sf_dir), "doc_id", "label", ["shown"])[1]


# -- quotas ----------------------------------------------------------------------------------------------

_QUOTAS = """quotas as (select lang as language, 't' || doc_id % 3 as task, count(*) as count from documents where doc_id % 50 <> 7 group by all),
    totals as (select lang as language, count(*) as count from documents where lang <> 'en' group by lang)"""


def _quotas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").withColumn("task", F.concat(F.lit("t"), F.col("doc_id") % 3)).withColumnRenamed("lang", "language")
    return docs.where("doc_id % 50 <> 7").groupBy("language", "task").count(), docs.where("language <> 'en'").groupBy("language").count()


@query(
    f"""with {_QUOTAS}, b as (select language, sum(q.count) as asked, max(t.count) as total from quotas q full join totals t using (language) group by language)
    select 'language_not_declared' as rule, language as key, cast(asked as varchar) as detail from b where total is null
    union all select 'language_quota', language, asked || ' of ' || total from b where asked <> total
    union all select 'total_quota', 'all', sum(asked) || ' of 100' from b having sum(asked) <> 100"""
)
def quota_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.quota_violations(*_quotas(spark, sf_dir), 100)


@query(f"""with {_QUOTAS}, r as (select language, task, unnest(range(1, count + 1)) as task_index from quotas)
    select 'cand_' || case when n < 10000 then lpad(cast(n as varchar), 4, '0') else cast(n as varchar) end as item_id, language, task, task_index from (select *, row_number() over (order by language, task, task_index) as n from r)""")
def quota_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate record for each unit of the quotas, numbered through."""
    return quota.candidates(_quotas(spark, sf_dir)[0], ["language", "task"], "cand_").select("item_id", "language", "task", F.col("task_index").cast("long").alias("task_index"))


_BANK = f"""keyed as (select doc_id % 6 as slot, doc_id, {norm_sql('text')} as k from documents where text is not null),
    bank as (select slot, doc_id from (select *, row_number() over (partition by k order by doc_id) as nth from keyed where k not in (select {norm_sql('text')} from benchmark)) where nth = 1),
    demand as (select slot, case when slot % 2 = 0 then n * 3 // 2 when slot = 5 then n // 8 else n // 4 end as asked from (select doc_id % 6 as slot, count(*) as n from documents group by all)),
    sized as (select d.slot, d.asked, coalesce(b.n, 0) as capacity from demand d left join (select slot, count(*) as n from bank group by slot) b using (slot)),
    net as (select *, sum(asked - capacity) over (order by slot) as net from sized),
    over_ as (select *, net - least(0, min(net) over (order by slot)) as over from net),
    told as (select *, asked + coalesce(lag(over) over (order by slot), 0) - over as taken from over_)"""


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").withColumn("slot", F.col("doc_id") % 6)
    bank = docs.where("text is not null").select("slot", "doc_id", "text")
    key = tx.normalize_answer(F.col("text"))
    bank = quota.unused(bank, key, "doc_id", table(spark, sf_dir, "benchmark").select("text"), key).select("slot", "doc_id")
    n = F.col("n")
    asked = F.when(F.col("slot") % 2 == 0, F.expr("n * 3 div 2")).when(F.col("slot") == 5, F.expr("n div 8")).otherwise(F.expr("n div 4"))
    demand = docs.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).select("slot", asked.alias("asked"))
    return quota.assign(demand, bank, "slot", "doc_id")


@query(f"""with {_BANK}, r as (select slot, unnest(range(1, asked + 1)) as index from demand), rn as (select *, row_number() over (order by slot, index) as n from r),
    e as (select b.slot as from_slot, doc_id, taken, row_number() over (partition by b.slot order by doc_id) as place from bank b join told t on b.slot = t.slot),
    en as (select from_slot, doc_id, row_number() over (order by from_slot, doc_id) as n from e where place <= taken)
    select slot, cast(index as integer) as index, from_slot, doc_id from rn join en using (n)""")
def bank_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests met from banks of unused, different texts; what a bank lacks moves on to the next."""
    return _assigned(spark, sf_dir)[0].select("slot", "index", "from_slot", "doc_id")


@query(f"with {_BANK} select cast(over as bigint) as short from told where slot = (select max(slot) from told) and over > 0")
def bank_shortage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)[1]


# -- power and intervals ---------------------------------------------------------------------------------

_GROUPS = f"""{PAIRS}, g as (select task, count(*) as n, count(*) filter (where en <> az) as k from pairs group by task union all select 'all', count(*), count(*) filter (where en <> az) from pairs)"""
_TESTED = """cells as (select m, unnest(range(0, m + 1)) as k from (select unnest(range(0, (select max(n) + 1 from g))) as m)),
    judged as (select m, k, least(1.0, 2 * list_sum(list_transform(range(0, least(k, m - k) + 1), lambda j: exp(lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) - m * ln(2))))) <= 0.05 + 1e-12 as hit from cells),
    hits as (select m, k from judged where hit)"""


def _power_sql(cases: str) -> str:
    """power by (task, x) for the rows task, n, d (share discordant) and x (difference) of the cases."""
    log = lambda p: f"case when {p} <= 0 then -1e9 else ln({p}) end"
    chance = f"exp(lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) + case when m = 0 then 0 else m * ({log('d')}) end + case when m = n then 0 else (n - m) * ({log('1 - d')}) end)"
    share = f"exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + case when k = 0 then 0 else k * ({log('(d + x) / (2 * d)')}) end + case when k = m then 0 else (m - k) * ({log('1 - (d + x) / (2 * d)')}) end)"
    return f"select task, x, sum({chance} * {share}) as power from {cases} join hits on m <= n group by task, x"


def _discordant(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _paired(spark, sf_dir)
    each = both.select(F.explode(F.array("task", F.lit("all"))).alias("task"), (F.col("en") != F.col("az")).alias("apart"))
    return each.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_if("apart").alias("k"))


@query(f"""with {PRED}, {_GROUPS}, {_TESTED}, x as (select task, n, k / n as d, 0.1 as x from g where k > 0 and k / n >= 0.1), p as ({_power_sql('x')})
    select g.task, g.n, g.k, case when x.task is null then null else round(coalesce(p.power, 0), 9) end as power from g left join x using (task) left join p on p.task = g.task""")
def power_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of the exact test to find a difference of a tenth, for each task's pairs and all of them."""
    return _discordant(spark, sf_dir).select("task", "n", "k", F.round(stats.power_of(F.col("n"), F.col("k"), F.lit(0.1)), 9).alias("power"))


@query(
    f"""with {PRED}, {PAIRS} select metric, round(max(value) filter (where k = {int(0.025 * REPLICATES)}), 9) as low, round(max(value) filter (where k = {int(0.975 * REPLICATES) - 1}), 9) as high from (
        select metric, value, row_number() over (partition by metric order by value) - 1 as k from (
            with {_MODELS}, m as (select *, row_number() over (order by pair_id) as at, count(*) over () as n from models),
            d as (select r.r as replicate, ('0x' || substr(md5('29|' || r.r || '|' || i.i), 1, 8))::bigint % m.n + 1 as at from range(1, {REPLICATES + 1}) as r(r), m cross join lateral (select m.at as i) as i),
            b as (select replicate, avg(base_en) as en_accuracy, avg(base_az) as az_accuracy, avg(base_en) - avg(base_az) as en_az_gap from d join m on d.at = m.at group by replicate)
            select metric, value from (unpivot b on en_accuracy, az_accuracy, en_az_gap into name metric value value)))
    group by metric"""
)
def single_model_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model's accuracies and gap: percentile intervals over pairs drawn with replacement."""
    df = _two_models(spark, sf_dir)
    return stats.bootstrap(df, stats.single_metrics(), REPLICATES, seed=29).select("metric", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query()
def paired_intervals_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paired intervals with draws counted by kinds of pairs: any number of pairs, the same cost."""
    df = _two_models(spark, sf_dir)
    return stats.bootstrap_by_kind(df, ["base_en", "base_az", "adapted_en", "adapted_az"], stats.paired_metrics(df), REPLICATES)


# -- overlap in order ------------------------------------------------------------------------------------


@query(
    f"""with a as (select doc_id, list_distinct({_OV}) as s, array_to_string({_OV}, ' ') as k from documents),
    b as (select item_id, list_distinct({_OV}) as s, array_to_string({_OV}, ' ') as k from benchmark),
    j as (select doc_id as left_id, item_id as right_id, len(list_intersect(a.s, b.s)) as n, len(a.s) + len(b.s) as m from a, b where a.k <> b.k)
    select row_number() over (order by n / (m - n) desc, left_id, right_id) as place, left_id, right_id from j where n / nullif(m - n, 0) >= 0.2"""
)
def similar_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar texts, the most similar first."""
    return overlap.ranked(overlap.similar(*_texts(spark, sf_dir), 0.2)).select("place", "left_id", "right_id")


def _review_status() -> Column:
    return F.when(F.col("status") == "answered", "approved").when(F.col("status") == "empty", "rejected").otherwise("pending")


@query(f"""with {PRED} select case status when 'answered' then 'approved' when 'empty' then 'rejected' else 'pending' end as review_status, count(*) as total, count(*) filter (where language = 'en') as en from pred group by 1""")
def review_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by review status; a status that isn't one is an error."""
    df = predictions(spark, sf_dir).withColumn("review_status", _review_status())
    return sm.status_counts(df, "review_status", ["approved", "rejected", "pending"], "item_id").join(df.where("language = 'en'").groupBy("review_status").agg(F.count(F.lit(1)).alias("en")), "review_status", "left").na.fill(0, ["en"])


@query(f"with {PRED} select item_id, pair_id, language from pred where status = 'answered'")
def approved_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.with_status(predictions(spark, sf_dir).withColumn("review_status", _review_status()), "approved").select("item_id", "pair_id", "language")


@query(f"""with l as (select lang as name, count(*) / sum(count(*)) over () as share, row_number() over (order by lang) as ord from documents group by lang), e as (select *, round(share * 1000, 9) as exact from l),
    w as (select *, floor(exact) as whole, exact - floor(exact) as part from e)
    select name, cast(whole + case when row_number() over (order by part desc, ord) <= 1000 - sum(whole) over () then 1 else 0 end as integer) as count from w""")
def language_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand records dealt to languages by their shares of the corpus, by largest remainders."""
    n = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("all"))
    shares = n.crossJoin(F.broadcast(total)).select("name", (F.col("n") / F.col("all")).alias("share"))
    return split.allocate_rows(split.numbered(shares, ["name"], "ord"), 1000)
