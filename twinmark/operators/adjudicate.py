"""Reviewers' labels: agreement, disagreements, cascades of decisions, and bounds for what stays open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinmark.functions.text import blind_id, label
from twinmark.operators.stats import kappa, mcnemar

LABELS = ("yes", "no")


def align(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of both by key with a_<column>, b_<column>, and side: both, first_only or second_only."""
    a = first.select(F.col(key), *(F.col(c).alias(f"a_{c}") for c in first.columns if c != key), F.lit(True).alias("_a"))
    b = second.select(F.col(key), *(F.col(c).alias(f"b_{c}") for c in second.columns if c != key), F.lit(True).alias("_b"))
    side = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "first_only").otherwise("second_only")
    return a.join(b, key, "full").withColumn("side", side).drop("_a", "_b")


def long_labels(aligned: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, a, b: one row for each label field of rows that both reviewers have."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), label(F.col(f"a_{f}")).alias("a"), label(F.col(f"b_{f}")).alias("b")) for f in fields)))
    return aligned.where("side = 'both'").select(key, each.alias("x")).select(key, "x.*")


def agreement(labels: DataFrame, chance_one: float | None = None) -> DataFrame:
    """Per field: complete and missing labels, agreements, raw agreement, kappa."""
    filled = labels.where("a <> '' and b <> ''")
    missing = labels.groupBy("field").agg(F.count_if((F.col("a") == "") | (F.col("b") == "")).alias("missing"))
    return missing.join(kappa(filled, "a", "b", ["field"], chance_one), "field", "left").select("field", F.coalesce("n", F.lit(0)).alias("complete"), "missing", F.coalesce("agreements", F.lit(0)).alias("agreements"), "raw_agreement", "kappa")


def distribution(labels: DataFrame) -> DataFrame:
    """field, reviewer, label, n."""
    each = F.explode(F.array(F.struct(F.lit("first").alias("reviewer"), F.col("a").alias("label")), F.struct(F.lit("second").alias("reviewer"), F.col("b").alias("label"))))
    return labels.select("field", each.alias("x")).groupBy("field", "x.reviewer", "x.label").agg(F.count(F.lit(1)).alias("n"))


def disagreements(labels: DataFrame) -> DataFrame:
    return labels.where("a <> b and a <> '' and b <> ''")


def cascade(first: Column, second: Column, third: Column, fourth: Column) -> tuple[Column, Column]:
    """(label, stage): what two reviewers agree on, else the fourth's word if asked, else the third's."""
    clear = lambda c: c.isin(*LABELS)
    agreed = (first == second) & clear(first)
    value = F.when(agreed, first).when(fourth.isNotNull(), F.when(clear(fourth), fourth)).when(clear(third), third)
    stage = F.when(agreed, "initial_agreement").when(fourth.isNotNull(), F.when(clear(fourth), "fourth_review").otherwise("unresolved_fourth_uncertain")).when(clear(third), "third_review").otherwise("unresolved")
    return value, stage


def bounds(df: DataFrame, by: list[str], value: str = "label") -> DataFrame:
    """Per group: yes, no, unresolved, and the share of yes if all open labels were no, or yes."""
    yes, n = F.count_if(F.col(value) == "yes"), F.count(F.lit(1))
    open_ = F.count_if(F.col(value).isNull() | ~F.col(value).isin(*LABELS))
    return df.groupBy(*by).agg(n.alias("total"), yes.alias("yes"), F.count_if(F.col(value) == "no").alias("no"), open_.alias("unresolved"), (yes / n).alias("lower_rate"), ((yes + open_) / n).alias("upper_rate"))


def p_value_bounds(pairs: DataFrame, by: str) -> DataFrame:
    """Lowest and highest exact p over all ways to resolve open labels; pairs: by, en, az (null: open).

    Each pair adds (1, 0), (0, 1) or nothing to the discordant counts b and c, or one of several if labels are
    open: u pairs may add to b, v to c, w to either. On the side where b is the larger, p falls with b and rises with c, and
    the other way round on the other side. So the lowest p is at a corner of the states that can be reached, all open
    pairs for one count and none for the other; the highest is 1 if the two counts can meet, else at the corner nearest to
    where they would. Four numbers a group, whatever the number of open pairs."""
    en, az = F.col("en"), F.col("az")
    may_b = F.coalesce(en == "yes", F.lit(True)) & F.coalesce(az == "no", F.lit(True))
    may_c = F.coalesce(en == "no", F.lit(True)) & F.coalesce(az == "yes", F.lit(True))
    fixed = en.isNotNull() & az.isNotNull()
    n = pairs.groupBy(by).agg(
        F.count_if(fixed).alias("complete_pairs"),
        F.count_if(~fixed).alias("uncertain_pairs"),
        F.count_if(fixed & may_b).alias("b"),
        F.count_if(fixed & may_c).alias("c"),
        F.count_if(~fixed & may_b).alias("more_b"),
        F.count_if(~fixed & may_c).alias("more_c"),
    )
    b, c, most_b, most_c = F.col("b"), F.col("c"), F.col("b") + F.col("more_b"), F.col("c") + F.col("more_c")
    low = F.least(mcnemar(most_b, c), mcnemar(b, most_c))
    high = F.when(b > most_c, mcnemar(b, most_c)).when(c > most_b, mcnemar(most_b, c)).otherwise(F.lit(1.0))
    return n.select(by, "complete_pairs", "uncertain_pairs", low.alias("min_p"), high.alias("max_p"))


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One row: how many rows there are, and two sums over hashes of them, which any order of the rows gives alike."""
    hashes = [F.xxhash64(*(F.lit(salt) if c is None else F.col(c) for c in (None, *columns)), F.concat_ws("", *(F.col(c).isNull().cast("string") for c in columns))) for salt in (1, 2)]
    return df.agg(F.count(F.lit(1)).alias("n"), *(F.sum(h.cast("decimal(38,0)")).alias(f"sum_{i}") for i, h in enumerate(hashes)))


def same_rows(first: DataFrame, second: DataFrame, *columns: str) -> bool:
    """Whether both hold the same rows equally often, by their fingerprints: one pass over each, without a shuffle of rows."""
    a, b = (fingerprint(df, *columns).first() for df in (first, second))  # one row each
    return a == b


def unmatched(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """key, n_first, n_second of the keys that the two tables don't hold equally often. Where fingerprints agree nothing more is read."""
    if same_rows(first, second, key):
        return first.select(key, F.lit(0).cast("long").alias("n_first"), F.lit(0).cast("long").alias("n_second")).where(F.lit(False))
    one = lambda df, a, b: df.select(key, F.lit(a).alias("a"), F.lit(b).alias("b"))
    both = one(first, 1, 0).unionByName(one(second, 0, 1)).groupBy(key).agg(F.sum("a").alias("n_first"), F.sum("b").alias("n_second"))
    return both.where("n_first <> n_second")


ANSWERS = (*LABELS, "uncertain")


def packet(first: DataFrame, second: DataFrame, key: str, value: str, shown: list[str]) -> DataFrame:
    """What a third reviewer is asked: rows that two reviewers (key, value, shown) label differently, or that the first one is not
    sure of; reviewer1 and reviewer2 are their labels."""
    both = align(first.select(key, value, *shown), second.select(key, value), key)
    a, b = label(F.col(f"a_{value}")), label(F.col(f"b_{value}"))
    return both.where((F.col("side") == "both") & ((a != b) | (a == "uncertain"))).select(key, *(F.col(f"a_{c}").alias(c) for c in shown), a.alias("reviewer1"), b.alias("reviewer2"))


def third_review(first: DataFrame, second: DataFrame, pending: DataFrame, third: DataFrame, key: str, value: str, shown: list[str], final: str = "final_adjudication", notes: str = "reviewer_notes") -> tuple[DataFrame, DataFrame]:
    """(violations, decided): a third reviewer's labels against the packet they were asked for.

    Violations (key, rule): keys that only one of two tables has, labels outside yes, no and uncertain, texts that differ from
    the first reviewer's, a packet that isn't what the two reviewers' labels ask for or gives their labels wrongly, an uncertain
    label without a note, an earlier decision that would change. decided: key, reviewer1, reviewer2, the final label (blank where
    uncertain), and whether it is resolved. Tables are compared by fingerprints first, and key by key only where those differ."""
    word = lambda c: label(F.coalesce(F.col(c), F.lit("")))
    rule = lambda df, name: df.select(key, F.lit(name).alias("rule"))
    text = F.xxhash64(*(F.coalesce(F.col(c), F.lit("")) for c in shown))
    side = lambda df, *more: df.select(key, text.alias("text"), *more)
    one, two = side(first, word(value).alias("one")), side(second, word(value).alias("two"))
    asked = packet(first, second, key, value, shown).select(key, "reviewer1", "reviewer2")
    given = pending.select(key, word("reviewer1").alias("reviewer1"), word("reviewer2").alias("reviewer2"), word(final).alias("before") if final in pending.columns else F.lit("").alias("before"))
    last = side(third, word(final).alias("label"), F.trim(F.coalesce(F.col(notes), F.lit(""))).alias("note"))
    found = [rule(unmatched(first, second, key), "reviewers_differ_in_keys"), rule(unmatched(given, last, key), "third_differs_in_keys"), rule(unmatched(asked, given, key), "packet_differs_in_keys")]
    found += [rule(df.where(~F.col(c).isin(*ANSWERS)), f"label_of_{c}") for df, c in ((one, "one"), (two, "two"), (last, "label"))]
    texts = one.withColumnRenamed("text", "own")
    if not same_rows(one, two, key, "text"):
        found.append(rule(two.join(texts, key).where("text <> own"), "second_text_differs"))
    found.append(rule(last.join(texts, key).where("text <> own"), "third_text_differs"))
    if not same_rows(asked, given, key, "reviewer1", "reviewer2"):
        renamed = asked.select(key, F.col("reviewer1").alias("a"), F.col("reviewer2").alias("b"))
        found.append(rule(given.join(renamed, key).where("reviewer1 <> a or reviewer2 <> b"), "packet_differs_in_labels"))
    met = given.join(last.drop("text"), key)
    found.append(rule(last.where("label = 'uncertain' and note = ''"), "uncertain_without_note"))
    found.append(rule(met.where("before <> '' and before <> label"), "earlier_decision"))
    violations = found[0]
    for f in found[1:]:
        violations = violations.unionByName(f)
    sure = F.col("label").isin(*LABELS)
    return violations, met.select(key, "reviewer1", "reviewer2", F.when(sure, F.col("label")).otherwise("").alias("final"), sure.alias("resolved"))


def blind_packet(answers: DataFrame, salt: str, seed: int) -> DataFrame:
    """Answers of several models under blind ids, in an order that tells nothing: audit_id, place, and the rest."""
    key = blind_id(salt, F.col("model"), F.col("item_id"))
    return answers.withColumn("audit_id", key).withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("audit_id"))))


def fold_models(results: DataFrame, questions: DataFrame) -> DataFrame:
    """One row an item: its question and a map from model to answer and score."""
    entry = F.struct("model", F.struct("prediction", "correct"))
    folded = results.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("answers"))
    return folded.join(questions.select("item_id", "question", "reference_answer"), "item_id", "left")


def against_rules(df: DataFrame, by: list[str]) -> DataFrame:
    """Per group: human and rule-based abstention rates and how many rows differ. human: yes or no; rule_status."""
    rule, human = F.col("rule_status") == "abstained", F.col("human") == "yes"
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(n.alias("total"), (F.count_if(human) / n).alias("human_rate"), (F.count_if(rule) / n).alias("rule_rate"), F.count_if(human != rule).alias("mismatches"))
