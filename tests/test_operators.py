import math

import pytest
from pyspark.sql import functions as F

from twinmark.operators import adjudicate as ad
from twinmark.operators import build, overlap, split, stats
from twinmark.operators import pairs as pr
from twinmark.operators import summaries as sm
from twinmark.operators import validate as va

GOLDEN = [(7, 11, 0.480682373046875), (9, 6, 0.60723876953125), (15, 19, 0.6075913612730801), (0, 0, 1.0), (8, 8, 1.0)]


def test_mcnemar_goldens(spark):
    df = spark.createDataFrame([r[:2] for r in GOLDEN], "b int, c int")
    got = [r.p for r in df.select(stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()]
    assert got == pytest.approx([r[2] for r in GOLDEN], abs=1e-11)


def test_power_goldens():
    assert stats.minimum_detectable_effect(61, 15 / 61) == pytest.approx(0.179694, abs=1e-5)
    assert stats.minimum_detectable_effect(61, 11 / 61) == pytest.approx(0.15202, abs=1e-4)
    assert stats.binomial_p(3, 5) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        stats.minimum_detectable_effect(5, 0.2)


def test_kappa_edges(spark):
    same = spark.createDataFrame([("yes", "yes")] * 5, "a string, b string")
    assert stats.kappa(same, "a", "b", []).first().kappa is None
    assert stats.kappa(same, "a", "b", [], chance_one=1.0).first().kappa == 1.0
    mixed = spark.createDataFrame([("yes", "yes"), ("yes", "no"), ("no", "no"), ("no", "no")], "a string, b string")
    assert stats.kappa(mixed, "a", "b", []).first().kappa == pytest.approx(0.5)


def test_holm_is_monotone_and_capped(spark):
    df = stats.holm(spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.9,)], "p_value double"))
    assert {r.p_value: round(r.p_holm, 6) for r in df.collect()} == {0.01: 0.04, 0.03: 0.09, 0.04: 0.09, 0.9: 0.9}


def test_p_value_bounds_equal_brute_force(spark):
    from itertools import product

    sides = [("yes", "no"), ("no", "yes"), (None, "no"), (None, None), ("yes", None), ("no", None), ("yes", "yes"), (None, None)]
    got = ad.p_value_bounds(spark.createDataFrame([("m", *s) for s in sides], "model string, en string, az string"), "model").first()

    def p(b, c):
        n = b + c
        return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n)

    every = []
    for filled in product(*(product(*([x] if x else ["yes", "no"] for x in s)) for s in sides)):
        every.append(p(sum(s == ("yes", "no") for s in filled), sum(s == ("no", "yes") for s in filled)))
    assert (got.min_p, got.max_p) == pytest.approx((min(every), max(every)), abs=1e-11)
    assert (got.complete_pairs, got.uncertain_pairs) == (3, 5)


def test_bootstrap_of_equal_pairs_has_no_width(spark):
    df = spark.createDataFrame([(i, 1, 0, 1, 1) for i in range(7)], "pair_id int, base_en int, base_az int, adapted_en int, adapted_az int")
    got = {r.metric: (r.low, r.high) for r in stats.bootstrap(df, stats.paired_metrics(df), 50).collect()}
    assert got["base_gap"] == (1.0, 1.0) and got["gap_change"] == (-1.0, -1.0)


def test_bootstrap_is_the_same_by_broadcast_and_by_shuffle(spark):
    df = spark.createDataFrame([(i, i % 2, i % 3 % 2, 1, i % 5 % 2) for i in range(23)], "pair_id int, base_en int, base_az int, adapted_en int, adapted_az int")
    near, far = ({tuple(r) for r in stats.bootstrap(df, stats.paired_metrics(df), 40, most=m).collect()} for m in (100, 0))
    assert near == far and len(near) == 9


def test_pairing_policies(spark):
    df = spark.createDataFrame([("p", "en", 1, 1), ("p", "en", 0, 2), ("p", "az", 1, 3), ("q", "en", 1, 4)], "pair_id string, language string, correct int, ord int")
    loose = pr.pair_up(df, ["correct"])
    assert not loose.where("pair_id = 'p'").select(pr.complete(loose).alias("x")).first().x
    last = pr.pair_up(df, ["correct"], duplicates="last", order="ord").where("pair_id = 'p'").first()
    first = pr.pair_up(df, ["correct"], duplicates="first", order="ord").where("pair_id = 'p'").first()
    assert (last.source.correct, first.source.correct) == (0, 1)


def test_summary_keys_tell_missing_from_zero(spark):
    df = spark.createDataFrame([("en", None, 1), ("en", "x", 0)], "language string, category string, correct int")
    got = {(r.dimension, r.key): r.accuracy for r in sm.by_dimensions(df, {"overall": [], "category": ["category"]}, sm.capability()).collect()}
    assert got == {("overall", "all"): 0.5, ("category", "__missing__"): 1.0, ("category", "x"): 0.0}
    assert sm.gap(df, {"accuracy": F.avg("correct")}).first().gap is None


def test_rates_without_rows_are_zero(spark):
    df = spark.createDataFrame([("correct_answer", True)], "outcome string, is_answerable boolean")
    got = df.agg(*sm.reliability()).first()
    assert (got.over_answering_rate, got.under_answering_rate, got.decision_accuracy) == (0.0, 0.0, 1.0)


def test_similar_equals_all_pairs(spark):
    import random

    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 8))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for threshold in (0.3, 0.6, 1.0):
        got = {(r.left_id, r.right_id): round(r.similarity, 9) for r in overlap.similar(df, df, threshold).collect()}
        want = {}
        for i, a in enumerate(texts):
            for j, b in enumerate(texts):
                x, y = set(a.split()), set(b.split())
                if a.split() != b.split() and x | y and len(x & y) / len(x | y) >= threshold:
                    want[i, j] = round(len(x & y) / len(x | y), 9)
        assert got == want


def test_similar_plan_has_no_product(spark):
    df = spark.createDataFrame([(1, "a b")], "id int, text string")
    plan = overlap.similar(df, df, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_splits(spark):
    assert split.split_sizes(10, 0.7, 0.15, 0.15) == (7, 1, 2)
    with pytest.raises(ValueError):
        split.split_sizes(10, 0.9, 0.2, 0.1)
    df = spark.createDataFrame([(f"i{k}", k // 2) for k in range(40)], "item_id string, pair_id int")
    a = split.pair_split(df, 0.5, 0.25, 0.25, 1)
    assert {r.item_id: r.split for r in a.collect()} == {r.item_id: r.split for r in split.pair_split(df, 0.5, 0.25, 0.25, 1).collect()}
    assert va.split_integrity(a, df).count() == 0
    assert {r.split: r["count"] for r in a.groupBy("split").count().collect()} == {"train": 20, "dev": 10, "test": 10}


def test_halves_round_to_even(spark):
    df = spark.createDataFrame([(f"i{k}", "c") for k in range(25)], "item_id string, category string")
    assert split.stratified_split(df, "item_id", "category", 0.1, 5).where("split = 'valid'").count() == 2


def test_allocation():
    assert split.allocate(10, {"a": 0.35, "b": 0.35, "c": 0.3}) == {"a": 4, "b": 3, "c": 3}
    assert split.allocate(0, {"a": 1.0}) == {"a": 0}
    with pytest.raises(ValueError):
        split.allocate(3, {"a": 0.5})


@pytest.mark.parametrize("rule, rows", [("unique_item_id", [("a", "p", "en", "t"), ("a", "q", "en", "t")]), ("not_blank", [(" ", "p", "en", "t")]), ("allowed_language", [("a", "p", "xx", "t")]), ("complete_pairs", [("a", "p", "en", "t")]), ("one_task_per_pair", [("a", "p", "en", "t"), ("b", "p", "az", "u")]), ("unique_pair_id_language", [("a", "p", "en", "t"), ("b", "p", "en", "t")])])
def test_each_rule_finds_its_violation(spark, rule, rows):
    df = spark.createDataFrame(rows, "item_id string, pair_id string, language string, task string")
    found = va.benchmark(df, ["en", "az"], ["t", "u"], texts=False)
    assert rule in {r.rule for r in found.collect()}
    with pytest.raises(va.ConstraintError):
        va.check(found)


def test_design():
    good = {"total_pairs": 4, "tasks": {"a": {"pairs": 4, "categories": {"x": 1, "y": 3}, "is_answerable": True}}, "difficulty": {"easy": 1.0}, "splits": {"train": 3, "test": 1}}
    assert va.design(good) == []
    assert len(va.design({**good, "total_pairs": 5, "splits": {"train": 9}})) == 2


def test_review_and_approval(spark):
    df = spark.createDataFrame([("a", "p", "approved"), ("b", "p", None), ("c", "q", "approved")], "item_id string, pair_id string, review_status string")
    assert [r.item_id for r in pr.approved_pairs(df).collect()] == ["c"]
    with pytest.raises(ValueError):
        pr.set_status(df, "pair_id", "none", "review_status", "approved")
    assert pr.approved_pairs(pr.set_status(df, "pair_id", "p", "review_status", "approved")).count() == 3


def test_build_steps(spark):
    slots = spark.createDataFrame([("t", "c", True, 1), ("t", "d", True, 2)], "task string, category string, is_answerable boolean, ord int")
    plan = build.plan(slots, spark.createDataFrame([(1, "easy"), (2, "hard")], "ord int, difficulty string"))
    assert [(r.pair_id, r.difficulty) for r in plan.orderBy("ord").collect()] == [("t_0001", "easy"), ("t_0002", "hard")]
    asked = build.prompts(plan, {"task": {"t": "Do t."}, "difficulty": {"easy": "Simply."}}, "{task} {difficulty}!")
    assert [r.instruction for r in asked.orderBy("ord").collect()] == ["Do t. Simply.!", "Do t. !"]
    bank = spark.createDataFrame([("c", 0, "x"), ("c", 1, "y")], "category string, slot int, text string")
    made = build.templates(spark.createDataFrame([("c", 5)], "category string, count int"), bank)
    assert [r.text for r in made.orderBy("index").collect()] == ["x", "y", "x", "y", "x"]


def test_cascade_and_bounds(spark):
    rows = [("yes", "yes", None, None), ("yes", "no", "no", None), ("yes", "no", "uncertain", "yes"), ("yes", "no", "uncertain", "uncertain")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    value, stage = ad.cascade(*(F.col(x) for x in "abcd"))
    df = df.select(value.alias("label"), stage.alias("stage"))
    assert [r.label for r in df.collect()] == ["yes", "no", "yes", None]
    got = ad.bounds(df, []).first()
    assert (got.lower_rate, got.upper_rate) == (0.5, 0.75)


def test_adaptation_rules(spark):
    good = ("a", "az", "c", "Do it", "Done", "bank", "s", "generated", "pending")
    schema = "item_id string, language string, category string, instruction string, response string, source string, subcategory string, generation_status string, review_status string"
    assert va.adaptation(spark.createDataFrame([good], schema), "az", {"c": ["s"]}, 5, 5).count() == 0
    bad = [good, ("b", "en", "d", "do IT!", "", "bank", "t", "raw", "approved")]
    found = {r.rule for r in va.adaptation(spark.createDataFrame(bad, schema), "az", {"c": ["s"]}, 1, 5).collect()}
    assert found == {"not_blank", "allowed_language", "allowed_category", "allowed_generation_status", "allowed_review_status", "subcategory", "unique_instruction_text", "words_instruction"}


def test_top_k_in_blocks_is_the_same(spark):
    import random

    rng = random.Random(5)
    df = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)], "id int, vector array<double>")
    q = df.where("id % 10 = 0")
    whole = overlap.embedding_top_k(q, df, 3, others=True).orderBy("query_id", "rank").collect()
    parts = overlap.embedding_top_k(q, df, 3, most_queries=2, others=True).orderBy("query_id", "rank").collect()
    assert whole == parts and len(whole) == 18


def test_leaks_equal_all_pairs(spark):
    import difflib
    import re

    left = ["the cat sits on the mat and waits for dinner", "A b c", "", None, "entirely other words stand here", "the cat sits on a mat", "x" * 40]
    right = ["the cats sat on thy mats or waited far dinners", "a b d", "cat the on sits mat the", "the cat sits on the mat, and waits for dinner", "x" * 30, None]
    a = spark.createDataFrame(list(enumerate(left)), "id long, text string")
    b = spark.createDataFrame(list(enumerate(right)), "id long, text string")
    tokens = lambda t: re.findall(r"[0-9]+|[a-z]+", t.lower())
    for sequence, jaccard in ((0.72, 0.6), (0.5, 0.25), (0.9, 0.9)):
        want = set()
        for i, x in enumerate(left):
            for k, y in enumerate(right):
                if x is None or y is None or tokens(x) == tokens(y):
                    continue
                p, q = set(tokens(x)), set(tokens(y))
                if len(p & q) / len(p | q) >= jaccard or difflib.SequenceMatcher(None, x.lower(), y.lower(), autojunk=False).ratio() >= sequence:
                    want.add((i, k))
        assert {(r.left_id, r.right_id) for r in overlap.leaks(a, b, sequence, jaccard).collect()} == want
        assert ((0, 0) in want) == (sequence < 0.9)


def test_turns_of_a_large_conversation(spark):
    rows = [("large", i, "user" if i % 3 else "assistant", f"t{i}") for i in range(4000)]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", None), ("x", 0, "assistant", "b"), ("y", 7, "user", None), ("y", 9, "assistant", "c"), ("z", 0, "user", "d"), ("z", 1, "system", "e"), ("z", 2, "assistant", "f")]
    want = []
    for p, q in zip(rows, rows[1:], strict=False):
        if p[0] == q[0] and (p[2], q[2]) == ("user", "assistant"):
            want.append((p[0], p[1], p[3], q[3]))
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").withColumn("_n", F.lit(0)).repartition(5)
    assert sorted(map(tuple, build.turns(df).collect()), key=repr) == sorted(want, key=repr)
    assert build.turns(df.where("false")).count() == 0
