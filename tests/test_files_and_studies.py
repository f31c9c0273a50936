"""Files in order, bundles, review alignment, quotas, power, intervals and overlaps at odd sizes, against plain versions."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinmark.operators import adjudicate as ad
from twinmark.operators import overlap, quota, stats
from twinmark.operators.validate import ConstraintError
from twinmark.plans.evaluate import PUBLISHED_SUMMARIES, PUBLISHED_TABLES, evaluate
from twinmark.sources import readers, sinks


def record(pair, lang, n, **more):
    return {"item_id": f"{pair}_{lang}", "pair_id": pair, "language": lang, "task": "reasoning", "question": "?", "reference_answer": "42", "prediction": str(n), "metadata": {"category": "x", "difficulty": "easy", "is_answerable": True}, **more}


def test_lines_are_numbered_through_the_blocks_of_a_file(spark, tmp_path):
    rng = random.Random(1)
    want = []
    for f in range(3):
        lines = ["" if rng.random() < 0.3 else f"f{f} row {i} " + "x" * rng.randrange(60) for i in range(4000)]
        (tmp_path / f"f{f}.txt").write_text("\n".join(lines) + "\n")
        want += [(f"f{f}.txt", i + 1, v) for i, v in enumerate(lines) if v]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = readers.lines(spark, str(tmp_path))
        assert rows.select("position.block").distinct().count() > 5
        some = readers.numbered_lines(rows.where("value <> ''"), rows)
        assert sorted((r.file, r.line, r.value) for r in some.collect()) == sorted(want)
        bad = [json.dumps(record(f"p{i}", "en", i)) for i in range(900)]
        bad[700] = "{oops"
        (tmp_path / "bad.jsonl").write_text("\n\n".join(bad))
        with pytest.raises(readers.SourceError, match="bad.jsonl, line 1401: not a JSON object"):
            readers.predictions(spark, str(tmp_path / "bad.jsonl"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_last_row_wins_over_files(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"{f}.jsonl").write_text("\n".join(json.dumps(record(f"p{i % 5}", "en", 100 * f + i)) for i in range(12 - f)))
    got = {r.item_id: int(r.prediction) for r in readers.answerable_by_item(spark, str(tmp_path)).collect()}
    assert got == {"p0_en": 205, "p1_en": 206, "p2_en": 207, "p3_en": 208, "p4_en": 209}
    firsts = {r.item_id: int(r.prediction) for r in readers.latest(readers.predictions(spark, str(tmp_path)), "item_id", first=True).collect()}
    assert firsts == {f"p{i}_en": i for i in range(5)}


def test_banks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "a"}\n{"id": "2", "text": "b"}')
    assert readers.bank(spark, str(tmp_path / "a.jsonl"), "id", ("text",)).count() == 2
    (tmp_path / "b.jsonl").write_text('{"id": "1"}\n{"id": "1"}')
    with pytest.raises(ConstraintError):
        readers.bank(spark, str(tmp_path / "b.jsonl"), "id")
    (tmp_path / "c.jsonl").write_text("\n\n")
    with pytest.raises(readers.SourceError):
        readers.bank(spark, str(tmp_path / "c.jsonl"), "id")


def test_published_bundle(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(record(p, lang, n)) for p, lang, n in [("a", "en", 42), ("a", "az", 42), ("b", "en", 42), ("b", "az", 7)]))
    tables, summaries = evaluate(readers.predictions(spark, str(tmp_path / "p.jsonl"))).published()
    at = str(tmp_path / "out")
    made = sinks.bundle(tables, summaries, at)
    assert sorted(made) == sorted([*(f"{n}.jsonl" for n in PUBLISHED_TABLES), *(f"{n}.json" for n in PUBLISHED_SUMMARIES)]) and len(made) == 24
    got = sinks.read_bundle(spark, at)
    assert got["primary_capability_summary"]["overall"]["accuracy"] == 0.75
    assert got["task_aware_summary"]["language_gap"]["accuracy"]["gap"] == 0.5
    assert got["capability_summary"]["language_gap"]["accuracy"]["gap"] == 0.5
    assert got["paired_failure_analysis_summary"]["overall"] == {"total_pairs": 2, "preserved_behavior": 1, "language_degradation": 1, "language_recovery": 0, "shared_failure": 0, "behavior_preservation_rate": 0.5, "degradation_rate": 0.5, "recovery_rate": 0.0, "shared_failure_rate": 0.0}
    assert got["paired_task_aware_results"].count() == 2


def test_a_stopped_writer_leaves_the_old_bundle(spark, tmp_path, monkeypatch):
    at, df = str(tmp_path / "b"), spark.range(3)
    sinks.bundle({"rows": df}, {}, at)
    with pytest.raises(FileExistsError):
        sinks.bundle({"rows": df}, {}, at)

    def broken(*_):
        raise OSError("disk full")

    monkeypatch.setattr(sinks, "document", broken)
    with pytest.raises(OSError):
        sinks.bundle({"rows": spark.range(9)}, {}, at, overwrite=True)
    monkeypatch.undo()
    assert sinks.read_bundle(spark, at)["rows"].count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["b"]
    (tmp_path / "b").rename(tmp_path / "b.old")  # stopped between its two renames
    assert sinks.read_bundle(spark, at)["rows"].count() == 3
    sinks.bundle({"rows": spark.range(9)}, {}, at, overwrite=True)
    assert sinks.read_bundle(spark, at)["rows"].count() == 9 and [p.name for p in tmp_path.iterdir()] == ["b"]
    sinks.document({"a": 1}, str(tmp_path / "d.json"))
    sinks.document({"a": 2}, str(tmp_path / "d.json"), overwrite=True)
    assert json.loads((tmp_path / "d.json").read_text()) == {"a": 2}
    with pytest.raises(FileExistsError):
        sinks.document({"a": 3}, str(tmp_path / "d.json"))


def test_a_pair_without_a_scored_side_is_an_error(spark, tmp_path):
    rows = [record("a", "en", 42), record("a", "az", 42), record("b", "en", 42), record("b", "az", 42, task="unanswerable")]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)))
    with pytest.raises(ConstraintError):
        evaluate(readers.predictions(spark, str(tmp_path / "p.jsonl")))


def test_bounds_equal_enumeration(spark):
    rng = random.Random(2)

    def p(b, c):
        n = b + c
        return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n)

    rows, want = [], {}
    for g in range(40):
        sides = [(rng.choice(["yes", "yes", "no", None]), rng.choice(["no", "no", "yes", None])) for _ in range(rng.randrange(1, 9))]
        sides += rng.choice([[], [("yes", "no")] * 9, [("no", "yes")] * 8])
        rows += [(g, *s) for s in sides]
        open_ = [s for s in sides if None in s]
        b, c = sum(s == ("yes", "no") for s in sides), sum(s == ("no", "yes") for s in sides)
        every = [p(b + sum(s == ("yes", "no") for s in f), c + sum(s == ("no", "yes") for s in f)) for f in itertools.product(*([x for x in itertools.product(*([v] if v else ["yes", "no"] for v in s))] for s in open_))]
        want[g] = (min(every), max(every))
    got = {r.g: (r.min_p, r.max_p) for r in ad.p_value_bounds(spark.createDataFrame(rows, "g int, en string, az string"), "g").collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], abs=1e-11) for g in want)


def test_bounds_of_a_million_open_pairs(spark):
    df = spark.range(1_000_000).select(F.lit("m").alias("g"), F.when(F.col("id") % 2 == 0, "yes").alias("en"), F.lit(None).cast("string").alias("az"))
    got = ad.p_value_bounds(df, "g").first()
    assert (got.uncertain_pairs, got.min_p, got.max_p) == (1_000_000, 0.0, 1.0)


def test_power_equals_the_double_sum(spark):
    cases = [(61, 15), (30, 9), (16, 5), (122, 26), (5, 5)]
    df = spark.createDataFrame([(n, k, d) for n, k in cases for d in (0.0, 0.1, k / n)], "n int, k int, d double")
    for r in df.select("*", stats.power_of(F.col("n"), F.col("k"), F.col("d")).alias("power")).collect():
        want = stats.mcnemar_power(r.n, r.k / r.n, r.d) if r.d <= r.k / r.n else None
        assert r.power == (pytest.approx(want, abs=1e-11) if want is not None else None)
    for r in df.select("n", "k", stats.effect_of(F.col("n"), F.col("k")).alias("effect")).distinct().collect():
        try:
            assert r.effect == pytest.approx(stats.minimum_detectable_effect(r.n, r.k / r.n), abs=1e-9)
        except ValueError:
            assert r.effect is None
    none = spark.createDataFrame([(9, 0), (0, 0)], "n int, k int").select(stats.effect_of(F.col("n"), F.col("k")).alias("e")).collect()
    assert [r.e for r in none] == [None, None]


def test_intervals_by_kind(spark):
    rng = np.random.default_rng(3)
    marks = rng.integers(0, 2, (150, 4)).tolist()
    df = spark.createDataFrame([(i, *m) for i, m in enumerate(marks)], "pair_id int, base_en int, base_az int, adapted_en int, adapted_az int")
    columns = ["base_en", "base_az", "adapted_en", "adapted_az"]
    a = {r.metric: r for r in stats.bootstrap(df, stats.paired_metrics(df), 4000).collect()}
    b = {r.metric: r for r in stats.bootstrap_by_kind(df, columns, stats.paired_metrics(df), 4000).collect()}
    assert a.keys() == b.keys() and all(abs(a[m].low - b[m].low) < 0.03 and abs(a[m].high - b[m].high) < 0.03 for m in a)
    many = spark.range(1_000_000).select(*((F.xxhash64("id", F.lit(c)) % 3 == 0).cast("int").alias(c) for c in columns))
    r = stats.bootstrap_by_kind(many, columns, [F.avg("base_en").alias("m")], 2000).first()
    middle = many.agg(F.avg("base_en")).first()[0]
    spread = 1.96 * math.sqrt(middle * (1 - middle) / 1_000_000)
    assert r.low == pytest.approx(middle - spread, abs=spread / 5) and r.high == pytest.approx(middle + spread, abs=spread / 5)
    with pytest.raises(ValueError):
        stats.bootstrap_by_kind(many.limit(0), columns, [F.avg("base_en").alias("m")])


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    assert ad.same_rows(a, a.orderBy("k", ascending=False), "k", "v")
    assert not ad.same_rows(a, a.distinct(), "k", "v") and not ad.same_rows(a, a.fillna("x"), "k", "v")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    assert {r.k: (r.n_first, r.n_second) for r in ad.unmatched(a, b, "k").collect()} == {2: (2, 0), 3: (0, 1)}
    assert ad.unmatched(a, a, "k").collect() == []


def test_requests_meet_entries_as_in_a_queue(spark):
    rng = random.Random(5)
    for _ in range(3):
        asked = {g: rng.randrange(6) for g in range(7)}
        bank = [(g, 100 * g + i) for g in range(7) for i in range(rng.randrange(6))]
        queue, want = [], []
        for g in range(7):
            queue += [(g, i + 1) for i in range(asked[g])]
            for entry in sorted(b for b in bank if b[0] == g):
                if queue:
                    want.append((*queue.pop(0), *entry))
        filled, short = quota.assign(spark.createDataFrame(list(asked.items()), "slot int, asked int"), spark.createDataFrame(bank, "slot int, item int"), "slot", "item")
        assert sorted((r.slot, r["index"], r.from_slot, r.item) for r in filled.collect()) == sorted(want)
        assert [r.short for r in short.collect()] == ([len(queue)] if queue else [])


def plainly_similar(a, b, threshold):
    words = lambda t: __import__("re").findall("[0-9a-zəğıöşüç]+", t.lower())
    out = {}
    for (i, s), (j, t) in itertools.product(a, b):
        x, y = words(s), words(t)
        if x != y and set(x) | set(y):
            score = len(set(x) & set(y)) / len(set(x) | set(y))
            if score >= threshold:
                out[i, j] = pytest.approx(score)
    return out


@pytest.mark.parametrize("cell", [3, 4000])
def test_token_overlap_with_boilerplate(spark, cell):
    rng = random.Random(7)
    text = lambda: " ".join(["licensed under"] * rng.randrange(2) + [f"w{rng.randrange(12)}" for _ in range(rng.randrange(7))])
    a, b = [(i, text()) for i in range(120)], [(i, text()) for i in range(90)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, text string")
    for threshold in (0.3, 0.6, 1.0):
        got = {(r.left_id, r.right_id): r.similarity for r in overlap.similar(frame(a), frame(b), threshold, cell).collect()}
        assert got == plainly_similar(a, b, threshold)


def test_a_heavy_token_is_dealt_over_many_tasks(spark):
    a = spark.range(3000).select("id", F.concat(F.lit("common "), F.col("id").cast("string")).alias("text"))
    b = spark.range(3000).select("id", F.concat(F.lit("common x"), (F.col("id") % 1500).cast("string")).alias("text"))
    assert overlap.similar(a, b, 0.3, 100).count() == 3000 * 3000  # one of three tokens in common, in every pair
    assert overlap.similar(a, b, 0.5, 100).count() == 0


def test_nearest_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(200)] + [(300, None), (301, [0.0, 0.0, 0.0]), (302, [1.0, None, 2.0]), (303, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    sound = {i: np.array(v) for i, v in rows if v and len(v) == 3 and None not in v and any(v)}
    for others, threshold, most in ((True, None, 20_000), (False, 0.9, 2)):
        got = overlap.embedding_top_k(df.where("id % 40 = 0"), df, 4, threshold, most, others).collect()
        for q in (i for i in sound if i % 40 == 0):
            s = sorted((-round(float(sound[q] @ v / np.sqrt((sound[q] @ sound[q]) * (v @ v))), 9), i) for i, v in sound.items() if not (others and i == q))[:4]
            want = [(i, -x) for x, i in s if threshold is None or -x >= threshold]
            mine = sorted((r["rank"], r.id, r.similarity) for r in got if r.query_id == q)
            assert [x for _, _, x in mine] == pytest.approx([x for _, x in want], abs=1e-9)
    assert overlap.embedding_top_k(df.where("false"), df, 4).collect() == []


def test_no_similarity_exceeds_the_common_subsequence():
    import difflib

    rng = random.Random(9)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcə") for _ in range(rng.randrange(1, 40))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert overlap._subsequence(a, b, {}) == table[-1][-1]
        assert difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() <= 2 * table[-1][-1] / (len(a) + len(b)) + 1e-12


def test_character_bounds_lose_no_pair():
    """Texts share numbers of few or many bits, with copies, texts of one character and characters beyond 16 bits."""
    import difflib
    from types import SimpleNamespace

    import pyarrow as pa

    rng = random.Random(7)
    texts = ["".join(rng.choice("abc \u00e9\U0001f600"[: rng.randint(1, 6)]) for _ in range(rng.randint(1, 40))) for _ in range(70)]
    texts += texts[:5] + ["a" * 300, "ab" * 150]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["left_id", "text"])
    for least, bits in ((0.3, 1), (0.5, 100), (0.72, 1 << 14), (1.0, 100)):
        run = overlap._near_characters(SimpleNamespace(value=(list(range(len(texts))), texts)), least, bits=bits)
        got = {(x, y): z for r in run([batch]) for x, y, z in zip(*(c.to_pylist() for c in r.columns), strict=True)}
        every = {(i, j): difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() for i, a in enumerate(texts) for j, b in enumerate(texts)}
        assert got == {pair: v for pair, v in every.items() if v >= least}
    assert not list(overlap._near_characters(SimpleNamespace(value=([], [])), 0.5)([batch]))
