import json

import pytest
from pyspark.sql import functions as F

from twinmark.operators.validate import ConstraintError
from twinmark.plans.evaluate import evaluate
from twinmark.plans.infer import infer
from twinmark.sources import readers, sinks
from twinmark.streaming.scoring import pair_stream


def record(pair, lang, task, reference, prediction, answerable=True, **meta):
    return {"item_id": f"{pair}_{lang}", "pair_id": pair, "language": lang, "task": task, "question": "?", "reference_answer": reference, "prediction": prediction, "metadata": {"category": "x", "difficulty": "easy", "is_answerable": answerable, **meta}}


ROWS = [
    record("reasoning_0001", "en", "reasoning", "42", "42 is the answer."),
    record("reasoning_0001", "az", "reasoning", "42", "43"),
    record("unanswerable_0001", "en", "unanswerable", "", "I don't know.", False),
    record("unanswerable_0001", "az", "unanswerable", "", "Dörd", False, category=None),
]


@pytest.fixture
def path(tmp_path):
    at = tmp_path / "p.jsonl"
    at.write_text("\n".join([json.dumps(ROWS[0]), "", *map(json.dumps, ROWS[1:])]) + "\n")
    return str(at)


def test_end_to_end(spark, path, tmp_path):
    done = evaluate(readers.predictions(spark, path))
    made = sinks.bundle(done.tables, done.summaries, str(tmp_path / "out"))
    assert len(made) == 24
    read = lambda n: json.loads((tmp_path / "out" / n).read_text())
    assert read("capability_summary.json")["overall"]["accuracy"] == 0.5
    assert read("capability_gap.json")["language_gap"]["accuracy"]["gap"] == 1.0
    assert read("reliability_pair_summary.json")["overall"]["source_only_reliable"] == 1
    assert read("reliability_summary.json")["category"].keys() == {"x", "None"}
    assert read("failure_summary.json")["overall"] == {"total": 4, "correct": 2, "capability_failure": 1, "over_answering": 1, "under_answering": 0, "empty_response": 0, "failure_rate": 0.5}
    with pytest.raises(Exception):
        sinks.bundle(done.tables, {}, str(tmp_path / "out"))


@pytest.mark.parametrize("line", ["{not json", json.dumps({k: v for k, v in ROWS[0].items() if k != "task"})])
def test_bad_lines_are_errors(spark, tmp_path, line):
    (tmp_path / "bad.jsonl").write_text(json.dumps(ROWS[0]) + "\n" + line + "\n")
    with pytest.raises(readers.SourceError):
        readers.predictions(spark, str(tmp_path / "bad.jsonl"))


def test_broken_pair_and_unknown_task(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps(ROWS[0]))
    with pytest.raises(ConstraintError):
        evaluate(readers.predictions(spark, str(tmp_path / "a.jsonl")))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(r | {"task": "poetry"}) for r in ROWS[:2]))
    with pytest.raises(ConstraintError):
        evaluate(readers.predictions(spark, str(tmp_path / "b.jsonl")))


def test_answerable_means_true(spark, tmp_path):
    rows = [ROWS[0], ROWS[1] | {"metadata": {"is_answerable": None}}, ROWS[2]]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert [r.item_id for r in readers.answerable(spark, str(tmp_path / "a.jsonl")).collect()] == ["reasoning_0001_en"]


def test_decisions(spark, tmp_path):
    at = tmp_path / "d.jsonl"
    at.write_text('{"item_id": "a", "decision": 1, "reason": "r"}\n{"item_id": "b", "decision": 0}\n')
    assert {r.item_id: r.decision for r in readers.decisions(spark, str(at)).collect()} == {"a": 1, "b": 0}
    at.write_text('{"item_id": "a", "decision": 2}\n')
    with pytest.raises(ConstraintError):
        readers.decisions(spark, str(at))


def test_review_csv(spark, tmp_path):
    at = tmp_path / "r.csv"
    at.write_text("﻿pair_id,ok\n P1 , Yes \np2,\n", encoding="utf-8")
    assert [(r.pair_id, r.ok) for r in readers.review_csv(spark, str(at), ["pair_id", "ok"], "pair_id").collect()] == [("p1", "yes"), ("p2", "")]
    with pytest.raises(readers.SourceError):
        readers.review_csv(spark, str(at), ["pair_id", "other"], "pair_id")


def test_batches_and_partitions(spark, tmp_path):
    df = spark.range(25).withColumn("language", F.when(F.col("id") % 2 == 0, "en").otherwise("az"))
    sinks.in_batches(df, str(tmp_path / "b"), 10, ["id"])
    assert sorted(p.name for p in (tmp_path / "b").glob("batch=*")) == ["batch=batch_001", "batch=batch_002", "batch=batch_003"]
    assert spark.read.json(str(tmp_path / "b" / "batch=batch_003")).count() == 5
    sinks.rows(df, str(tmp_path / "l"), by=["language"])
    assert (tmp_path / "l" / "language=az").is_dir()


def test_documents_are_not_overwritten(tmp_path):
    at = str(tmp_path / "x.json")
    sinks.document({"ə": 1}, at)
    assert "ə" in (tmp_path / "x.json").read_text(encoding="utf-8")
    with pytest.raises(FileExistsError):
        sinks.document({}, at)


def test_inference(spark):
    df = spark.createDataFrame([("a", "q1"), ("b", None)], "item_id string, question string")
    got = infer(df, lambda: lambda qs: [q[::-1] for q in qs])
    assert {r.item_id: r.prediction for r in got.collect()} == {"a": "1q", "b": ""}


def test_pairs_on_a_stream(spark, tmp_path):
    rows = [("p", "en", 1, "2024-01-01 00:00:00"), ("p", "az", 0, "2024-01-01 00:05:00"), ("q", "en", 1, "2024-01-01 00:01:00"), ("late", "en", 1, "2024-01-01 05:00:00")]
    spark.createDataFrame(rows, "pair_id string, language string, correct int, t string").selectExpr("pair_id", "language", "correct", "cast(t as timestamp) as ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pair_id string, language string, correct int, ts timestamp").parquet(str(tmp_path / "in"))
    q = pair_stream(stream).writeStream.format("memory").queryName("paired").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.pair_id, r.source_correct, r.target_correct) for r in spark.table("paired").collect()] == [("p", 1, 0)]


def test_experiment(spark, tmp_path):
    from twinmark.plans import experiment
    from twinmark.sources.readers import config

    bench = tmp_path / "bench.jsonl"
    bench.write_text("\n".join(json.dumps({k: v for k, v in r.items() if k != "prediction"}) for r in ROWS))
    conf = {
        "experiment": {"name": "x", "seed": 17},
        "languages": {"source": "en", "target": "az"},
        "model": {"config_path": "m.yaml"},
        "benchmark": {"input_path": str(bench)},
        "inference": {"output_path": str(tmp_path / "pred")},
        "evaluation": {"output_dir": str(tmp_path / "eval")},
        "artifacts": {"save_config_snapshot": True, "save_run_metadata": True},
    }
    assert experiment.faults({}) and experiment.faults({**conf, "languages": {"source": "en", "target": "en"}})
    done = experiment.run(spark, conf, lambda: lambda questions: ["42" for _ in questions])
    assert done.summaries["capability_summary"].where("dimension = 'overall'").first().accuracy == 1.0
    assert config(str(tmp_path / "eval_run" / "experiment_config.yaml")) == conf
    with pytest.raises(FileExistsError):
        experiment.preflight(spark, conf)
    part = {**conf, "inference": {"output_path": str(tmp_path / "pred2")}}
    part["evaluation"] = {"output_dir": str(tmp_path / "eval2")}
    assert experiment.run(spark, part, lambda: lambda questions: questions, 1, 2, skip_evaluation=True) is None
    assert spark.read.parquet(str(tmp_path / "pred2")).count() == 2


def test_summaries_of_many_runs(spark, tmp_path):
    for name, rate in (("a", 0.5), ("b", 0.25)):
        sinks.document({"overall": {"rate": rate}}, str(tmp_path / name / "s.json"))
    got = readers.summaries(spark, str(tmp_path / "*" / "s.json"), {"rate": "$.overall.rate"}).collect()
    assert sorted((r.run, float(r.rate)) for r in got) == [("a", 0.5), ("b", 0.25)]
