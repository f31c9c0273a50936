"""A whole experiment: check the configuration, read the benchmark, ask the model, keep the answers,
evaluate them, and write what was run. Taken up again by start and limit.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinmark.operators import validate as va
from twinmark.operators.split import piece
from twinmark.plans.evaluate import Evaluation, evaluate
from twinmark.plans.infer import Answer, infer
from twinmark.sources import readers, sinks

#: What a configuration must say, by section.
NEEDS = {
    "experiment": ("name", "seed"),
    "languages": ("source", "target"),
    "model": ("config_path",),
    "benchmark": ("input_path",),
    "inference": ("output_path",),
    "evaluation": ("output_dir",),
    "artifacts": (),
}


def faults(config: dict) -> list[str]:
    """What is missing or wrong in a configuration."""
    wrong = []
    for section, names in NEEDS.items():
        part = config.get(section)
        if not isinstance(part, dict):
            wrong.append(f"section {section} is missing")
            continue
        wrong += [f"{section}.{n} is missing" for n in names if part.get(n) in (None, "")]
    if not wrong:
        seed = config["experiment"]["seed"]
        if not isinstance(seed, int) or isinstance(seed, bool):
            wrong.append("experiment.seed is no whole number")
        if config["languages"]["source"] == config["languages"]["target"]:
            wrong.append("source and target language are the same")
    return wrong


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def preflight(spark: SparkSession, config: dict) -> DataFrame:
    """The benchmark of a sound configuration, whose pairs are whole and whose outputs are free."""
    if wrong := faults(config):
        raise ValueError("; ".join(wrong))
    for section, key in (("inference", "output_path"), ("evaluation", "output_dir")):
        part = config[section]
        if not part.get("overwrite", False) and exists(spark, part[key]):
            raise FileExistsError(part[key])
    rows = readers.benchmark(spark, config["benchmark"]["input_path"])
    if not rows.take(1):
        raise ValueError("the benchmark is empty")
    languages = [config["languages"][k] for k in ("source", "target")]
    va.check(va.one_per_pair(rows, "task"))
    if config["benchmark"].get("require_complete_pairs", True):
        va.check(va.complete_pairs(rows, languages))
    return rows


def run(spark: SparkSession, config: dict, build: Callable[[], Answer], start: int = 0, limit: int | None = None, skip_evaluation: bool = False, decisions: DataFrame | None = None, binary_decisions: DataFrame | None = None) -> Evaluation | None:
    """The experiment of a configuration. build() makes the model on the executors."""
    rows = preflight(spark, config).drop("file")
    if start or limit is not None:
        rows = piece(rows, ["item_id"], start, limit)
    out = config["inference"]["output_path"]
    sinks.table(infer(rows, build), out, config["inference"].get("overwrite", False))
    began = datetime.datetime.now(datetime.timezone.utc).isoformat()
    done = None
    if not skip_evaluation:
        languages = config["languages"]
        done = evaluate(spark.read.parquet(out), decisions, binary_decisions, languages["source"], languages["target"])
        sinks.bundle(done.tables, done.summaries, config["evaluation"]["output_dir"], config["evaluation"].get("overwrite", False))
    beside = config["evaluation"]["output_dir"].rstrip("/") + "_run"
    if config["artifacts"].get("save_config_snapshot"):
        sinks.snapshot(config, f"{beside}/experiment_config.yaml", True)
    if config["artifacts"].get("save_run_metadata"):
        sinks.document({"name": config["experiment"]["name"], "seed": config["experiment"]["seed"], "finished": began, "start": start, "limit": limit}, f"{beside}/run_metadata.json", True)
    return done
