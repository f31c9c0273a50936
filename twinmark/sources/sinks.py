"""Writing rows, summaries and bundles; nothing is overwritten unless asked."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinmark.operators.split import batches


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def rows(df: DataFrame, path: str, overwrite: bool = False, by: list[str] = (), nulls: bool = False) -> None:
    """JSON lines; with by, one folder for each value (language, split, batch). With nulls, fields that are null are written, else left out."""
    to = df.write.mode(_mode(overwrite))
    (to.partitionBy(*by) if by else to).json(path, ignoreNullFields=not nulls)


def table(df: DataFrame, path: str, overwrite: bool = False, by: list[str] = ()) -> None:
    df.write.mode(_mode(overwrite)).partitionBy(*by).parquet(path) if by else df.write.mode(_mode(overwrite)).parquet(path)


def csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode(_mode(overwrite)).csv(path, header=True)


def in_batches(df: DataFrame, path: str, size: int, order: list[str], overwrite: bool = False) -> None:
    """JSON lines in folders batch=batch_001, ... of a fixed number of rows."""
    rows(batches(df, order, size), path, overwrite, ["batch"])


def nested(summary: DataFrame) -> dict:
    """A tidy summary as {dimension: {key: metrics}}; summaries have a row for each key of a few dimensions."""
    out: dict = {}
    for r in summary.collect():
        d = r.asDict()
        dimension, key = d.pop("dimension"), d.pop("key")
        out.setdefault(dimension, {})[key] = d
    return {d: out[d]["all"] if d == "overall" else dict(sorted(out[d].items())) for d in sorted(out)}


def _store(path: str):
    """(the folder or file as the store names it, the store)"""
    spark = SparkSession.getActiveSession()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _move(source, target, overwrite: bool) -> None:
    """One rename; a file that is there is replaced by the same step, so a reader sees the old one or the new one."""
    spark = SparkSession.getActiveSession()
    jvm = spark._jvm
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if overwrite else kind.NONE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, how)


def _put(text: str, path: str, overwrite: bool) -> None:
    """A small text file in whatever store, written beside its place and renamed into it."""
    at, fs = _store(path)
    if fs.exists(at) and not overwrite:
        raise FileExistsError(path)
    at = fs.makeQualified(at)
    temp = fs.makeQualified(SparkSession.getActiveSession()._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}.tmp"))
    out = fs.create(temp)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    _move(temp, at, overwrite)


def document(value: dict, path: str, overwrite: bool = False) -> None:
    """A small JSON document."""
    _put(json.dumps(value, ensure_ascii=False, indent=2, default=str) + "\n", path, overwrite)


def snapshot(config: dict, path: str, overwrite: bool = False) -> None:
    """A run's configuration as YAML."""
    import yaml

    _put(yaml.safe_dump(config, allow_unicode=True, sort_keys=False), path, overwrite)


MANIFEST = "manifest.json"


def _whole(summary: DataFrame | list[DataFrame]) -> dict:
    """A summary's document; a list of summaries is one document with all their dimensions."""
    out: dict = {}
    for df in summary if isinstance(summary, list) else [summary]:
        out |= nested(df if {"dimension", "key"} <= set(df.columns) else df.withColumns({"dimension": F.lit("overall"), "key": F.lit("all")}))
    return out


def _settle(folder: str) -> None:
    """What a writer that was stopped between its two renames has left: the old bundle goes back to its place."""
    at, fs = _store(folder)
    old, _ = _store(f"{folder}.old")
    if fs.exists(old):
        if fs.exists(at):
            fs.delete(old, True)
        else:
            fs.rename(old, at)


def bundle(tables: dict[str, DataFrame], summaries: dict[str, DataFrame | list[DataFrame]], folder: str, overwrite: bool = False) -> list[str]:
    """All artifacts of an evaluation: row tables as folders of JSON lines, summaries as nested documents.

    They are written to a folder beside the place, with a manifest as the last one, and come to the place by one rename.
    An old bundle steps aside until the new one is there. So a reader finds a whole bundle or none, and a writer that is stopped
    leaves the old one, which the next reader or writer puts back if it had stepped aside."""
    _settle(folder)
    at, fs = _store(folder)
    there = fs.exists(at)
    if there and not overwrite:
        raise FileExistsError(folder)
    stage = f"{folder}.{uuid.uuid4().hex}.tmp"
    made = []
    try:
        for name, df in tables.items():
            rows(df, f"{stage}/{name}.jsonl")
            made.append(f"{name}.jsonl")
        for name, summary in summaries.items():
            document(_whole(summary), f"{stage}/{name}.json")
            made.append(f"{name}.json")
        document({"artifacts": made}, f"{stage}/{MANIFEST}")
        new, old = _store(stage)[0], _store(f"{folder}.old")[0]
        if there and not fs.rename(at, old):
            raise OSError(f"{folder} could not be set aside")
        if not fs.rename(new, at):
            raise OSError(f"{folder} could not be written")
        if there:
            fs.delete(old, True)
    except BaseException:
        fs.delete(_store(stage)[0], True)
        _settle(folder)
        raise
    return made


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame | dict]:
    """The artifacts of a bundle by name: tables as DataFrames, summaries as documents; an error if one is missing."""
    _settle(folder)
    whole = spark.read.text(f"{folder}/{MANIFEST}", wholetext=True).first()
    out: dict[str, DataFrame | dict] = {}
    for name in json.loads(whole.value)["artifacts"]:
        if not _store(f"{folder}/{name}")[1].exists(_store(f"{folder}/{name}")[0]):
            raise FileNotFoundError(f"{folder}/{name}")
        if name.endswith(".jsonl"):
            out[name.removesuffix(".jsonl")] = spark.read.json(f"{folder}/{name}")
        else:
            out[name.removesuffix(".json")] = json.loads(spark.read.text(f"{folder}/{name}", wholetext=True).first().value)
    return out
