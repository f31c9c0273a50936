"""Shared plumbing: shipping this package to executors, cutting lineage, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so Python tasks can import it."""
    if spark.sparkContext.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    at = os.path.join(tempfile.mkdtemp(prefix="twinmark-"), "twinmark_pkg.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(at)  # the driver's file server hands it on; executors don't see `at`
    _shipped.add(spark.sparkContext.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a fresh one on a
    local master, where driver and executors are one machine; an error elsewhere."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="twinmark-shared-")
    return _own_dirs[app]


def cut(df: DataFrame) -> DataFrame:
    """Materialise df reliably in the shared folder and forget how it was made."""
    at = shared_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def slices(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of the given column, one row at least, so that a
    batch of very long texts doesn't multiply in memory."""
    col = batch.column(column)
    size = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    at, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


_kept: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What a Python worker keeps from task to task for an operator, such as models and tables of words.
    Workers are used again by other operators, so only the last one's is kept."""
    for other in [k for k in _kept if k != operator]:
        del _kept[other]
    return _kept.setdefault(operator, {})


def free_name(df_or_names, want: str) -> str:
    """A column name that doesn't clash with those there."""
    names = {x.lower() for x in (df_or_names if isinstance(df_or_names, (list, set)) else df_or_names.columns)}
    while want.lower() in names:
        want = f"_{want}"
    return want


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a running number from 1 in the given order, as column name (long). No task takes the whole table: ranges
    of the order are numbered by themselves and moved up by the counts before them. The order should tell all rows
    apart, so that rows that are alike can be split too."""
    part, within, base = (free_name(df, x) for x in ("part", "within", "base"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id())
    dealt = cut(dealt.withColumn(within, F.monotonically_increasing_id() - F.shiftleft(F.col(part).cast("long"), 33)))
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(base))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = counts.select(part, F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    return dealt.join(F.broadcast(counts), part).withColumn(name, F.col(within) + F.col(base) + 1).drop(part, within, base)
