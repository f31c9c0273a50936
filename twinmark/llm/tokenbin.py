"""Token files: flat unsigned integers, 64-bit document offsets, memory-mapped reads.

Layout of a token store, a folder in the shared file system:
  part-NNNNN.bin   all ids of the part's documents, one after another, little-endian; unsigned
                   16-bit if the vocabulary fits, else unsigned 32-bit
  part-NNNNN.idx   64-bit: number of documents n, then n + 1 offsets (in ids, from 0), then n
                   document ids, then n flags (1: the document's id is null)
  index.json       dtype, and of each part its name, documents, ids, and base: the number of ids
                   in all parts before it, a prefix sum over the parts

Parts hold ascending ranges of document ids (nulls first; rows of one id by their text). A part is
written under another name and renamed, so a task that is run again replaces a part by the same
bytes. Nothing but one row per part reaches the driver.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinmark.llm.common import fresh_path, ship, slices
from twinmark.llm.wordcache import encoder


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


def _put(fs: pafs.FileSystem, at: str, chunks: list[bytes]) -> None:
    temp = f"{at}.{os.getpid()}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
    with fs.open_output_stream(temp) as f:
        for c in chunks:
            f.write(c)
    fs.move(temp, at)


def _writer(uri: str, tokenizer: str, end_id: int, dtype: str, drops_space: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc, (fs, top) = encoder(tokenizer, drops_space), _fs(uri)
        name, end = f"part-{part:05d}", np.array([end_id], dtype).tobytes()
        temp = f"{top}/{name}.bin.{TaskContext.get().taskAttemptId()}.tmp"
        lengths, docs, nulls, out = [], [], [], None
        for whole in batches:
            for b in slices(whole, "text"):
                out = out or fs.open_output_stream(temp)
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    ids = np.frombuffer(enc.ids(text or ""), "<u4").astype(dtype)
                    out.write(ids.tobytes())
                    out.write(end)
                    lengths.append(len(ids) + 1)
                    docs.append(doc or 0)
                    nulls.append(doc is None)
        if out is None:
            return
        out.close()
        fs.move(temp, f"{top}/{name}.bin")
        n = len(docs)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
        _put(fs, f"{top}/{name}.idx", [np.array([n], "<i8").tobytes(), offsets.tobytes(), np.array(docs, "<i8").tobytes(), np.array(nulls, "<u1").tobytes()])
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([name]), pa.array([n], pa.int64()), pa.array([int(offsets[-1])], pa.int64())], ["part", "name", "docs", "ids"])

    return run


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, vocabulary: int = 50_257, uri: str | None = None, drops_space: bool = False, parts: int | None = None) -> str:
    """Write the store of docs (doc_id, text; null text is empty) and return its folder.

    parts: how many files; the session's shuffle partitions unless given. An empty table gives a
    store without parts.
    """
    spark = docs.sparkSession
    ship(spark)
    uri = uri or fresh_path(spark, "tokens")
    fs, top = _fs(uri)
    fs.create_dir(top, recursive=True)
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    rows = (
        texts.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), tie)
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")
        .mapInArrow(_writer(uri, tokenizer, end_id, dtype, drops_space), "part int, name string, docs long, ids long")
        .collect()
    )  # one row a part
    base, index = 0, []
    for r in sorted(rows, key=lambda r: r.part):
        index.append({"name": r.name, "docs": r.docs, "ids": r.ids, "base": base})
        base += r.ids
    _put(fs, f"{top}/index.json", [json.dumps({"dtype": dtype, "parts": index}).encode()])
    return uri


def mapped(uri: str, name: str) -> np.ndarray:
    """The bytes of a file, mapped into memory where the store is a mounted folder, else read."""
    fs, top = _fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(f"{top}/{name}", np.uint8, "r")
    with fs.open_input_file(f"{top}/{name}") as f:
        return np.frombuffer(f.read(), np.uint8)


def open_part(uri: str, name: str, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, document ids, null flags) of one part."""
    raw = mapped(uri, f"{name}.idx")
    n = int(raw[:8].view("<i8")[0])
    offsets = raw[8 : 16 + 8 * n].view("<i8")
    docs = raw[16 + 8 * n : 16 + 16 * n].view("<i8")
    return mapped(uri, f"{name}.bin").view(dtype), offsets, docs, raw[16 + 16 * n : 16 + 17 * n]


def read_index(uri: str) -> dict:
    fs, top = _fs(uri)
    with fs.open_input_stream(f"{top}/index.json") as f:
        return json.loads(f.read())


def read_back(spark: SparkSession, uri: str, rows: int = 20_000) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens and the
    checksum of its ids as unsigned 32-bit integers."""
    ship(spark)
    index = read_index(uri)
    dtype = index["dtype"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not index["parts"]:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.to_pylist():
                ids, offsets, docs, nulls = open_part(uri, p["name"], dtype)
                for at in range(0, len(docs), rows):
                    o = np.array(offsets[at : at + rows + 1])
                    ends = o[1:]
                    crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(o[:-1].tolist(), ends.tolist(), strict=True)]
                    k = slice(at, at + len(ends))
                    yield pa.record_batch([pa.array(np.array(docs[k]), pa.int64(), mask=np.array(nulls[k]).astype(bool)), pa.array(o[:-1] + p["base"]), pa.array(ends - o[:-1]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame([(p["name"], p["base"]) for p in index["parts"]], "name string, base long")
    return table.repartition(len(index["parts"])).mapInArrow(run, schema)
