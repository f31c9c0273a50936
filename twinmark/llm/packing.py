"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best fit: a fixed number of open bins, indexed by a bitset whose bit f says
that some open bin has f free places. A piece goes to the open bin with the least free space that
holds it; if none does, a bin is opened, and when all places for open bins are taken the fullest
bin closes first. Each input partition packs by itself, so texts are never shuffled. The pieces in bins
that a partition still has open at its end, a bounded number of bins, are packed again over the whole
corpus, in groups of a fixed size, online and through the same kind of bins; what is open at the end of
that goes through a quarter as many bins, and so on, so partitions cost few sequences.

Nulls and empty texts are documents of just the end id. Rows with equal or null ids are separate
documents. Documents longer than a sequence are cut into whole sequences and a rest, a very long text
like any other: only its own ids are held. Other columns aren't read, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinmark.llm.common import cut, ship, slices
from twinmark.llm.wordcache import encoder

SEQUENCE = 4096
OPEN_BINS = 512
GROUP = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """The open bins of one packer. put(length) -> (bin, offset); closed bins are told by `closed`."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.count, self.bits, self.next = size, most, 0, 0, 0
        self.by_free: list[deque] = [deque() for _ in range(size + 1)]
        self.closed: set[int] = set()

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        got = held.popleft()
        if not held:
            self.bits &= ~(1 << free)
        return got

    def put(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.count == self.most:  # the fullest closes first
                self.closed.add(self._take((self.bits & -self.bits).bit_length() - 1))
                self.count -= 1
            b, free = self.next, self.size
            self.next += 1
            self.count += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(b)
            self.bits |= 1 << rest
        else:
            self.closed.add(b)
            self.count -= 1
        return b, self.size - free


def _pack_texts(path: str, end_id: int, size: int, most: int, drops_space: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        enc, bins, full = encoder(path, drops_space), OpenBins(size, most), 0
        waiting: dict[int, list[tuple]] = {}
        names = [x.split()[0] for x in PIECES.split(", ")] + ["is_open"]
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        ready: list[tuple] = []
        for whole in batches:
            for batch in slices(whole, "text"):
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = enc.ids(text or "") + end
                    n = len(ids) // 4
                    for k, at in enumerate(range(0, n, size)):
                        length = min(size, n - at)
                        row = (doc, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]))
                        if length == size:
                            ready.append((*row, base + 2 * full + 1, 0, False))
                            full += 1
                        else:
                            b, offset = bins.put(length)
                            waiting.setdefault(b, []).append((*row, base + 2 * b, offset, False))
                if bins.closed:
                    for b in bins.closed:
                        ready += waiting.pop(b, ())
                    bins.closed.clear()
                if ready:
                    yield out(ready)
                    ready = []
        for rows in waiting.values():
            ready += [(*r[:-1], True) for r in rows]
            if len(ready) > 20_000:
                yield out(ready)
                ready = []
        if ready:
            yield out(ready)

    return run


def _pack_rest(size: int, most: int):
    """Later rounds: pieces of bins that were left open, in order of their checksums, through fewer bins each time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = -1 - (TaskContext.get().partitionId() << 33)
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        length = rows.column("length").to_numpy()
        seq, offset = np.empty(len(length), "i8"), np.empty(len(length), "i8")
        todo, bins_open, used = np.argsort(rows.column("ids_crc32").to_numpy(), kind="stable"), most, 0
        while len(todo):
            bins, place = OpenBins(size, bins_open), []
            for n in length[todo].tolist():
                place.append(bins.put(n))
            own, offset[todo] = np.array(place, "i8").T
            seq[todo] = base - used - own
            used += bins.next
            still_open = np.ones(bins.next, bool)
            still_open[list(bins.closed)] = False
            todo = todo[still_open[own]] if bins_open > 1 else todo[:0]
            bins_open = max(1, bins_open // 4)
        for name, v in (("sequence_id", seq), ("offset", offset)):
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(v))
        yield from rows.to_batches(max_chunksize=20_000)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SEQUENCE, open_bins: int = OPEN_BINS, group: int = GROUP, drops_space: bool = True) -> DataFrame:
    """One row per piece: where it comes from (doc_id, piece, start), its length and checksum, and
    where it goes (sequence_id, offset). Needs columns doc_id and text; others are not read.

    group: pieces that one task of the later rounds packs; its memory is bounded by it.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    pieces = cut(texts.mapInArrow(_pack_texts(tokenizer, end_id, size, open_bins, drops_space), f"{PIECES}, is_open boolean"))
    rest = pieces.where("is_open").drop("is_open")
    groups = max(1, -(-rest.count() // group))
    again = rest.repartition(groups).mapInArrow(_pack_rest(size, open_bins), PIECES)
    return pieces.where("not is_open").drop("is_open").unionByName(again)
