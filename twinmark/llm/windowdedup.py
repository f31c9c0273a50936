"""Substring dedup: words that stand in a window of `span` consecutive words found earlier go.

A window is judged by its whole word sequence: it is a later one if the same sequence also starts earlier, in a
document of smaller id or before it in its own. Every word that any later window covers is removed, so each removed
word stands in an earlier copy; all windows are judged on the input.

Windows travel as super-k-mers. A window's minimiser is the least hash among its runs of `run` words; consecutive
windows with the same minimiser share all but one of their words with the next, so they go as one packed string of
words to the minimiser's bucket. Equal windows have equal minimisers and meet there. In the bucket words become numbers
by an exact dictionary, windows are sorted by a hash of their numbers, and neighbours of equal hash are compared word
by word, so the judgement is exact whatever hashes collide.

Against skew:
* A task combines before it sends: of equal packed strings only the first occurrence travels, and the later ones
  are judged on the spot. A passage that a third of all documents share is sent once or a few times a task.
* Minimisers that hold more than half of a partition's fair share, counted over all texts beforehand, come
  last in the order. What surrounds a common passage is different everywhere, so windows over its edges spread.
  The list has at most 4 entries a partition.
* A bucket that is still too large for a task's memory gives its windows one by one, and Spark groups those by
  their words, with sums on the map side and spilling.

Rows that repeat id and text are one document, and are treated alike; rows that only repeat the id are told apart by
their texts, in an order of hashes. Null ids come first. Words are runs of anything but ASCII white space. Null texts
have no words; a text of fewer than `span` words has no window and is left alone. A very long text is cut in a task in
slices of its own, a packed string holds at most MOST windows, and a document's places are bounded by the document. An
empty table gives no rows. dedup() returns the input's columns whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from twinmark.llm.common import fresh_path, free_name, ship, slices
from twinmark.llm.linededup import _keys

SPAN, RUN = 20, 4
MOST = 512  # windows of a packed string
HELD = 150_000  # packed strings that a task combines at a time
BUCKETS = 16  # a shuffle partition
AT_ONCE, TOO_LARGE = 4_000_000, 16_000_000  # bytes of packed strings: sorted together, of one bucket
TRAVEL = "bucket int, k_id array<long>, k_text array<long>, start array<int>, words array<int>, size int, packed binary"
FOUND = "k_id long, k_text long, start int, stop int, window binary"

U8 = np.uint64
MIX = U8(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U8(31))) * MIX
    return x ^ (x >> U8(29))


def rolled(x: np.ndarray, span: int) -> np.ndarray:
    """Polynomial hashes of all runs of `span` numbers, by doubling; empty where there are fewer."""
    wrap = (1 << 64) - 1
    whole, done, held, length, power = None, 0, x, 1, int(MIX)
    while True:
        if span & length:
            if whole is None:
                whole = held
            else:
                n = max(len(x) - done - length + 1, 0)
                whole = whole[:n] * U8(power) + held[done : done + n]
            done += length
        if length * 2 > span:
            return whole[: max(len(x) - span + 1, 0)]
        n = max(len(x) - 2 * length + 1, 0)
        held = held[:n] * U8(power) + held[length : length + n]
        length, power = 2 * length, power * power & wrap


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` numbers in a row."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        n = max(len(out) - step, 0)
        out, have = np.minimum(out[:n], out[step : step + n]), have + step
    return out


class Words:
    """The words of some texts in a row: the text each stands in, its place there, and where it stands in `packed`."""

    def __init__(self, texts: list[bytes | None], span: int):
        split = [t.split() if t else [] for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        some = [w for words in split if len(words) >= span for w in words]
        size[size < span] = 0
        self.text = np.repeat(np.arange(len(split)), size)
        self.place = np.arange(len(some)) - np.repeat(np.cumsum(size) - size, size)
        self.packed = b" ".join(some)
        self.at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)])
        self.hash = _mixed(np.fromiter(map(zlib.crc32, some), U8, len(some)) + U8(1))


def minimisers(words: Words, span: int, run: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, minimiser) of each super-k-mer. hot: sorted minimisers that come last."""
    h = _mixed(rolled(words.hash, run)) >> U8(1)
    if len(hot) and len(h):
        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        h = np.where(hot[at] == h, h | U8(1 << 63), h)
    low = least(h, span - run + 1)
    n = len(low)
    at = np.flatnonzero(words.text[:n] == words.text[span - 1 : span - 1 + n])
    if not len(at):
        return at, at, low[:0]
    low = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1) | (words.text[at[1:]] != words.text[at[:-1]])
    first = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(since % MOST == 0)
    return at[first], np.diff(np.append(first, len(at))), low[first] & U8((1 << 63) - 1)


def _texts(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for whole in batches:
        for b in slices(whole, "text"):
            yield b, Words(b.column("text").cast(pa.large_binary()).to_pylist(), span)


def hot_minimisers(texts: DataFrame, span: int, run: int, parts: int) -> np.ndarray:
    """Minimisers of more than 1 / (2 * parts) of all super-k-mers, and none of fewer than half as many: at most 4 * parts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, n = np.zeros(0, U8), np.zeros(0, np.int64)
        total = 0
        for _, words in _texts(batches, span):
            low, times = np.unique(minimisers(words, span, run, kinds[:0])[2], return_counts=True)
            total += int(times.sum())
            both = np.concatenate([kinds, low])
            kinds, where = np.unique(both, return_inverse=True)
            n = np.bincount(where, np.concatenate([n, times]), len(kinds)).astype(np.int64)
            if len(kinds) > 2_000_000:  # rare ones make room: each has less than a fourth of a partition's share here
                often = n >= max(2, total // (8 * parts))
                kinds, n = kinds[often], n[often]
        often = n >= max(2, total // (4 * parts))
        yield pa.record_batch([pa.array(np.append(kinds[often].astype(np.int64), -1)), pa.array(np.append(n[often], total))], ["low", "n"])

    counts = texts.mapInArrow(count, "low long, n long").groupBy("low").agg(F.sum("n").alias("n")).persist()
    try:
        total = counts.where("low = -1").agg(F.sum("n")).first()[0] or 0
        most = max(2, total // (4 * parts))
        rows = counts.where((F.col("low") >= 0) & (F.col("n") > most)).select("low").collect()  # fewer than total / most
    finally:
        counts.unpersist()
    return np.sort(np.array([r.low for r in rows], U8))


class _Sender:
    """Packed strings that a task holds back to combine them, and what it has judged already."""

    def __init__(self, span: int, buckets: int):
        self.span, self.buckets = span, buckets
        self.held: dict[bytes, tuple[int, int, int, int, int]] = {}
        self.later: list[tuple[int, int, int, int]] = []
        self.turn = 0

    def add(self, words: Words, k_id: list[int], k_text: list[int], first: np.ndarray, n: np.ndarray, low: np.ndarray) -> None:
        held, later, span, packed = self.held, self.later, self.span, words.packed
        begin, end = words.at[first].tolist(), (words.at[first + n + span - 1] - 1).tolist()
        for a, b, t, p, size, m in zip(begin, end, words.text[first].tolist(), words.place[first].tolist(), (n + span - 1).tolist(), low.tolist(), strict=True):
            key, here = packed[a:b], (k_id[t], k_text[t], p)
            there = held.setdefault(key, new := (*here, size, m))
            if there is not new and there[:3] != here:
                if here < there[:3]:
                    held[key], here = new, there[:3]
                later.append((*here, size))

    def sent(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            rows = np.array([(*v[:4], v[4] % self.buckets) for v in self.held.values()], np.int64)
            strings = list(self.held)
            order = np.argsort(rows[:, 4], kind="stable")
            cuts = np.flatnonzero(np.diff(rows[order, 4], prepend=-1))
            out = []
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
                mine = order[i:j]
                text = b" ".join([strings[k] for k in mine.tolist()])
                out.append((int(rows[mine[0], 4]), *(rows[mine, c].tolist() for c in range(4)), len(text), pa.compress(text, codec="zstd", asbytes=True)))
                if len(out) == 1000:
                    yield _travel(out)
                    out = []
            if out:
                yield _travel(out)
            self.held.clear()
        for i in range(0, len(self.later), 20_000):
            part = list(zip(*self.later[i : i + 20_000], strict=True))
            self.turn += 1
            yield _travel([((self.turn * 7919) % self.buckets, *map(list, part), 0, None)])
        self.later.clear()


def _travel(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "k_id", "k_text", "start", "words", "size", "packed"])


def _cutter(span: int, run: int, buckets: int, hot: np.ndarray):
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Sender(span, buckets)
        for b, words in _texts(batches, span):
            out.add(words, b.column("k_id").to_pylist(), b.column("k_text").to_pylist(), *minimisers(words, span, run, hot))
            if len(out.held) + len(out.later) > HELD:
                yield from out.sent()
        yield from out.sent()

    return cut_up


class _Bucket:
    """Packed strings of one or several whole buckets."""

    def __init__(self):
        self.k_id, self.k_text, self.start, self.words, self.text, self.size = [], [], [], [], [], 0

    def add(self, row: dict) -> None:
        for name in ("k_id", "k_text", "start", "words"):
            getattr(self, name).append(np.array(row[name], np.int64))
        self.text.append(pa.decompress(row["packed"], row["size"], codec="zstd", asbytes=True))
        self.size += row["size"]

    def windows(self, span: int):
        """Arrays by word: its packed string, its place in the document; the words' numbers; where windows start."""
        raw = np.frombuffer(b" ".join([*self.text, b""]), np.uint8)
        ends = np.concatenate([[0], np.flatnonzero(raw == 32) + 1])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)])
        code = words.dictionary_encode().indices.to_numpy()
        size = np.concatenate(self.words)
        string = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        place = np.repeat(np.concatenate(self.start), size) + inside
        return raw, ends, string, place, code, np.flatnonzero(inside + span <= np.repeat(size, size))

    def judged(self, span: int) -> Iterator[pa.RecordBatch]:
        """The runs of words that later windows cover."""
        if not self.text:
            return
        _, _, string, place, code, at = self.windows(span)
        key = rolled(_mixed(code.astype(U8) + U8(1)), span)[at]
        order = np.argsort(key)
        key = key[order]
        equal = key[1:] == key[:-1]
        some = np.zeros(len(key), bool)
        some[1:] = equal
        some[:-1] |= equal
        at, key = at[order[some]], key[some]
        if not len(at):
            return
        group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        same = group[1:] == group[:-1]
        if any((code[at[1:] + j] != code[at[:-1] + j])[same].any() for j in range(span)):  # a hash stands for several windows
            group = np.unique(code[at[:, None] + np.arange(span)], axis=0, return_inverse=True)[1].ravel()
        k_id, k_text = (np.concatenate(x)[string[at]] for x in (self.k_id, self.k_text))
        order = np.lexsort((place[at], k_text, k_id, group))
        at, group, k_id, k_text = at[order], group[order], k_id[order], k_text[order]
        new = np.concatenate([[True], group[1:] != group[:-1]])
        first = np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(at))))
        later = (k_id != k_id[first]) | (k_text != k_text[first]) | (place[at] != place[at[first]])
        at = np.sort(at[later])
        if not len(at):
            return
        begins = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (string[at[1:]] != string[at[:-1]])])
        i = np.flatnonzero(begins)
        last = np.append(i[1:], len(at)) - 1
        mine = string[at[i]]
        yield _found(np.concatenate(self.k_id)[mine], np.concatenate(self.k_text)[mine], place[at[i]], place[at[last]] + span)

    def single(self, span: int) -> Iterator[pa.RecordBatch]:
        """The windows one by one."""
        if not self.text:
            return
        raw, ends, string, place, _, at = self.windows(span)
        raw, k_id, k_text = raw.tobytes(), np.concatenate(self.k_id), np.concatenate(self.k_text)
        for i in range(0, len(at), 50_000):
            some = at[i : i + 50_000]
            words = [raw[a:b] for a, b in zip(ends[some].tolist(), (ends[some + span] - 1).tolist(), strict=True)]
            yield _found(k_id[string[some]], k_text[string[some]], place[some], place[some] + span, words)


def _found(k_id, k_text, start, stop, window: list[bytes] | None = None) -> pa.RecordBatch:
    longs, ints = (lambda x: pa.array(x, pa.int64())), (lambda x: pa.array(x, pa.int32()))
    return pa.record_batch([longs(k_id), longs(k_text), ints(start), ints(stop), pa.array([None] * len(k_id) if window is None else window, pa.binary())], ["k_id", "k_text", "start", "stop", "window"])


def _judge(span: int, at_once: int, too_large: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, now, bucket, single = _Bucket(), _Bucket(), None, False  # whole: buckets seen to their ends
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if row["packed"] is None:  # judged where it was cut
                    start = np.array(row["start"])
                    yield _found(row["k_id"], row["k_text"], start, start + np.array(row["words"]))
                    continue
                if row["bucket"] != bucket:
                    if single:
                        yield from now.single(span)
                    else:
                        for name in ("k_id", "k_text", "start", "words", "text"):
                            getattr(whole, name).extend(getattr(now, name))
                        whole.size += now.size
                    now, bucket, single = _Bucket(), row["bucket"], False
                    if whole.size > at_once:
                        yield from whole.judged(span)
                        whole = _Bucket()
                now.add(row)
                if now.size > too_large:
                    single = True
                if single and now.size > at_once:
                    yield from now.single(span)
                    now = _Bucket()
        if single:
            yield from now.single(span)
            now = _Bucket()
        for name in ("k_id", "k_text", "start", "words", "text"):
            getattr(whole, name).extend(getattr(now, name))
        yield from whole.judged(span)

    return run


def later_windows(docs: DataFrame, span: int = SPAN, run: int = RUN, at_once: int = AT_ONCE, too_large: int = TOO_LARGE) -> DataFrame:
    """k_id, k_text, start, stop: runs of words (from 0, end exclusive) that later windows cover; runs may overlap. Kept in the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    run = min(run, span)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.where("text is not null").select(*_keys(docs), F.col("text").cast("string").alias("text"))
    hot = hot_minimisers(texts.select("text"), span, run, parts)
    sent = texts.mapInArrow(_cutter(span, run, parts * BUCKETS, hot), TRAVEL)
    found = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_judge(span, at_once, too_large), FOUND)
    at = fresh_path(spark, "later-windows")
    found.write.parquet(at)
    found = spark.read.schema(FOUND).parquet(at)
    covered = found.where("window is null").drop("window")
    single = found.where("window is not null")
    if not single.take(1):
        return covered
    place = F.struct("k_id", "k_text", "start")
    firsts = single.groupBy("window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("window", "first")
    return covered.unionByName(single.join(firsts, "window").where(place != F.col("first")).select("k_id", "k_text", "start", "stop"))


def _with_runs(docs: DataFrame, span: int, run: int, **how) -> tuple[DataFrame, str]:
    """docs with a column of the runs to remove, null where there are none, and its name."""
    names = docs.columns
    a, b, runs = (free_name(names, x) for x in ("k_id", "k_text", "runs"))
    gone = later_windows(docs, span, run, **how).groupBy(F.col("k_id").alias(a), F.col("k_text").alias(b)).agg(F.collect_set(F.struct("start", "stop")).alias(runs))
    keyed = docs.select("*", *(c.alias(n) for c, n in zip(_keys(docs), (a, b), strict=True)))
    return keyed.join(gone, [a, b], "left").drop(a, b), runs


def _cleaned(text: str | None, runs: list | None) -> tuple[int, int, str]:
    """Words, words removed, and the others joined by single spaces."""
    words = (text or "").encode().split()
    if not runs:
        return len(words), 0, b" ".join(words).decode()
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [r["start"] for r in runs], 1)
    np.add.at(edge, [r["stop"] for r in runs], -1)
    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
    return len(words), len(words) - len(stay), b" ".join([words[i] for i in stay]).decode()


def dedup(docs: DataFrame, span: int = SPAN, run: int = RUN, with_counts: bool = False, **how) -> DataFrame:
    """The documents, with the words of later windows removed and the others joined by single spaces (texts without such
    words too, null as empty); with_counts adds n_words and n_removed. how: at_once and too_large of later_windows()."""
    df, runs = _with_runs(docs, span, run, **how)
    names = docs.columns
    counts = [free_name(names, "n_words"), free_name(names, "n_removed")] if with_counts else []

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                n, gone, kept = zip(*map(_cleaned, b.column("text").to_pylist(), b.column(runs).to_pylist()), strict=True)
                columns = [pa.array(kept, pa.string()) if c == "text" else b.column(c) for c in names]
                yield pa.record_batch([*columns, *[pa.array(x, pa.int64()) for x in (n, gone)][: len(counts)]], [*names, *counts])

    df = df.select(*(F.col("text").cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in names), runs)
    schema = StructType([*df.schema.fields[:-1], *(StructField(c, LongType()) for c in counts)])
    return df.mapInArrow(clean, schema)


def assess(docs: DataFrame, span: int = SPAN, run: int = RUN, **how) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, the digest of the words that stay, joined by single spaces."""
    df = dedup(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), span, run, True, **how)
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


SQL = f"""
    with d as (
        select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
    ), w as (
        select doc_id, words, unnest(range(1, len(words) - {SPAN - 2})) as pos from d where len(words) >= {SPAN}
    ), n as (
        select doc_id, pos, row_number() over (partition by array_to_string(words[pos:pos + {SPAN - 1}], ' ') order by doc_id, pos) as nth from w
    ), each as (
        select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from d
    ), judged as (
        select e.doc_id, e.pos, e.word, coalesce(max(n.nth) over (partition by e.doc_id order by e.pos rows {SPAN - 1} preceding), 1) > 1 as removed
        from each e left join n on e.doc_id = n.doc_id and e.pos = n.pos
    ), kept as (
        select doc_id, count(*) filter (where removed) as n_removed, string_agg(word, ' ' order by pos) filter (where not removed) as text
        from judged group by doc_id
    )
    select d.doc_id, cast(len(d.words) as bigint) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
    from d left join kept k on d.doc_id = k.doc_id
"""
