"""Near duplicates: all texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Words are runs of letters and digits in lower case. A text with fewer than five words has one shingle,
all its words; a text without words (or null) has none and is linked to nothing.

1. Texts with equal sets of shingles become one set (a class of copies), told by a 128-bit key.
2. Chosen path: each set has 64 minimum hashes, its sampled tokens. A bucket with more than LIMIT sets is
   split: its own random draw takes one token, or with CHANCE two, so 1 / 0.8 on average, and each set
   goes into the bucket of its value of every token taken. So two sets of similarity 0.8 have one child
   bucket in common on average at every level, and stay together down to level d with survival(d), which
   falls like 1 / d rather than like 0.8 ** d. Runs are repeated until the recall of such a pair, taken
   at the deepest level, reaches TARGET (runs_for). Buckets of up to HOT sets are split within one task;
   which are larger is counted by Spark and travels as a bitmap of bounded size, and those split one
   level further across tasks; a bit shared by chance only sends a bucket one level deeper, all of it
   alike. Small buckets, and those of the last level, are brute-forced: sketches are compared, in vectors,
   and what looks like LOOSE or more is joined by a spanning forest rather than by all pairs. A pair at
   0.8 looks like less with a chance below 1e-6. A bucket of more than HOT sets at the last level
   hangs on one node of the graph.
3. The graph's components contain all true groups, loosely. Within each component the sets themselves
   are compared: exact numbers of links, and a spanning forest of true links. So links that no run found
   are counted as well, as long as their component hangs together. A component of more than BLOCK sets is
   compared block against block, and its sets travel as their difference from one of them, which for
   near copies is a small part of the set.
4. Components of that forest are the groups.

Nothing is collected but the bitmaps. Groups are spread over blocks bounded in sets and in shingles, so a
group that holds a third of all rows, or very long texts, is many tasks. Very long texts are cut into words
in slices of a few megabytes; one text's shingles must fit in a worker. Rows that repeat id and text, null
ids and ties: every row gets its class; the class is named by its smallest id (null if it has no other).
Columns other than doc_id and text are not read, whatever their names, and pass through keep_one()
unchanged. Empty tables give no rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinmark.llm.common import cut, free_name, kept, ship, slices
from twinmark.llm.components import components, smallest_labels

WORDS, SIMILAR = 5, 0.8
COORDINATES, DEPTH, LIMIT, HOT = 64, 6, 256, 16_384
CHANCE, TARGET = 0.25, 0.999
BLOCK, BLOCK_TOKENS = 512, 4_000_000
LOOSE = 0.5
BITS = (24, 27)
"""Powers of two: bits of a bitmap of large buckets, 32 for each of them within these, so 2 to 16 MB."""

U8 = np.uint64


@functools.cache
def _alnum() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U8(30))) * U8(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U8(27))) * U8(0x94D049BB133111EB)
    return x ^ (x >> U8(31))


def shingle_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one after another; number of each text's."""
    lower = [t.lower() for t in texts]
    code = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le"), "<u4")
    inside = _alnum()[code]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    empty = np.zeros(len(texts), np.int64)
    if not len(starts):
        return np.empty(0, U8), empty
    place = np.flatnonzero(inside)
    word_no = np.cumsum(np.isin(place, starts, assume_unique=True)) - 1
    within = (place - starts[word_no]).astype(U8)
    parts = _mix(code[place].astype(U8) + (within + U8(1)) * U8(0x9E3779B97F4A7C15))
    word = _mix(np.add.reduceat(parts, np.searchsorted(place, starts)))
    text_end = np.cumsum([len(t) + 1 for t in lower])
    doc = np.searchsorted(text_end, starts, side="right")
    n = np.bincount(doc, minlength=len(texts))
    rank = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    # the shingle that starts at each word: shorter texts have one, at their first word
    left = n[doc] - rank
    take = (left >= words) | (rank == 0)
    h = np.zeros(len(word), U8)
    padded = np.concatenate([word, np.zeros(words - 1, U8)])
    for k in range(words):
        h = np.where(k < left, _mix(h * U8(0x9E3779B97F4A7C15) + padded[k : k + len(word)]), h)
    h, doc = h[take], doc[take]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    h, doc = h[new], doc[new]
    return h, np.bincount(doc, minlength=len(texts))


@functools.cache
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**63, n, dtype=np.int64).astype(U8) | U8(1), rng.integers(0, 2**63, n, dtype=np.int64).astype(U8)


def minimum_hashes(h: np.ndarray, n: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """(sets, coordinates) of 32 bits; zeros for an empty set."""
    out = np.zeros((len(n), coordinates), np.uint32)
    some = np.flatnonzero(n)
    if len(some):
        start = (np.cumsum(n) - n)[some]
        a, b = _seeds(coordinates)
        for k in range(coordinates):
            x = h * a[k] + b[k]
            x ^= x >> U8(32)
            x *= U8(0x9E3779B97F4A7C15)
            out[some, k] = np.minimum.reduceat((x >> U8(32)).astype(np.uint32), start)
    return out


def _text_keys() -> list[Column]:
    """What tells rows apart: the id, and a hash of the text that also says whether the id is null."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k_id"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("k_text")]


def signatures(docs: DataFrame) -> DataFrame:
    """k_id, k_text, key (of the set; null for an empty one), size, hashes (minimum hashes) of each row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("jaccard")
        for whole in batches:
            for b in slices(whole, "text"):
                h, n = shingle_sets([t or "" for t in b.column("text").to_pylist()])
                end = np.cumsum(n)
                keys = [hashlib.blake2b(h[e - c : e].tobytes(), digest_size=16).digest() if c else None for e, c in zip(end.tolist(), n.tolist(), strict=True)]
                mh = minimum_hashes(h, n)
                yield pa.record_batch([b.column("k_id"), b.column("k_text"), pa.array(keys, pa.binary()), pa.array(n), pa.array([r.tobytes() if k else None for r, k in zip(mh, keys, strict=True)], pa.binary())], ["k_id", "k_text", "key", "size", "hashes"])

    return docs.select(*_text_keys(), "text").mapInArrow(run, "k_id long, k_text long, key binary, size long, hashes binary")


def _matrix(column: pa.Array, kind=np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def survival(depth: int, similar: float = SIMILAR, chance: float = CHANCE) -> float:
    """The chance that two sets of that similarity share a bucket `depth` levels down in one run."""
    alone = 0.0  # chance that they share none below a bucket that they share
    for _ in range(depth):
        one = 1 - similar + similar * alone
        alone = (1 - chance) * one + chance * one**2
    return 1 - alone


def runs_for(target: float = TARGET, depth: int = DEPTH, similar: float = SIMILAR) -> int:
    """Runs are added until the estimated recall at the deepest level reaches the target."""
    missed, runs = 1.0, 0
    while 1 - missed < target:
        missed *= 1 - survival(depth, similar)
        runs += 1
    return runs


def _drawn(path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What buckets draw, by their paths: a token, another one, and whether that is taken too."""
    r = _mix(path + U8(0x632BE59BD9B4E019))
    one = r % U8(COORDINATES)
    two = (one + U8(1) + (r >> U8(8)) % U8(COORDINATES - 1)) % U8(COORDINATES)
    return one.astype(np.int64), two.astype(np.int64), (r >> U8(32)) < U8(int(CHANCE * 2**32))


def _child(path: np.ndarray, token: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _mix(_mix(path + token.astype(U8)) + value.astype(U8) * U8(0x9E3779B97F4A7C15))


def _split(path: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets `at` (rows of values), each in the bucket of its path: (sets, their child buckets' paths)."""
    one, two, both = _drawn(path)
    extra = np.flatnonzero(both)
    sets, parent = np.concatenate([at, at[extra]]), np.concatenate([path, path[extra]])
    token = np.concatenate([one, two[extra]])
    return sets, _child(parent, token, values[sets, token])


def _power(bitmap: np.ndarray) -> int:
    return len(bitmap).bit_length() + 2


def _has(bitmap: np.ndarray, path: np.ndarray) -> np.ndarray:
    bit = (path >> U8(64 - _power(bitmap))).astype(np.int64)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _levels(hashes: np.ndarray, runs: int, maps: list[np.ndarray], depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(level from 1, sets, their buckets' paths, whether the bucket is too large for a task), run by run."""
    every = np.arange(len(hashes))
    for r in range(runs):
        at, path = every, np.full(len(hashes), _mix(np.array([r + 1], U8))[0])
        for level in range(1, depth + 1):
            at, path = _split(path, hashes, at)
            big = _has(maps[level - 1], path) if level <= len(maps) else np.zeros(len(path), bool)
            yield level, at, path, big
            at, path = at[big], path[big]
            if not len(at):
                break


def large_buckets(sets: DataFrame, runs: int, depth: int = DEPTH, hot: int = HOT) -> list[np.ndarray]:
    """One bitmap a level, of the buckets there with more than `hot` sets."""
    maps: list[np.ndarray] = []
    if sets.count() <= hot:
        return maps
    for level in range(1, depth + 1):
        held = sets.sparkSession.sparkContext.broadcast([m.tobytes() for m in maps])

        def run(batches: Iterator[pa.RecordBatch], held=held, level=level) -> Iterator[pa.RecordBatch]:
            above = [np.frombuffer(m, np.uint8) for m in held.value]
            for b in batches:
                if b.num_rows:
                    found = [path for at, _, path, _ in _levels(_matrix(b.column("hashes")), runs, above, level) if at == level]
                    yield pa.record_batch([pa.array(np.concatenate(found or [np.empty(0, U8)]).view(np.int64))], ["path"])

        words = cut(sets.select("hashes").mapInArrow(run, "path long").groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot))
        held.unpersist()
        if not (n := words.count()):
            break
        power = min(max((32 * n).bit_length(), BITS[0]), BITS[1])
        word = F.shiftrightunsigned("path", 64 - power + 5).cast("int").alias("word")
        bits = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(path, {64 - power}) % 32 as int))").alias("bits")
        rows = words.select(word, bits).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # a bitmap's words
        m = np.zeros((1 << power) // 32, "<u4")
        m[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
        maps.append(m.view(np.uint8))
    return maps


def _leaves(path: np.ndarray, values: np.ndarray, levels: int, limit: int) -> Iterator[np.ndarray]:
    """The small buckets of one bucket's sets (rows of values), at most `levels` further down."""
    todo = [(np.arange(len(values)), path, levels)]
    while todo:
        at, path, left = todo.pop()
        if len(at) <= limit or not left:
            yield at
            continue
        sets, child = _split(path, values, at)
        order = np.argsort(child, kind="stable")
        sets, child = sets[order], child[order]
        first = np.flatnonzero(np.concatenate([[True], child[1:] != child[:-1]])).tolist()
        for i, e in zip(first, [*first[1:], len(sets)], strict=True):
            if e - i > 1:
                todo.append((sets[i:e], child[i:e], left - 1))


def _stars(sketch: np.ndarray, agree: int) -> Iterator[tuple[np.ndarray, int]]:
    """(members, first member) of each group of sketches that agree in so many places, directly or over others."""
    left = np.arange(len(sketch))
    while len(left):
        seed, left = int(left[0]), left[1:]
        queue, found = [seed], []
        while queue and len(left):
            hit = (sketch[left] == sketch[queue.pop()]).sum(1) >= agree
            if hit.any():
                found.append(left[hit])
                queue += left[hit].tolist()
                left = left[~hit]
        if found:
            yield np.concatenate(found), seed


def _grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows of equal neighbouring values together, however they fall on batches; several groups at once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(column).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(v != v[-1])[-1]) + 1 if (v != v[-1]).any() else 0
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        elif held and held[-1].column(column)[0] != b.column(column)[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def coarse_edges(sets: DataFrame, similar: float = SIMILAR, target: float = TARGET, depth: int = DEPTH, limit: int = LIMIT, hot: int = HOT, loose: float = LOOSE) -> DataFrame:
    """Edges (a, b) between keys, or a key and an overlarge bucket's own node, that contain all true links
    with the target's recall."""
    spark = sets.sparkSession
    runs = runs_for(target, depth, similar)
    maps = large_buckets(sets, runs, depth, hot)
    held = spark.sparkContext.broadcast([m.tobytes() for m in maps])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [np.frombuffer(m, np.uint8) for m in held.value]
        for b in batches:
            if not b.num_rows:
                continue
            hashes = _matrix(b.column("hashes"))
            keys, sketch = b.column("key"), pa.array([r.tobytes() for r in hashes.astype(np.uint8)], pa.binary())
            for level, at, path, big in _levels(hashes, runs, maps, depth):
                out = np.flatnonzero(~big | (level == depth))
                if len(out):
                    rows = pa.array(at[out])
                    left = np.where(big[out], -1, depth - level).astype(np.int32)  # -1: still too large at the last level
                    yield pa.record_batch([pa.array(path[out].view(np.int64)), pa.array(left), keys.take(rows), sketch.take(rows)], ["path", "levels", "key", "sketch"])

    placed = sets.select("key", "hashes").mapInArrow(assign, "path long, levels int, key binary, sketch binary")
    over = len(maps) == depth
    placed = cut(placed) if over else placed
    agree = math.ceil(loose * COORDINATES)

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, "path"):
            path, sk, levels = t.column("path").to_numpy(), _matrix(t.column("sketch").combine_chunks(), np.uint8), t.column("levels").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            size = np.diff(np.append(first, len(path)))
            a, b = [], []
            two = first[size == 2]
            if len(two):
                ok = two[(sk[two] == sk[two + 1]).sum(1) >= agree]
                a.append(ok)
                b.append(ok + 1)
            for i, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                for leaf in _leaves(path[i : i + n].view(U8), sk[i : i + n], int(levels[i]), limit):
                    for members, seed in _stars(sk[i + leaf], agree):
                        a.append(leaf[members] + i)
                        b.append(np.full(len(members), leaf[seed] + i))
            if a:
                keys = t.column("key").combine_chunks()
                yield pa.record_batch([keys.take(pa.array(np.concatenate(x))) for x in (a, b)], ["a", "b"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = placed.where("levels >= 0") if over else placed
    edges = small.repartition(n, "path").sortWithinPartitions("path").mapInArrow(brute, "a binary, b binary")
    if over:
        node = F.concat(F.lit(b"\xff"), F.unhex(F.lpad(F.hex("path"), 16, "0")))  # 9 bytes: no set's key
        edges = edges.unionByName(placed.where("levels < 0").select(F.col("key").alias("a"), node.alias("b")))
    return edges


TAG = U8(0xA5A5A5A55A5A5A5A)
_ROW = "group binary, parts int, part int, key binary, copies long, base long, minus long, tokens binary"


def _shingles_of(docs: DataFrame) -> DataFrame:
    """The sets themselves: differences from the empty set."""
    names = ["group", "parts", "part", "key", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                h, n = shingle_sets([t or "" for t in b.column("text").to_pylist()])
                end = np.cumsum(n)
                sets = [h[e - c : e].tobytes() for e, c in zip(end.tolist(), n.tolist(), strict=True)]
                none = pa.array(np.zeros(b.num_rows, np.int64))
                yield pa.record_batch([*(b.column(c) for c in names), none, none, pa.array(sets, pa.binary())], [*names, "base", "minus", "tokens"])

    return docs.select(*names, "text").mapInArrow(run, _ROW)


def _differences(sets: DataFrame, heads: DataFrame) -> DataFrame:
    """Sets of groups of several blocks as what they have more, and less, than the group's first set."""
    first = sets.join(heads, ["group", "key"], "left_semi").select("group", F.col("tokens").alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, minus, tokens = [], [], []
            for x, h in zip(b.column("tokens").to_pylist(), b.column("head").to_pylist(), strict=True):
                x, h = np.frombuffer(x, U8), np.frombuffer(h, U8)
                less = np.setdiff1d(h, x, assume_unique=True)
                base.append(len(h))
                minus.append(len(less))
                tokens.append(np.concatenate([np.setdiff1d(x, h, assume_unique=True), less ^ TAG]).tobytes())
            yield pa.record_batch([*(b.column(c) for c in ("group", "parts", "part", "key", "copies")), pa.array(base, pa.int64()), pa.array(minus, pa.int64()), pa.array(tokens, pa.binary())], ["group", "parts", "part", "key", "copies", "base", "minus", "tokens"])

    return sets.join(first, "group").select("group", "parts", "part", "key", "copies", "tokens", "head").mapInArrow(run, _ROW)


def exact_links(members: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """members: columns of _ROW. Rows a, b, n, whole: sets of a group of one block with their group's first
    member b and the number n of documents linked to them (whole); of larger groups either b null and the
    number that part of the comparisons links to a, or n null and an edge."""
    spark = members.sparkSession
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    rows = members.select("*", other).select("group", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "parts", "part", "key", "copies", "base", "minus", "tokens")
    rows = rows.withColumn("task", F.xxhash64("group", "low", "high")).drop("group")
    num, den = round(similar * 1000), 1000

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, "task"):
            task, low, high, parts, part, copies, base, minus = (t.column(c).to_numpy() for c in ("task", "low", "high", "parts", "part", "copies", "base", "minus"))
            keys, raw = t.column("key").to_pylist(), t.column("tokens").to_pylist()
            first = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])).tolist()
            out: list[tuple] = []
            for i, e in zip(first, [*first[1:], len(task)], strict=True):
                sets, less = [np.frombuffer(x, U8) for x in raw[i:e]], minus[i:e]
                size = base[i:e] - less + np.array([len(s) for s in sets]) - less
                link = intersections(sets) + (base[i:e] - less)[:, None] - less[None, :]
                link = den * link >= num * (size[:, None] + size[None, :] - link)
                np.fill_diagonal(link, False)
                if low[i] != high[i]:  # only across; within is another task's
                    link &= part[i:e, None] != part[None, i:e]
                n = link @ copies[i:e]
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                root = _roots(link)
                if parts[i] == 1:
                    out += [(keys[i + k], keys[i + root[k]], int(n[k]), True) for k in some]
                else:
                    out += [(keys[i + k], None, int(n[k]), False) for k in some]
                    out += [(keys[i + k], keys[i + root[k]], None, False) for k in some if root[k] != k]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "n", "whole"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "task").sortWithinPartitions("task").mapInArrow(compare, "a binary, b binary, n long, whole boolean")


def _roots(link: np.ndarray) -> np.ndarray:
    """The first member of each member's group, from a matrix of links."""
    return smallest_labels(*np.nonzero(np.triu(link)), len(link))


def intersections(sets: list[np.ndarray], often: int = 48, cells: int = 16_000_000) -> np.ndarray:
    """Sizes of all pairs' intersections, over shared tokens only: a product of membership matrices for
    tokens of many sets, pair by pair for the rest. The diagonal is left open."""
    m = len(sets)
    if m == 2:
        return np.full((2, 2), len(np.intersect1d(*sets, assume_unique=True)))
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
    held = np.diff(np.append(first, len(flat)))
    out = np.zeros(m * m, np.int64)
    for k in np.unique(held[(held > 1) & (held <= often)]).tolist():
        rows = who[first[held == k][:, None] + np.arange(k)]
        for at in range(0, len(rows), max(1, 4_000_000 // k**2)):
            r = rows[at : at + max(1, 4_000_000 // k**2)]
            out += np.bincount((r[:, :, None] * m + r[:, None, :]).ravel(), minlength=m * m)
    out = out.reshape(m, m)
    many = first[held > often]
    width = max(1, cells // m)
    for at in range(0, len(many), width):
        x = np.zeros((m, min(width, len(many) - at)), np.float32)
        for j, (i, n) in enumerate(zip(many[at : at + width].tolist(), held[held > often][at : at + width].tolist(), strict=True)):
            x[who[i : i + n], j] = 1
        out += np.rint(x @ x.T).astype(np.int64)
    return out


def groups(docs: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows, sets, twice): rows has k_id, k_text and key of each document; sets has each key's label (its
    group), copies, links (documents in other sets) and first (its smallest k_id, k_text); twice has the
    k_id, k_text of rows that repeat, or is None."""
    texts = docs.select("doc_id", "text")
    rows = cut(signatures(texts))
    twice = cut(rows.groupBy("k_id", "k_text").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    twice = twice if twice.take(1) else None
    found = rows.where("key is not null")
    sets = cut(found.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("k_id", "k_text")).alias("first"), F.max("size").alias("size"), F.min("hashes").alias("hashes")))
    loose = components(coarse_edges(sets, similar)).where(F.length("node") == 16).withColumnRenamed("node", "key")
    members = cut(loose.join(sets.select("key", "copies", "first", "size"), "key"))
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("held"), F.min("key").alias("head")).where("m > 1")
    parts = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("held") / BLOCK_TOKENS)).cast("int")
    sizes = sizes.select("label", parts.alias("parts"), "head")
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    # one document of each set, by its row's keys: the texts of the rest are not needed
    wanted = members.join(sizes, "label").select(F.col("label").alias("group"), "parts", part.alias("part"), "key", "copies", "first.*")
    own = cut(_shingles_of(texts.select(*_text_keys(), "text").join(wanted, ["k_id", "k_text"])))
    own = own.dropDuplicates(["key"]) if twice is not None else own
    large = cut(sizes.where("parts > 1").select(F.col("label").alias("group"), F.col("head").alias("key")))
    if many := large.count():
        own = own.where("parts = 1").unionByName(_differences(own.where("parts > 1"), large))
    links = cut(exact_links(own, similar))
    label = links.where("whole").select(F.col("a").alias("key"), F.col("n").alias("links"), F.col("b").alias("label"))
    if many:
        degree = links.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("links"))
        linked = components(links.where("n is null").select("a", "b")).withColumnRenamed("node", "key")
        label = label.unionByName(degree.join(linked, "key"))
    sets = sets.select("key", "copies", "first").join(label, "key", "left")
    return rows, cut(sets.select("key", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "key").alias("label"))), twice


def join(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (smallest id of the group), class_size and n_links: how many other documents
    are within the similarity, copies included."""
    rows, sets, _ = groups(docs, similar)
    whole = sets.groupBy("label").agg(F.sum("copies").alias("class_size"), F.min("first").alias("head"))
    named = cut(sets.join(whole, "label").select("key", "copies", "links", "class_size", "head"))
    both = rows.select("k_id", "k_text", "key").join(named, "key", "left")
    null = F.lit(-(2**63))
    doc = F.when(F.col("k_id") != null, F.col("k_id"))
    head = F.coalesce(F.col("head.k_id"), F.col("k_id"))
    return both.select(doc.alias("doc_id"), F.when(head != null, head).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns; documents
    without words stay. Rows that repeat id and text are one document: of those that differ in other
    columns, the one whose columns' hash is smallest stays."""
    rows, sets, twice = groups(docs, similar)
    heads = sets.groupBy("label").agg(F.min("first").alias("head"))
    named = cut(sets.join(heads, "label").select("key", "head"))
    out = rows.where("key is not null").select("k_id", "k_text", "key").join(named, "key").where((F.col("k_id") != F.col("head.k_id")) | (F.col("k_text") != F.col("head.k_text")))
    drop = out.select("k_id", "k_text").distinct()
    a, b = free_name(docs, "k_id"), free_name(docs, "k_text")
    keyed = docs.select("*", *(c.alias(n) for c, n in zip(_text_keys(), (a, b), strict=True)))
    named = lambda df: df.select(F.col("k_id").alias(a), F.col("k_text").alias(b))
    left = keyed.join(named(drop), [a, b], "left_anti")
    every = [F.col(f"`{c}`") for c in docs.columns]
    if twice is not None:  # the same id and text again: no other row needs to be looked at
        twice = named(twice)
        again = left.join(twice, [a, b], "left_semi").groupBy(a, b).agg(F.min_by(F.struct(*every), F.xxhash64(*every)).alias("row")).select("row.*")
        return left.join(twice, [a, b], "left_anti").select(*every).unionByName(again.select(*every))
    return left.select(*every)


SQL = r"""
    with recursive w as (
        select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents
    ), s as (
        select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                          when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w
    ), x as (
        select doc_id, len(s) as n, unnest(s) as t from s
    ), links as materialized (
        select a.doc_id as a, b.doc_id as b from x a join x b on a.t = b.t and a.doc_id <> b.doc_id
        group by a.doc_id, b.doc_id, a.n, b.n having 10 * count(*) >= 8 * (a.n + b.n - count(*))
    ), r(doc_id, seen) as (
        select doc_id, doc_id from documents union select r.doc_id, links.b from r join links on r.seen = links.a
    ), c as (
        select doc_id, min(seen) as class_id, count(*) as class_size from r group by doc_id
    )
    select c.*, (select count(*) from links where links.a = c.doc_id) as n_links from c
"""
