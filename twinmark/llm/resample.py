"""Importance resampling towards a target: documents are drawn by how much their words look like the target's.

A feature is a run of 1 to `order` words; it falls in the bucket of its checksum. A bucket's gain says how much
more often the target has it than the corpus, a document's weight is the mean gain of its features, and a draw
without replacement takes the highest weights plus Gumbel noise that is a hash of the seed and the id.

Both passes over the texts walk a trie of words in each task. A node is a run of words: it holds the checksum of
the run's bytes, so that a child's goes on from its parent's, and the times the run was met. In the first pass the
counts end in one total per bucket and task, and Spark adds those up; a trie that has grown to its limit gives its
counts to the task's totals and starts again, which changes no sum. In the second pass a node carries its bucket's
gain from the moment it is made, and a document's weight is the sum over the nodes its words lead through. What goes
to the driver is one number per bucket; the draw finds the lowest score it takes from two small histograms, and ranks
only what is above it, in ranges.

Words are runs of digits, letters a-z and anything beyond ASCII, once A-Z are lowered. Null and empty texts have no
features and weight 0. Rows are documents of their own, also where ids or whole rows repeat: equal ids have equal
noise, equal scores go by id, null ids (hashed as empty) first, and rows alike in both in no particular order. With
no target or no corpus counts are 0 and the gains follow from the formula. An empty table gives no rows. Of the
input only doc_id and text are read by assess(); draw() returns the input's columns, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from twinmark.llm.common import cut, free_name, ranked, ship, slices

ORDER, BUCKETS, SHARE, LEAST, SEED = 1, 10_000, 10, 20, 2024
NODES = 400_000  # of a trie, after which its counts are handed over; a slice of texts may exceed it by its own words
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
"""Bytes of UTF-8 with A-Z lowered and everything that ends a word as a space."""


class _Words(dict):
    """The root's children: word -> node, made when first asked for."""

    def __init__(self, make: Callable[[bytes], int]):
        self.make = make

    def __missing__(self, word: bytes) -> int:
        self[word] = node = self.make(word)
        return node


class Trie:
    """Runs of up to `order` words. Of node i: crc[i], the run's checksum; gain[i], where gains are given; met[i]."""

    def __init__(self, order: int, buckets: int, gains: np.ndarray | None = None):
        self.order, self.buckets, self.gains = order, buckets, None if gains is None else gains.tolist()
        self.clear()

    def clear(self) -> None:
        self.first = _Words(lambda w: self._node(zlib.crc32(w), w))
        self.deeper: dict[int, int] = {}  # parent << 32 | first node of the word that follows -> node
        self.crc: list[int] = []
        self.word: list[bytes | None] = []  # of the root's children only
        self.gain: list[int] = []
        self.met = np.zeros(0, np.int64)

    def _node(self, crc: int, word: bytes | None) -> int:
        self.crc.append(crc)
        if self.order > 1:
            self.word.append(word)
        if self.gains is not None:
            self.gain.append(self.gains[crc % self.buckets])
        return len(self.crc) - 1

    def walk(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of 1, 2, ... words: the nodes of all runs of that length, and how many each text has of them."""
        split = [t.translate(FOLD).split() if t else [] for t in texts]
        size = np.fromiter(map(len, split), np.int64, len(split))
        first = np.fromiter((n for words in split for n in map(self.first.__getitem__, words)), np.int64, int(size.sum()))
        yield first, size
        text = np.repeat(np.arange(len(split)), size)
        nodes = first
        for k in range(1, self.order):
            if len(nodes) < 2:
                return
            inside = text[: len(text) - k] == text[k:]  # the run ends in the text it starts in
            key = np.where(inside, nodes[:-1] << 32 | first[k:], -1)
            kinds, which = np.unique(key, return_inverse=True)
            made = np.empty(len(kinds), np.int64)
            for i, x in enumerate(kinds.tolist()):
                node = 0 if x < 0 else self.deeper.get(x)
                if node is None:
                    node = self.deeper[x] = self._node(zlib.crc32(b" " + self.word[x & 0xFFFFFFFF], self.crc[x >> 32]), None)
                made[i] = node
            nodes = made[which]
            yield nodes[inside], np.bincount(text[: len(inside)][inside], minlength=len(split))

    def count(self, texts: list[bytes | None]) -> None:
        for nodes, _ in self.walk(texts):
            seen = np.bincount(nodes, minlength=len(self.crc))
            seen[: len(self.met)] += self.met
            self.met = seen

    def totals(self) -> np.ndarray:
        """Features met by bucket."""
        bucket = np.array(self.crc, np.int64) % self.buckets
        out = np.zeros(self.buckets, np.int64)
        np.add.at(out, bucket, np.pad(self.met, (0, len(bucket) - len(self.met))))
        return out

    def weigh(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: words, features, and the sum of its features' gains."""
        words, features, total = None, np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for nodes, size in self.walk(texts):
            words = size if words is None else words
            run = np.concatenate([[0], np.cumsum(np.array(self.gain, np.int64)[nodes])])
            ends = np.cumsum(size)
            features += size
            total += run[ends] - run[ends - size]
        return words, features, total


def _bytes(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS, nodes: int = NODES) -> DataFrame:
    """bucket, n: features of all texts by bucket; buckets without features are left out."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(order, buckets), np.zeros(buckets, np.int64)
        for whole in batches:
            for b in slices(whole, "text"):
                trie.count(_bytes(b))
                if len(trie.crc) > nodes:
                    out += trie.totals()
                    trie.clear()
        out += trie.totals()
        some = np.flatnonzero(out)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(out[some], pa.int64())], ["bucket", "n"])

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket, floor(1000 * ln of its share in the target over its share in the corpus), each feature counted once more."""

    def held(df: DataFrame) -> list[int]:
        out = [0] * buckets
        for r in bucket_counts(df, order, buckets).collect():  # one row a bucket at most
            out[r.bucket] = r.n
        return out

    s, t = held(docs), held(target)
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, order: int, names: tuple[str, str, str], nodes: int = NODES) -> DataFrame:
    """docs with words, features and weight under the given names."""
    spark = docs.sparkSession
    ship(spark)
    raw, buckets = gain.astype("<i8").tobytes(), len(gain)
    text = free_name(docs, "text_read")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(order, buckets, np.frombuffer(raw, "<i8"))
        for whole in batches:
            for b in slices(whole, text):
                words, features, total = trie.weigh(b.column(text).cast(pa.large_binary()).to_pylist())
                weight = total // np.maximum(features, 1)
                if len(trie.crc) > nodes:
                    trie.clear()
                keep = [b.column(i) for i in range(b.num_columns - 1)]
                yield pa.record_batch([*keep, *(pa.array(x, pa.int64()) for x in (words, features, weight))], [*b.schema.names[:-1], *names])

    schema = StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in names)])
    return docs.withColumn(text, F.col("text").cast("string")).mapInArrow(run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of sha256("seed:id")."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def cutoff(scores: DataFrame, score: str, share: int, width: int = 256) -> tuple[int, int | None]:
    """(how many are drawn, the lowest score among them): a histogram of bins of `width` scores, then one of the scores
    of the bin where the last one falls. Scores lie within some 10^5 of each other, so both are short."""
    bins = scores.groupBy(F.floor(F.col(score) / width).alias("bin")).count().orderBy(F.desc("bin")).collect()
    k = share * sum(r["count"] for r in bins) // 100
    if not k:
        return 0, None
    left, last = k, None
    for r in bins:
        last = r.bin
        if r["count"] >= left:
            break
        left -= r["count"]
    for r in scores.where(F.floor(F.col(score) / width) == last).groupBy(score).count().orderBy(F.desc(score)).collect():
        if r["count"] >= left:
            return k, r[score]
        left -= r["count"]
    raise AssertionError("the histograms disagree")


def _scored(docs: DataFrame, gain: np.ndarray, order: int, seed: int, names: tuple[str, str, str, str]) -> DataFrame:
    words, features, weight, score = names
    return weighed(docs, gain, order, (words, features, weight)).withColumn(score, F.col(weight) + noise(F.col("doc_id"), seed))


def assess(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, share: int = SHARE, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document: of the N with at least `least` words the
    floor(share * N / 100) highest scores are drawn and ranked from 1, ties to smaller ids; the others' rank is null."""
    light = docs.select("doc_id", "text")
    df = cut(_scored(light, gains(docs, target, order, buckets), order, seed, ("n_words", "n_features", "weight", "score")).drop("text"))
    k, low = cutoff(df.where(F.col("n_words") >= least), "score", share)
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return df.select("*", none)
    above = (F.col("n_words") >= least) & (F.col("score") >= low)
    placed = df.where(above).withColumn("place", F.monotonically_increasing_id())  # of a table that is kept: the same each time
    top = ranked(placed, [F.desc("score"), F.asc_nulls_first("doc_id"), F.col("place")], "rank").drop("place")
    top = top.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return top.unionByName(df.where(~above).select("*", none))


def draw(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, share: int = SHARE, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """The drawn documents, with the input's columns. Whole rows aren't sorted: those above the lowest score drawn are
    kept as they pass, and only those that tie with it are put in order of their ids."""
    names = tuple(free_name(docs, x) for x in ("n_words", "n_features", "weight", "score"))
    gain = gains(docs, target, order, buckets)
    df = _scored(docs, gain, order, seed, names)
    light = cut(df.select(names[0], names[3]).where(F.col(names[0]) >= least))
    k, low = cutoff(light, names[3], share)
    if not k:
        return docs.where(F.lit(False))
    over = light.where(F.col(names[3]) > low).count()
    df = df.where(F.col(names[0]) >= least)
    at, place = free_name(docs, "rank"), free_name(docs, "place")
    tied = cut(df.where(F.col(names[3]) == low)).withColumn(place, F.monotonically_increasing_id())
    tied = ranked(tied, [F.asc_nulls_first("doc_id"), F.col(place)], at).where(F.col(at) <= k - over)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return df.where(F.col(names[3]) > low).select(*own).unionByName(tied.select(*own))
