"""Modified Kneser-Ney models of characters, one for each language, counted by Spark and kept in sorted hash arrays.

Symbols are characters in lower case, of any script: only digits are one symbol, kinds of white space are
one, and a run of white space or of one sign counts once, else long runs, easily foretold, would make noise
look fluent. So the table of n-grams has no bound but the corpus, and grows with it.

Counts of n-grams of ORDER symbols cover all texts. Shorter n-grams count the symbols that stand before
them. Discounts come from the counts of counts of each language and order. N-grams seen once (for shorter
ones: after one symbol) are counted in every statistic but not stored, and their mass goes to the shorter
n-gram: a text's own noise, which stands nowhere else, so earns it nothing.

The stored table is a folder of parts in the shared file system, each a range of 64-bit hashes in ascending
order with one value each: of (language, n-gram) the discounted probability, of (language, context) the
weight of the shorter n-gram. Executors write the parts and map them into memory where the store is a
mounted folder, so workers of one machine share their pages; nothing of it passes the driver. Workers keep a
table of fixed size of n-grams scored last, and look the others up by binary search.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinmark.llm.common import cut, fresh_path, kept, ship, slices
from twinmark.llm.tokenbin import _fs, mapped

ORDER = 5
U8 = np.uint64
_BASE = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(ORDER)], U8)
SLOTS = 1 << 20
"""N-grams that a worker keeps at once."""


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each code point, and whether a run of it counts once. 0 stands before a text only."""
    symbol, once = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            symbol[c] = ord(ch.lower()[0])
        elif ch.isspace():
            symbol[c], once[c] = 32, True
        elif ch.isdigit():
            symbol[c] = 48
        elif unicodedata.category(ch)[0] in "PS":
            once[c] = ch not in ".,;:!?'\"-()"
    symbol[0] = 0xFFFD
    return symbol, once


@dataclass
class Grams:
    """Symbols of texts one after another, each text after ORDER - 1 zeros; where real symbols are; number of each text's."""

    symbols: np.ndarray
    at: np.ndarray
    n: np.ndarray

    def keys(self) -> np.ndarray:
        """One 64-bit number for each n-gram of ORDER symbols."""
        s = self.symbols.astype(U8) + U8(1)
        out = s.copy()
        for k in range(1, ORDER):
            out[k:] += s[:-k] * _BASE[k]
        return out[self.at]


def grams(texts: list[str]) -> Grams:
    n = np.array([len(t) for t in texts], np.int64)
    pad = ORDER - 1
    if not len(n):
        return Grams(np.empty(0, np.uint32), np.empty(0, np.int64), n)
    symbol, once = _tables()
    raw = np.frombuffer(("\1" * pad + ("\1" * pad).join(texts)).encode("utf-32-le", "surrogatepass"), "<u4")
    sym = symbol[raw]
    start = np.cumsum(n + pad) - n
    real = np.ones(len(sym), bool)
    for k in range(1, pad + 1):
        real[start - k] = False
        sym[start - k] = 0
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != sym[:-1]) | ~once[sym[1:]] | ~real[1:]
    n = np.diff(np.concatenate([[0], np.cumsum(keep & real)])[np.concatenate([start, [len(sym)]])])
    return Grams(sym[keep], np.flatnonzero(real[keep]), n)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: keys to hashes, one to one."""
    x = (x ^ (x >> U8(30))) * U8(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U8(27))) * U8(0x94D049BB133111EB)
    return x ^ (x >> U8(31))


def hashed(slot: int, kind: int, key: np.ndarray) -> np.ndarray:
    """kind: the order of an n-gram, or 16 and the order whose context it is."""
    return mix(key ^ mix(np.array([slot << 8 | kind], U8)))


def slot_of(lang: str | None, languages: tuple[str, ...]) -> int:
    return languages.index(lang) if lang in languages else len(languages)


class Store:
    """The mapped parts of a model's table, and the n-grams that this worker scored last."""

    def __init__(self, uri: str, parts: list[str], symbols: dict[int, int]):
        self.symbols = symbols
        self.parts = [(mapped(uri, f"{p}.key").view("<i8"), mapped(uri, f"{p}.val").view("<f4")) for p in parts]
        self.ends = np.array([k[-1] for k, _ in self.parts], np.int64)
        self.seen, self.score = np.zeros(SLOTS, U8), np.zeros(SLOTS, np.float32)

    def find(self, h: np.ndarray, missing: float) -> np.ndarray:
        """Values of hashes, `missing` for those that aren't stored."""
        out = np.full(len(h), missing)
        order = np.argsort(h.view(np.int64))
        asked = h.view(np.int64)[order]
        edge = np.searchsorted(asked, self.ends, side="right")
        low = 0
        for (keys, values), high in zip(self.parts, edge.tolist(), strict=True):
            if high > low:
                at = np.searchsorted(keys, asked[low:high])
                ok = keys[at] == asked[low:high]
                out[order[low:high][ok]] = values[at[ok]]
            low = high
        return out

    def fresh(self, slot: int, symbols: np.ndarray) -> np.ndarray:
        """Log probability of each row's last symbol after the others, from the table. Rows: symbols backwards."""
        c = (symbols.astype(U8) + U8(1)) * _BASE
        p = np.full(len(symbols), 1.0 / (self.symbols.get(slot, 0) + 1))
        for order in range(1, ORDER + 1):
            own = hashed(slot, order, c[:, :order].sum(1, dtype=U8))
            ctx = hashed(slot, 16 + order, ((symbols[:, 1:order].astype(U8) + U8(1)) * _BASE[: order - 1]).sum(1, dtype=U8))
            p = self.find(own, 0.0) + self.find(ctx, 1.0) * p
        return np.log(np.maximum(p, 1e-12))

    def log_p(self, slot: int, g: Grams, keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Natural log of the probability of the symbols at g.at[rows] after those before them."""
        h = hashed(slot, 0, keys[rows])
        h |= U8(1)  # 0 is an empty place
        place = (h >> U8(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        out = self.score[place].astype(np.float64)
        new = np.flatnonzero(self.seen[place] != h)
        if len(new):
            one, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            at = g.at[rows[new[first]]]
            lp = self.fresh(slot, g.symbols[at[:, None] - np.arange(ORDER)]).astype(np.float32)  # as it will be remembered
            out[new] = lp[back]
            where = place[new[first]]
            self.seen[where], self.score[where] = one, lp
        return out


@dataclass
class Model:
    """Where the table is, its parts in ascending order, and the number of different symbols of each language."""

    uri: str
    parts: list[str]
    symbols: dict[int, int] = field(default_factory=dict)

    def store(self) -> Store:
        mine = kept("ngrams")
        if self.uri not in mine:
            mine.clear()
            mine[self.uri] = Store(self.uri, self.parts, self.symbols)
        return mine[self.uri]


def texts_of(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def slots_of(batch: pa.RecordBatch, languages: tuple[str, ...]) -> np.ndarray:
    return np.array([slot_of(x, languages) for x in batch.column("lang").to_pylist()], np.int64)


def counts(texts: DataFrame, languages: tuple[str, ...], most: int = 1_000_000, slots: int = SLOTS) -> DataFrame:
    """slot, gram, n of all texts (columns text and lang). Tasks add up n-grams in a table of fixed size; what
    finds its place taken is added up in arrays and handed on when there are `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("ngrams")
        seen, n_of, at_of, shift = np.zeros(slots, U8), np.zeros(slots, np.int64), np.zeros((slots, ORDER + 1), np.uint32), U8(65 - slots.bit_length())
        over: list[tuple] = []
        marks = mix((np.arange(len(languages) + 1) << 8).astype(U8))

        def summed(parts: list[tuple]) -> tuple:
            key, first, back = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
            return key, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64), np.concatenate([p[2] for p in parts])[first]

        def out(n: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(n), 100_000):
                r = rows[i : i + 100_000]
                words = np.ascontiguousarray(r[:, ORDER - 1 :: -1]).view(f"<U{ORDER}").ravel().tolist()
                yield pa.record_batch([pa.array(r[:, ORDER].astype(np.int32)), pa.array(words, pa.string()), pa.array(n[i : i + 100_000])], ["slot", "gram", "n"])

        for whole in batches:
            for b in slices(whole, "text"):
                g = grams(texts_of(b))
                slot = np.repeat(slots_of(b, languages), g.n)
                h = mix(g.keys() ^ marks[slot]) | U8(1)  # 0 is an empty place
                place = (h >> shift).astype(np.int64)
                hit = seen[place] == h
                n_of += np.bincount(place[hit], minlength=slots)
                new = np.flatnonzero(~hit)
                key, first, n = np.unique(h[new], return_index=True, return_counts=True)
                rows = np.column_stack([g.symbols[g.at[new[first]][:, None] - np.arange(ORDER)], slot[new[first]].astype(np.uint32)])
                where = (key >> shift).astype(np.int64)
                free = (seen[where] == 0) & np.concatenate([[True], where[1:] != where[:-1]])[: len(where)]
                seen[where[free]], n_of[where[free]], at_of[where[free]] = key[free], n[free], rows[free]
                over.append((key[~free], n[~free], rows[~free]))
                if sum(len(p[0]) for p in over) > most:
                    over[:] = [summed(over)]
                    if len(over[0][0]) > most // 2:
                        yield from out(*over.pop()[1:])
        taken = np.flatnonzero(seen)
        yield from out(n_of[taken], at_of[taken])
        if over:
            yield from out(*summed(over)[1:])

    return texts.mapInArrow(run, "slot int, gram string, n long").groupBy("slot", "gram").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Discount of counts 1, 2, 3 and more, from how many n-grams have counts 1 to 4."""
    if n1 and n2 and n3:
        y = n1 / (n1 + 2 * n2)
        own = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        return [d if 0 <= d < k else k / 2 for k, d in enumerate(own, 1)]
    return [0.5, 1.0, 1.5]


def train(texts: DataFrame, languages: tuple[str, ...]) -> Model:
    """The models of the languages from all texts (columns text and lang), as a table in the shared folder."""
    spark = texts.sparkSession
    ship(spark)
    uri = fresh_path(spark, "ngrams")
    by_order = [cut(counts(texts, languages).select("slot", F.lit(ORDER).alias("kind"), "gram", "n"))]
    for order in range(ORDER - 1, 0, -1):
        shorter = F.substring("gram", 2, order)
        by_order.append(by_order[-1].groupBy("slot", shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n")).select("slot", F.lit(order).alias("kind"), "gram", "n"))
    every = by_order[0]
    for df in by_order[1:]:
        every = every.unionByName(df)
    every = cut(every)
    few = every.groupBy("slot", "kind").agg(F.count(F.lit(1)).alias("all"), *(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).collect()  # one row a language and order
    if not few:
        return Model(uri, [])
    rows = [(r.slot, r.kind, *discounts(r.n1, r.n2, r.n3, r.n4)) for r in few]
    off = spark.createDataFrame(rows, "slot int, kind int, d1 double, d2 double, d3 double")
    left = F.col("n") - F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    stored = (F.col("n") > 1) | (F.col("kind") == 1)
    graded = every.join(F.broadcast(off), ["slot", "kind"]).select("slot", "kind", "gram", "n", F.substring(F.col("gram"), F.lit(1), F.col("kind") - 1).alias("ctx"), F.when(stored, left).alias("mass"))
    whole = graded.groupBy("slot", "kind", "ctx").agg(F.sum("n").alias("total"), F.coalesce(F.sum("mass"), F.lit(0.0)).alias("told"))
    own = graded.where("mass is not null").join(whole.select("slot", "kind", "ctx", "total"), ["slot", "kind", "ctx"]).select("slot", "kind", "gram", (F.col("mass") / F.col("total")).alias("value"))
    weight = whole.where("told > 0").select("slot", (F.col("kind") + 16).alias("kind"), F.col("ctx").alias("gram"), (1 - F.col("told") / F.col("total")).alias("value"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = own.unionByName(weight).mapInArrow(_hashes, "hash long, value float")
    written = table.repartitionByRange(parts, "hash").sortWithinPartitions("hash").mapInArrow(_writer(uri), "part int, name string").collect()  # one row a part
    return Model(uri, [r.name for r in sorted(written, key=lambda r: r.part)], {r.slot: r["all"] for r in few if r.kind == 1})


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        slot, kind, value = (b.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "kind", "value"))
        text = np.array(b.column("gram").to_pylist(), object)
        for s, k in {*zip(slot.tolist(), kind.tolist(), strict=True)}:
            at = np.flatnonzero((slot == s) & (kind == k))
            n = (k - 1) % 16 if k > 16 else k
            joined = "".join(text[at]).encode("utf-32-le", "surrogatepass")
            codes = (np.frombuffer(joined, "<u4") if n else np.empty(0, "<u4")).reshape(len(at), n)[:, ::-1]
            key = ((codes.astype(U8) + U8(1)) * _BASE[:n]).sum(1, dtype=U8)
            yield pa.record_batch([pa.array(hashed(s, k, key).view(np.int64)), pa.array(value[at].astype(np.float32))], ["hash", "value"])


def _writer(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, (fs, top) = TaskContext.get().partitionId(), _fs(uri)
        name, out = f"part-{part:05d}", {}
        for b in batches:
            if not b.num_rows:
                continue
            if not out:
                fs.create_dir(top, recursive=True)
                out = {end: fs.open_output_stream(f"{top}/{name}{end}.{TaskContext.get().taskAttemptId()}.tmp") for end in (".key", ".val")}
            out[".key"].write(b.column("hash").to_numpy().astype("<i8").tobytes())
            out[".val"].write(b.column("value").to_numpy().astype("<f4").tobytes())
        if not out:
            return
        for end, f in out.items():
            f.close()
            fs.move(f"{top}/{name}{end}.{TaskContext.get().taskAttemptId()}.tmp", f"{top}/{name}{end}")
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([name])], ["part", "name"])

    return run

