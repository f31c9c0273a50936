"""Overlap between a training table and a benchmark: exact, by token sets, by embeddings."""

from __future__ import annotations

import difflib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinmark.functions.text import overlap_key, overlap_tokens
from twinmark.operators.split import numbered
from twinmark.operators.storage import cut


def key_hash(text: Column) -> Column:
    """128 bits for a text's tokens in order: whole texts are never shuffled."""
    return F.md5(overlap_key(text))


def exact(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs left_id, right_id whose texts have the same tokens in the same order. Both: id, text."""
    a = left.select(F.col("id").alias("left_id"), key_hash(F.col("text")).alias("k"))
    b = right.select(F.col("id").alias("right_id"), key_hash(F.col("text")).alias("k"))
    return a.join(b, "k").select("left_id", "right_id")


def classes(rows: DataFrame) -> DataFrame:
    """Rows (id, text) of one table that share their tokens with another: id, class_id (the smallest id) and
    class_size. Classes are summed on the map side; pairs are never spelled out."""
    keyed = rows.select("id", key_hash(F.col("text")).alias("k"))
    many = keyed.groupBy("k").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size")).where("class_size > 1")
    return keyed.join(many, "k").select("id", "class_id", "class_size")


CELL = 4_000
"""Rows of a token's list that meet within one cell of its grid."""


def similar(left: DataFrame, right: DataFrame, threshold: float, cell: int = CELL, most_tokens: int = 500_000) -> DataFrame:
    """All pairs of unequal texts whose token sets have a Jaccard similarity of at least threshold > 0.

    Texts are cut into tokens once and kept as sets of 64-bit hashes; equal sets go as one. Tokens are ordered from rare to
    common, and two sets that similar share a token in the first n - ceil(threshold * n) + 1 of each (prefix filter), with
    enough tokens left behind it in both to reach the overlap that is needed (positional filter), so mostly rare
    tokens meet in the join. A token that is common in both tables all the same is dealt over a grid: its left rows over
    as many strips as there are `cell` of them, its right rows likewise, each row copied to the cells of its strip. So no task
    gets two whole lists. Up to `most_tokens` tokens of both sides are broadcast to the sets. Tokens that one side lacks come first of all and are only counted. Pairs found are compared exactly.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")

    def side(df: DataFrame, n: str) -> tuple[DataFrame, DataFrame]:
        hashes = F.transform(overlap_tokens(F.col("text")), lambda t: F.xxhash64(t))
        rows = df.select(F.col("id").alias(f"{n}_id"), hashes.alias("tokens"))
        rows = rows.select(f"{n}_id", F.array_sort(F.array_distinct("tokens")).alias(f"{n}_set"), F.xxhash64("tokens").alias(f"{n}_key"))
        rows = cut(rows.withColumn(f"{n}_kind", F.unhex(F.md5(F.array_join(F.transform(f"{n}_set", lambda t: t.cast("string")), ",")))))
        sets = rows.groupBy(f"{n}_kind").agg(F.any_value(f"{n}_set").alias(f"{n}_set"))
        return rows.drop(f"{n}_set"), cut(sets.withColumn(f"{n}_no", F.monotonically_increasing_id()))

    (a_rows, a), (b_rows, b) = side(left, "left"), side(right, "right")
    count = lambda df, n: df.select(F.explode(f"{n}_set").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias(f"n_{n}"))
    often = cut(count(a, "left").join(count(b, "right"), "t").select("t", (F.col("n_left") + F.col("n_right")).alias("n"), *(F.ceil(F.col(f"n_{n}") / cell).cast("int").alias(f"strips_{n}") for n in ("left", "right"))))
    if often.count() <= most_tokens:  # else both sides' tokens meet it by a shuffle
        often = F.broadcast(often)

    def prefix(df: DataFrame, n: str, other: str) -> DataFrame:
        rows = df.select(f"{n}_no", F.size(f"{n}_set").alias("size"), F.explode(f"{n}_set").alias("t")).join(often, "t")
        first = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1
        w = Window.partitionBy(f"{n}_no")
        rank = F.row_number().over(w.orderBy("n", "t")) + F.col("size") - F.count(F.lit(1)).over(w)
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= first)
        own = F.pmod(F.xxhash64(f"{n}_no"), F.col(f"strips_{n}")).cast("int").alias(f"strip_{n}")
        cells = F.explode(F.sequence(F.lit(0), F.col(f"strips_{other}") - 1)).alias(f"strip_{other}")
        return rows.select(f"{n}_no", F.col("size").alias(f"{n}_size"), F.col("rank").alias(f"{n}_rank"), "t", own, cells)

    met = prefix(a, "left", "right").join(prefix(b, "right", "left"), ["t", "strip_left", "strip_right"])
    low, high = F.least("left_size", "right_size"), F.greatest("left_size", "right_size")
    needed = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("left_size") + F.col("right_size")) - 1e-9)
    ahead = 1 + F.least(F.col("left_size") - F.col("left_rank"), F.col("right_size") - F.col("right_rank"))
    met = met.where((low >= F.lit(threshold) * high - 1e-9) & (ahead >= needed)).select("left_no", "right_no").distinct()
    both = met.join(a, "left_no").join(b, "right_no")
    shared = F.size(F.array_intersect("left_set", "right_set"))
    score = shared / (F.size("left_set") + F.size("right_set") - shared)
    kinds = both.select("left_kind", "right_kind", score.alias("similarity")).where(F.col("similarity") >= threshold)
    pairs = kinds.join(a_rows, "left_kind").join(b_rows, "right_kind").where("left_key <> right_key")
    return pairs.select("left_id", "right_id", "similarity")


def ranked(pairs: DataFrame, name: str = "place") -> DataFrame:
    """Pairs left_id, right_id, similarity with their place from 1: most similar first, ties by ids."""
    return numbered(pairs.withColumn("_less", -F.col("similarity")), ["_less", "left_id", "right_id"], name).drop("_less")


def report(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """One row: records on both sides, exact pairs and similar pairs at the threshold."""
    parts = [("left_records", left), ("right_records", right), ("exact_overlaps", exact(left, right)), ("similar_overlaps", similar(left, right, threshold))]
    counts = None
    for name, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("n"))).alias(name)
    return counts.agg(*(pick(name) for name, _ in parts), F.lit(threshold).alias("threshold"))


def sequence_ratio(left: Column, right: Column) -> Column:
    """Similarity of two texts as character sequences (matching blocks); in Arrow batches, for few pairs."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)])

    return ratio(left, right)


def _similar_characters(left: DataFrame, right: DataFrame, least: float, block: int = 20_000_000) -> DataFrame:
    """All pairs left_id, right_id, sequence of texts whose character similarity is at least `least` > 0.

    The right side is an evaluation set: it travels in blocks of at most `block` characters, each against all
    left texts, so texts are never shuffled. Pairs go by bounds that hold for the similarity: the shorter text
    has least / (2 - least) of the longer one's length, and both share so many characters, place aside,
    counted in vectors. The rest is compared in full."""
    if not 0 < least <= 1:
        raise ValueError("the character similarity must be above 0 and at most 1")
    spark = left.sparkSession
    kind = left.schema["id"].dataType.simpleString()
    rows = right.select("id", F.lower("text").alias("text")).where(F.length("text") > 0)
    length, share = F.length("text"), least / (2 - least)
    size, short, long = rows.agg(F.sum(length), F.min(length), F.max(length)).first()
    blocks = max(1, math.ceil((size or 0) / block))
    texts = left.select(F.col("id").alias("left_id"), F.lower("text").alias("text"))
    texts = texts.where(length.between(share * (short or 0) - 1e-9, (long or 0) / share + 1e-9))
    out = None
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toArrow()  # at most about a block of characters
        held = spark.sparkContext.broadcast((part.column("id").to_pylist(), part.column("text").to_pylist()))
        found = texts.mapInArrow(_near_characters(held, least), f"left_id {kind}, right_id {right.schema['id'].dataType.simpleString()}, sequence double")
        out = found if out is None else out.unionByName(found)
    return out


def _spots(texts: list[str]) -> tuple[dict[str, int], int, list[int]]:
    """Several texts in the bits of one number, a free bit after each: where each character stands, all texts' bits,
    and where each text starts."""
    spots: dict[str, int] = {}
    full, start = 0, [0]
    for t in texts:
        own: dict[str, int] = {}
        for i, c in enumerate(t):
            own[c] = own.get(c, 0) | 1 << i
        for c, bits in own.items():
            spots[c] = spots.get(c, 0) | bits << start[-1]
        full |= ((1 << len(t)) - 1) << start[-1]
        start.append(start[-1] + len(t) + 1)
    return spots, full, start


def _left_over(text: str, spots: dict[str, int], full: int) -> int:
    """The table of longest common subsequences of `text` with all texts of `spots` at once, a row in the bits of one number.
    Bits still set in a text's place are its characters outside the subsequence; a sum's carry ends in the free bit."""
    row = full
    for c in text:
        if hit := row & spots.get(c, 0):
            row = (row + hit | row - hit) & full
    return row


def _subsequence(a: str, b: str, spots: dict[str, int]) -> int:
    """Length of the longest common subsequence, which no similarity by matching blocks exceeds. spots: where each character
    stands in a, filled at first use."""
    if not spots:
        spots.update(_spots([a])[0])
    return len(a) - _left_over(b, spots, (1 << len(a)) - 1).bit_count()


def _ratio(a: str, b: str, least: float) -> float | None:
    """Similarity by matching blocks, None once what is matched and the subsequences of what is left can't reach `least`."""
    size = len(a) + len(b)
    whole = difflib.SequenceMatcher(None, a, b, autojunk=False)
    matched, todo = 0, [(0, len(a), 0, len(b), min(len(a), len(b)))]
    ahead = todo[0][-1]  # no more than this is still to come
    while todo:
        alo, ahi, blo, bhi, most = todo.pop()
        ahead -= most
        i, j, k = whole.find_longest_match(alo, ahi, blo, bhi)
        if not k:
            continue
        matched += k
        for w, x, y, z in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
            if most := _subsequence(a[w:x], b[y:z], {}):
                todo.append((w, x, y, z, most))
                ahead += most
        if 2 * (matched + ahead) < least * size - 1e-9:
            return None
    ratio = 2.0 * matched / size if size else 1.0
    return ratio if ratio >= least else None


def _near_characters(held, least: float, kinds: int = 64, bits: int = 1 << 14):
    def histogram(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), kinds), np.int32)
        for i, t in enumerate(texts):
            out[i] = np.bincount(np.frombuffer(t.encode("utf-32-le"), "<u4") % kinds, minlength=kinds)
        return out

    def run(batches):
        ids, texts = held.value
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        ids, texts = [ids[i] for i in order], [texts[i] for i in order]
        length, counts = np.array([len(t) for t in texts], np.int64), histogram(texts)
        group = np.cumsum(length) // bits  # neighbours in length share a number of about so many bits
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])).tolist() if len(texts) else []
        for b in batches:
            left = [(i, t) for i, t in zip(b.column("left_id").to_pylist(), b.column("text").to_pylist(), strict=True) if t]
            own, size = histogram([t for _, t in left]), np.array([len(t) for _, t in left], np.int64)
            lows, highs = (np.searchsorted(length, x, side="left") for x in (least / (2 - least) * size - 1e-9, (2 - least) / least * size + 1e-9))
            found = []
            for start, end in zip(first, [*first[1:], len(texts)], strict=False):
                here = np.flatnonzero((lows < end) & (highs > start)).tolist()
                spots, full, place = _spots(texts[start:end] if here else [])
                for x in here:
                    low, high, (i, text) = max(start, lows[x]), min(end, highs[x]), left[x]
                    near = low + np.flatnonzero(2 * np.minimum(counts[low:high], own[x]).sum(1) >= least * (size[x] + length[low:high]) - 1e-9)
                    row = _left_over(text, spots, full) if len(near) else 0
                    for j in near.tolist():
                        other = texts[j]
                        outside = (row >> place[j - start] & (1 << len(other)) - 1).bit_count()
                        if 2 * (len(other) - outside) < least * (len(text) + len(other)) - 1e-9:
                            continue
                        if (ratio := _ratio(text, other, least)) is not None:
                            found.append((i, ids[j], ratio))
            if found:
                yield pa.record_batch([pa.array(x) for x in zip(*found, strict=True)], ["left_id", "right_id", "sequence"])

    return run


def leaks(left: DataFrame, right: DataFrame, sequence: float = 0.72, jaccard: float = 0.60, most_pairs: int = 1_000_000) -> DataFrame:
    """All pairs of unequal texts that are near by token sets or by characters, each looked for by bounds
    of its own."""
    by_tokens = similar(left, right, jaccard).select("left_id", "right_id")
    by_characters = _similar_characters(left, right, sequence)
    known = by_characters.groupBy("left_id", "right_id").agg(F.max("sequence").alias("sequence"))
    met = cut(by_tokens.distinct().join(known, ["left_id", "right_id"], "full"))

    def texts(df: DataFrame, n: str) -> DataFrame:
        """Only texts that are in a pair; up to `most_pairs` pairs, their ids go to the texts rather than texts to them."""
        ids = met.select(F.col(f"{n}_id").alias("id")).distinct()
        return df.join(F.broadcast(ids) if few else ids, "id", "left_semi").select(F.col("id").alias(f"{n}_id"), F.col("text").alias(n))

    few = met.count() <= most_pairs
    both = met.join(texts(left, "left"), "left_id").join(texts(right, "right"), "right_id")
    both = both.where(overlap_key(F.col("left")) != overlap_key(F.col("right")))
    a, b = (F.array_distinct(overlap_tokens(F.col(n))) for n in ("left", "right"))
    shared = F.size(F.array_intersect(a, b))
    score = F.try_divide(shared, F.size(a) + F.size(b) - shared)
    unknown = F.col("sequence").isNull()  # the ratio is worked out only for pairs that the characters did not bring
    fresh = both.withColumn("_ratio", sequence_ratio(F.when(unknown, F.lower("left")).otherwise(""), F.when(unknown, F.lower("right")).otherwise("")))
    return fresh.select("left_id", "right_id", score.alias("similarity"), F.when(unknown, F.col("_ratio")).otherwise(F.col("sequence")).alias("sequence"))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def _vectors(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vector: the rows, and their vectors; a vector with a null in it holds NaN."""
    col = batch.column("vector").cast(pa.large_list(pa.float64()))
    ends, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
    there, size = col.is_valid().to_numpy(zero_copy_only=False), np.diff(ends)
    out = {}
    for n in np.unique(size[there]).tolist():
        rows = np.flatnonzero(there & (size == n))
        out[n] = rows, flat[ends[rows][:, None] + np.arange(n)]
    return out


def _nearest(ids: pa.Array, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, others: bool, least: float, rows: int = 2048):
    """The k nearest of a partition's rows for each query: products of matrices, block by block, and what they leave of each query's best so far."""
    lengths = {n: np.sqrt((q * q).sum(1)) for n, (_, q) in queries.items()}
    names = np.array(ids.to_pylist(), object)

    def run(batches):
        best = pd.DataFrame({"query": np.zeros(0, np.int64), "id": [], "similarity": np.zeros(0)})
        floor, kind = np.full(len(names), least), None

        def kept(new: list[pd.DataFrame]) -> pd.DataFrame:
            every = pd.concat([best, *new]).sort_values(["query", "similarity", "id"], ascending=[True, False, True], kind="stable")
            return every.groupby("query", sort=False).head(k)

        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                own, new, kind = np.array(b.column("id").to_pylist(), object), [], b.column("id").type
                for n, (where, v) in _vectors(b).items():
                    if n not in queries:
                        continue
                    number, q = queries[n]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        s = (q @ v.T) / (lengths[n][:, None] * np.sqrt((v * v).sum(1)))
                    hit = s >= floor[number][:, None]  # never true of NaN
                    if others:
                        hit &= names[number][:, None] != own[where][None, :]
                    i, j = np.nonzero(hit)
                    new.append(pd.DataFrame({"query": number[i], "id": own[where[j]], "similarity": s[i, j]}))
                if new:
                    best = kept(new)
                    full = best.groupby("query")["similarity"].agg(["size", "min"])
                    full = full[full["size"] >= k]
                    floor[full.index.to_numpy()] = np.maximum(full["min"].to_numpy(), least)
        if len(best):
            yield pa.record_batch([ids.take(pa.array(best["query"].to_numpy(np.int64))), pa.array(best["id"].tolist(), kind), pa.array(best["similarity"].to_numpy(float))], ["query_id", "id", "similarity"])

    return run


def embedding_top_k(queries: DataFrame, rows: DataFrame, k: int, threshold: float | None = None, most_queries: int = 20_000, others: bool = False, most_bytes: int = 64_000_000) -> DataFrame:
    """For each query its k nearest rows by cosine (ties to smaller ids), those at the threshold if one is given.
    Both: id, vector. The queries are a stated set: they go in blocks of at most about `most_queries` and `most_bytes`, each
    against all rows; a partition keeps k rows a query, and those of all partitions meet in one window.
    others: a query's own id is no answer. Vectors of other lengths, without length, null or with nulls answer nothing."""
    spark = queries.sparkSession
    n, size = queries.agg(F.count(F.lit(1)), F.sum(F.size("vector") * 8 + 16)).first()
    blocks = max(1, math.ceil(n / most_queries), math.ceil((size or 0) / most_bytes))
    key, kind = queries.schema["id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        held = part.select("id", "vector").toArrow().combine_chunks().to_batches()  # one block, of a bounded size
        if not held:
            continue
        run = _nearest(held[0].column("id"), _vectors(held[0]), k, others, -np.inf if threshold is None else threshold)
        found = rows.select("id", "vector").mapInArrow(run, f"query_id {key}, id {kind}, similarity double")
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = best if blocks == 1 else cut(best)  # a block is done before the next is sent
        out = best if out is None else out.unionByName(best)
    return spark.createDataFrame([], f"query_id {key}, id {kind}, similarity double, rank int") if out is None else out


def duplicates(df: DataFrame, key: Column, order: str, id_column: str) -> DataFrame:
    """Rows whose key an earlier row has: the row's id, a 128-bit hash of the key, and the earlier holder's id.

    Keys are hashed once and counted on the map side. Only rows whose key is there twice are numbered, in order of
    key and place by ranges, so one key may fill many tasks; a row's earlier holder is then the row of the number before."""
    rows = cut(df.select(F.col(id_column), F.col(order).alias("_order"), F.md5(key).alias("dup_key")).where("dup_key is not null"))
    twice = rows.groupBy("dup_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("dup_key")
    rows = numbered(rows.join(twice, "dup_key", "left_semi"), ["dup_key", "_order"], "_row").select(id_column, "dup_key", "_row")
    rows = cut(rows)
    before = rows.select(F.col(id_column).alias("earlier_id"), F.col("dup_key").alias("_key"), (F.col("_row") + 1).alias("_row"))
    return rows.join(before, "_row").where("dup_key = _key").select(id_column, "dup_key", "earlier_id")
