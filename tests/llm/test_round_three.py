"""Centroid clustering, substring dedup and importance resampling against plain versions."""

import random
from collections import Counter

import brute
import numpy as np
import pytest

from twinmark.llm import clusters, resample, windowdedup
from twinmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


# substring dedup


def words_left(spark, rows, parts=3, **how):
    df = spark.createDataFrame(rows, DOCS).repartition(parts)
    got = windowdedup.dedup(df, with_counts=True, **how).collect()
    return Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got)


def plain_left(rows, span):
    return Counter((r[0], n, gone, " ".join(kept)) for r, (n, gone, kept) in zip(rows, brute.windows(rows, span), strict=True))


def random_texts(seed, n, vocabulary, passages=6):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(rng.randrange(3, 40))] for _ in range(passages)]
    rows = []
    for i in range(n):
        w = []
        while len(w) < rng.randrange(1, 120):
            w += rng.choice(shared) if rng.random() < 0.4 else [word() for _ in range(rng.randrange(1, 15))]
        rows.append((i, "".join(x + rng.choice([" ", "\n", "\t", "  "]) for x in w)))
    return rows


@pytest.mark.parametrize("span,run,vocabulary", [(20, 4, 5000), (5, 2, 3), (7, 7, 2), (3, 4, 1), (1, 1, 50)])
def test_windows(spark, span, run, vocabulary):
    rows = random_texts(span, 60, vocabulary)
    assert words_left(spark, rows, span=span, run=run) == plain_left(rows, span)


def test_windows_odd_rows(spark):
    long = " ".join(f"x{i % 700}" for i in range(60_000))
    copy = " ".join(f"c{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, copy), (4, copy), (4, "before " + copy), (None, copy), (None, None), (5, long), (6, "a " * 3000), (7, "é b " + copy + " ünder"), (8, "\x1c".join("abc") + " " + copy)]
    assert words_left(spark, rows) == plain_left(rows, 20)


def test_windows_too_many_for_a_bucket(spark):
    rows = random_texts(3, 80, 2)
    assert words_left(spark, rows, span=6, run=2, at_once=50, too_large=200) == plain_left(rows, 6)


def test_windows_common_passage(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(45))
    rng = random.Random(5)
    own = lambda: " ".join(f"q{rng.randrange(10**9)}" for _ in range(rng.randrange(5, 60)))
    rows = [(i, f"{own()} {passage} {own()}") for i in range(300)]
    texts = spark.createDataFrame(rows, DOCS).select("text").repartition(4)
    hot = windowdedup.hot_minimisers(texts, 20, 4, 4)
    assert 0 < len(hot) <= 16
    assert words_left(spark, rows, parts=4) == plain_left(rows, 20)
    monkeypatch.setattr(windowdedup, "HELD", 10)  # strings combined a few at a time
    out = windowdedup._Sender(20, 8)
    w = windowdedup.Words([r[1].encode() for r in rows[:50]], 20)
    out.add(w, list(range(50)), [0] * 50, *windowdedup.minimisers(w, 20, 4, hot))
    inner = [x for x in out.later if x[3] >= 20]
    assert inner and all(x[0] > 0 for x in inner)  # all but the first document's are judged before anything travels


def test_windows_hashes_that_collide(spark, monkeypatch):
    monkeypatch.setattr(windowdedup, "_mixed", lambda x: x & np.uint64(1))
    rows = random_texts(8, 40, 4)
    texts = [t.encode() for _, t in rows]
    b = windowdedup._Bucket()
    w = windowdedup.Words(texts, 6)
    first, n, low = windowdedup.minimisers(w, 6, 2, np.zeros(0, np.uint64))
    s = windowdedup._Sender(6, 1)
    s.add(w, list(range(40)), [0] * 40, first, n, low)
    gone = Counter()
    mark = lambda d, a, z: gone.update((d, i) for i in range(a, z))
    for d, _, a, size in s.later:
        mark(d, a, a + size)
    s.later.clear()
    for batch in s.sent():
        for row in batch.to_pylist():
            b.add(row)
    for batch in b.judged(6):
        for r in batch.to_pylist():
            mark(r["k_id"], r["start"], r["stop"])
    assert Counter(d for d, _ in gone) == Counter({i: g for i, (_, g, _) in enumerate(brute.windows(rows, 6)) if g})


def test_windows_columns(spark):
    df = spark.createDataFrame([(1, "x", 7, "k", 2.5)], "n_removed int, k_id string, doc_id long, runs string, text double").drop("text").selectExpr("*", "repeat('a b ', 30) as text")
    got = windowdedup.dedup(df, with_counts=True)
    assert got.columns == [*df.columns, "n_words", "_n_removed"]
    (r,) = got.collect()
    assert (r.n_removed, r.k_id, r.runs, r.n_words, r._n_removed, r.text) == (1, "x", "k", 60, 58, "a b")
    assert windowdedup.assess(df.where("false")).collect() == []


# centroid clustering


def clustered(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = clusters.cluster(df, **how)
    got = [] if found.assigned is None else [tuple(r) for r in found.assigned.collect()]
    return sorted(got, key=repr), found


@pytest.mark.parametrize("n,k,size,spread", [(400, 16, 64, 1.0), (300, 9, 5, 0.05), (200, 16, 1, 1.0), (30, 2, 3, 1.0), (20, 1, 4, 1.0), (5, 16, 64, 1.0)])
def test_clusters(spark, n, k, size, spread):
    rng = np.random.default_rng(n)
    rows = [(i, (spread * rng.normal(size=size) + rng.integers(0, 3)).tolist()) for i in range(n)]
    want, cents = brute.kmeans(rows, k, 5, size)
    got, found = clustered(spark, rows, k=k, rounds=5, size=size)
    assert got == sorted(want, key=repr) and found.centroids == cents


def test_bounds_save_distances(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(16, 64)) * 4
    rows = [(i, (middle[i % 16] + 0.1 * rng.normal(size=64)).tolist()) for i in range(1500)]
    want, _ = brute.kmeans(rows, 16, 4)
    got, found = clustered(spark, rows, rounds=4)
    assert got == sorted(want, key=repr)
    assert found.measured[0] == 16 and found.measured[-1] < 4


def test_clusters_odd_rows(spark):
    rng = np.random.default_rng(2)
    sound = [(i, rng.normal(size=64).tolist()) for i in range(60)]
    big = [[1e300] * 64, [-1e300] + [0.5] * 63, [1.7e308] * 64, [3e9] * 64]
    rows = [*sound, *sound[:20], (None, sound[5][1]), (None, [0.25] * 64), (99, None), (98, []), (97, [0.5] * 63), (96, [float("nan")] * 64), (95, [float("inf")] * 64), (94, [None] + [0.1] * 63)]
    for extra in ([], [(200 + i, v) for i, v in enumerate(big)]):
        want, _ = brute.kmeans(rows + extra)
        got, _ = clustered(spark, rows + extra)
        assert got == sorted(((i, c, min(d, 2**63 - 1)) for i, c, d in want), key=repr)
    same = [(i, [0.5] * 64) for i in range(40)]  # all tied
    assert clustered(spark, same)[0] == sorted(((i, 0, 0) for i in range(40)), key=repr)
    assert clustered(spark, [(96, [float("nan")] * 64), (1, None)])[0] == []


def test_clusters_columns(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id", "embedding", "1 as cluster", "'x' as at", "2 as vector")
    a = sorted(map(tuple, clusters.assess(df).collect()))
    assert a == sorted(map(tuple, QUERIES["op11_centroid_clustering"](spark, SF).collect()))
    assert len({r[4] for r in a}) == 1 and a[0][4] == sum(r[2] for r in a)
    assert clusters.assess(df.where("false")).collect() == []


# importance resampling


def sampled(spark, rows, target, parts=3, **how):
    docs, goal = spark.createDataFrame(rows, DOCS).repartition(parts), spark.createDataFrame([(x,) for x in target], "text string")
    got = resample.assess(docs, goal, **how).collect()
    return Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got), [r.doc_id for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])], docs, goal


@pytest.mark.parametrize("how", [{}, {"order": 3, "buckets": 97, "share": 35, "least": 1}, {"order": 2, "buckets": 1, "seed": 7}])
def test_resampling(spark, how):
    rows = [(i, t) for i, t in random_texts(11, 120, 40)]
    rows += [(1000, None), (1001, ""), (1002, "Straße ÀÉ naïve №5 日本語 x_y A-B " * 9), (None, "one two " * 15), (None, None), (1003, "w1 " * 50_000)]
    target = ["w1 w2 w3 " * 5, None, "", "W7 w8"]
    got, drawn, docs, goal = sampled(spark, rows, target, **how)
    want, best = brute.importance(rows, target, **how)
    assert got == Counter(want) and drawn == best
    taken = resample.draw(docs.withColumn("score", docs.doc_id * 2), goal, **how)
    assert taken.columns == ["doc_id", "text", "score"] and Counter(r.doc_id for r in taken.collect()) == Counter(best)


def test_resampling_ties(spark):
    rows = [(i % 4, "same words in all of these texts " * 4) for i in range(90)] + [(9, "short")]
    got, drawn, _, _ = sampled(spark, rows, ["same"], share=50)
    want, best = brute.importance(rows, ["same"], share=50)
    assert got == Counter(want) and drawn == best and len(best) == 45
    got = resample.assess(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "text string"), share=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 46))


def test_resampling_empty(spark):
    none = spark.createDataFrame([], DOCS)
    assert resample.assess(none, none).collect() == [] and resample.draw(none, none).collect() == []
    few = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    assert [r["rank"] for r in resample.assess(few, none).collect()] == [None, None]


def test_trie_that_starts_again(spark):
    texts = spark.createDataFrame(random_texts(4, 80, 300), DOCS).select("text").coalesce(1)
    few, many = (Counter({r.bucket: r.n for r in resample.bucket_counts(texts, 3, 50, nodes).collect()}) for nodes in (1, 10**6))
    assert few == many


def test_query_draws_a_tenth(spark):
    rows = QUERIES["op13_importance_resampling"](spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want, best = brute.importance(docs, target)
    assert {(r.doc_id, r.n_features, r.weight, r.score) for r in rows} == set(want)
    assert [r.doc_id for r in sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])] == best
