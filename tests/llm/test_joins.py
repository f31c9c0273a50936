"""Operators over pairs and hosts, against plain versions."""

import math
import random
import time
from fractions import Fraction

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinmark.llm import components, jaccard, langid, topk

RNG = random.Random(11)


def near_rows():
    words = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(25):
        base = [RNG.choice(words) for _ in range(RNG.randint(3, 120))]
        for _ in range(RNG.randint(1, 6)):
            own = list(base)
            for _ in range(RNG.randint(0, 3)):
                own[RNG.randrange(len(own))] = RNG.choice(words)
            rows.append((k, " ".join(own)))
            k += 1
    rows += [(k, ""), (k + 1, None), (k + 2, "..."), (k + 3, "One two"), (k + 4, "one, TWO!"), (None, rows[0][1]), (k + 5, rows[0][1].upper())]
    return rows


def test_groups_and_links_equal_all_pairs(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "k_id", "k_text", "label", "path")})
    want = brute.jaccard(rows)
    got = {r.doc_id: r for r in jaccard.join(df).collect()}
    assert len(got) == len(rows)
    for i, (doc, _) in enumerate(rows):
        group, links = want[i]
        ids = [rows[j][0] for j in group]
        named = None if None in ids and len(ids) == 1 else min((x for x in ids if x is not None), default=None)
        r = got[doc]
        assert (r.class_size, r.n_links) == (len(group), links), doc
        if None not in ids:
            assert r.class_id == named
    one = jaccard.keep_one(df)
    assert one.columns == df.columns and one.count() == len({want[i][0] for i in range(len(rows))})


def test_large_buckets_and_blocks_give_the_same(spark, monkeypatch):
    rows = near_rows() + [(10_000 + i, " ".join(f"v{j}" if j != i else "odd" for j in range(90))) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: (r.class_size, r.n_links) for r in jaccard.join(df).collect()}
    assert want[10_000] == (70, 69)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard.coarse_edges, "__defaults__", (0.8, 0.999, 3, 4, 16, 0.5))
    assert {r.doc_id: (r.class_size, r.n_links) for r in jaccard.join(df).collect()} == want
    monkeypatch.setattr(components, "EDGES", 3)  # rounds of joins instead of one task
    assert {r.doc_id: (r.class_size, r.n_links) for r in jaccard.join(df).collect()} == want


def pairs_at(n, similar, seed=3):
    """Minimum hashes of n pairs of sets whose tokens agree with that probability, and of a crowd."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**32, (n, jaccard.COORDINATES), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < similar, a, rng.integers(0, 2**32, a.shape, dtype=np.uint32))
    return a, b


@pytest.mark.parametrize("depth", range(1, jaccard.DEPTH + 1))
def test_recall_at_each_depth(depth):
    n = 4000
    a, b = pairs_at(n, 0.8)
    met = np.zeros(n, bool)
    seen = np.zeros((jaccard.runs_for(), n), bool)
    for r in range(len(seen)):
        ends = []
        for h in (a, b):
            at, path = np.arange(n), np.full(n, jaccard._mix(np.array([r + 1], np.uint64))[0])
            for _ in range(depth):
                at, path = jaccard._split(path, h, at)
            ends.append(set(zip(at.tolist(), path.tolist(), strict=True)))
        seen[r, [i for i, _ in ends[0] & ends[1]]] = True
    met = seen.any(0)
    assert seen.mean() == pytest.approx(jaccard.survival(depth), abs=0.05)
    assert met.mean() >= 0.99


def test_a_pair_at_the_limit_looks_near_enough():
    from math import ceil, comb

    p, n = 0.8, jaccard.COORDINATES
    assert sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(ceil(jaccard.LOOSE * n))) < 1e-6


def test_leaves_hold_all_sets_of_a_bucket_once_or_more():
    a, _ = pairs_at(3000, 1.0)
    a[:, :40] = a[0, :40]  # a crowd that agrees in most places
    a[1500:, 40:] = a[1500, 40:]
    leaves = list(jaccard._leaves(np.full(3000, 5, np.uint64), a.astype(np.uint8), 6, 64))
    assert set(range(1500, 3000)) <= set(np.concatenate(leaves).tolist())


def test_repeated_rows_are_one_set(spark):
    rows = [(1, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l m"), (3, "other words that stand alone here")]
    got = {r.doc_id: (r.class_size, r.n_links) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, 2), 2: (3, 2), 3: (1, 0)}


def test_very_long_texts_are_compared_whole(spark):
    words = [f"w{i}" for i in range(120_000)]
    rows = [(i, " ".join([*words[:-i], *["x"] * i] if i else words)) for i in range(3)] + [(9, " ".join(words[60_000:]))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (0, 2), 9: (9, 0)}


def test_jaccard_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(df).count() == 0 and jaccard.keep_one(df).count() == 0
    blank = spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string")
    assert jaccard.join(blank).count() == 3


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g")], "doc_id long, text string")
    assert [r.doc_id for r in jaccard.keep_one(df).collect()] == [1]


def test_shingles_equal_the_definition():
    texts = ["", "a", "One two three four", "one two three four five six", "x_y z-1 é😀漢字 İs", "one two three four five one two three four five"]
    h, n = jaccard.shingle_sets(texts)
    assert n.tolist() == [len(brute.shingles(t) or ()) for t in texts]
    assert len(jaccard.shingle_sets(["a b c d e"])[0]) == 1
    assert (jaccard.shingle_sets(["A, b c d e!"])[0] == jaccard.shingle_sets(["x", "a b c d e"])[0][-1:]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (201, 202), (300, 300)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert {got[i] for i in (*range(41), 100)} == {0} and got[202] == 200 and 300 not in got
    rounds = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a int, b int"), most=2).collect()}
    assert rounds == got
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0


def brute_top(rows, k):
    q = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    most, out = 2**63 - 1, []
    for n, (i, v) in enumerate(q):
        if i % 50 == 0:
            s = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -most), most), j) for m, (j, w) in enumerate(q) if m != n and len(w) == len(v))
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [1, 8192])
def test_top_k(spark, block):
    rows = [(i, [RNG.uniform(-1, 1) for _ in range(6)]) for i in range(120)]
    rows += [(500 + i, [0.5] * 6) for i in range(60)]  # ties
    rows += [(700, None), (750, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (800, [float("nan")] * 6), (850, [float("inf")] * 6), (None, [0.1] * 6), (900, [0.5, 0.25]), (901, [0.1, 0.1]), (950, []), (7, rows[3][1])]
    rows += [(50, rows[50][1]), (50, rows[50][1]), (50, rows[4][1]), (100, [0.50001] * 6), (100, [0.50002] * 6)]  # ids and rows that repeat
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).repartition(5)
    got = [tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, block=block, width=64).collect()]
    assert sorted(got) == brute_top(rows, 5)


def test_top_k_of_large_vectors(spark):
    rows = [(i, [RNG.uniform(-1, 1) * 10 ** RNG.choice([0, 5, 7, 9, 300]) for _ in range(8)]) for i in range(60)]
    rows += [(100, [5e4] * 8), (101, [5e4 + 1 / 256] * 8), (150, [1.7e308] * 8), (151, [-1.7e308] * 8), (200, [2.0**25] * 8), (201, [2.0**25 + 1 / 256] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect()) == brute_top(rows, 5)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.search(df, F.col("vec_id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<double>")
    assert topk.search(alone, F.col("vec_id") % 50 == 0).count() == 0


SAMPLE = {"en": ["the", "and", "that", "with", "which", "there", "would"], "de": ["und", "nicht", "auch", "eine", "werden", "ist", "schon"], "fr": ["les", "des", "est", "dans", "pour", "avec", "vous"], "es": ["los", "que", "una", "para", "pero", "como", "esta"]}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, " ".join(RNG.choice(SAMPLE[lang]) for _ in range(60)), lang) for i, lang in enumerate(list(SAMPLE) * 20)]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_language_of_held_out_pages(spark, model):
    pages, want = [], {}
    for i in range(120):
        lang = RNG.choice(list(SAMPLE))
        said = lang if i % 3 else None
        text = " ".join(RNG.choice(SAMPLE[lang]) for _ in range(12))
        pages.append((i, f"http://www.{lang}-site.example.com/{i}", f'<html{f" lang={said}" if said else ""}><script>the and that</script><body>{text}</body>'))
        want[i] = lang
    pages += [(200, "http://www.de-site.example.com/x", ""), (201, None, None), (None, "bad url", "<p>und nicht auch eine</p>"), (202, "http://x.fr/", "<html lang='de'>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit(1), "post": F.lit(2)})
    got = {r.page_id: r for r in langid.identify(df, model).collect()}
    assert len(got) == len(pages)
    assert sum(got[i].lang == w for i, w in want.items()) >= 0.95 * len(want)
    assert got[200].lang == "de" and got[200].text_lang is None  # nothing but its host speaks
    assert got[None].lang == "de" and got[202].lang == "de"


def test_two_languages_of_one_script(spark):
    words = {"ru": ["и", "что", "это", "как", "был", "ещё", "дела"], "uk": ["й", "що", "це", "як", "був", "ще", "справи"]}
    text = lambda lang, n: " ".join(RNG.choice(words[lang]) for _ in range(n))
    df = spark.createDataFrame([(i, text(lang, 60), lang) for i, lang in enumerate(list(words) * 20)], "doc_id long, text string, lang string")
    own = langid.train(df, tuple(words))
    pages = [(i, None, f"<p>{text(lang, 10)}</p>") for i, lang in enumerate(list(words) * 30)]
    got = langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), own, tuple(words)).collect()
    assert all(r.lang == list(words)[r.page_id % 2] for r in got) and len(got) == 60


def test_fusion_equals_the_definition(spark, model):
    langs, pages = list(SAMPLE), []
    for i in range(60):
        lang = RNG.choice(langs)
        said = RNG.choice([lang, "xx", None])
        text = " ".join(RNG.choice(SAMPLE[lang] + SAMPLE["en"]) for _ in range(RNG.randint(0, 6)))
        url = RNG.choice([f"http://{RNG.choice('ab')}.site{i % 3}.{RNG.choice(['de', 'com', 'fr'])}/{i}", "no address", None])
        pages.append((i, url, f'<html{f" lang={said}" if said else ""}>{text}'))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    seen = {r.page_id: r for r in langid.evidence(df, model).collect()}
    soft = lambda x: np.exp(np.array(x) - max(x)) / np.exp(np.array(x) - max(x)).sum()
    post = {i: soft(r.text) for i, r in seen.items()}
    k, strength = len(langs), langid.STRENGTH
    base = (sum(post.values()) + 1) / (len(pages) + k)

    def told(column, i):
        value = seen[i][column]
        if value is None:
            return np.zeros(k)
        has = [j for j, r in seen.items() if r[column] is not None]
        own = sum(post[j] for j in has if seen[j][column] == value)
        return np.log((own + 0.5) / (sum(post[j] for j in has) + 0.5 * (len({seen[j][column] for j in has}) + 1)))

    def others(column, i, below):
        like = [j for j in seen if seen[j][column] is not None and seen[j][column] == seen[i][column]]
        if not like:
            return base
        return (np.maximum(sum(post[j] for j in like) - post[i], 0) + strength * below) / (len(like) - 1 + strength)

    for r in langid.identify(df, model).collect():
        i = r.page_id
        prior = others("host", i, others("domain", i, base))
        fused = soft(np.array(seen[i].text) + told("declared", i) + told("suffix", i) + np.log(prior))
        assert r.confidence == pytest.approx(fused.max(), abs=2e-6)
        assert r.lang == langs[int(fused.argmax())] or np.sort(fused)[-1] - np.sort(fused)[-2] < 1e-9


def test_long_pages_take_time_in_proportion():
    began = time.time()
    for page in ("<script " * 250_000, "<" * 2_000_000, "<!--" * 500_000, "<html " * 300_000, "<nav></script>" * 100_000, "<meta http-equiv=content-language " * 50_000):
        langid.visible(page)
        langid.declared(page, ("de",))
    assert time.time() - began < 10
    assert langid.visible("a<script>x</script >b<SCRIPT>y<!-- c --> d <i>e</i> < f").split() == ["a", "b", "y", "d", "e", "<", "f"]


def test_no_pages(spark, model):
    assert langid.identify(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


@pytest.mark.parametrize("url, want", [("https://u@A.B.de:80/x?y", ("a.b.de", "b.de", "de")), ("http://x.example.com", ("x.example.com", "example.com", "generic")), ("nope", (None,) * 3)])
def test_addresses(url, want):
    assert langid.address(url) == want


def test_markup():
    assert langid.declared('<!doctype html><HTML class=a LANG="de-AT">', ("de",)) == "de"
    assert langid.declared('<meta http-equiv="Content-Language" content="xx">', ("de",)) == "other"
    assert langid.declared("<p>", ("de",)) is None
    assert langid.visible("<style>x</style><p>a&amp;b<!-- c --></p>").split() == ["a&b"]


def test_bitmaps_mark_the_large_buckets(spark):
    hashes = np.random.default_rng(1).integers(0, 2**32, (40, jaccard.COORDINATES), dtype=np.uint32)
    hashes[:20] = hashes[0]
    df = spark.createDataFrame([(bytes([i]), hashes[i].tobytes()) for i in range(40)], "key binary, hashes binary")
    maps = jaccard.large_buckets(df, runs=5, depth=2, hot=8)
    assert len(maps) == 2
    for _, at, _, big in jaccard._levels(hashes, 5, maps, 2):
        assert (big == (at < 20)).all()
