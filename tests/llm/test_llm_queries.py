"""The registered queries and the pipeline over the smallest tables, whole."""

from collections import Counter

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinmark.llm import packing, quality
from twinmark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        q = con.execute(ORACLE_SQL[name])
        columns = [x[0] for x in q.description]
        assert canon(rows, df.columns) == canon(q.fetchall(), columns)


def test_stages_against_plain_versions(spark, docs, tmp_path):
    stage = dict(corpus_pipeline.STAGES)
    table = {"docs": docs}

    def run(name, given):
        at = str(tmp_path / name)
        stage[name](spark, given, SF).write.parquet(at)
        table[name] = spark.read.parquet(at)
        return {r.doc_id: r for r in table[name].collect()}

    before = {r.doc_id: r for r in docs.collect()}
    m = quality.fit(docs)
    verdict = {r.doc_id: r for r in quality.assess(docs, m).collect()}
    a = run("quality", docs)
    assert set(a) == {i for i, r in verdict.items() if r.kept and not brute.rules(before[i].text)[0] < 10}
    assert all(a[i] == before[i] for i in a) and table["quality"].columns == docs.columns
    b = run("line_dedup", table["quality"])
    want = {i: (t, n) for i, t, n in brute.line_dedup([(i, r.text) for i, r in a.items()])}
    assert {i: r.text for i, r in b.items()} == {i: t for i, (t, n) in want.items() if not n or t.strip()}
    c = run("near_duplicates", table["line_dedup"])
    rows = [(i, r.text) for i, r in b.items()]
    groups = {g for g, _ in brute.jaccard(rows).values()}
    assert set(c) == {min(rows[j][0] for j in g) for g in groups}
    d = run("secrets", table["near_duplicates"])
    assert set(d) == set(c) and all(brute.secrets(r.text)[0] == [0, 0, 0] for r in d.values())
    assert all(d[i].text == c[i].text for i in d if brute.secrets(c[i].text)[0] == [0, 0, 0])
    e = stage["packing"](spark, table["secrets"], SF).collect()
    assert {r.doc_id for r in e} == set(d) and all(r.offset + r.length <= packing.SEQUENCE for r in e)


def test_empty_corpus(spark, docs):
    df = docs.where("false")
    for _, f in corpus_pipeline.STAGES:
        df = f(spark, df, SF)
    assert df.count() == 0


def test_stages_on_odd_rows(spark, docs, tmp_path):
    """Nulls in every column, repeated rows, very long texts and clashing names, through all five stages."""
    plain = sorted(docs.collect(), key=lambda r: r.doc_id)
    some = {c: plain[3][c] for c in docs.columns}
    odd = [{c: None for c in docs.columns}, some, some, {**some, "doc_id": 900_001, "lang": None}, {**some, "doc_id": 900_002, "text": ""}, {**some, "doc_id": 900_003, "text": None}]
    odd += [{**some, "doc_id": 900_004, "text": " ".join(r.text for r in plain)}, {**some, "doc_id": 900_005, "text": "z" * 300_000}, {**some, "doc_id": 900_006, "text": " \n\t" * 40}]
    given = docs.unionByName(spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in odd], docs.schema))
    for c in ("k_id", "k_text", "found", "masked", "n_removed", "kept", "sequence_id", "key", "slot"):
        given = given.withColumn(c, F.lit(c))
    stage, at, table = dict(corpus_pipeline.STAGES), given, {}
    for name in list(stage)[:-1]:
        stage[name](spark, at, SF).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        assert at.columns == given.columns and all(r.k_id == "k_id" and r.slot == "slot" for r in at.select("k_id", "slot").distinct().collect())
        table[name] = [(r.doc_id, r.text) for r in at.select("doc_id", "text").collect()]
    kept = {(r.doc_id, r.kept) for r in quality.assess(given, quality.fit(given)).collect()}
    ids = [r.doc_id for r in given.select("doc_id").collect()]
    assert Counter(i for i, _ in table["quality"]) == Counter(i for i in ids if (i, True) in kept)
    assert {900_002, 900_003, 900_005, 900_006, None}.isdisjoint(i for i, _ in table["quality"]) and plain[3].doc_id in {i for i, _ in table["quality"]}
    want = {i: (t, n) for i, t, n in brute.line_dedup(table["quality"])}
    assert Counter(table["line_dedup"]) == Counter((i, want[i][0]) for i, _ in table["quality"] if not want[i][1] or want[i][0].strip())
    groups = {g for g, _ in brute.jaccard(table["line_dedup"]).values()}
    assert Counter(i for i, _ in table["near_duplicates"]) == Counter(min(table["line_dedup"][j][0] for j in g) for g in groups)
    assert Counter(i for i, _ in table["secrets"]) == Counter(i for i, _ in table["near_duplicates"]) and all(brute.secrets(t)[0] == [0, 0, 0] for _, t in table["secrets"])
    pieces = stage["packing"](spark, at, SF).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in table["secrets"]} and len({(r.doc_id, r.piece) for r in pieces}) == len(pieces)
