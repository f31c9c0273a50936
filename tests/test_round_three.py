"""Findings of the third round: queries against their SQL where only larger tables showed a difference."""

import json

import pytest
from pyspark.sql import functions as F
from test_queries import canon

import __spark_entry__ as entry
from twinmark.functions import text
from twinmark.operators import quota
from twinmark.sources import readers


@pytest.fixture
def agrees(spark, tmp_path):
    """Whether a query gives what its SQL gives, on documents (text, lang) numbered from 0, each with a label."""
    import duckdb

    def check(name: str, texts: list[tuple[str, str]]) -> list[tuple]:
        docs = [(i, t, lang, "web", len(t)) for i, (t, lang) in enumerate(texts)]
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(d[0], 1, 0) for d in docs], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
        con = duckdb.connect()
        for t in ("documents", "labels"):
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        df = entry.queries()[name](spark, str(tmp_path))
        q = con.execute(entry.oracle_sql()[name])
        columns = [x[0] for x in q.description]
        rows = [tuple(r) for r in df.select(*columns).collect()]
        assert canon(rows, columns) == canon(q.fetchall(), columns)
        return rows

    return check


def test_candidates_beyond_four_digits(spark):
    quotas = spark.createDataFrame([("az", "a", 9998), ("en", "a", 4)], "language string, task string, count long")
    rows = quota.candidates(quotas, ["language", "task"], "cand_").where("language = 'en' or task_index = 1").collect()
    assert sorted((r.item_id, r.language, r.task_index) for r in rows) == [("cand_0001", "az", 1), ("cand_10000", "en", 2), ("cand_10001", "en", 3), ("cand_10002", "en", 4), ("cand_9999", "en", 1)]


def test_quota_candidates_query_beyond_four_digits(agrees):
    rows = agrees("quota_candidates", [("a b c", "en" if i % 3 else "de") for i in range(10_300)])
    assert len({r[0] for r in rows}) == len(rows) > 10_000


#: Second words whose capitals are several letters, at each place modulo 30: every task, category and kind of prediction.
CAPITALS = [(f"Das {('ieß', 'ﬁn', 'ŉa', 'Stchß,.', 'ᾳb')[i % 5]} x{i} und {'ß' * (i % 3)}", "de") for i in range(60)]


def test_capitals_letter_for_letter(spark):
    words = ["straße", "ŉ", "ﬁﬁ", "ᾳ", "ᾼ", "ΐ", "ẞß", "plain", "", None, "əlma i ı", "😀ß"]
    df = spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", text.capitals(F.col("w")).alias("w"))
    assert [r.w for r in df.orderBy("i").collect()] == ["STRAẞE", "ŉ", "ﬁﬁ", "ᾼ", "ᾼ", "ΐ", "ẞẞ", "PLAIN", "", None, "ƏLMA I I", "😀ẞ"]


def test_prediction_files_capitals(agrees):
    assert any(r[6] == "IEẞ." for r in agrees("prediction_files", CAPITALS))


def test_wide_to_long_capitals(agrees):
    assert any(r[0].endswith("_az") and r[2] == "IEẞ." for r in agrees("wide_to_long", CAPITALS))


def test_wide_to_long_capitals_of_every_letter(agrees):
    plain = [range(0x3000, 0xA000), range(0xAC00, 0xE000)]  # no case there; and surrogates
    letters = [chr(c) for c in range(0x21, 0x20000) if not chr(c).isspace() and not any(c in r for r in plain)]
    words = ["".join(letters[i : i + 1000]) for i in range(0, len(letters), 1000)]
    rows = agrees("wide_to_long", [(f"a {words[i // 6]}", "de") for i in range(6 * len(words))])
    assert any(r[0].endswith("_az") and "\u019b" in r[2] and r[2].startswith("!") for r in rows)


def test_option_scores_capitals(agrees):
    scores = dict(agrees("option_scores", CAPITALS))
    assert scores["0"] == 1 and CAPITALS[0][0].startswith("Das ieß")


def test_short_answer_scores_capitals(agrees):
    assert dict(agrees("short_answer_scores", CAPITALS))["0"] == 1


def test_answerable_files_capitals(agrees):
    assert dict(agrees("answerable_files", CAPITALS))["0"] == "IEẞ."


def test_answerable_files_null_text(spark, tmp_path):
    import duckdb

    docs = spark.createDataFrame([(i, (None, "a b c", None, "")[i % 4], "en") for i in range(12)], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.selectExpr("doc_id", "1L as quality", "0L as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    rows = dict(entry.queries()["answerable_files"](spark, str(tmp_path)).collect())
    assert rows == dict(con.execute(entry.oracle_sql()["answerable_files"]).fetchall())
    assert (rows["0"], rows["2"], rows["3"]) == (".", None, "")


def test_a_null_prediction_is_not_a_missing_one(spark, tmp_path):
    row = dict.fromkeys(readers.BENCHMARK, "x") | {"metadata": {"is_answerable": True}}
    (tmp_path / "null.jsonl").write_text(json.dumps(row | {"prediction": None}))
    assert [r.prediction for r in readers.answerable(spark, str(tmp_path / "null.jsonl")).collect()] == [None]
    with pytest.raises(readers.SourceError, match="missing: prediction"):
        readers.predictions(spark, str(tmp_path / "null.jsonl"))
    for other in (row, row | {"prediction": None, "task": None}):
        (tmp_path / "bad.jsonl").write_text(json.dumps(other))
        with pytest.raises(readers.SourceError, match="missing: "):
            readers.answerable(spark, str(tmp_path / "bad.jsonl"))


def test_instruction_scores_capitals(agrees):
    assert dict(agrees("instruction_scores", CAPITALS))["30"] == 1
