import pytest
from pyspark.sql import functions as F

from twinmark.functions import reliability as rel
from twinmark.functions import scorers as sc
from twinmark.functions import text as tx


def one(spark, schema, row, expr):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first().x


@pytest.mark.parametrize("text, want", [("  Yes!  It is\t", "yes it is"), ("1/2-dir", "12dir"), ("a  b", "a b"), ("", ""), ("İ", "i̇")])
def test_normalize(spark, text, want):
    assert one(spark, "t string", (text,), tx.normalize_answer(F.col("t"))) == want


def test_nfc_composes_once(spark):
    df = tx.nfc(spark.createDataFrame([("é",), ("plain",), (None,)], "t string"), "t")
    assert [r.t for r in df.collect()] == ["é", "plain", None]


@pytest.mark.parametrize("p, r, want", [("x" * 3 + " Baku", "Baku", 1), ("Bakıda yaşayır", "Bakı", 1), ("an apple a day", "apple day", 0), ("İstanbul", "istanbul", 0), ("no", "nobody", 0), ("Paris but not", "Paris", 0)])
def test_short_answer(spark, p, r, want):
    assert one(spark, "p string, r string", (p, r), sc.short_answer(F.col("p"), F.col("r"))) == want


def test_dispatch_follows_task_then_category(spark):
    rows = [("reasoning", "x", "Yes", "binary_answer"), ("reasoning", "x", "Baku", "short_answer"), ("linguistic_understanding", "paraphrase_understanding", "a", "option_match"), ("linguistic_understanding", "contextual_meaning", "a", "semantic_adjudication"), ("linguistic_understanding", None, "a", None), ("unanswerable", "x", "a", None)]
    df = spark.createDataFrame(rows, "t string, c string, r string, want string")
    got = df.select("want", sc.evaluator(F.col("t"), F.col("c"), F.col("r")).alias("e")).collect()
    assert [r.e for r in got] == [r.want for r in got]


@pytest.mark.parametrize("phrase", rel.ABSTENTIONS)
def test_every_abstention(spark, phrase):
    assert one(spark, "t string", (f"Well: {phrase.upper() if phrase.isascii() else phrase}, sorry",), rel.status(F.col("t"))) == "abstained"


def test_outcomes_and_failures(spark):
    rows = [(a, s) for a in (True, False) for s in rel.STATUSES]
    df = spark.createDataFrame(rows, "a boolean, s string").withColumn("o", rel.outcome(F.col("a"), F.col("s")))
    got = {(r.a, r.s): (r.o, r.f) for r in df.select("*", rel.failure(F.col("o"), F.lit(None).cast("int")).alias("f")).collect()}
    assert got[True, "answered"] == ("correct_answer", "correct")
    assert got[True, "abstained"] == ("under_answering",) * 2
    assert got[False, "answered"] == ("over_answering",) * 2
    assert got[False, "abstained"] == ("correct_abstention", "correct")
    assert got[True, "empty"] == got[False, "empty"] == ("empty_response",) * 2


@pytest.mark.parametrize("a, b, want", [(["a", "b", "c"], ["b", "c", "d"], 0.5), ([], [], 1.0), (["a"], [], 0.0)])
def test_jaccard(spark, a, b, want):
    assert one(spark, "a array<string>, b array<string>", (a, b), tx.jaccard(F.col("a"), F.col("b"))) == want


@pytest.mark.parametrize("text, want", [("", 0), ("  ", 0), ("a  b c", 3)])
def test_word_count(spark, text, want):
    assert one(spark, "t string", (text,), tx.word_count(F.col("t"))) == want


def test_scorers_take_time_in_proportion_to_the_text(spark):
    import time

    words = " ".join(f"söz{i}" for i in range(20_000))
    rows = [(words, "söz19999 söz1"), (words + " Bakıda", "Bakı"), ("bakı " * 20_000 + "but", "bakı"), ("but " + "bakı " * 20_000, "bakı şəhəri")]
    df = spark.createDataFrame(rows, "p string, r string")
    began = time.time()
    assert [r.x for r in df.select(sc.short_answer(F.col("p"), F.col("r")).alias("x")).collect()] == [0, 1, 0, 0]
    assert time.time() - began < 15


def test_evaluation_composes_texts(spark):
    from twinmark.plans.evaluate import flat

    rows = [("go\u0308l", "göl", "q\u0308?", ("c", "d", True))]
    df = spark.createDataFrame(rows, "prediction string, reference_answer string, question string, metadata struct<category:string,difficulty:string,is_answerable:boolean>")
    assert flat(df).select(sc.exact(F.col("prediction"), F.col("reference_answer")).alias("x")).first().x == 1


def test_overlap_tokens_hold_digits_and_letters_together(spark):
    got = {t: one(spark, "t string", (t,), tx.overlap_key(F.col("t"))) for t in ("GPT4 is", "gpt 4 is", "Şəhər2-Bakı")}
    assert got == {"GPT4 is": "gpt4 is", "gpt 4 is": "gpt 4 is", "Şəhər2-Bakı": "şəhər2 bakı"}


def test_words_sort_by_the_azerbaijani_alphabet(spark):
    ordered = ["cib", "çay", "elm", "əlma", "gül", "ğ", "Iraq", "İran", "oda", "ördək", "sal", "şar", "zebra", "42"]
    df = spark.createDataFrame([(w,) for w in reversed(ordered)], "word string")
    assert [r.word for r in df.orderBy(tx.collation_key(F.col("word"))).collect()] == ordered
