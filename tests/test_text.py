import math

import pytest
from pyspark.sql import functions as F

from reviewloom import constants as K
from reviewloom.functions import text as T
from reviewloom.operators import scoring as SC
from reviewloom.functions import vectors as V


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_clean_text(spark):
    rows = [None, "", "   ", "\t\n", "nan", "NaN", "None", "null", "NULL", "nil", " None ", "a b",
            "a\u001cb", "a　b", "a \n\t b"]
    want = ["", "", "", "", "", "", "", "", "", "nil", "None", "a b", "a b", "a b", "a b"]
    assert values(spark, rows, T.clean_text(F.col("x"))) == want


def test_normalize_for_nlp(spark):
    rows = ["Work-Life  Balance!", "Café & Co.", "none", None]
    assert values(spark, rows, T.normalize_for_nlp(F.col("x"))) == ["work-life balance", "caf co", "", ""]


def test_strip_urls(spark):
    rows = ["See http://a.b/c?d=1 and www.x.y, OK 42!", None]
    assert values(spark, rows, T.strip_urls_alpha(F.col("x"))) == ["see and ok", ""]


def test_words_are_unicode_and_two_long(spark):
    assert values(spark, ["Été a co-worker x1 _ok"], T.words(F.col("x"))) == [
        ["été", "co", "worker", "x1", "_ok"]]


def test_phrase_hits_are_whole_words(spark):
    rows = ["fair fair unfair fair.", "Work-life balance, work life balance", "", None]
    frame = spark.createDataFrame(list(enumerate(rows)), "review_id int, review_text string")
    got = SC.regex_factor_counts(frame, {"c": ["fair", "work-life balance"]})
    assert [r["hits_c"] for r in got.orderBy("review_id").collect()] == [3, 2, 0, 0]


def test_thousands_of_phrases_and_no_overlapping_hits(spark):
    frame = spark.createDataFrame([(0, "a a a a b a b a"), (1, "w7 w8 w9 x")], "review_id int, review_text string")
    many = [f"w{k} w{k + 1}" for k in range(3000)]
    got = SC.regex_factor_counts(frame, {"c": ["a a", "a b a"], "m": many}).orderBy("review_id").collect()
    assert [(r["hits_c"], r["hits_m"]) for r in got] == [(3, 0), (0, 2)]
    over = SC.phrase_overlap(frame, [*many, "a a"]).orderBy("review_id").collect()
    assert [r["phrase_overlap"] for r in over] == [1, 2]


def test_l2_normalize_and_ties(spark):
    row = spark.range(1).select(
        V.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("u"),
        V.l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("z"),
        V.argmax_name([F.lit(0.5), F.lit(0.5), F.lit(0.1)], ["a", "b", "c"]).alias("t")).first()
    assert row["u"] == pytest.approx([0.6, 0.8]) and row["z"] == [0.0, 0.0] and row["t"] == "a"


def test_stop_list():
    words = K.english_stop_words()
    assert len(words) == len(set(words)) == 318 and not math.isnan(len(words))
