import pytest
from pyspark.sql import functions as F

from reviewloom import constants as K
from reviewloom.operators import scoring as C
from reviewloom.operators import segments as S
from reviewloom.operators import terms as N
from reviewloom.sources import seeds as J


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "review_id int, review_text string")


def test_ngrams_bridge_stop_words(spark):
    got = [r["term"] for r in N.ngrams(texts(spark, "the work of a co-worker is hard"), hi=2).collect()]
    assert sorted(got) == ["hard", "work", "work worker", "worker", "worker hard"]
    near = [r["term"] for r in N.ngrams(texts(spark, "work of hard labour"), lo=2, hi=3, bridge=False).collect()]
    assert near == ["hard labour"]


def test_keep_empty_keeps_one_row(spark):
    rows = N.ngrams(texts(spark, "the of", "work", ""), hi=3, keep_empty=True).collect()
    assert sorted((r["review_id"], r["term"]) for r in rows if r["term"]) == [(1, "work")]
    assert sorted(r["review_id"] for r in rows) == [0, 1, 2]


def test_keyword_floor_falls_back(spark):
    rows = N.keyword_table(texts(spark, "alpha beta", "gamma"), min_df=2).collect()
    assert {r["min_df_used"] for r in rows} == {1} and len(rows) == 4
    rows = N.keyword_table(texts(spark, "alpha beta", "alpha", "beta zeta"), min_df=2).collect()
    assert [(r["keyword"], r["frequency"], r["min_df_used"]) for r in rows] == [("alpha", 2, 2), ("beta", 2, 2)]


def test_keyword_cap_breaks_ties_by_term(spark):
    rows = N.keyword_table(texts(spark, "bb aa cc", "cc bb aa"), max_features=2, ngram_max=1).collect()
    assert [r["keyword"] for r in rows] == ["aa", "bb"]


def test_profile_repeats_round_half_even(spark):
    seeds = spark.createDataFrame(
        [("c", 0, "x1", 0, 0.5), ("c", 0, "x2", 1, 0.7), ("c", 0, "x3", 2, 0.9), ("c", 0, "x4", 3, 0.01)],
        "category string, category_ord int, term string, term_ord int, score double")
    body = C.profile_documents(seeds).first()["text"].split()
    assert [body.count(f"x{i}") for i in (1, 2, 3, 4)] == [2, 4, 4, 1]


def test_tfidf_scores_small(spark):
    rows = [("a", "pros_gd", "friendly culture"), ("b", "pros_gd", "the of"), ("c", "pros_gd", "quality products"),
            ("d", "cons_gd", "friendly culture")]
    segs = spark.createDataFrame(rows, "review_id string, side string, review_text string")
    out = {r["review_id"]: r for r in C.label_scores(
        C.tfidf_scores(segs, J.seed_exact(spark)), "tfidf").collect()}
    first = K.CATEGORIES[0]
    assert sorted(out) == ["a", "b", "c", "d"]
    assert out["a"]["primary_category"] == first and out["a"]["classification"] == "HR"
    assert out["b"]["hr_score"] == 0 and out["b"]["primary_category"] == first
    assert out["c"]["primary_category"] == "product_belief" and out["c"]["classification"] == "Non HR"
    # Frequencies are fitted per side, so the same text scores differently.
    assert out["a"][f"score_{first}"] != out["d"][f"score_{first}"]


def test_older_label_is_strict(spark):
    a, b = K.OLDER_HR_CATEGORIES
    df = spark.createDataFrame([(0.25, 0.25), (0.3, 0.25)], f"{a} double, {b} double")
    assert [r["Classification"] for r in C.older_label(df).collect()] == ["Non HR", "HR"]


def test_classify_backends(spark):
    segs = spark.createDataFrame([("a", "pros_gd", "culture")], "review_id string, side string, review_text string")
    assert C.classify(segs, J.seed_exact(spark)).first()["classification_backend"] == "tfidf"
    with pytest.raises(ValueError):
        C.classify(segs, J.seed_exact(spark), "sentence_transformer")
    with pytest.raises(ValueError):
        C.classify(segs, J.seed_exact(spark), "other")


def test_filters(spark):
    df = spark.createDataFrame([("Non HR",), (" non hr ",), ("HR",), (None,)], "classification string")
    assert S.non_hr(df).count() == 1 and S.non_hr_loose(df).count() == 2
    with pytest.raises(ValueError):
        S.non_hr(df.drop("classification").withColumn("x", F.lit(1)))
    with pytest.raises(ValueError):
        S.detect_text_column(df)
    assert S.detect_text_column(df.withColumn("Likes", F.lit("x")).withColumn("text", F.lit("y"))) == "Likes"
    scores = S.ensure_score_columns(spark.createDataFrame([("",), ("HR",)], "Classification string"))
    assert [r["Classification"] for r in scores.collect()] == [None, "HR"] and "justice" in scores.columns


def test_keep_side_keeps_markers(spark):
    df = spark.createDataFrame([("none", "x", 1), (" \t", "y", 2), (None, "z", 3)], "Likes string, Dislikes string, n int")
    kept = S.keep_side(df, "Likes", "Dislikes")
    assert kept.columns == ["Likes", "n"] and [r["n"] for r in kept.collect()] == [1]


def test_token_filter(spark):
    tokens = spark.createDataFrame(
        [(1, 0, "Good", "ADJ", False, False), (1, 1, "the", "DET", True, False), (1, 2, "Team", "NOUN", False, False),
         (1, 3, "go", "VERB", False, False), (2, 0, "a", "DET", True, False)],
        "doc_id long, pos int, lemma string, pos_tag string, is_stop boolean, is_punct boolean")
    entities = spark.createDataFrame([(1, 0, "Acme Corp"), (1, 1, "UK")], "doc_id long, ord int, text string")
    got = {r["doc_id"]: r["processed_text"] for r in S.token_filter(tokens, entities).collect()}
    assert got == {1: "good team acme corp", 2: ""}


def test_term_rows_are_shuffled_as_hashes_and_score_the_same(spark):
    rows = spark.createDataFrame([("a", "x y"), ("b", "x y"), (None, "x y"), ("a", "y"), ("a", None)], "side string, term string")
    hashed = C._hashed(N.keyed_group(rows, "side"), "side")
    assert hashed.schema["term"].dataType.simpleString() == "bigint"
    got = [r["term"] for r in hashed.collect()]
    assert len(set(got)) == 5 and got[4] is None
    seeds = spark.createDataFrame([("pay", 0, "good pay", 0, 1.0), ("peers", 1, "kind peers", 0, 0.6)],
                                  "category string, category_ord int, term string, term_ord int, score double")
    texts = spark.createDataFrame([("a", "1", "good pay here"), ("a", "2", "kind peers good"), (None, "3", "pay"), ("b", "4", "the")],
                                  "side string, review_id string, review_text string")
    keyed = N.keyed_group(texts, "side")
    tf = C.text_terms(keyed, "side", "review_id", "review_text", 3, None)
    plain = C._scored(tf, C._fit(keyed, tf, seeds, None, "side", 3, None), "side", "review_id")
    rounded = lambda df: sorted((r["review_id"], r["side"], round(r["score_pay"], 12), round(r["score_peers"], 12)) for r in df.collect())
    assert rounded(C.tfidf_scores(texts, seeds)) == rounded(plain)
