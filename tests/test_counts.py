"""Counts made where the words are, against the plain plans of n-gram rows."""

from pyspark.sql import functions as F

from reviewloom import constants as K
from reviewloom.functions import text as T
from reviewloom.operators import counts as X
from reviewloom.operators import scoring as C
from reviewloom.operators import terms as N

TEXTS = [("a", 1, "good pay good pay here"), ("a", 1, "pay good"), ("a", None, "kind peers"), ("a", None, ""), ("b", 2, "good pay, kind peers"),
         (None, 3, "pay"), ("b", 4, "the"), ("b", 5, None), ("a", 6, "kind peers kind peers good")]


def texts(spark):
    return spark.createDataFrame(TEXTS, "side string, review_id long, review_text string").repartition(3)


def words_of(df, keys):
    return X.by_words(df, keys, T.content_words(F.col("review_text"), K.english_stop_words()), "review_text")


def plain(df, columns):
    return sorted((tuple(str(r[c]) for c in columns) for r in df.collect()))


def test_counts_equal_grouped_ngram_rows(spark, monkeypatch):
    monkeypatch.setattr(X.pieces, "__defaults__", (2,))  # pieces of about two words
    keys = ["side", "review_id"]
    want = N.ngrams(texts(spark), "review_text", 1, 3, keep_empty=True).groupBy(*keys, "term", "ngram_len").agg(F.count("*").alias("tf"))
    got = X.term_counts(words_of(texts(spark), keys), 1, 3, keep_empty=True)
    columns = [*keys, "term", "ngram_len", "tf"]
    assert plain(got, columns) == plain(want, columns)
    apart = N.ngrams(texts(spark), "review_text", 2, 3, bridge=False).groupBy("review_id", "term").agg(F.count("*").alias("tf"))
    kept = F.transform(T.words(F.col("review_text")), lambda w: F.when(~w.isin(K.english_stop_words()), w).otherwise(""))
    lists = X.term_counts(X.by_words(texts(spark), ["review_id"], kept, "review_text"), 2, 3, bridge=False)
    assert plain(lists, ["review_id", "term", "tf"]) == plain(apart, ["review_id", "term", "tf"])


def test_a_piece_holds_whole_documents_only(spark):
    import pyarrow as pa

    def batch(ids, many):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([["w"] * m if m is not None else None for m in many], pa.list_(pa.string()))],
                                          names=["id", "words"])

    found = list(X.pieces(iter([batch([1, 1, 2], [3, 3, 1]), batch([2, 3, None], [4, None, 9]), batch([None], [1])]), 1, 4))
    assert [(b.column(0).to_pylist(), d.tolist()) for b, d in found] == [([1, 1], [0, 0]), ([2, 2], [0, 0]), ([3, None, None], [0, 1, 1])]


def test_features_are_not_grouped_or_sorted_by_document_and_term(spark):
    df = spark.createDataFrame([(i, f"good pay w{i % 3}") for i in range(30)], "review_id long, review_text string")
    features = N.text_features(df, max_df=1.0)
    plan = features._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan
    assert {r["term"] for r in features.collect()} >= {"good", "good pay", "pay w1"}


def test_words_that_no_kept_ngram_can_hold_are_left_out(spark):
    rows = [(i, "aa bb " + f"cc{i % 2} dd{i % 10}") for i in range(40)]
    df = spark.createDataFrame(rows, "review_id long, review_text string")
    assert sorted(N.frequent_words(words_of(df, ["review_id"]), 2, 4)) == ["aa", "bb", "cc0", "cc1"]
    assert N.frequent_words(words_of(df, ["review_id"]), 2, 100) is None
    every = N.keyword_table(df, max_features=1000).collect()
    for some in (2, 4, 5):
        assert N.keyword_table(df, max_features=some).collect() == every[:some]


def test_only_frequencies_above_one_come_back_to_a_block(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_TEXTS", 2)
    blocks = X.in_blocks(texts(spark), "side", "review_id", "review_text", T.content_words(F.col("review_text"), K.english_stop_words()))
    assert blocks.select("block").distinct().count() > 1
    assert blocks.groupBy("side", "review_id").agg(F.count_distinct("block").alias("n")).where("n > 1").isEmpty()
    back = X.frequencies(blocks, 3)
    assert back.agg(F.min("df")).first()[0] == 2
    df = N.ngrams(texts(spark), "review_text", 1, 3).select("side", "review_id", "term").distinct().groupBy("side", "term").count()
    assert sorted(r["df"] for r in back.select("hash", "df").distinct().collect()) == sorted(
        r["count"] for r in df.where("count > 1").collect())


def test_scores_and_weights_by_blocks_equal_the_joined_ones(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_TEXTS", 2)
    seeds = spark.createDataFrame([("pay", 0, "good pay", 0, 1.0), ("peers", 1, "kind peers", 0, 0.6)],
                                  "category string, category_ord int, term string, term_ord int, score double")
    keyed = N.keyed_group(texts(spark), "side")
    tf = C.text_terms(keyed, "side", "review_id", "review_text", 3, None)
    rounded = lambda df: sorted((str(r["side"]), str(r["review_id"]), round(r["score_pay"], 12), round(r["score_peers"], 12)) for r in df.collect())
    want = rounded(C._scored(tf, C._fit(keyed, tf, seeds, None, "side", 3, None), "side", "review_id"))
    assert rounded(C.tfidf_scores(texts(spark), seeds)) == want and any(w[2] > 0 for w in want)
    assert len({(w[0], w[1]) for w in want}) == len(want)
    counted = X.term_counts(words_of(texts(spark), ["side", "review_id"]), 1, 3)
    df = counted.groupBy("side", "term").agg(F.count("*").alias("df"))
    n = texts(spark).groupBy("side").agg(F.count("*").alias("n"))
    raw = [(r["side"], r["review_id"], r["term"], r["tf"]) for r in counted.collect()]
    dfs = {(r["side"], r["term"]): r["df"] for r in df.collect()}
    sizes = {r["side"]: r["n"] for r in n.collect()}
    import math

    weight = {(s, d, t): k * (math.log((1 + sizes[s]) / (1 + dfs[s, t])) + 1) for s, d, t, k in raw}
    length = {}
    for (s, d, _), w in weight.items():
        length[s, d] = length.get((s, d), 0) + w * w
    got = {(r["side"], r["review_id"], r["term"]): r["weight"] for r in N.tfidf(texts(spark)).collect()}
    assert got.keys() == weight.keys()
    assert all(abs(got[k] - w / math.sqrt(length[k[0], k[1]])) < 1e-12 for k, w in weight.items())


def test_counts_of_a_text_are_one_row_a_length(spark):
    lists = N.document_terms(texts(spark), "review_id", "review_text")
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan
    got = {(r["review_id"], r["ngram_len"]): dict(zip(r["terms"], r["tf"])) for r in lists.collect()}
    assert got[1, 2] == {"good pay": 2, "pay good": 2} and (4, 1) not in got and (5, 1) not in got


def test_a_settled_vocabulary_is_not_settled_again(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"good pay w{i % 3}") for i in range(30)] + [(90, None)], "review_id long, review_text string")
    df.write.parquet(str(tmp_path / "texts"))
    stored = spark.read.parquet(str(tmp_path / "texts"))
    themes = spark.createDataFrame([("pay", "good pay"), ("other", "w1")], "category string, text string")
    known = N.text_vocabulary(stored, max_df=1.0)
    want = plain(N.text_features(df, max_df=1.0), ["review_id", "term", "weight", "df"]), plain(N.theme_scores(
        df, themes, ["pay", "other"], max_df=1.0), ["review_id", "theme_pay", "theme_other"])
    monkeypatch.setattr(N, "feature_vocabulary", None)
    monkeypatch.setattr(N, "materialize", None)
    assert plain(N.text_features(stored, known=known), ["review_id", "term", "weight", "df"]) == want[0]
    assert plain(N.theme_scores(stored, themes, ["pay", "other"], known=known), ["review_id", "theme_pay", "theme_other"]) == want[1]
