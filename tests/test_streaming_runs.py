import pytest
from pyspark.sql import functions as F

from reviewloom import constants as K
from reviewloom.operators import scoring as C
from reviewloom.operators import seeds as E
from reviewloom.operators import segments as S
from reviewloom.plans import stages as P
from reviewloom.streaming import incremental as X

CATS = K.CATEGORIES[:3]


@pytest.fixture
def terms(spark):
    rows = [(CATS[i % 3], i % 3, f"t{i}", 1.0, [float(i % 3 == j) + 0.01 * i * (j == 1) for j in range(3)])
            for i in range(12)]
    return spark.createDataFrame(
        rows, "category string, category_ord int, term string, score double, vector array<double>")


def keyword_files(spark, tmp_path, terms):
    words = terms.select(F.concat(F.lit("k"), "term").alias("keyword"), "vector")
    source = str(tmp_path / "in")
    for part in range(3):
        words.where(F.substring("keyword", 3, 2).cast("int") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    return words, source


def test_stream_merge_equals_batch(spark, tmp_path, terms):
    words, source = keyword_files(spark, tmp_path, terms)
    base, cents = terms.where("score = 1 AND term IN ('t0', 't1', 't2')"), C.category_centroids(terms)
    stream = spark.readStream.schema(words.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second run resumes and finds nothing to do
        X.stream_seed_merge(stream, base, cents, str(tmp_path / "out"), str(tmp_path / "cp"), 0.6,
                            categories=CATS).awaitTermination()
    matched = S.score_at_least(E.best_category(words, cents, CATS), 0.6).select(
        "category", "category_ord", F.lower("keyword").alias("term"), F.round("score", 9).alias("score"),
        F.lit(K.EXPANSION_SOURCE).alias("source"))
    empty = matched.limit(0)
    want = E.seed_merge(empty, matched, base.select("category", "category_ord", "term"))
    key = lambda df: sorted((r["category"], r["term"], r["score"]) for r in df.collect())
    assert key(X.latest_seeds(spark, str(tmp_path / "out"))) == key(want)


def test_stream_classify_equals_batch(spark, tmp_path, terms):
    words, source = keyword_files(spark, tmp_path, terms)
    cents = C.category_centroids(terms)
    stream = spark.readStream.schema(words.schema).option("maxFilesPerTrigger", 1).parquet(source)
    rows = stream.withColumnRenamed("keyword", "review_id")
    for _ in range(2):
        X.stream_classify(rows, cents, str(tmp_path / "out"), str(tmp_path / "cp"), CATS).awaitTermination()
    want = C.label_scores(C.embedding_scores(words.withColumnRenamed("keyword", "review_id"), cents, CATS),
                          "sentence_transformer", CATS)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


TEXTS = [("r0", "a", "fair pay and good work culture"), ("r1", "a", "no promotion"), ("r2", "b", "friendly people, fair pay"),
         ("r3", None, "good work"), ("r4", None, "fair"), ("r5", "b", ""), ("r6", "b", None), ("r7", "c", "culture fair fair")]


def review_files(spark, tmp_path, rows):
    frame = spark.createDataFrame(rows, "review_id string, side string, review_text string")
    source = str(tmp_path / "texts")
    for part in range(3):
        frame.where(F.substring("review_id", 2, 3).cast("int") % 3 == part).coalesce(1).write.mode("append").parquet(source)
    return frame, spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)


@pytest.fixture
def dictionary(spark):
    return spark.createDataFrame([("pay", 0, "fair pay", 0, 1.0), ("pay", 0, "pay", 1, 0.7), ("team", 1, "friendly", 0, 1.0),
                                  ("team", 1, "work culture", 1, 0.9)],
                                 "category string, category_ord int, term string, term_ord int, score double")


def rows_of(df):
    return sorted(df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in sorted(df.dtypes)]).collect(), key=str)


def test_stream_with_a_frozen_tfidf_model_equals_batch(spark, tmp_path, dictionary):
    frame, stream = review_files(spark, tmp_path, TEXTS)
    model = C.freeze_tfidf(frame, dictionary, str(tmp_path / "model"))
    for _ in range(2):  # the second run resumes and finds nothing to do
        X.stream_classify_tfidf(stream, model, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = X.scored_rows(spark, str(tmp_path / "out"))
    assert rows_of(got) == rows_of(C.label_scores(C.tfidf_scores(frame, dictionary), "tfidf", model.categories))
    assert got.count() == len(TEXTS) and got.where("side IS NULL").count() == 2


def test_frozen_model_ignores_what_it_does_not_know(spark, tmp_path, dictionary):
    frame, _ = review_files(spark, tmp_path, TEXTS)
    model = C.freeze_tfidf(frame, dictionary, str(tmp_path / "model"))
    late = spark.createDataFrame([("x", "a", "unheard fair pay words"), ("y", "a", "fair pay"), ("z", "new", "fair pay")], frame.schema)
    got = {r.review_id: (round(r.score_pay, 9), r.score_team) for r in C.frozen_tfidf_scores(late, model).collect()}
    assert got["x"] == got["y"] and got["y"][0] > 0.5 and got["z"] == (0.0, 0.0)
    again = C.load_tfidf(spark, str(tmp_path / "model"))
    assert again.categories == ["pay", "team"] and again.terms.count() == model.terms.count()


def test_frozen_scores_by_ranges_of_hashes_equal_the_joined_ones(spark, tmp_path, dictionary, monkeypatch):
    from reviewloom.operators import counts as Y
    from reviewloom.operators import terms as N

    monkeypatch.setattr(Y, "BLOCK_TEXTS", 2)
    monkeypatch.setattr(Y, "BLOCKS_OF_RANGE", 1)
    frame = spark.createDataFrame(TEXTS + [(None, "a", "pay"), (None, "a", "good pay")], "review_id string, side string, review_text string")
    model = C.freeze_tfidf(frame, dictionary, str(tmp_path / "model"))
    assert model.terms.count() > 1 and dict(model.terms.dtypes)["hashes"] == "binary"
    late = spark.createDataFrame([("x", "a", "unheard fair pay words friendly"), ("x", "b", "fair pay"), ("y", None, "work culture"), ("z", "new", "fair pay"),
                                  (None, "a", "good fair pay"), ("w", "a", None)], frame.schema)
    keyed = lambda df: N.keyed_group(df, "side")
    tf = lambda df: C.text_terms(keyed(df), "side", "review_id", "review_text", 3, None)
    plain = C._fit(keyed(frame), tf(frame), dictionary, None, "side", 3, None)
    for df in (frame, late):
        got = C.frozen_tfidf_scores(df, model)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "HashAggregate" not in plan
        assert rows_of(got) == rows_of(C._scored(tf(df), plain, "side", "review_id"))
    none = C.freeze_tfidf(frame.where("false"), dictionary, str(tmp_path / "none"))
    assert {(r.score_pay, r.score_team) for r in C.frozen_tfidf_scores(late, none).collect()} == {(0.0, 0.0)}


def test_texts_are_read_once_for_their_phrases_and_their_largest_counts(spark, tmp_path):
    frame = spark.createDataFrame([("r0", "fair pay, fair pay"), ("r1", "fair pay"), ("r2", "pay rise"), ("r3", None)], "review_id string, review_text string")
    frame.write.parquet(str(tmp_path / "phrases"))
    stored = spark.read.parquet(str(tmp_path / "phrases"))
    scored = C.regex_factor_score(stored, {"pay": ["fair pay"], "rise": ["pay rise"]})
    ruled = C.hr_rule_score(stored, stored.select("review_id", F.lit(0.5).alias("hr_score")), ["fair pay"], ["pay"])
    for df in (scored, ruled):
        # The texts are behind what was written.
        assert "review_text" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.review_id: (r.regex_pay, r.regex_rise) for r in scored.collect()} == {"r0": (1.0, 0.0), "r1": (0.5, 0.0), "r2": (0.0, 1.0), "r3": (0.0, 0.0)}
    assert {r.review_id: round(r.hr_rule_score, 9) for r in ruled.collect()} == {"r0": 0.8, "r1": 0.625, "r2": 0.375, "r3": 0.2}


def test_an_empty_vocabulary_has_no_themes(spark):
    from reviewloom.operators import terms as N

    texts = spark.createDataFrame([("r0", "alone"), ("r1", None)], "review_id string, review_text string")
    themes = spark.createDataFrame([("pay", "alone"), ("team", "peers")], "category string, text string")
    scored = N.theme_scores(texts, themes, ["pay", "team"], "review_id", "review_text")
    assert sorted((r.review_id, r.theme_pay, r.theme_team) for r in scored.collect()) == [("r0", 0.0, 0.0), ("r1", 0.0, 0.0)]


def test_own_and_null_sides_keep_their_rows(spark, dictionary):
    frame = spark.createDataFrame(TEXTS, "review_id string, side string, review_text string")
    got = {r.review_id: r for r in C.classify(frame, dictionary).collect()}
    assert sorted(got) == sorted(t[0] for t in TEXTS)
    # A side's scores are those of the side alone.
    alone = {r.review_id: r for r in C.tfidf_scores(frame.where("side IS NULL").withColumn("side", F.lit("only")), dictionary).collect()}
    assert all(abs(alone[k].score_pay - got[k].score_pay) < 1e-12 for k in ("r3", "r4"))
    from reviewloom.operators import terms as N
    weights = N.tfidf(frame)
    assert {r.side for r in weights.collect()} == {"a", "b", "c", None}
    assert all(abs(r.n - 1) < 1e-9 for r in weights.groupBy("side", "review_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect())


def test_stream_by_single_terms_equals_batch_with_any_dictionary(spark, tmp_path, terms):
    words, source = keyword_files(spark, tmp_path, terms)
    words = words.withColumnRenamed("keyword", "review_id")
    stream = spark.readStream.schema("keyword string, vector array<double>").option("maxFilesPerTrigger", 1).parquet(
        source).withColumnRenamed("keyword", "review_id")
    X.stream_classify_older(stream, terms, str(tmp_path / "out"), str(tmp_path / "cp"), CATS).awaitTermination()
    want = C.older_label(C.older_scores(words, terms, CATS))
    assert rows_of(X.scored_rows(spark, str(tmp_path / "out"))) == rows_of(want)
    # The dictionary in blocks, a row without a vector, a category without terms.
    more = words.unionByName(spark.createDataFrame([("none", None)], words.schema))
    cats = [*CATS, "empty"]
    whole = C.older_scores(more, terms, cats)
    cut = C.older_scores(more, terms, cats, block_terms=4)
    assert rows_of(cut) == rows_of(whole) and cut.columns == whole.columns
    assert whole.where("review_id = 'none'").select(*cats).first() == (0.0,) * 4


def test_full_run_writes_and_skips_stages(spark, tmp_path, monkeypatch):
    a = spark.createDataFrame([(0, "Acme", "Good work culture and friendly people", "Slow promotion")],
                              "source_row_id long, Company string, Pros string, Cons string")
    b = spark.createDataFrame([(0, "Beta", "fair pay", None)],
                              "source_row_id long, Company string, Likes string, Dislikes string")
    first = P.full_run(spark, str(tmp_path), "r1", raw_a=a, raw_b=b)
    assert first["classified"].count() == 3
    assert first["manifest"].first()["row_counts"]["segments"] == 3
    for name, n in first["manifest"].first()["row_counts"].items():
        assert n == first[name].count(), name
    monkeypatch.setattr(type(a), "count", None)  # the counts come with the writes
    again = P.full_run(spark, str(tmp_path), "r2", segments=first["segments"], keywords=first["keywords"],
                       seeds=first["seeds"])
    assert again["manifest"].first()["row_counts"] == {"classified": 3}


def test_an_empty_run_counts_nothing(spark, tmp_path):
    a = spark.createDataFrame([], "source_row_id long, Company string, Pros string, Cons string")
    b = spark.createDataFrame([], "source_row_id long, Company string, Likes string, Dislikes string")
    got = P.full_run(spark, str(tmp_path), "r3", raw_a=a, raw_b=b)
    assert set(got["manifest"].first()["row_counts"].values()) <= {0, got["seeds"].count()}


def test_given_labels_go_first_and_every_label_has_its_evidence(spark, tmp_path, dictionary):
    frame = spark.createDataFrame([(i, s, t, g) for (i, s, t), g in zip(TEXTS, ["HR", " Non HR ", None, "", None, "HR", None, None])],
                                  "review_id string, side string, review_text string, given string")
    out = P.full_run(spark, str(tmp_path), "r", segments=frame, keywords=frame.limit(0), seeds=dictionary, existing_label="given")["classified"]
    got = {r.review_id: r for r in out.collect()}
    assert len(got) == len(TEXTS)
    assert (got["r0"].classification, got["r0"].classification_method, got["r0"].classification_confidence) == ("HR", "existing", 1.0)
    assert got["r1"].classification == "Non HR" and got["r3"].classification_method == "tfidf"
    for r in got.values():
        assert 0.5 <= r.classification_confidence <= 1 and r.classification_reason
    assert got["r6"].classification_reason == "hr_score 0.0000 < 0.10" and got["r6"].classification == "Non HR"


def test_discovery_describes_every_row(spark, tmp_path):
    import json
    import random

    from reviewloom.plans import discovery as Y

    rng = random.Random(3)
    topics = ["slow laptop broken screen support", "long commute parking train station", "cold food canteen lunch menu"]
    rows = []
    for k in range(150):
        words = rng.sample(topics[k % 3].split(), 4) + rng.sample("office team year week place".split(), 2)
        rows.append((f"r{k}", "cons_gd" if k % 5 else None, "negative", " ".join(words), "Non HR", float(k % 3)))
    rows += [(f"c{k}", "cons_gd", "negative", rows[0][3].upper(), " non hr", 1.0) for k in range(7)]
    rows += [("h", "cons_gd", "negative", "pay rise", "HR", 1.0), ("one", "pros_gd", "positive", "", "Non HR", None)]
    classified = spark.createDataFrame(rows, "review_id string, side string, sentiment_side string, review_text string, classification string, score_pay double")
    seeds = spark.createDataFrame([("tools", 0, "laptop screen", 0, 1.0), ("travel", 1, "commute train", 0, 1.0), ("food", 2, "canteen lunch", 0, 1.0)],
                                  "category string, category_ord int, term string, term_ord int, score double")
    out = Y.discover_clusters(spark, str(tmp_path), "run", classified, seeds, resolutions=[1.0], min_df=2, width=8)
    trace = {r.review_id: r for r in out["review_trace"].collect()}
    assert sorted(trace) == sorted(r[0] for r in rows if r[0] != "h")
    assert all(r.cluster_number is not None for r in trace.values())
    assert {r.group_key for r in trace.values()} == {"none", "cons_gd", "pros_gd"}
    assert {trace[f"c{k}"].cluster_number for k in range(7)} == {trace["c0"].cluster_number} and trace["c0"].review_count >= 7
    for r in out["cluster_summary"].collect():
        own = [t for t in trace.values() if (t.group_key, t.cluster_number) == (r.group_key, r.cluster_number)]
        assert r.review_count == len(own)
        assert all(x in trace for x in r.representative_reviews.split(", "))
    # Texts of one topic are together: the largest cluster of the large group is nearly pure.
    sizes = {}
    for k in range(150):
        if k % 5:
            sizes.setdefault(trace[f"r{k}"].cluster_number, []).append(k % 3)
    biggest = max(sizes.values(), key=len)
    assert max(biggest.count(t) for t in range(3)) >= 0.9 * len(biggest)
    cards = [json.loads(line) for f in (tmp_path / "run" / "cluster_cards").glob("part-*") for line in f.read_text().splitlines()]
    assert len(cards) == out["cluster_summary"].count() and {"top_terms", "dominant_seed_cluster"} <= set(cards[0])
    assert out["cluster_model_selection"].where("selected").count() >= 1
    assert Y.discover_clusters(spark, str(tmp_path), "none", classified.where("false"), seeds)["clusters"].count() == 0
