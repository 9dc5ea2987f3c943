"""Registered queries over files, runs, streams and small groups: tables go to the shared folder and come back."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from reviewloom import constants as K
from reviewloom.catalog import inputs as I
from reviewloom.catalog import sql as Q
from reviewloom.catalog import summary_queries as SQ
from reviewloom.catalog import text_queries as TQ
from reviewloom.catalog import vector_queries as VQ
from reviewloom.functions import vectors as V
from reviewloom.operators import cluster as L
from reviewloom.operators import hierarchy as H
from reviewloom.operators import neighbors as NB
from reviewloom.operators import reduce as D
from reviewloom.operators import scoring as C
from reviewloom.operators import seeds as E
from reviewloom.operators import segments as S
from reviewloom.operators import terms as N
from reviewloom.plans import stages as P
from reviewloom.session import materialize, scratch_folder
from reviewloom.sources import reviews as IO
from reviewloom.sources import seeds as J
from reviewloom.streaming import incremental as X

QUERIES = {}
ORACLE = {}


def register(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function
    return add


def shared(spark, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{scratch_folder(spark).rstrip('/')}/reviewloom/{name}-{uuid.uuid4().hex}"


CSV = {"header": True, "escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def cell(x: str) -> str:
    return f"CASE WHEN {x} IN ({Q.strings(K.NULL_CELLS)}) THEN NULL ELSE {x} END"


LINES = "substr(d.text, strpos(d.text, chr(10)) + 1)"


@register("csv_reviews", f"""
SELECT d.doc_id, {cell('d.source')} AS company, md5({cell("split_part(d.text, chr(10), 1)")}) AS pros_md5,
       md5({cell(f"CASE WHEN strpos(d.text, chr(10)) > 0 THEN {LINES} END")}) AS cons_md5
FROM documents d""")
def csv_reviews(spark, sf_dir):
    """Reviews with quoted line breaks through CSV files and the splittable reader."""
    path = shared(spark, "raw-a")
    I.raw_a(spark, sf_dir).withColumnRenamed("source_row_id", "key").write.options(**CSV).csv(path)
    back = IO.read_reviews(spark, path, "glassdoor")
    return back.select(F.col("key").cast("long").alias("doc_id"), F.col("Company").alias("company"),
                       F.md5("Pros").alias("pros_md5"), F.md5("Cons").alias("cons_md5"))


@register("csv_row_numbers", """
SELECT count(*) AS n_rows, 0::BIGINT AS first_row, count(*) - 1 AS last_row, count(*) AS different_numbers FROM documents""")
def csv_row_numbers(spark, sf_dir):
    path = shared(spark, "raw-a")
    I.raw_a(spark, sf_dir).withColumnRenamed("source_row_id", "key").write.options(**CSV).csv(path)
    back = IO.read_reviews(spark, path, "glassdoor")
    return back.agg(F.count("*").alias("n_rows"), F.min("source_row_id").alias("first_row"), F.max("source_row_id").alias("last_row"),
                    F.count_distinct("source_row_id").alias("different_numbers"))


@register("keyword_file_terms", Q.with_(Q.SEGMENTS, Q.KEYWORDS) + """
SELECT DISTINCT lower(keyword) AS keyword FROM keywords WHERE keyword NOT IN (""" + Q.strings(K.NULL_CELLS) + ")")
def keyword_file_terms(spark, sf_dir):
    path = shared(spark, "keywords")
    N.keyword_table(I.segments(spark, sf_dir)).withColumnRenamed("keyword", "words").write.options(
        **CSV).csv(path)
    return J.read_keywords(spark, path).select("keyword")


@register("sides_round_trip", Q.with_(Q.SEGMENTS) + "SELECT side, review_id, md5(review_text) AS text_md5 FROM segments")
def sides_round_trip(spark, sf_dir):
    path = shared(spark, "sides")
    IO.write_sides(I.segments(spark, sf_dir), path)
    return IO.read_sides(spark, path).select("side", "review_id", F.md5("review_text").alias("text_md5"))


LABELLED = Q.with_(Q.SEGMENTS, Q.KEYWORDS, Q.SEEDS, Q.TFIDF, Q.LABELLED)


@register("excluded_hr_rows", LABELLED + """
SELECT 'run-1' AS run_id, review_id, round(hr_score, 6) AS hr_score FROM labelled WHERE classification = 'HR'""")
def excluded_hr_rows(spark, sf_dir):
    path = shared(spark, "excluded")
    labelled = C.label_scores(C.tfidf_scores(I.segments(spark, sf_dir), I.corpus_seeds(spark, sf_dir)), "tfidf")
    IO.write_excluded_hr(labelled, path, "run-1")
    return spark.read.parquet(path).select("run_id", "review_id", F.round("hr_score", 6).alias("hr_score"))


@register("run_manifest_counts", LABELLED + """
SELECT 'segments' AS stage, count(*) AS n FROM segments UNION ALL SELECT 'keywords', count(*) FROM keywords
UNION ALL SELECT 'classified', count(*) FROM labelled
UNION ALL SELECT 'given seeds', count(*) FROM seeds""")
def run_manifest_counts(spark, sf_dir):
    """A whole run with given seeds: the manifest lists what was written, not the stage that was skipped."""
    seeds = I.corpus_seeds(spark, sf_dir)
    run = P.full_run(spark, shared(spark, "runs"), "run-1", raw_a=I.raw_a(spark, sf_dir), raw_b=I.raw_b(spark, sf_dir), seeds=seeds)
    counts = run["manifest"].select(F.explode("row_counts").alias("stage", "n"))
    return counts.unionByName(seeds.agg(F.lit("given seeds").alias("stage"), F.count("*").alias("n")))


@register("skipped_stage_labels", LABELLED + """
SELECT side, classification, count(*) AS n FROM labelled GROUP BY ALL""")
def skipped_stage_labels(spark, sf_dir):
    """A second run that takes its segments, keywords and seeds from the first one's folder."""
    folder = shared(spark, "runs")
    first = P.full_run(spark, folder, "run-1", raw_a=I.raw_a(spark, sf_dir), raw_b=I.raw_b(spark, sf_dir),
                       seeds=I.corpus_seeds(spark, sf_dir))
    load = lambda name: spark.read.parquet(f"{folder}/run-1/{name}")
    again = P.full_run(spark, folder, "run-2", segments=load("segments"), keywords=load("keywords"), seeds=first["seeds"])
    return again["classified"].groupBy("side", "classification").agg(F.count("*").alias("n"))


@register("detected_text_lengths", "SELECT conv_id, turn, length(text)::INTEGER AS chars FROM conversations")
def detected_text_lengths(spark, sf_dir):
    turns = I.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.length(S.detect_text_column(turns)).alias("chars"))


EXACT_SEEDS = "seeds AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {i}, '{t.lower()}', {j}, 1.0::DOUBLE)" for i, (c, terms) in enumerate(K.BASE_SEEDS.items())
    for j, t in enumerate(sorted(x.lower() for x in terms))) + ") v(category, category_ord, term, term_ord, score))"


@register("exact_seed_labels", Q.with_(Q.SEGMENTS, EXACT_SEEDS, Q.TFIDF, Q.LABELLED) + """
SELECT review_id, primary_category, round(hr_score, 6) AS hr_score, classification FROM labelled""")
def exact_seed_labels(spark, sf_dir):
    labelled = C.label_scores(C.tfidf_scores(I.segments(spark, sf_dir), J.seed_exact(spark)), "tfidf")
    return labelled.select("review_id", "primary_category", F.round("hr_score", 6).alias("hr_score"), "classification")


SCORED = ("side", "review_id", "primary_category", "classification")
STREAMED = LABELLED + f"""
SELECT side, review_id, primary_category, classification, {', '.join(f'round({c}, 6) AS {c}' for c in Q.SCORE_COLUMNS)} FROM labelled"""


@register("frozen_tfidf_scores", STREAMED)
def frozen_tfidf_scores(spark, sf_dir):
    """Fitted, written, loaded, and only then used for scoring."""
    segments = I.stored_segments(spark, sf_dir)
    C.freeze_tfidf(segments, I.corpus_seeds(spark, sf_dir, segments), folder := shared(spark, "model"), stored=True)
    scores = C.label_scores(C.frozen_tfidf_scores(segments, C.load_tfidf(spark, folder), stored=True), "tfidf")
    return scores.select(*SCORED, *TQ.rounded_scores(scores))


@register("streamed_tfidf_scores", STREAMED)
def streamed_tfidf_scores(spark, sf_dir):
    """The same scores from a stream of files, one micro-batch each."""
    segments = I.stored_segments(spark, sf_dir)
    model = C.freeze_tfidf(segments, I.corpus_seeds(spark, sf_dir, segments), shared(spark, "model"), stored=True)
    source, out = shared(spark, "stream"), shared(spark, "scored")
    segments.repartition(3, "review_id").write.parquet(source)
    stream = spark.readStream.schema(segments.schema).option("maxFilesPerTrigger", 1).parquet(source)
    X.stream_classify_tfidf(stream, model, out, shared(spark, "progress")).awaitTermination()
    scores = X.scored_rows(spark, out)
    return scores.select(*SCORED, *TQ.rounded_scores(scores))


def vector_stream(spark, rows):
    source = shared(spark, "stream")
    rows.repartition(3).write.parquet(source)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)


@register("streamed_embedding_scores", VQ.ORACLE["embedding_category_scores"])
def streamed_embedding_scores(spark, sf_dir):
    terms = I.seed_vectors(spark, sf_dir).withColumn("score", 1.0 - 0.1 * (F.substring("term", 2, 6).cast("long") % 5))
    cents = materialize(C.category_centroids(terms, weighted=True), "centroids")
    stream = vector_stream(spark, I.vectors(spark, sf_dir).select("vec_id", "vector"))
    out = shared(spark, "scored")
    X.stream_classify(stream, cents, out, shared(spark, "progress"), VQ.CATS, "vec_id").awaitTermination()
    scores = spark.read.parquet(out)
    return scores.select("vec_id", *[F.round(f"score_{c}", 6).alias(f"score_{c}") for c in VQ.CATS], "primary_category",
                         F.round("hr_score", 6).alias("hr_score"), "classification")


def capped_dictionary(spark, sf_dir):
    terms = I.seed_vectors(spark, sf_dir)
    own = terms.join(C.category_centroids(terms), ["category", "category_ord"]).select(
        "category", "category_ord", "term", "vector",
        F.round(V.dot(V.l2_normalize(F.col("vector")), F.col("centroid")), 4).alias("score"))
    return materialize(E.top_terms_per_category(own, K.OLDER_SEED_TOP_N), "dictionary")


def older_columns(scored):
    return scored.select("vec_id", *[F.round(c, 6).alias(c) for c in VQ.CATS], "Classification")


@register("streamed_older_scores", VQ.ORACLE["older_term_scores"])
def streamed_older_scores(spark, sf_dir):
    stream, out = vector_stream(spark, I.vectors(spark, sf_dir).select("vec_id", "vector")), shared(spark, "scored")
    X.stream_classify_older(stream, capped_dictionary(spark, sf_dir), out, shared(spark, "progress"), VQ.CATS, "vec_id").awaitTermination()
    return older_columns(X.scored_rows(spark, out))


@register("blocked_older_scores", VQ.ORACLE["older_term_scores"])
def blocked_older_scores(spark, sf_dir):
    """The dictionary in blocks of 200 terms, as one larger than a task would be cut."""
    return older_columns(C.older_label(C.older_scores(
        I.vectors(spark, sf_dir), capped_dictionary(spark, sf_dir), VQ.CATS, "vec_id", block_terms=200)))


@register("streamed_seed_merge", Q.with_(VQ.VEC, VQ.centroid("cent", "unit", "category")) + VQ.BEST + """
, found AS (SELECT category, term, round(score, 9) AS score FROM best WHERE round(score, 9) >= 0.2),
base AS (SELECT category, term FROM unit WHERE label = 4),
forced AS (SELECT coalesce(f.category, b.category) AS category, coalesce(f.term, b.term) AS term,
                  CASE WHEN b.term IS NOT NULL THEN 1.0 ELSE f.score END AS score
           FROM found f FULL JOIN base b ON b.category = f.category AND b.term = f.term)
SELECT category, term, round(score, 3) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY round(score, 9) DESC, term) AS r FROM forced) WHERE r <= 100""")
def streamed_seed_merge(spark, sf_dir):
    terms = I.seed_vectors(spark, sf_dir)
    cents = materialize(C.category_centroids(terms), "centroids")
    stream, out = vector_stream(spark, terms.select(F.col("term").alias("keyword"), "vector")), shared(spark, "dictionary")
    X.stream_seed_merge(stream, terms.where("category_ord = 4"), cents, out, shared(spark, "progress"), 0.2,
                        categories=VQ.CATS).awaitTermination()
    return X.latest_seeds(spark, out).select("category", "term", F.round("score", 3).alias("score"))


@register("encoded_rows", """
SELECT doc_id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS spaces FROM documents""")
def encoded_rows(spark, sf_dir):
    """Vectors from a caller's encoder instead of a table."""
    @F.pandas_udf("array<double>")
    def encoder(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(len(t)), float(t.count(" "))] for t in texts.fillna("")])

    rows = C.attach_embeddings(I.text_table(spark, sf_dir, "documents").select("doc_id", "text"), text="text", encoder=encoder)
    return rows.select("doc_id", F.get("vector", F.lit(0)).alias("chars"), F.get("vector", F.lit(1)).alias("spaces"))


WIDE_VECTORS = f"""
esims AS (SELECT 'gd_' || u.vec_id || '_pros' AS review_id, c.category, greatest(list_inner_product(u.v, c.c), 0.0) AS s FROM unit u, cent c),
ewide AS (SELECT review_id, {', '.join(f"max(s) FILTER (category = '{c}') AS e{i}" for i, c in enumerate(VQ.CATS))} FROM esims GROUP BY review_id)"""


def review_vectors(spark, sf_dir):
    return I.vectors(spark, sf_dir).select(F.format_string("gd_%d_pros", "vec_id").alias("review_id"), "vector")


@register("backend_choice", Q.with_(Q.SEGMENTS, Q.KEYWORDS, Q.SEEDS, Q.TFIDF, Q.LABELLED, VQ.VEC, VQ.centroid("cent", "unit", "category"), WIDE_VECTORS) + f"""
SELECT 'tfidf' AS classification_backend, classification, count(*) AS n FROM labelled GROUP BY ALL
UNION ALL SELECT 'sentence_transformer', CASE WHEN round({' + '.join(f'coalesce(e{VQ.CATS.index(c)}, 0.0)' for c in K.HR_CATEGORIES)}, 9) >= 0.5
  THEN 'HR' ELSE 'Non HR' END, count(*) FROM segments LEFT JOIN ewide USING (review_id) GROUP BY ALL""")
def backend_choice(spark, sf_dir):
    """Without vectors the automatic choice is TF-IDF; with vectors it is these, and rows without one score 0."""
    segments, seeds = I.segments(spark, sf_dir), I.corpus_seeds(spark, sf_dir)
    count = lambda df: df.groupBy("classification_backend", "classification").agg(F.count("*").alias("n"))
    return count(C.classify(segments, seeds)).unionByName(count(C.classify(
        segments, seeds, vectors=review_vectors(spark, sf_dir), seed_vectors=I.seed_vectors(spark, sf_dir), categories=VQ.CATS)))


@register("hybrid_three_part_scores", Q.with_(
    Q.SEGMENTS, Q.KEYWORDS, Q.SEEDS, Q.TFIDF, TQ.FACTORS, VQ.VEC, VQ.centroid("cent", "unit", "category"), WIDE_VECTORS) + f"""
SELECT review_id, {', '.join(f'round(0.4 * r{i} + 0.3 * score_{c} + 0.3 * e{i}, 6) AS factor_{c}' for i, c in enumerate(VQ.CATS))}
FROM factors JOIN wide USING (review_id) JOIN ewide USING (review_id)""")
def hybrid_three_part_scores(spark, sf_dir):
    segments = I.stored_segments(spark, sf_dir)
    cents = C.category_centroids(I.seed_vectors(spark, sf_dir), weighted=True)
    embedded = C.embedding_scores(review_vectors(spark, sf_dir), cents, VQ.CATS)
    embedded = embedded.withColumnsRenamed({f"score_{c}": f"embedding_{c}" for c in VQ.CATS})
    three = C.tfidf_scores(segments, I.corpus_seeds(spark, sf_dir, segments), stored=True).join(
        C.regex_factor_score(segments, TQ.FACTOR_PHRASES), "review_id").join(embedded, "review_id")
    return three.select("review_id", *[F.round(C.hybrid_score(F.col(f"regex_{c}"), F.col(f"score_{c}"), F.col(f"embedding_{c}")), 6)
                                       .alias(f"factor_{c}") for c in VQ.CATS])


OWN_TFIDF = Q.TFIDF.replace("segments", "own_sides")
OWN_SIDES = "own_sides AS (SELECT coalesce(nullif(lang, 'fr'), '-') AS side, doc_id AS review_id, text AS review_text FROM documents)"


@register("own_side_scores", Q.with_(Q.SEGMENTS, Q.KEYWORDS, Q.SEEDS, OWN_SIDES, OWN_TFIDF) + f"""
SELECT nullif(side, '-') AS lang, review_id AS doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in Q.SCORE_COLUMNS)} FROM wide""")
def own_side_scores(spark, sf_dir):
    """Sides that the library does not name, one of them null: every row gets scores of its own side."""
    texts = I.text_table(spark, sf_dir, "documents").withColumn("lang", F.nullif("lang", F.lit("fr")))
    scores = C.tfidf_scores(texts, I.corpus_seeds(spark, sf_dir), group="lang", doc="doc_id", text="text")
    return scores.select("lang", "doc_id", *TQ.rounded_scores(scores))


PAIR_GROUP = "CASE WHEN label = 9 THEN '-' ELSE 'p' || (vec_id // 2) END"
SMALL = VQ.dbscan_sql(PAIR_GROUP).replace(
    "core AS (SELECT g, a AS id FROM nb GROUP BY ALL HAVING count(*) >= 5)",
    "core AS (SELECT nb.g, a AS id FROM nb JOIN (SELECT g, count(*) AS n FROM pts GROUP BY g) z ON z.g = nb.g GROUP BY nb.g, a, n "
    "HAVING count(*) >= least(5, n) AND n > 1)")


@register("small_group_labels", Q.with_(VQ.VEC, SMALL, recursive=True) + """
SELECT nullif(group_key, '-') AS group_key, id, label, is_core FROM labels""")
def small_group_labels(spark, sf_dir):
    """Groups of one and two rows, and a larger one whose key is null."""
    points = I.vectors(spark, sf_dir).select(
        F.when(F.col("label") != 9, F.concat(F.lit("p"), F.floor(F.col("vec_id") / 2))).alias("group_key"),
        F.col("vec_id").alias("id"), V.as_double(F.col("vector")).alias("vector"))
    return L.cluster_dbscan(points, VQ.EPS, 5)


@register("svd_checks", Q.with_(SQ.UNIQUE, SQ.FEATURES) + """
SELECT count(DISTINCT doc_id) AS n_rows, least(96, count(DISTINCT term)) AS n_components, true AS orthogonal, true AS descending,
       true AS no_longer_than_one FROM feats""")
def svd_checks(spark, sf_dir):
    reduced = materialize(D.reduce_svd(N.text_features(SQ.unique_documents(spark, sf_dir), "doc_id"), "doc_id", 96), "svd")
    products = materialize(D.vector_products(reduced), "svd-products")
    own = products.where("p = q").select("p", "product")
    following = own.join(own.select((F.col("p") - 1).alias("p"), F.col("product").alias("next")), "p")
    return reduced.agg(F.count("*").alias("n_rows"), F.max(F.size("vector")).cast("long").alias("n_components")).select(
        "*", (products.where("p < q").agg(F.max(F.abs("product"))).scalar() < 1e-6).alias("orthogonal"),
        following.agg(F.bool_and(F.col("next") <= F.col("product") + 1e-6)).scalar().alias("descending"),
        reduced.agg(F.max(V.dot(F.col("vector"), F.col("vector"))) <= 1 + 1e-9).scalar().alias("no_longer_than_one"))


@register("approximate_pair_checks", Q.with_(VQ.VEC, VQ.PAIRS) + """
SELECT count(*) AS n_exact, true AS all_are_pairs, true AS recall_reached FROM pairs""")
def approximate_pair_checks(spark, sf_dir):
    """The approximate mode on the given vectors against the exact one."""
    points = VQ.all_points(spark, sf_dir)
    exact = materialize(NB.eps_join(points, VQ.EPS).select("a", "b"), "pairs")
    near = materialize(NB.eps_join(points, VQ.EPS, mode="approximate").select("a", "b"), "near-pairs")
    known = near.join(exact, ["a", "b"], "left_semi").agg(F.count("*")).scalar()
    return exact.agg(F.count("*").alias("n_exact")).select(
        "n_exact", (known == near.agg(F.count("*")).scalar()).alias("all_are_pairs"),
        (known >= 0.9 * F.col("n_exact")).alias("recall_reached"))


@register("spanning_forest_checks", Q.with_(VQ.VEC, VQ.dbscan_sql("'all'"), recursive=True) + """
SELECT count(*) - 1 AS n_edges, count(*) - (SELECT count(DISTINCT root) FROM root) - (count(*) - (SELECT count(*) FROM core)) AS n_edges_within
FROM pts""")
def spanning_forest_checks(spark, sf_dir):
    """The forest of mutual reachability has as many edges up to a radius as joins the components that the graph has there."""
    forest = H.spanning_forest(VQ.all_points(spark, sf_dir), 5, block_rows=256)
    return forest.agg(F.count("*").alias("n_edges"), F.count_if(F.round("weight", 9) <= VQ.EPS).alias("n_edges_within"))
