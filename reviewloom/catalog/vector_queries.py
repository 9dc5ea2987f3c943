"""Registered queries over the vector side, each with its oracle statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom import constants as K
from reviewloom.catalog import inputs as I
from reviewloom.catalog import sql as Q
from reviewloom.functions import vectors as V
from reviewloom.operators import cluster as L
from reviewloom.operators import neighbors as NB
from reviewloom.operators import reduce as D
from reviewloom.operators import report as R
from reviewloom.operators import scoring as C
from reviewloom.operators import seeds as E

QUERIES = {}
ORACLE = {}
EPS = 1.15
CATS = I.VECTOR_CATEGORIES
CAT_LIST = "[" + Q.strings(CATS) + "]"


def register(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function
    return add


VEC = f"""
vec AS (SELECT vec_id, label, {CAT_LIST}[label + 1] AS category, printf('v%06d', vec_id) AS term,
               CAST(embedding AS DOUBLE[]) AS raw FROM embeddings),
unit AS (SELECT *, [x / greatest(sqrt(list_inner_product(raw, raw)), 1e-12) FOR x IN raw] AS v FROM vec)"""


def centroid(name: str, source: str, by: str, weight: str = "1.0", value: str = "v") -> str:
    """CTEs ending in ``name`` (by, c): the unit-length weighted mean of ``source.value``."""
    return f"""
{name}_x AS (SELECT {by}, {weight} AS w, unnest({value}) AS x,
             generate_subscripts({value}, 1) AS pos FROM {source}),
{name}_m AS (SELECT {by}, list(x ORDER BY pos) AS m FROM
             (SELECT {by}, pos, sum(w * x) / sum(w) AS x FROM {name}_x GROUP BY ALL) GROUP BY {by}),
{name} AS (SELECT {by}, [x / greatest(sqrt(list_inner_product(m, m)), 1e-12) FOR x IN m] AS c
           FROM {name}_m)"""


def all_points(spark, sf_dir):
    return I.vectors(spark, sf_dir).select(
        F.lit("all").alias("group_key"), F.col("vec_id").alias("id"),
        V.as_double(F.col("vector")).alias("vector"))


def parity_points(spark, sf_dir):
    return I.vectors(spark, sf_dir).select(
        F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("group_key"),
        F.col("vec_id").alias("id"), V.as_double(F.col("vector")).alias("vector"))


@register("vector_normalize_dot", Q.with_(VEC) + """
SELECT vec_id, round(list_inner_product(v, v), 6) AS unit_dot,
       round(list_inner_product(raw, list_reverse(raw)), 6) AS self_reverse_dot,
       round(greatest(list_cosine_similarity(raw, list_reverse(raw)), 0.0), 4) AS clamped_cosine
FROM unit""")
def vector_normalize_dot(spark, sf_dir):
    v, back = F.col("vector"), F.reverse("vector")
    unit = V.l2_normalize(v)
    return I.vectors(spark, sf_dir).select(
        "vec_id", F.round(V.dot(unit, unit), 6).alias("unit_dot"),
        F.round(V.dot(v, back), 6).alias("self_reverse_dot"),
        V.round_score(V.clamp0(V.cosine(v, back))).alias("clamped_cosine"))


@register("category_centroids", Q.with_(VEC, centroid("cent", "unit", "category")) + """
SELECT category, CAST(pos AS INTEGER) AS pos, round(x, 6) + 0.0 AS x
FROM (SELECT category, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM cent)""")
def category_centroids(spark, sf_dir):
    cents = C.category_centroids(I.seed_vectors(spark, sf_dir))
    return cents.select("category", F.posexplode("centroid").alias("p", "x")).select(
        "category", (F.col("p") + 1).alias("pos"), (F.round("x", 6) + 0.0).alias("x"))


@register("embedding_category_scores", Q.with_(
    VEC, "weighted AS (SELECT *, 1.0 - 0.1 * (vec_id % 5) AS w FROM unit)",
    centroid("cent", "weighted", "category", "w")) + f"""
, sims AS (SELECT u.vec_id, c.category, greatest(list_inner_product(u.v, c.c), 0.0) AS s
           FROM unit u, cent c),
wide AS (SELECT vec_id, {', '.join(f"coalesce(max(s) FILTER (category = '{c}'), 0.0) AS score_{c}" for c in CATS)}
         FROM sims GROUP BY vec_id)
SELECT vec_id, {', '.join(f'round(score_{c}, 6) AS score_{c}' for c in CATS)},
       {Q.argmax([f'score_{c}' for c in CATS], CATS)} AS primary_category,
       round({' + '.join('score_' + c for c in K.HR_CATEGORIES)}, 6) AS hr_score,
       CASE WHEN round({' + '.join('score_' + c for c in K.HR_CATEGORIES)}, 9) >= 0.5
            THEN 'HR' ELSE 'Non HR' END AS classification
FROM wide""")
def embedding_category_scores(spark, sf_dir):
    terms = I.seed_vectors(spark, sf_dir).withColumn(
        "score", 1.0 - 0.1 * (F.substring("term", 2, 6).cast("long") % 5))
    cents = C.category_centroids(terms, weighted=True)
    scores = C.embedding_scores(I.vectors(spark, sf_dir), cents, CATS, doc="vec_id")
    labelled = C.label_scores(scores, "sentence_transformer", CATS)
    return labelled.select(
        "vec_id", *[F.round(f"score_{c}", 6).alias(f"score_{c}") for c in CATS],
        "primary_category", F.round("hr_score", 6).alias("hr_score"), "classification")


BEST = f"""
, sims AS (SELECT u.vec_id, u.term, c.category, list_inner_product(u.v, c.c) AS s FROM unit u, cent c),
swide AS (SELECT vec_id, term, {', '.join(f"max(s) FILTER (category = '{c}') AS s{i}" for i, c in enumerate(CATS))}
          FROM sims GROUP BY ALL),
best AS (SELECT vec_id, term, {Q.argmax([f's{i}' for i in range(10)], CATS)} AS category,
                greatest({', '.join(f's{i}' for i in range(10))}) AS score FROM swide)"""


@register("keyword_best_category", Q.with_(VEC, centroid("cent", "unit", "category")) + BEST + """
SELECT term AS keyword, category, round(score, 4) AS score FROM best""")
def keyword_best_category(spark, sf_dir):
    terms = I.seed_vectors(spark, sf_dir)
    found = E.best_category(terms.select(F.col("term").alias("keyword"), "vector"),
                            C.category_centroids(terms), CATS)
    return found.select("keyword", "category", V.round_score(F.col("score")).alias("score"))


EXPANDED = f"""
, pooled AS (
  SELECT category, term, 1.0 AS score, '{K.BASE_SOURCE}' AS source FROM unit WHERE label < 3
  UNION ALL SELECT category, term, round(score, 4), '{K.EXPANSION_SOURCE}' FROM best
  WHERE round(score, 9) >= 0.2),
merged AS (SELECT category, term, max(score) AS score, arg_max(source, score) AS source
           FROM pooled GROUP BY ALL),
expanded AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, term) - 1 AS term_ord
  FROM merged QUALIFY term_ord < 60)"""


@register("seed_expansion", Q.with_(VEC, centroid("cent", "unit", "category")) + BEST + EXPANDED + """
SELECT category, term, score, source, CAST(term_ord AS INTEGER) AS term_ord FROM expanded""")
def seed_expansion(spark, sf_dir):
    terms = I.seed_vectors(spark, sf_dir)
    cents = C.category_centroids(terms)
    base = terms.where(F.col("category_ord") < 3)
    grown = E.seed_expand(terms.select(F.col("term").alias("keyword"), "vector"), base, cents,
                          threshold=0.2, top_n=60, categories=CATS)
    return grown.select("category", "term", "score", "source", "term_ord")


@register("seed_incremental_merge", Q.with_(VEC, centroid("cent", "unit", "category")) + BEST + f"""
, old AS (SELECT category, term, score, '{K.EXPANSION_SOURCE}' AS source FROM best WHERE round(score, 9) >= 0.1),
new AS (SELECT category, term, 0.9 * list_inner_product(v, v) AS score, 'batch' AS source FROM unit),
merged AS (SELECT category, term, max(score) AS score, arg_max(source, score) AS source
           FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY ALL),
base AS (SELECT category, term FROM unit WHERE label = 4),
forced AS (SELECT coalesce(m.category, b.category) AS category, coalesce(m.term, b.term) AS term,
                  CASE WHEN b.term IS NOT NULL THEN 1.0 ELSE m.score END AS score,
                  CASE WHEN b.term IS NOT NULL THEN '{K.BASE_SOURCE}' ELSE m.source END AS source
           FROM merged m FULL JOIN base b ON b.category = m.category AND b.term = m.term)
SELECT category, term, round(score, 3) AS score, source FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY round(score, 9) DESC, term) AS r FROM forced)
WHERE r <= 100""")
def seed_incremental_merge(spark, sf_dir):
    terms = I.seed_vectors(spark, sf_dir)
    cents = C.category_centroids(terms)
    best = E.best_category(terms.select(F.col("term").alias("keyword"), "vector"), cents, CATS)
    old = best.where(F.round("score", 9) >= 0.1).select(
        "category", "category_ord", F.col("keyword").alias("term"), F.round("score", 9).alias("score"),
        F.lit(K.EXPANSION_SOURCE).alias("source"))
    unit = V.l2_normalize(F.col("vector"))
    new = terms.select("category", "category_ord", "term",
                       F.round(0.9 * V.dot(unit, unit), 9).alias("score"), F.lit("batch").alias("source"))
    merged = E.seed_merge(old, new, terms.where(F.col("category_ord") == 4))
    return merged.select("category", "term", "score", "source")


@register("top_terms_per_category", Q.with_(VEC, centroid("cent", "unit", "category")) + BEST + """
SELECT category, term, round(score, 4) AS score,
       CAST(row_number() OVER (PARTITION BY category ORDER BY round(score, 4) DESC, term) - 1 AS INTEGER) AS term_ord
FROM best QUALIFY term_ord < 20""")
def top_terms_per_category(spark, sf_dir):
    terms = I.seed_vectors(spark, sf_dir)
    best = E.best_category(terms.select(F.col("term").alias("keyword"), "vector"),
                           C.category_centroids(terms), CATS)
    ranked = E.top_terms_per_category(
        best.select("category", F.col("keyword").alias("term"), F.round("score", 4).alias("score")), 20)
    return ranked.select("category", "term", "score", "term_ord")


@register("older_term_scores", Q.with_(VEC, centroid("cent", "unit", "category")) + f"""
, own AS (SELECT u.category, u.term, u.v, round(list_inner_product(u.v, c.c), 4) AS weight
          FROM unit u JOIN cent c USING (category)),
capped AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY category ORDER BY weight DESC, term) <= 100),
pairs AS (SELECT u.vec_id, s.category, max(list_inner_product(u.v, s.v) * s.weight) AS s
          FROM unit u, capped s GROUP BY ALL),
wide AS (SELECT vec_id, {', '.join(f"max(s) FILTER (category = '{c}') AS {c}" for c in CATS)}
         FROM pairs GROUP BY vec_id)
SELECT vec_id, {', '.join(f'round({c}, 6) AS {c}' for c in CATS)},
       CASE WHEN round({' + '.join(K.OLDER_HR_CATEGORIES)}, 9) > 0.5 THEN 'HR' ELSE 'Non HR' END AS "Classification"
FROM wide""")
def older_term_scores(spark, sf_dir):
    terms = I.seed_vectors(spark, sf_dir)
    cents = C.category_centroids(terms)
    own = terms.join(cents, ["category", "category_ord"]).select(
        "category", "category_ord", "term", "vector",
        F.round(V.dot(V.l2_normalize(F.col("vector")), F.col("centroid")), 4).alias("score"))
    dictionary = E.top_terms_per_category(own, K.OLDER_SEED_TOP_N)
    scored = C.older_label(C.older_scores(I.vectors(spark, sf_dir), dictionary, CATS, doc="vec_id"))
    return scored.select("vec_id", *[F.round(c, 6).alias(c) for c in CATS], "Classification")


@register("attach_embeddings", """
SELECT d.doc_id, d.lang, e.label, round(CAST(e.embedding[1] AS DOUBLE), 6) AS first_value
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def attach_embeddings(spark, sf_dir):
    vectors = I.vectors(spark, sf_dir).withColumnRenamed("vec_id", "doc_id")
    joined = C.attach_embeddings(I.table(spark, sf_dir, "documents").select("doc_id", "lang"),
                                 vectors, "doc_id")
    with_label = joined.join(vectors.select("doc_id", "label"), "doc_id", "left")
    return with_label.select("doc_id", "lang", "label",
                             F.round(F.col("vector")[0].cast("double"), 6).alias("first_value"))


PAIRS = f"""
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.raw, b.raw) AS dist
          FROM vec a JOIN vec b ON a.vec_id < b.vec_id
          WHERE round(list_distance(a.raw, b.raw), 9) <= {EPS})"""


@register("eps_join_pairs", Q.with_(VEC, PAIRS) + "SELECT a, b, round(dist, 6) AS dist FROM pairs")
def eps_join_pairs(spark, sf_dir):
    # Small blocks, so that several pivots and block pairs take part even on the small tables.
    pairs = NB.eps_join(all_points(spark, sf_dir), EPS, block_rows=128)
    return pairs.select("a", "b", F.round("dist", 6).alias("dist"))


@register("knn_join_edges", Q.with_(VEC) + """
, sims AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_inner_product(a.v, b.v) AS sim
           FROM unit a JOIN unit b ON a.vec_id <> b.vec_id)
SELECT src, dst, round(sim, 6) AS sim,
       CAST(row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) AS INTEGER) AS rank
FROM sims QUALIFY rank <= 8""")
def knn_join_edges(spark, sf_dir):
    found = NB.knn_join(all_points(spark, sf_dir), 8, block_rows=256)
    return found.select("src", "dst", F.round("sim", 6).alias("sim"), "rank")


def dbscan_sql(group: str) -> str:
    return f"""
pts AS (SELECT vec_id AS id, {group} AS g, raw FROM vec),
nb AS (SELECT a.g, a.id AS a, b.id AS b FROM pts a JOIN pts b ON a.g = b.g
       WHERE round(list_distance(a.raw, b.raw), 9) <= {EPS}),
core AS (SELECT g, a AS id FROM nb GROUP BY ALL HAVING count(*) >= 5),
ce AS (SELECT nb.a, nb.b FROM nb JOIN core x ON x.id = nb.a JOIN core y ON y.id = nb.b),
reach AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, ce.b FROM reach r JOIN ce ON ce.a = r.b),
root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
lab AS (SELECT c.g, c.id, dense_rank() OVER (PARTITION BY c.g ORDER BY root) - 1 AS label
        FROM core c JOIN root USING (id)),
border AS (SELECT nb.a AS id, min(lab.label) AS label FROM nb JOIN lab ON lab.id = nb.b GROUP BY nb.a),
labels AS (SELECT p.g AS group_key, p.id, CAST(coalesce(lab.label, border.label, -1) AS INTEGER) AS label,
                  lab.id IS NOT NULL AS is_core
           FROM pts p LEFT JOIN lab ON lab.id = p.id LEFT JOIN border ON border.id = p.id)"""


@register("dbscan_labels", Q.with_(VEC, dbscan_sql("'all'"), recursive=True) + "SELECT * FROM labels")
def dbscan_labels(spark, sf_dir):
    return L.cluster_dbscan(all_points(spark, sf_dir), EPS, 5, block_rows=256)


PARITY = "CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END"


@register("dbscan_per_group", Q.with_(VEC, dbscan_sql(PARITY), recursive=True) + "SELECT * FROM labels")
def dbscan_per_group(spark, sf_dir):
    return L.cluster_dbscan(parity_points(spark, sf_dir), EPS, 5)


@register("density_labels", Q.with_(VEC, dbscan_sql("'all'"), recursive=True) + """
, sized AS (SELECT label, count(*) AS n, min(id) AS f FROM labels WHERE is_core GROUP BY label),
kept AS (SELECT label, row_number() OVER (ORDER BY f) - 1 AS new FROM sized WHERE n >= 3)
SELECT group_key, id, CAST(coalesce(CASE WHEN is_core THEN new END, -1) AS INTEGER) AS label
FROM labels LEFT JOIN kept USING (label)""")
def density_labels(spark, sf_dir):
    return L.cluster_density(all_points(spark, sf_dir), min_cluster_size=3, min_samples=5, eps=EPS)


@register("cluster_columns", Q.with_(VEC, dbscan_sql("'all'"), recursive=True) + f"""
SELECT e.vec_id, e.label AS given, l.label AS cluster_id, l.label = -1 AS is_cluster_noise,
       CAST(count(*) OVER (PARTITION BY l.label) AS INTEGER) AS cluster_size,
       round(e.raw[1], 6) AS cluster_x, round(e.raw[2], 6) AS cluster_y, 'none' AS reducer_used,
       'dbscan' AS cluster_algorithm_used, '{K.MODEL_ID}' AS cluster_embedding_model_id,
       15 AS cluster_min_cluster_size, 5 AS cluster_min_samples
FROM vec e JOIN labels l ON l.id = e.vec_id""")
def cluster_columns(spark, sf_dir):
    points = all_points(spark, sf_dir)
    labels = L.cluster_dbscan(points, EPS, 5).drop("is_core")
    frame = I.vectors(spark, sf_dir).select("vec_id", F.col("label").alias("given"))
    wide = L.add_cluster_columns(frame, labels, points, "none", "dbscan", key="vec_id")
    return wide.withColumns({"cluster_x": F.round("cluster_x", 6), "cluster_y": F.round("cluster_y", 6)})


@register("cluster_report", Q.with_(VEC, dbscan_sql(PARITY), recursive=True) + """
SELECT group_key, count(*) AS n_rows, count(DISTINCT label) FILTER (label >= 0) AS n_clusters,
       count(*) FILTER (label = -1) AS n_noise,
       (SELECT max(n) FROM (SELECT group_key AS g2, label, count(*) AS n FROM labels WHERE label >= 0
                            GROUP BY ALL) WHERE g2 = group_key) AS largest_cluster
FROM labels GROUP BY group_key""")
def cluster_report(spark, sf_dir):
    return R.cluster_report(L.cluster_dbscan(parity_points(spark, sf_dir), EPS, 5))


@register("cluster_sizes", Q.with_(VEC, dbscan_sql("'all'"), recursive=True) + """
SELECT group_key, label, count(*) AS cluster_size FROM labels GROUP BY ALL""")
def cluster_sizes(spark, sf_dir):
    return L.cluster_sizes(L.cluster_dbscan(all_points(spark, sf_dir), EPS, 5))


@register("assign_nearest_centroid", Q.with_(VEC, centroid("cent", "unit", "label")) + """
SELECT vec_id AS id, arg_min(c.label, struct_pack(d := round(list_distance(u.raw, c.c) ** 2, 9), l := c.label)) AS label
FROM unit u, cent c GROUP BY vec_id""")
def assign_nearest_centroid(spark, sf_dir):
    cents = C.category_centroids(I.seed_vectors(spark, sf_dir)).select(
        F.col("category_ord").alias("label"), "centroid")
    return L.assign_nearest(all_points(spark, sf_dir), cents).select("id", "label")


@register("standard_scale", Q.with_(VEC) + """
, x AS (SELECT vec_id, unnest(raw) AS x, generate_subscripts(raw, 1) AS pos FROM vec),
s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd FROM x GROUP BY pos)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round((x - m) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END, 6) + 0.0 AS x
FROM x JOIN s USING (pos)""")
def standard_scale(spark, sf_dir):
    scaled = D.standard_scale(I.vectors(spark, sf_dir))
    return scaled.select("vec_id", F.posexplode("vector").alias("p", "x")).select(
        "vec_id", (F.col("p") + 1).alias("pos"), (F.round("x", 6) + 0.0).alias("x"))


@register("pca_reduced")
def pca_reduced(spark, sf_dir):
    reduced = D.reduce_pca(all_points(spark, sf_dir), 10)
    return reduced.select("id", F.posexplode("vector").alias("pos", "x"), "reducer_used")


@register("kmeans_labels")
def kmeans_labels(spark, sf_dir):
    return L.cluster_kmeans(all_points(spark, sf_dir))


@register("dbscan_on_pca")
def dbscan_on_pca(spark, sf_dir):
    reduced = D.reduce_pca(all_points(spark, sf_dir), 10)
    return L.cluster_dbscan(reduced, 0.45, 5)


@register("clustered_sides", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'small' ELSE 'side' || label % 3 END AS side FROM embeddings)
SELECT side, count(*) AS n_rows, true AS sizes_add_up, true AS labels_from_zero, true AS labels_without_gaps,
       CASE WHEN count(*) <= 2 THEN 'none_too_few_rows' ELSE 'pca' END AS reducer_used,
       CASE WHEN count(*) = 1 THEN 'none_too_few_rows' ELSE 'kmeans' END AS algorithm_used
FROM v GROUP BY side""")
def clustered_sides(spark, sf_dir):
    """What holds for every side clustered by itself, whatever the start of the search."""
    vectors = I.vectors(spark, sf_dir)
    side = F.when(F.col("vec_id") % 7 == 0, "small").otherwise(F.concat(F.lit("side"), F.col("label") % 3))
    out = L.cluster_rows(vectors.select("vec_id", side.alias("side")), vectors, "kmeans", key="vec_id")
    per = out.groupBy("side", "cluster_id", "reducer_used", "cluster_algorithm_used").agg(
        F.count("*").alias("n"), F.max("cluster_size").alias("given"))
    return per.groupBy("side").agg(
        F.sum("n").alias("n_rows"), F.bool_and(F.col("n") == F.col("given")).alias("sizes_add_up"),
        (F.min("cluster_id") == 0).alias("labels_from_zero"),
        (F.max("cluster_id") + 1 == F.count("*")).alias("labels_without_gaps"),
        F.max("reducer_used").alias("reducer_used"), F.max("cluster_algorithm_used").alias("algorithm_used"))
