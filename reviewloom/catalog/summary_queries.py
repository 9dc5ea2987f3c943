"""Registered queries over deduplication, features, graphs and cluster summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom import constants as K
from reviewloom.catalog import inputs as I
from reviewloom.catalog import sql as Q
from reviewloom.catalog import vector_queries as VQ
from reviewloom.functions import text as T
from reviewloom.functions import vectors as V
from reviewloom.operators import cluster as L
from reviewloom.operators import dedup as U
from reviewloom.operators import graph as G
from reviewloom.operators import neighbors as NB
from reviewloom.operators import reduce as D
from reviewloom.operators import report as R
from reviewloom.operators import scoring as C
from reviewloom.operators import segments as S
from reviewloom.operators import terms as N
from reviewloom.session import materialize

QUERIES = {}
ORACLE = {}
THEMES = K.CATEGORIES


def register(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function
    return add


def unique_documents(spark, sf_dir):
    """Documents deduplicated by normalised text, with their source number as cluster."""
    documents = I.text_table(spark, sf_dir, "documents")
    unique = U.dedup_exact(documents, "text", "doc_id", ["n_chars"])
    sources = I.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("first_id"), F.substring("source", 4, 9).cast("int").alias("cluster_number"))
    return unique.join(sources, "first_id").select(
        F.col("first_id").alias("doc_id"), "text_key", F.col("review_text_original").alias("review_text"),
        "review_text_normalized", F.col("_review_count").alias("review_count"), "n_chars", "cluster_number")


NORM = f"lower({Q.collapse('text')})"
UNIQUE = f"""
uniq AS (
  SELECT min(doc_id) AS doc_id, {NORM} AS norm, arg_min(text, doc_id) AS review_text,
         count(*) AS review_count, avg(n_chars) AS n_chars,
         CAST(substr(arg_min(source, doc_id), 4) AS INTEGER) AS cluster_number
  FROM documents GROUP BY {NORM})"""

FEATURE_STOP = Q.strings(N.feature_stop_words())
FEATURES = f"""
plain AS (SELECT doc_id, translate(lower(review_text), '{T.ACCENTED}', '{T.PLAIN}') AS body FROM uniq),
{Q.grams('fg', 'plain', 'doc_id', 'body', hi=2, stop=FEATURE_STOP)},
ftf AS (SELECT doc_id, term, count(*) AS tf FROM fg GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM uniq),
vocab AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf
          FROM (SELECT term, sum(tf) AS total, count(*) AS df FROM ftf GROUP BY term), nd
          WHERE df >= 5 AND df <= 0.92 * n ORDER BY total DESC, term LIMIT 15000),
fraw AS (SELECT doc_id, term, df, (1 + ln(tf)) * idf AS raw FROM ftf JOIN vocab USING (term)),
feats AS (SELECT doc_id, term, df, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM fraw)"""

THEME = f"""
theme_docs AS (SELECT category, translate(string_agg(term, ' ' ORDER BY term_ord), '{T.ACCENTED}', '{T.PLAIN}') AS body
               FROM seeds GROUP BY category),
{Q.grams('hg', 'theme_docs', 'category', 'body', hi=2, stop=FEATURE_STOP)},
htf AS (SELECT category, term, count(*) AS tf FROM hg GROUP BY ALL),
hraw AS (SELECT category, term, (1 + ln(tf)) * idf AS raw FROM htf JOIN vocab USING (term)),
hw AS (SELECT category, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY category)) AS weight FROM hraw),
hsim AS (SELECT f.doc_id, h.category, sum(f.weight * h.weight) AS s FROM feats f JOIN hw h USING (term) GROUP BY ALL),
themes AS (SELECT u.doc_id, {', '.join(f"coalesce(max(s) FILTER (category = '{c}'), 0.0) AS theme_{c}" for c in THEMES)}
           FROM uniq u LEFT JOIN hsim USING (doc_id) GROUP BY u.doc_id)"""


def theme_documents(spark, sf_dir):
    seeds = I.corpus_seeds(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("term_ord", "term")))
    return seeds.groupBy("category").agg(
        F.array_join(F.transform(ordered, lambda x: x["term"]), " ").alias("text"))


@register("exact_duplicates", Q.with_(UNIQUE) + """
SELECT doc_id AS first_id, norm AS review_text_normalized, review_text AS review_text_original,
       review_count AS _review_count, round(n_chars, 6) AS n_chars FROM uniq""")
def exact_duplicates(spark, sf_dir):
    unique = U.dedup_exact(I.text_table(spark, sf_dir, "documents"), "text", "doc_id", ["n_chars"])
    return unique.select("first_id", "review_text_normalized", "review_text_original", "_review_count",
                         F.round("n_chars", 6).alias("n_chars"))


@register("map_back_to_rows", Q.with_(UNIQUE) + f"""
SELECT d.doc_id, u.doc_id AS unique_review_id, u.review_count, u.cluster_number
FROM documents d LEFT JOIN uniq u ON u.norm = {NORM.replace('text', 'd.text')}""")
def map_back_to_rows(spark, sf_dir):
    unique = unique_documents(spark, sf_dir).withColumnRenamed("doc_id", "unique_review_id")
    rows = I.text_table(spark, sf_dir, "documents").select("doc_id", "text")
    return U.map_back(rows, unique, ["unique_review_id", "review_count", "cluster_number"], "text").drop("text")


@register("near_duplicate_pairs", Q.with_(UNIQUE, FEATURES) + """
SELECT a.doc_id AS a, b.doc_id AS b, round(sum(a.weight * b.weight), 6) AS sim
FROM feats a JOIN feats b ON a.term = b.term AND a.doc_id < b.doc_id
GROUP BY ALL HAVING round(sum(a.weight * b.weight), 9) >= 0.9""")
def near_duplicate_pairs(spark, sf_dir):
    features = N.text_features(unique_documents(spark, sf_dir), "doc_id")
    # A lower threshold than the default, because the given near copies differ by more than 2 %.
    return U.near_duplicates(features, 0.9).select("a", "b", F.round("sim", 6).alias("sim"))


@register("text_features", Q.with_(UNIQUE, FEATURES) + """
SELECT doc_id, term, df, round(weight, 6) AS weight FROM feats""")
def text_features(spark, sf_dir):
    return N.text_features(unique_documents(spark, sf_dir), "doc_id").select(
        "doc_id", "term", "df", F.round("weight", 6).alias("weight"))


THEME_COLUMNS = [f"theme_{c}" for c in THEMES]


@register("top_seed_themes", Q.with_(UNIQUE, FEATURES, Q.SEGMENTS, Q.KEYWORDS, Q.SEEDS, THEME) + f"""
SELECT doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in THEME_COLUMNS)},
       {Q.argmax(THEME_COLUMNS, THEMES)} AS top_seed_theme,
       round(greatest({', '.join(THEME_COLUMNS)}), 6) AS top_seed_score
FROM themes""")
def top_seed_themes(spark, sf_dir):
    scores = N.theme_scores(unique_documents(spark, sf_dir), theme_documents(spark, sf_dir), THEMES, "doc_id")
    best = R.top_seed_theme(scores, THEMES)
    return best.select("doc_id", *[F.round(c, 6).alias(c) for c in THEME_COLUMNS], "top_seed_theme",
                       F.round("top_seed_score", 6).alias("top_seed_score"))


TOP_TERMS = """
cw AS (SELECT u.cluster_number, f.term, sum(f.weight * u.review_count) AS w
       FROM feats f JOIN uniq u USING (doc_id) GROUP BY ALL),
ct AS (SELECT cluster_number, sum(review_count) AS total FROM uniq GROUP BY ALL),
top_terms AS (SELECT cluster_number, term, w / total AS weight,
                     row_number() OVER (PARTITION BY cluster_number ORDER BY round(w / total, 9) DESC, term) AS rank
              FROM cw JOIN ct USING (cluster_number) QUALIFY rank <= 12)"""


@register("top_terms_per_cluster", Q.with_(UNIQUE, FEATURES, TOP_TERMS) + """
SELECT cluster_number, term, round(weight, 6) AS weight, CAST(rank AS INTEGER) AS rank FROM top_terms""")
def top_terms_per_cluster(spark, sf_dir):
    unique = unique_documents(spark, sf_dir)
    top = R.top_terms_per_cluster(N.text_features(unique, "doc_id"), unique, "cluster_number")
    return top.select("cluster_number", "term", F.round("weight", 6).alias("weight"), "rank")


def themed_rows(spark, sf_dir):
    """Unique documents with theme scores, the theme vector and text quality."""
    unique = unique_documents(spark, sf_dir)
    scores = N.theme_scores(unique, theme_documents(spark, sf_dir), THEMES, "doc_id")
    quality = S.text_quality(unique)
    return quality.join(scores, "doc_id").withColumn("vector", F.array(*THEME_COLUMNS))


DOMINANT = f"""
dmean AS (SELECT cluster_number, {', '.join(f'sum({c} * review_count) / sum(review_count) AS {c}' for c in THEME_COLUMNS)}
          FROM themes JOIN uniq USING (doc_id) GROUP BY cluster_number),
dominant AS (SELECT cluster_number, {Q.argmax(THEME_COLUMNS, THEMES)} AS dominant_seed_cluster,
                    greatest({', '.join(THEME_COLUMNS)}) AS dominant_seed_score,
                    [{', '.join(THEME_COLUMNS)}] AS profile
             FROM dmean)"""

WORDS = f"[w FOR w IN regexp_split_to_array(lower(review_text), '{Q.NOT_WORD}') IF length(w) >= 2"
REPRESENTATIVE = f"""
rscore AS (
  SELECT cluster_number, doc_id,
    list_inner_product(x, profile) / (greatest(sqrt(list_inner_product(x, x)), 1e-12)
      * greatest(sqrt(list_inner_product(profile, profile)), 1e-12))
    + x[list_position({Q.CATEGORY_LIST}, dominant_seed_cluster)]
    + least(len({WORDS}]), 40) / 40 * 0.1 + 0.02 * ln(1 + review_count)
    - CASE WHEN len({WORDS} AND w NOT IN ({Q.STOP})]) < 3 THEN 0.5 ELSE 0 END AS score
  FROM (SELECT u.*, [{', '.join(THEME_COLUMNS)}] AS x FROM uniq u JOIN themes USING (doc_id))
  JOIN dominant USING (cluster_number)),
reps AS (SELECT *, row_number() OVER (PARTITION BY cluster_number ORDER BY round(score, 9) DESC, doc_id) AS rank
         FROM rscore QUALIFY rank <= 5)"""

THEME_PARTS = (UNIQUE, FEATURES, Q.SEGMENTS, Q.KEYWORDS, Q.SEEDS, THEME, DOMINANT)


@register("representative_reviews", Q.with_(*THEME_PARTS, REPRESENTATIVE) + """
SELECT cluster_number, doc_id, round(score, 6) AS representative_score, CAST(rank AS INTEGER) AS rank FROM reps""")
def representative_reviews(spark, sf_dir):
    rows = themed_rows(spark, sf_dir)
    dominant = R.dominant_theme(rows, THEMES, "cluster_number")
    overlap = rows.join(dominant, "cluster_number").withColumn("theme_overlap", F.element_at(
        F.create_map(*[x for c in THEMES for x in (F.lit(c), F.col(f"theme_{c}"))]),
        F.col("dominant_seed_cluster")))
    best = R.representative_reviews(overlap, "cluster_number")
    return best.withColumn("representative_score", F.round("representative_score", 6))


PHRASES = f"""
pt AS (SELECT cluster_number, doc_id, unnest(regexp_split_to_array(lower(review_text), '{Q.NOT_WORD}')) AS w,
              generate_subscripts(regexp_split_to_array(lower(review_text), '{Q.NOT_WORD}'), 1) AS pos FROM uniq),
pl AS (SELECT cluster_number, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM pt WHERE length(w) >= 2
       WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
pc AS (SELECT cluster_number, w || ' ' || w2 AS phrase FROM pl
       WHERE w2 IS NOT NULL AND w NOT IN ({Q.STOP}) AND w2 NOT IN ({Q.STOP})
       UNION ALL SELECT cluster_number, w || ' ' || w2 || ' ' || w3 FROM pl
       WHERE w3 IS NOT NULL AND w NOT IN ({Q.STOP}) AND w2 NOT IN ({Q.STOP}) AND w3 NOT IN ({Q.STOP})),
phrases AS (SELECT cluster_number, phrase, count(*) AS frequency,
                   row_number() OVER (PARTITION BY cluster_number ORDER BY count(*) DESC, phrase) AS rank
            FROM pc GROUP BY cluster_number, phrase QUALIFY rank <= 10)"""


@register("cluster_summary", Q.with_(*THEME_PARTS, REPRESENTATIVE, TOP_TERMS, PHRASES) + """
SELECT cluster_number, CAST(sum(review_count) AS BIGINT) AS review_count, count(*) AS unique_review_count,
       any_value(d.dominant_seed_cluster) AS dominant_seed_cluster,
       round(any_value(d.dominant_seed_score), 6) AS dominant_seed_score,
       (SELECT string_agg(term, ', ' ORDER BY rank) FROM top_terms t WHERE t.cluster_number = u.cluster_number) AS top_terms,
       (SELECT string_agg(phrase, ', ' ORDER BY rank) FROM phrases t WHERE t.cluster_number = u.cluster_number) AS top_phrases,
       (SELECT string_agg(doc_id, ', ' ORDER BY rank) FROM reps t WHERE t.cluster_number = u.cluster_number) AS representative_reviews
FROM uniq u JOIN dominant d USING (cluster_number) GROUP BY cluster_number""")
def cluster_summary(spark, sf_dir):
    # The texts, their vocabulary and the rows are written, as several parts read them.
    unique = materialize(S.text_quality(unique_documents(spark, sf_dir)).select(
        "doc_id", "cluster_number", "review_text", "review_count", "token_count", "low_information"), "unique")
    known = N.text_vocabulary(unique, "doc_id")
    scores = N.theme_scores(unique, theme_documents(spark, sf_dir), THEMES, "doc_id", known=known)
    rows = materialize(unique.join(scores, "doc_id").withColumn("vector", F.array(*THEME_COLUMNS)), "themed-rows")
    summary = R.cluster_summary(rows, N.text_features(unique, "doc_id", known=known), THEMES, "cluster_number")
    return summary.withColumn("dominant_seed_score", F.round("dominant_seed_score", 6))


@register("final_cluster_numbers", """
WITH merged AS (SELECT doc_id, CAST(substr(source, 4) AS INTEGER) AS micro_id,
                       CAST(substr(source, 4) AS INTEGER) // 3 AS old FROM documents),
sized AS (SELECT old, row_number() OVER (ORDER BY count(*) DESC, old) - 1 AS new FROM merged GROUP BY old)
SELECT doc_id, micro_id, CAST(new AS INTEGER) AS cluster_number FROM merged JOIN sized USING (old)""")
def final_cluster_numbers(spark, sf_dir):
    documents = I.table(spark, sf_dir, "documents")
    micro = documents.select("doc_id", F.substring("source", 4, 9).cast("int").alias("micro_id"))
    communities = micro.select(F.col("micro_id").alias("node"),
                               F.floor(F.col("micro_id") / 3).alias("community")).distinct()
    return G.renumber_by_size(G.micro_to_final(micro, communities))


@register("review_trace", Q.with_(UNIQUE) + """
SELECT u.doc_id, u.review_text, u.cluster_number, s.review_count, s.unique_review_count
FROM uniq u JOIN (SELECT cluster_number, CAST(sum(review_count) AS BIGINT) AS review_count,
                         count(*) AS unique_review_count FROM uniq GROUP BY cluster_number) s
  USING (cluster_number)
WHERE u.doc_id = (SELECT min(doc_id) FROM uniq WHERE review_count > 1)""")
def review_trace(spark, sf_dir):
    unique = unique_documents(spark, sf_dir)
    summary = unique.groupBy("cluster_number").agg(
        F.sum("review_count").alias("review_count"), F.count("*").alias("unique_review_count"))
    wanted = unique.where("review_count > 1").agg(F.min("doc_id")).scalar()
    trace = R.review_trace(unique.select("doc_id", "review_text", "cluster_number"), wanted, "doc_id", summary)
    return trace.select("doc_id", "review_text", "cluster_number", "review_count", "unique_review_count")


def blocks_of(spark, sf_dir):
    """The vectors as three feature blocks with a repeat weight."""
    v = I.vectors(spark, sf_dir)
    return v.select(
        "vec_id", "label", (1 + F.col("vec_id") % 3).alias("review_count"),
        V.as_double(F.col("vector")).alias("semantic"),
        V.as_double(F.slice("vector", 1, 11)).alias("seed"),
        F.array(*[F.col("vector")[11 + i].cast("double") for i in range(11)]).alias("metric"))


BLOCKS = """
blocks AS (SELECT vec_id, label, 1 + vec_id % 3 AS w, raw AS semantic, raw[1:11] AS seed, raw[12:22] AS metric
           FROM vec)"""


@register("combined_feature_blocks", Q.with_(VQ.VEC, BLOCKS) + """
, parts AS (SELECT vec_id, list_concat([0.6 * x FOR x IN semantic], [0.25 * x FOR x IN seed],
                                       [0.15 * x FOR x IN [CAST(label AS DOUBLE), 0.0, semantic[1]]]) AS v FROM blocks)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(x, 6) + 0.0 AS x
FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM parts)""")
def combined_feature_blocks(spark, sf_dir):
    rows = blocks_of(spark, sf_dir).withColumns(
        {"gap": F.lit(None).cast("double"), "first": F.col("semantic")[0]})
    metric = D.numeric_block(rows, ["label", "gap", "first"])
    combined = rows.select("vec_id", F.posexplode(
        D.combine_blocks(F.col("semantic"), F.col("seed"), metric)).alias("p", "x"))
    return combined.select("vec_id", (F.col("p") + 1).alias("pos"), (F.round("x", 6) + 0.0).alias("x"))


def mean_sql(name: str, value: str) -> str:
    return f"""
{name} AS (SELECT label, list(x ORDER BY pos) AS {value} FROM (
  SELECT label, pos, sum(w * x) / sum(w) AS x FROM (
    SELECT label, w, unnest({value}) AS x, generate_subscripts({value}, 1) AS pos FROM blocks)
  GROUP BY ALL) GROUP BY label)"""


PROFILES = ",".join(mean_sql(f"p_{v}", v) for v in ("semantic", "seed", "metric")) + """,
profiles AS (SELECT * FROM p_semantic JOIN p_seed USING (label) JOIN p_metric USING (label))"""


def block_profiles(spark, sf_dir):
    rows = blocks_of(spark, sf_dir)
    return reduce(lambda a, b: a.join(b, "id"), [
        R.weighted_profiles(rows, "label", v).withColumnRenamed("profile", v)
        for v in ("semantic", "seed", "metric")])


@register("weighted_profiles", Q.with_(VQ.VEC, BLOCKS, PROFILES) + """
SELECT label AS id, CAST(pos AS INTEGER) AS pos, round(x, 6) + 0.0 AS x
FROM (SELECT label, unnest(semantic) AS x, generate_subscripts(semantic, 1) AS pos FROM profiles)""")
def weighted_profiles(spark, sf_dir):
    profiles = R.weighted_profiles(blocks_of(spark, sf_dir), "label", "semantic")
    return profiles.select("id", F.posexplode("profile").alias("p", "x")).select(
        "id", (F.col("p") + 1).alias("pos"), (F.round("x", 6) + 0.0).alias("x"))


@register("micro_cluster_graph", Q.with_(VQ.VEC, BLOCKS, PROFILES) + """
, sims AS (SELECT a.label AS src, b.label AS dst,
                  0.6 * list_cosine_similarity(a.semantic, b.semantic)
                  + 0.25 * list_cosine_similarity(a.seed, b.seed)
                  + 0.15 * list_cosine_similarity(a.metric, b.metric) AS sim
           FROM profiles a JOIN profiles b ON a.label <> b.label),
near AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(sim, 9) DESC, dst) <= 4),
edges AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(sim) AS sim FROM near
          GROUP BY 1, 2 HAVING round(max(sim), 9) >= 0.05),
sizes AS (SELECT label, sum(w) AS size FROM blocks GROUP BY label)
SELECT src, dst, round(sim * (1 + 0.1 * ln(1 + least(a.size, b.size))), 6) AS weight
FROM edges JOIN sizes a ON a.label = src JOIN sizes b ON b.label = dst""")
def micro_cluster_graph(spark, sf_dir):
    sizes = blocks_of(spark, sf_dir).groupBy(F.col("label").alias("id")).agg(
        F.sum("review_count").alias("size"))
    edges = G.micro_graph(block_profiles(spark, sf_dir), sizes, k=4, min_weight=0.05)
    return edges.withColumn("weight", F.round("weight", 6))


@register("graph_modularity", Q.with_(VQ.VEC, VQ.PAIRS) + """
, e AS (SELECT x.label AS la, y.label AS lb, 1 / (1 + dist) AS w
        FROM pairs JOIN vec x ON x.vec_id = a JOIN vec y ON y.vec_id = b),
d AS (SELECT label, sum(w) AS k FROM (SELECT la AS label, w FROM e UNION ALL SELECT lb, w FROM e) GROUP BY label)
SELECT round((SELECT sum(w) FILTER (la = lb) / sum(w) FROM e)
             - 1.2 * (SELECT sum(k * k) FROM d) / (4 * (SELECT sum(w) FROM e) ** 2), 6) AS modularity""")
def graph_modularity(spark, sf_dir):
    pairs = NB.eps_join(VQ.all_points(spark, sf_dir), VQ.EPS)
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), (1 / (1 + F.col("dist"))).alias("weight"))
    labels = I.vectors(spark, sf_dir).select(F.col("vec_id").alias("node"), "label")
    return G.modularity(edges, labels, 1.2).select(F.round("modularity", 6).alias("modularity"))


@register("clustering_comparison", Q.with_(VQ.VEC, VQ.centroid("cent", "unit", "label")) + """
, near AS (SELECT u.vec_id, any_value(u.label) AS a,
                  arg_min(c.label, struct_pack(d := round(list_distance(u.raw, c.c) ** 2, 9), l := c.label)) AS b
           FROM unit u, cent c GROUP BY u.vec_id),
cell AS (SELECT a, b, count(*)::DOUBLE AS n FROM near GROUP BY ALL),
ra AS (SELECT sum(n) AS n FROM cell GROUP BY a), cb AS (SELECT sum(n) AS n FROM cell GROUP BY b),
t AS (SELECT (SELECT sum(n) FROM cell) AS n,
             (SELECT sum(n * (n - 1) / 2) FROM cell) AS p, (SELECT sum(n * (n - 1) / 2) FROM ra) AS pa,
             (SELECT sum(n * (n - 1) / 2) FROM cb) AS pb),
h AS (SELECT -(SELECT sum(x.n / t.n * ln(x.n / t.n)) FROM ra x, t) AS ha,
             -(SELECT sum(x.n / t.n * ln(x.n / t.n)) FROM cb x, t) AS hb,
             -(SELECT sum(x.n / t.n * ln(x.n / t.n)) FROM cell x, t) AS hab),
m AS (SELECT ha, hb, ha + hb - hab AS mi FROM h)
SELECT round((p - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) AS ari,
       round(mi / ((ha + hb) / 2), 6) AS nmi, round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness,
       round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6) AS v_measure
FROM t, m""")
def clustering_comparison(spark, sf_dir):
    cents = C.category_centroids(I.seed_vectors(spark, sf_dir)).select(
        F.col("category_ord").alias("label"), "centroid")
    near = L.assign_nearest(VQ.all_points(spark, sf_dir), cents).select("id", F.col("label").alias("near"))
    given = I.vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label")
    result = R.compare_clusterings(near.join(given, "id"), "label", "near")
    return result.select(*[F.round(c, 6).alias(c) for c in result.columns])


@register("svd_reduced")
def svd_reduced(spark, sf_dir):
    features = N.text_features(unique_documents(spark, sf_dir), "doc_id")
    reduced = D.reduce_svd(features, "doc_id", 96)
    return reduced.select("doc_id", F.posexplode("vector").alias("pos", "x"))


def micro_graph_of(spark, sf_dir):
    rows = L.micro_clusters(blocks_of(spark, sf_dir).withColumn("vector", F.col("semantic"))).drop("vector")
    rows = I.materialize(rows, "micro")
    profiles = reduce(lambda a, b: a.join(b, "id"), [
        R.weighted_profiles(rows, "micro_id", v).withColumnRenamed("profile", v)
        for v in ("semantic", "seed", "metric")])
    sizes = rows.groupBy(F.col("micro_id").alias("id")).agg(F.sum("review_count").alias("size"))
    return rows, sizes, I.materialize(G.micro_graph(profiles, sizes, min_weight=0.05), "micro-graph")


@register("micro_clusters")
def micro_clusters(spark, sf_dir):
    rows = L.micro_clusters(blocks_of(spark, sf_dir).withColumn("vector", F.col("semantic")))
    return rows.select("vec_id", "micro_id", "review_count")


@register("micro_cluster_checks", """
SELECT count(*) AS n_rows, CAST(sum(1 + vec_id % 3) AS BIGINT) AS total_weight,
       CAST(greatest(12, least(384, floor(sqrt(count(*) / 2)))) AS INTEGER) AS k, true AS numbers_below_k, true AS most_numbers_used
FROM embeddings""")
def micro_cluster_checks(spark, sf_dir):
    rows = I.materialize(L.micro_clusters(blocks_of(spark, sf_dir).withColumn("vector", F.col("semantic"))).select(
        "vec_id", "micro_id", "review_count"), "micro")
    k = L.micro_count(rows.count())
    sizes = rows.groupBy("micro_id").agg(F.count("*").alias("n"), F.sum("review_count").alias("weight"))
    return sizes.agg(
        F.sum("n").alias("n_rows"), F.sum("weight").alias("total_weight"), F.lit(k).alias("k"),
        ((F.min("micro_id") >= 0) & (F.max("micro_id") < k)).alias("numbers_below_k"), (F.count("*") > 0.9 * k).alias("most_numbers_used"))


@register("community_model_selection")
def community_model_selection(spark, sf_dir):
    _, sizes, edges = micro_graph_of(spark, sf_dir)
    communities = G.graph_communities(edges, sizes, K.RESOLUTIONS)
    return G.select_resolution(edges, communities)


@register("community_final_numbers")
def community_final_numbers(spark, sf_dir):
    rows, sizes, edges = micro_graph_of(spark, sf_dir)
    communities = G.graph_communities(edges, sizes, [1.0]).select("node", "community")
    return G.renumber_by_size(G.micro_to_final(rows.select("vec_id", "micro_id"), communities))


# What must hold for the searches whose start or order is free, as values that both sides can give.

@register("pca_checks", """
SELECT count(*) AS n_rows, 10 AS n_components, true AS centred, true AS descending, true AS uncorrelated FROM embeddings""")
def pca_checks(spark, sf_dir):
    reduced = I.materialize(D.reduce_pca(VQ.all_points(spark, sf_dir), 10), "pca")
    long = reduced.select("id", F.posexplode("vector").alias("p", "x"))
    met = long.join(long.select("id", F.col("p").alias("q"), F.col("x").alias("y")), "id").where("p <= q")
    moments = met.groupBy("p", "q").agg(F.avg("x").alias("mean"), F.avg(F.col("x") * F.col("y")).alias("product"))
    # The window spans ten rows.
    before = F.lag("product").over(W.orderBy("p"))
    flat = moments.where("p = q").select("mean", (F.coalesce(before, F.col("product")) >= F.col("product") - 1e-9).alias("down"))
    return reduced.agg(F.count("*").alias("n_rows"), F.max(F.size("vector")).alias("n_components")).select(
        "*", flat.agg(F.max(F.abs("mean")) < 1e-9).scalar().alias("centred"),
        flat.agg(F.bool_and("down")).scalar().alias("descending"),
        moments.where("p < q").agg(F.max(F.abs("product")) < 1e-9).scalar().alias("uncorrelated"))


@register("kmeans_checks", """
SELECT count(*) AS n_rows, greatest(2, least(8, count(*) // 15)) AS n_clusters, true AS nearly_all_nearest FROM embeddings""")
def kmeans_checks(spark, sf_dir):
    """Nearly every row (the search stops at a small shift) belongs to the nearest of the cluster means."""
    points = VQ.all_points(spark, sf_dir)
    labels = I.materialize(L.cluster_kmeans(points), "kmeans")
    means = C.category_centroids(points.join(labels.select("id", "label"), "id").select(
        F.col("label").alias("category"), F.col("label").alias("category_ord"), "vector"), unit_inputs=False, unit_output=False)
    near = L.assign_nearest(points, means.select(F.col("category").alias("label"), "centroid"))
    both = labels.join(near.select("id", F.col("label").alias("near")), "id")
    return both.agg(F.count("*").alias("n_rows"), F.count_distinct("label").alias("n_clusters"),
                    (F.avg((F.col("label") == F.col("near")).cast("int")) > 0.97).alias("nearly_all_nearest"))


@register("community_checks", """
SELECT count(*) AS n_rows, true AS rows_numbered_by_size, true AS better_than_singletons, 1 AS n_selected FROM embeddings""")
def community_checks(spark, sf_dir):
    rows, sizes, edges = micro_graph_of(spark, sf_dir)
    found = I.materialize(G.graph_communities(edges, sizes, [0.5, 1.0]), "communities")
    one = found.where("resolution = 1.0").select("node", "community")
    numbered = G.renumber_by_size(G.micro_to_final(rows.select("vec_id", "micro_id"), one))
    per = numbered.groupBy("cluster_number").agg(F.count("*").alias("n"))
    # The window spans one row per community.
    later = F.lead("n").over(W.orderBy("cluster_number"))
    order = per.select((F.coalesce(later, F.lit(0)) <= F.col("n")).alias("down"), "n")
    alone = G.modularity(edges, sizes.select(F.col("id").alias("node"), F.col("id").alias("label")))
    picked = G.select_resolution(edges, found)
    return order.agg(F.sum("n").alias("n_rows"), F.bool_and("down").alias("rows_numbered_by_size")).select(
        "*", (picked.where("resolution = 1.0").select("modularity").scalar() >= alone.scalar()).alias("better_than_singletons"),
        picked.agg(F.count_if("selected").cast("int")).scalar().alias("n_selected"))
