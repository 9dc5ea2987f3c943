"""Registered queries over the text side, each with its oracle statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom import constants as K
from reviewloom.catalog import inputs as I
from reviewloom.catalog import sql as Q
from reviewloom.functions import text as T
from reviewloom.operators import scoring as C
from reviewloom.operators import segments as S
from reviewloom.operators import terms as N
from reviewloom.plans import stages as P
from reviewloom.session import materialize

QUERIES = {}
ORACLE = {}


def register(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function
    return add


def rounded_scores(df: DataFrame, digits: int = 6) -> list:
    return [F.round(f"score_{c}", digits).alias(f"score_{c}") for c in K.CATEGORIES]


SEGMENT_COLUMNS = ["review_id", "source_row_id", "platform", "source_side", "sentiment_side", "side",
                   "company", "rating", "location", "review_text"]


@register("side_share_report", Q.with_(Q.SEGMENTS, Q.KEYWORDS, Q.SEEDS, Q.TFIDF, Q.LABELLED) + """
SELECT split_part(side, '_', 2) AS platform_code, side, classification, count(*) AS n_rows,
       round(count(*) / sum(count(*)) OVER (PARTITION BY side), 6) AS share
FROM labelled GROUP BY side, classification""")
def side_share_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_score_label(I.segments(spark, sf_dir), I.corpus_seeds(spark, sf_dir))


@register("split_segments", Q.with_(Q.SEGMENTS) + f"SELECT {', '.join(SEGMENT_COLUMNS)} FROM segments")
def split_segments(spark, sf_dir):
    return I.segments(spark, sf_dir).select(*SEGMENT_COLUMNS)


@register("keywords_top_2500", Q.with_(Q.SEGMENTS, Q.KEYWORDS) + "SELECT * FROM keywords")
def keywords_top_2500(spark, sf_dir):
    return N.keyword_table(I.segments(spark, sf_dir))


@register("tfidf_category_scores", Q.with_(Q.SEGMENTS, Q.KEYWORDS, Q.SEEDS, Q.TFIDF, Q.LABELLED) + f"""
SELECT side, review_id, {', '.join(f'round({c}, 6) AS {c}' for c in Q.SCORE_COLUMNS)},
       primary_category, round(primary_category_score, 6) AS primary_category_score,
       round(hr_score, 6) AS hr_score, classification, 0.1::DOUBLE AS classification_threshold_used,
       'tfidf' AS classification_backend
FROM labelled""")
def tfidf_category_scores(spark, sf_dir):
    scores = C.tfidf_scores(I.segments(spark, sf_dir), I.corpus_seeds(spark, sf_dir))
    labelled = C.label_scores(scores, "tfidf")
    return labelled.select(
        "side", "review_id", *rounded_scores(labelled), "primary_category",
        F.round("primary_category_score", 6).alias("primary_category_score"),
        F.round("hr_score", 6).alias("hr_score"), "classification",
        "classification_threshold_used", "classification_backend")


@register("ngram_counts", Q.with_(Q.SEGMENTS, Q.grams("g", "segments", "review_id", "review_text")) + """
SELECT review_id, CAST(ngram_len AS INTEGER) AS ngram_len, count(*) AS n, count(DISTINCT term) AS n_distinct,
       max(term) AS last_term
FROM g GROUP BY ALL""")
def ngram_counts(spark, sf_dir):
    # One row per text and length holds its distinct n-grams, so nothing is grouped across rows.
    lists = N.document_terms(I.segments(spark, sf_dir), "review_id", "review_text", 1, 3)
    return lists.select("review_id", "ngram_len", F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"),
                        F.size("terms").cast("long").alias("n_distinct"), F.array_max("terms").alias("last_term"))


@register("tfidf_weights", Q.with_(Q.SEGMENTS, Q.grams("g", "segments", "side, review_id", "review_text")) + """
, tf AS (SELECT side, review_id, term, count(*) AS tf FROM g GROUP BY ALL),
df AS (SELECT side, term, count(*) AS df FROM tf GROUP BY ALL),
n AS (SELECT side, count(*) AS n FROM segments GROUP BY side),
raw AS (SELECT side, review_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS raw
        FROM tf JOIN df USING (side, term) JOIN n USING (side)),
w AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY side, review_id)) AS weight FROM raw)
SELECT side, review_id, count(*) AS n_terms, round(sum(weight), 4) AS sum_weight,
       round(max(weight), 6) AS max_weight
FROM w GROUP BY ALL""")
def tfidf_weights(spark, sf_dir):
    weights = N.tfidf(I.segments(spark, sf_dir))
    return weights.groupBy("side", "review_id").agg(
        F.count("*").alias("n_terms"), F.round(F.sum("weight"), 4).alias("sum_weight"),
        F.round(F.max("weight"), 6).alias("max_weight"))


URLS_OUT = ("trim(regexp_replace(regexp_replace(regexp_replace(translate(text, chr(10) || chr(9), '  '), "
            f"'http[^{Q.SPACE[1:-1]}]+|www[^{Q.SPACE[1:-1]}]+', ' ', 'g'), "
            f"'[^a-zA-Z{Q.SPACE[1:-1]}]', ' ', 'g'), '{Q.SPACE}+', ' ', 'g'), ' ')")


@register("text_cleaning", f"""
SELECT doc_id, md5({Q.clean('text')}) AS clean_md5, {Q.normalize('text')} AS normalized,
       md5(lower({URLS_OUT})) AS letters_md5,
       md5(regexp_replace(coalesce(text, ''), '^{Q.SPACE}+|{Q.SPACE}+$', '', 'g')) AS stripped_md5
FROM documents""")
def text_cleaning(spark, sf_dir):
    c = F.col("text")
    return I.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(T.clean_text(c)).alias("clean_md5"), T.normalize_for_nlp(c).alias("normalized"),
        F.md5(T.strip_urls_alpha(c)).alias("letters_md5"), F.md5(T.fill_strip(c)).alias("stripped_md5"))


@register("unique_terms", Q.with_(Q.SEGMENTS) + f"""
SELECT lower({Q.clean('review_text')}) AS keyword, min(review_id) AS first_at
FROM segments WHERE length({Q.clean('review_text')}) > 0 GROUP BY 1""")
def unique_terms(spark, sf_dir):
    from reviewloom.sources.seeds import unique_terms as unique

    return unique(I.segments(spark, sf_dir), "review_text", "review_id")


@register("standard_columns", Q.with_(Q.SEGMENTS) + """
SELECT platform, source_row_id, company, rating, location, CAST(NULL AS VARCHAR) AS job_title,
       positive_text IS NOT NULL AS has_positive, length(negative_text) AS negative_length
FROM raw_rows""")
def standard_columns(spark, sf_dir):
    rows = S.union_sides(S.standardize_columns(I.raw_a(spark, sf_dir), "glassdoor"),
                         S.standardize_columns(I.raw_b(spark, sf_dir), "ambitionbox"))
    return rows.select("platform", "source_row_id", "company", "rating", "location", "job_title",
                       F.col("positive_text").isNotNull().alias("has_positive"),
                       F.length("negative_text").cast("long").alias("negative_length"))


@register("first_rows_of_each_source", """
SELECT 'a' AS raw, doc_id AS ordinal FROM documents WHERE doc_id < 100
UNION ALL SELECT 'b', conv_id * 1000 + turn FROM conversations
WHERE conv_id * 1000 + turn < 100000""")
def first_rows_of_each_source(spark, sf_dir):
    a = S.first_n(I.raw_a(spark, sf_dir), 100, "source_row_id")
    b = S.first_n(I.raw_b(spark, sf_dir), 100000, "source_row_id")
    return a.select(F.lit("a").alias("raw"), F.col("source_row_id").alias("ordinal")).unionByName(
        b.select(F.lit("b").alias("raw"), F.col("source_row_id").alias("ordinal")))


@register("text_versions_quality", Q.with_(Q.SEGMENTS) + f"""
SELECT review_id, {Q.collapse('review_text')} AS review_text_clean,
       md5(lower({Q.collapse('review_text')})) AS normalized_md5,
       CAST(len([w FOR w IN regexp_split_to_array(lower(review_text), '{Q.NOT_WORD}') IF length(w) >= 2]) AS INTEGER) AS token_count,
       CASE WHEN len([w FOR w IN regexp_split_to_array(lower(review_text), '{Q.NOT_WORD}')
                      IF length(w) >= 2 AND w NOT IN ({Q.STOP})]) < 3
            THEN 'low_information' ELSE 'ok' END AS segment_quality
FROM segments""")
def text_versions_quality(spark, sf_dir):
    rows = S.text_quality(S.text_versions(I.segments(spark, sf_dir)))
    return rows.select("review_id", "review_text_clean",
                       F.md5("review_text_normalized").alias("normalized_md5"), "token_count",
                       "segment_quality")


@register("collocations", Q.with_(Q.SEGMENTS) + f"""
, t AS (SELECT review_id, unnest(regexp_split_to_array(lower(review_text), '{Q.NOT_WORD}')) AS w,
               generate_subscripts(regexp_split_to_array(lower(review_text), '{Q.NOT_WORD}'), 1) AS pos
        FROM segments),
l AS (SELECT w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM t WHERE length(w) >= 2
      WINDOW o AS (PARTITION BY review_id ORDER BY pos)),
c AS (SELECT w || ' ' || w2 AS phrase, 2 AS ngram_len FROM l
      WHERE w2 IS NOT NULL AND w NOT IN ({Q.STOP}) AND w2 NOT IN ({Q.STOP})
      UNION ALL SELECT w || ' ' || w2 || ' ' || w3, 3 FROM l
      WHERE w3 IS NOT NULL AND w NOT IN ({Q.STOP}) AND w2 NOT IN ({Q.STOP}) AND w3 NOT IN ({Q.STOP}))
SELECT phrase, CAST(ngram_len AS INTEGER) AS ngram_len, count(*) AS frequency FROM c
GROUP BY ALL HAVING count(*) >= 3""")
def collocations(spark, sf_dir):
    return N.collocations(I.segments(spark, sf_dir))


# Words that occur in the given texts, next to the seed phrases, so that the rules have hits.
EXTRA_WORDS = [["the", "of the"], ["de", "de la"], ["and", "and the"], ["to", "to be"], ["in", "in the"],
               ["der", "und"], ["is", "it is"], ["that", "with"], ["que", "la"], ["for", "was"],
               ["le", "les"]]
FACTOR_PHRASES = {c: K.BASE_SEEDS[c] + extra for c, extra in zip(K.CATEGORIES, EXTRA_WORDS)}
HR_WORDS = K.HR_SIGNALS + ["this", "by the"]
PADDED = f"' ' || regexp_replace(lower(review_text), '{Q.NOT_WORD}', '  ', 'g') || ' '"


def sql_key(phrase: str) -> str:
    return f"(' ' || array_to_string(regexp_extract_all(lower('{phrase}'), '[a-z0-9_]+'), '  ') || ' ')"


def sql_hits(phrases: list[str]) -> str:
    return " + ".join(f"len(regexp_extract_all(p, {sql_key(x)}))" for x in phrases)


def sql_present(phrases: list[str]) -> str:
    return " + ".join(f"CAST(contains(p, {sql_key(x)}) AS INTEGER)" for x in phrases)


FACTORS = f"""
padded AS (SELECT side, review_id, {PADDED} AS p FROM segments),
hits AS (SELECT review_id, {', '.join(f"{sql_hits(p)} AS h{i}" for i, p in enumerate(FACTOR_PHRASES.values()))},
                {sql_hits(HR_WORDS)} AS hs, {sql_present(sum(FACTOR_PHRASES.values(), []))} AS overlap
         FROM padded),
tops AS (SELECT {', '.join(f'max(h{i}) AS m{i}' for i in range(11))}, max(hs) AS ms, max(overlap) AS mo FROM hits),
factors AS (SELECT review_id, overlap, {', '.join(f"coalesce(h{i}::DOUBLE / nullif(m{i}, 0), 0.0) AS r{i}" for i in range(11))},
                   coalesce(hs::DOUBLE / nullif(ms, 0), 0.0) AS rs, coalesce(overlap::DOUBLE / nullif(mo, 0), 0.0) AS ro
            FROM hits, tops)"""


@register("phrase_factor_scores", Q.with_(Q.SEGMENTS, FACTORS) + f"""
SELECT review_id, {', '.join(f'round(r{i}, 6) AS regex_{c}' for i, c in enumerate(K.CATEGORIES))} FROM factors""")
def phrase_factor_scores(spark, sf_dir):
    scored = C.regex_factor_score(I.segments(spark, sf_dir), FACTOR_PHRASES)
    return scored.select("review_id", *[F.round(f"regex_{c}", 6).alias(f"regex_{c}") for c in K.CATEGORIES])


@register("phrase_overlap", Q.with_(Q.SEGMENTS, FACTORS) +
          "SELECT review_id, CAST(overlap AS INTEGER) AS phrase_overlap FROM factors")
def phrase_overlap(spark, sf_dir):
    return C.phrase_overlap(I.segments(spark, sf_dir), sum(FACTOR_PHRASES.values(), []))


@register("hybrid_factor_scores", Q.with_(Q.SEGMENTS, Q.KEYWORDS, Q.SEEDS, Q.TFIDF, FACTORS) + f"""
SELECT review_id, {', '.join(f'round(0.6 * r{i} + 0.4 * score_{c}, 6) AS factor_{c}' for i, c in enumerate(K.CATEGORIES))}
FROM factors JOIN wide USING (review_id)""")
def hybrid_factor_scores(spark, sf_dir):
    segments = I.stored_segments(spark, sf_dir)
    both = C.tfidf_scores(segments, I.corpus_seeds(spark, sf_dir, segments), stored=True).join(
        C.regex_factor_score(segments, FACTOR_PHRASES), "review_id")
    return both.select("review_id", *[
        F.round(C.hybrid_score(F.col(f"regex_{c}"), F.col(f"score_{c}")), 6).alias(f"factor_{c}")
        for c in K.CATEGORIES])


@register("hr_rule_scores", Q.with_(Q.SEGMENTS, Q.KEYWORDS, Q.SEEDS, Q.TFIDF, Q.LABELLED, FACTORS) + """
, scored AS (SELECT review_id, 0.35 * rs + 0.25 * ro + 0.4 * hr_score AS s
             FROM factors JOIN labelled USING (review_id)),
conf AS (SELECT *, greatest(least(greatest(s, 0), 1), 1 - least(greatest(s, 0), 1)) AS confidence FROM scored)
SELECT review_id, round(s, 6) AS hr_rule_score, round(confidence, 6) AS confidence,
       round(confidence, 9) >= 0.7 AS confident, round(confidence, 9) BETWEEN 0.4 AND 0.7 AS borderline
FROM conf""")
def hr_rule_scores(spark, sf_dir):
    segments = I.stored_segments(spark, sf_dir)
    labelled = C.label_scores(C.tfidf_scores(segments, I.corpus_seeds(spark, sf_dir, segments), stored=True), "tfidf")
    scored = C.hr_rule_score(segments, labelled, sum(FACTOR_PHRASES.values(), []), HR_WORDS)
    conf = scored.withColumn("confidence", S.hr_confidence(F.col("hr_rule_score")))
    return conf.select(
        "review_id", F.round("hr_rule_score", 6).alias("hr_rule_score"),
        F.round("confidence", 6).alias("confidence"),
        S.is_confident(F.col("confidence")).alias("confident"),
        S.is_borderline(F.col("confidence")).alias("borderline"))


@register("keep_one_side", """
SELECT conv_id, turn, text AS "Likes" FROM conversations
WHERE role <> 'assistant' AND length(trim(text)) > 0""")
def keep_one_side(spark, sf_dir):
    raw = I.raw_b(spark, sf_dir)
    kept = S.keep_side(raw, "Likes", "Dislikes")
    return kept.select(F.floor(F.col("source_row_id") / 1000).alias("conv_id"),
                       (F.col("source_row_id") % 1000).alias("turn"), "Likes")


@register("non_hr_groups", Q.with_(Q.SEGMENTS, Q.KEYWORDS, Q.SEEDS, Q.TFIDF, Q.LABELLED) + """
, given AS (SELECT s.review_id, s.side, s.sentiment_side,
                   coalesce(nullif(trim(CASE WHEN s.rating = 1 THEN ' HR ' WHEN s.rating = 0 THEN '' END), ''),
                            l.classification) AS classification
            FROM segments s JOIN labelled l USING (review_id)),
kept AS (SELECT * FROM given WHERE lower(trim(classification)) = 'non hr')
SELECT 'four_source_groups' AS mode, side AS group_key, count(*) AS n_rows FROM kept GROUP BY side
UNION ALL SELECT 'sentiment_side_groups', sentiment_side || '_all', count(*) FROM kept GROUP BY sentiment_side
UNION ALL SELECT 'full_unified_group', 'all', count(*) FROM kept""")
def non_hr_groups(spark, sf_dir):
    segments = I.segments(spark, sf_dir)
    labelled = C.label_scores(C.tfidf_scores(segments, I.corpus_seeds(spark, sf_dir)), "tfidf")
    given = F.when(F.col("rating") == 1, " HR ").when(F.col("rating") == 0, "")
    rows = segments.join(labelled.select("review_id", F.col("classification").alias("computed")), "review_id")
    rows = rows.select("side", "sentiment_side", S.existing_label_first(given, F.col("computed")).alias("classification"))
    kept = S.non_hr_loose(rows)
    # All three groupings from one pass over the scores: they read its few counts.
    counts = materialize(kept.groupBy("side", "sentiment_side").agg(F.count("*").alias("n")), "side-counts")
    modes = [S.group_mode(counts, m)
             .groupBy("group_key").agg(F.sum("n").alias("n_rows")).select(F.lit(m).alias("mode"), "group_key", "n_rows")
             for m in ("four_source_groups", "sentiment_side_groups", "full_unified_group")]
    return S.union_sides(*modes)


@register("side_report_rollup", Q.with_(Q.SEGMENTS, Q.KEYWORDS, Q.SEEDS, Q.TFIDF, Q.LABELLED) + """
SELECT CASE WHEN side LIKE '%gd' THEN 'glassdoor' ELSE 'ambitionbox' END AS platform, side, classification,
       count(*) AS n_rows
FROM labelled GROUP BY ROLLUP (1, 2, 3)""")
def side_report_rollup(spark, sf_dir):
    from reviewloom.operators import report as R

    labelled = C.label_scores(C.tfidf_scores(I.segments(spark, sf_dir), I.corpus_seeds(spark, sf_dir)), "tfidf")
    platform = F.when(F.col("side").endswith("gd"), "glassdoor").otherwise("ambitionbox")
    return R.side_report(labelled.withColumn("platform", platform))


@register("unprocessed_rows", """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def unprocessed_rows(spark, sf_dir):
    done = I.table(spark, sf_dir, "labels")
    return S.unprocessed(I.table(spark, sf_dir, "documents").select("doc_id", "lang"), done, "doc_id")


@register("seed_round_trip", Q.with_(Q.SEGMENTS, Q.KEYWORDS, Q.SEEDS) + """
SELECT category, category_ord, term,
       CAST(row_number() OVER (PARTITION BY category ORDER BY score DESC, term) - 1 AS INTEGER) AS term_ord, score
FROM seeds""")
def seed_round_trip(spark, sf_dir):
    from reviewloom.sources import seeds as J

    back = J.parse_seed(J.seed_payload(I.corpus_seeds(spark, sf_dir)))
    return back.select("category", "category_ord", "term", "term_ord", "score")


@register("non_hr_strict", """
SELECT doc_id, CASE WHEN quality = 1 THEN 'Non HR' WHEN toxic = 1 THEN ' non hr ' ELSE 'HR' END AS classification
FROM labels WHERE quality = 1""")
def non_hr_strict(spark, sf_dir):
    """Only the plain spelling passes, whatever its case; a padded one does not."""
    given = F.when(F.col("quality") == 1, "Non HR").when(F.col("toxic") == 1, " non hr ").otherwise("HR")
    return S.non_hr(I.table(spark, sf_dir, "labels").select("doc_id", given.alias("classification")))


@register("score_columns", """
SELECT doc_id, nullif(CASE WHEN toxic = 1 THEN 'HR' ELSE '' END, '') AS "Classification", quality::DOUBLE AS justice,
       CAST(NULL AS DOUBLE) AS job_satisfaction FROM labels""")
def score_columns(spark, sf_dir):
    rows = I.table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "HR").otherwise("").alias("Classification"),
        F.col("quality").cast("double").alias("justice"))
    return S.ensure_score_columns(rows).select("doc_id", "Classification", "justice", "job_satisfaction")


TAGS = ["NOUN", "VERB", "DET", "ADJ", "PROPN", "ADP"]


@register("token_filter_texts", f"""
WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS lemma, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents)
SELECT doc_id, md5(coalesce(string_agg(lower(lemma), ' ' ORDER BY pos) FILTER (
         length(lemma) % 6 IN ({', '.join(str(i) for i, t in enumerate(TAGS) if t not in ('DET', 'ADP'))})
         AND lemma NOT LIKE '%.' AND length(lemma) <> 7 AND length(lemma) >= 3), '')) AS processed_md5
FROM t GROUP BY doc_id""")
def token_filter_texts(spark, sf_dir):
    """Words of the documents with tags dealt out by length, in place of an annotated token table."""
    words = I.text_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("pos", "lemma"))
    names = F.array(*[F.lit(t) for t in TAGS])
    tokens = words.select("doc_id", "pos", "lemma", F.get(names, F.length("lemma") % 6).alias("pos_tag"),
                          (F.length("lemma") == 7).alias("is_stop"), F.col("lemma").endswith(".").alias("is_punct"))
    return S.token_filter(tokens).select("doc_id", F.md5("processed_text").alias("processed_md5"))


FIVE = [*K.CATEGORIES[2:6], "food"]
FIVE_TFIDF = Q.TFIDF.replace("count(*) + 11", f"count(*) + {len(FIVE)}").replace("FROM seeds)", "FROM five)")


@register("five_category_scores", Q.with_(Q.SEGMENTS, Q.KEYWORDS, Q.SEEDS, f"""
five AS (SELECT CASE WHEN category = '{K.CATEGORIES[6]}' THEN 'food' ELSE category END AS category, term, term_ord, score
         FROM seeds WHERE category IN ({', '.join(f"'{c}'" for c in K.CATEGORIES[2:7])}))""", FIVE_TFIDF) + f"""
SELECT s.review_id, {', '.join(f"round(coalesce(max(score) FILTER (category = '{c}'), 0.0), 6) AS score_{c}" for c in FIVE)}
FROM segments s LEFT JOIN sims USING (side, review_id) GROUP BY s.review_id""")
def five_category_scores(spark, sf_dir):
    """A dictionary of five categories, one of them not in the default list: names and order are its own."""
    seeds = I.corpus_seeds(spark, sf_dir).where(F.col("category").isin(K.CATEGORIES[2:7])).withColumn(
        "category", F.when(F.col("category") == K.CATEGORIES[6], "food").otherwise(F.col("category")))
    scored = C.tfidf_scores(I.segments(spark, sf_dir), seeds)
    return scored.select("review_id", *[F.round(f"score_{c}", 6).alias(f"score_{c}") for c in FIVE])


@register("confidence_filters", Q.with_(Q.SEGMENTS, Q.KEYWORDS, Q.SEEDS, Q.TFIDF, Q.LABELLED, FACTORS) + """
, scored AS (SELECT 0.35 * rs + 0.25 * ro + 0.4 * hr_score AS s FROM factors JOIN labelled USING (review_id)),
conf AS (SELECT round(greatest(least(greatest(s, 0), 1), 1 - least(greatest(s, 0), 1)), 9) AS c FROM scored)
SELECT 'confident' AS rows_kept, count(*) FILTER (c >= 0.7) AS n FROM conf
UNION ALL SELECT 'borderline', count(*) FILTER (c BETWEEN 0.4 AND 0.7) FROM conf""")
def confidence_filters(spark, sf_dir):
    segments = I.stored_segments(spark, sf_dir)
    labelled = C.label_scores(C.tfidf_scores(segments, I.corpus_seeds(spark, sf_dir, segments), stored=True), "tfidf")
    scored = C.hr_rule_score(segments, labelled, sum(FACTOR_PHRASES.values(), []), HR_WORDS)
    # Written, so that both filters read one pass of scoring.
    conf = materialize(scored.select(S.hr_confidence(F.col("hr_rule_score")).alias("classification_confidence")), "confidences")
    kept = {"confident": S.confidence_filter(conf), "borderline": S.borderline_queue(conf)}
    return S.union_sides(*[df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rows_kept"), "n") for name, df in kept.items()])
