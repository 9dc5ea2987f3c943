"""Shared pieces of the oracle statements."""

from __future__ import annotations

from reviewloom import constants as K

# The same character classes as the Spark side, in RE2 spelling.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
NOT_WORD = r"[^\p{L}\p{N}_]+"


def strings(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


STOP = strings(K.english_stop_words())


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'), ' ')"


def clean(x: str) -> str:
    return f"CASE WHEN lower({x}) IN ('nan', 'none', 'null') THEN '' ELSE {collapse(x)} END"


def normalize(x: str) -> str:
    return f"trim(regexp_replace(lower({clean(x)}), '[^a-z0-9-]+', ' ', 'g'), ' ')"


SEGMENTS = f"""
raw_rows AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS source_row_id, 'glassdoor' AS platform, d.source AS company,
         CAST(l.quality AS DOUBLE) AS rating, d.lang AS location,
         split_part(d.text, chr(10), 1) AS positive_text,
         CASE WHEN strpos(d.text, chr(10)) > 0
              THEN substr(d.text, strpos(d.text, chr(10)) + 1) END AS negative_text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  UNION ALL
  SELECT CAST(conv_id * 1000 + turn AS VARCHAR), 'ambitionbox', role, CAST(NULL AS DOUBLE), NULL,
         CASE WHEN role <> 'assistant' THEN text END, CASE WHEN role = 'assistant' THEN text END
  FROM conversations),
sided AS (
  SELECT *, 'positive' AS sentiment_side, positive_text AS raw_text FROM raw_rows
  UNION ALL SELECT *, 'negative', negative_text FROM raw_rows),
named AS (
  SELECT *, CASE platform || sentiment_side WHEN 'glassdoorpositive' THEN 'Pros'
              WHEN 'glassdoornegative' THEN 'Cons' WHEN 'ambitionboxpositive' THEN 'Likes'
              ELSE 'Dislikes' END AS source_side,
         {clean('raw_text')} AS review_text
  FROM sided),
segments AS (
  SELECT CASE platform WHEN 'glassdoor' THEN 'gd_' ELSE 'am_' END || source_row_id || '_'
           || lower(source_side) AS review_id,
         source_row_id, platform, source_side, sentiment_side,
         lower(source_side) || CASE platform WHEN 'glassdoor' THEN '_gd' ELSE '_am' END AS side,
         company, rating, location, review_text
  FROM named WHERE length(review_text) > 0)"""


def grams(name: str, source: str, keys: str, text: str, hi: int = 3, lo: int = 1,
          stop: str = STOP) -> str:
    """CTEs ending in ``name`` (keys, term, ngram_len): one row per n-gram occurrence."""
    leads = ", ".join(
        f"lead(w, {i}) OVER (PARTITION BY {keys} ORDER BY pos) AS w{i + 1}" for i in range(1, hi))
    pieces = []
    for n in range(lo, hi + 1):
        term = " || ' ' || ".join(["w"] + [f"w{i}" for i in range(2, n + 1)])
        last = "w" if n == 1 else f"w{n}"
        pieces.append(f"SELECT {keys}, {term} AS term, {n} AS ngram_len FROM {name}_l "
                      f"WHERE {last} IS NOT NULL")
    return f"""
{name}_t AS (
  SELECT {keys}, unnest(regexp_split_to_array(lower({text}), '{NOT_WORD}')) AS w,
         generate_subscripts(regexp_split_to_array(lower({text}), '{NOT_WORD}'), 1) AS pos
  FROM {source}),
{name}_l AS (
  SELECT {keys}, w{', ' + leads if leads else ''} FROM {name}_t
  WHERE length(w) >= 2 AND w NOT IN ({stop})),
{name} AS ({' UNION ALL '.join(pieces)})"""


KEYWORDS = f"""
keyword_texts AS (SELECT review_id, {normalize('review_text')} AS body FROM segments),
{grams('kg', 'keyword_texts', 'review_id', 'body')},
keyword_stats AS (
  SELECT term, ngram_len, sum(tf) AS frequency, count(*) AS df
  FROM (SELECT review_id, term, ngram_len, count(*) AS tf FROM kg GROUP BY ALL) GROUP BY ALL),
keyword_floor AS (SELECT CASE WHEN max(df) >= 2 THEN 2 ELSE 1 END AS f FROM keyword_stats),
keywords AS (
  SELECT term AS keyword, CAST(frequency AS INTEGER) AS frequency,
         CAST(ngram_len AS INTEGER) AS ngram_len, 'basic_regex_stopword' AS preprocessing,
         CAST(f AS INTEGER) AS min_df_used
  FROM keyword_stats, keyword_floor WHERE df >= f
  ORDER BY frequency DESC, term LIMIT 2500)"""

CATEGORY_LIST = "[" + strings(K.CATEGORIES) + "]"

SEEDS = f"""
ranked AS (
  SELECT keyword, row_number() OVER (ORDER BY frequency DESC, keyword) - 1 AS rank
  FROM (SELECT * FROM keywords WHERE ngram_len = 1 ORDER BY frequency DESC, keyword LIMIT 44)),
seeds AS (
  SELECT {CATEGORY_LIST}[CAST(rank % 11 + 1 AS INTEGER)] AS category,
         CAST(rank % 11 AS INTEGER) AS category_ord, keyword AS term,
         CAST(rank // 11 AS INTEGER) AS term_ord, round(1 - 0.1 * (rank // 11), 4) AS score
  FROM ranked)"""

# Repeat counts: 5 * score lands on 5, 4.5, 4, 3.5; half to even gives 5, 4, 4, 4.
TFIDF = f"""
profile_words AS (
  SELECT category, term_ord, term,
         greatest(1, least(5, CAST(round_even(CAST(score * 5 AS DOUBLE), 0) AS INTEGER))) AS reps
  FROM seeds),
profile_docs AS (
  SELECT category, string_agg(repeat(term || ' ', reps), '' ORDER BY term_ord) AS body
  FROM profile_words GROUP BY category),
{grams('tg', 'segments', 'side, review_id', 'review_text')},
{grams('pg', 'profile_docs', 'category', 'body')},
doc_tf AS (SELECT side, review_id, term, count(*) AS tf FROM tg GROUP BY ALL),
prof_tf AS (SELECT side, category, term, count(*) AS tf
            FROM pg, (SELECT DISTINCT side FROM segments) GROUP BY ALL),
all_df AS (
  SELECT side, term, count(*) AS df
  FROM (SELECT side, term FROM doc_tf UNION ALL SELECT side, term FROM prof_tf) GROUP BY ALL),
corpus_n AS (SELECT side, count(*) + 11 AS n FROM segments GROUP BY side),
idf AS (SELECT side, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM all_df JOIN corpus_n USING (side)),
doc_w AS (SELECT side, review_id, term, tf * idf AS w FROM doc_tf JOIN idf USING (side, term)),
prof_w AS (SELECT side, category, term, tf * idf AS w FROM prof_tf JOIN idf USING (side, term)),
doc_len AS (SELECT side, review_id, sqrt(sum(w * w)) AS len FROM doc_w GROUP BY ALL),
prof_len AS (SELECT side, category, sqrt(sum(w * w)) AS len FROM prof_w GROUP BY ALL),
dots AS (
  SELECT d.side, d.review_id, p.category, sum(d.w * p.w) AS dot
  FROM doc_w d JOIN prof_w p ON p.side = d.side AND p.term = d.term GROUP BY ALL),
sims AS (
  SELECT side, review_id, category, dot / (dl.len * pl.len) AS score
  FROM dots JOIN doc_len dl USING (side, review_id) JOIN prof_len pl USING (side, category)),
wide AS (
  SELECT s.side, s.review_id,
         {', '.join(f"coalesce(max(score) FILTER (category = '{c}'), 0.0) AS score_{c}" for c in K.CATEGORIES)}
  FROM segments s LEFT JOIN sims USING (side, review_id) GROUP BY ALL)"""


def argmax(columns: list[str], names: list[str]) -> str:
    rounded = [f"round({c}, 9)" for c in columns]
    best = f"greatest({', '.join(rounded)})"
    whens = " ".join(f"WHEN {r} = {best} THEN '{n}'" for r, n in zip(rounded, names))
    return f"CASE {whens} END"


SCORE_COLUMNS = [f"score_{c}" for c in K.CATEGORIES]

LABELLED = f"""
labelled AS (
  SELECT *, {argmax(SCORE_COLUMNS, K.CATEGORIES)} AS primary_category,
         greatest({', '.join(SCORE_COLUMNS)}) AS primary_category_score,
         {' + '.join('score_' + c for c in K.HR_CATEGORIES)} AS hr_score,
         CASE WHEN round({' + '.join('score_' + c for c in K.HR_CATEGORIES)}, 9) >= 0.1
              THEN 'HR' ELSE 'Non HR' END AS classification
  FROM wide)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts) + "\n"
