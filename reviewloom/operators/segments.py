"""From raw two-sided review tables to one long table of text segments, and filters on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom import constants as K
from reviewloom.functions import text as T


def _column_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def standardize_columns(df: DataFrame, platform: str, row_id: str = "source_row_id") -> DataFrame:
    """Rename one platform's columns to the common schema; absent columns become null."""
    names = K.DIALECTS[platform]
    sides = [(column, sentiment) for _, (p, column, sentiment) in K.SIDES.items() if p == platform]
    kept = [_column_or_null(df, raw).cast("string").alias(common) for common, raw in names.items()]
    texts = [_column_or_null(df, column).cast("string").alias(f"{sentiment}_text")
             for column, sentiment in sides]
    return df.select(
        F.col(row_id).cast("string").alias("source_row_id"),
        F.lit(platform).alias("platform"),
        *kept,
        *texts,
    ).withColumn("rating", F.expr("try_cast(rating AS double)"))


def source_field(platform: Column, sentiment_side: Column) -> Column:
    """Name of the raw text column a segment came from."""
    first = platform == "glassdoor"
    positive = sentiment_side == "positive"
    return (F.when(first & positive, "Pros").when(first, "Cons")
            .when((platform == "ambitionbox") & positive, "Likes").otherwise("Dislikes"))


def side_name(platform: Column, sentiment_side: Column) -> Column:
    branches = [(F.lit(side), (platform == p) & (sentiment_side == s))
                for side, (p, _, s) in K.SIDES.items()]
    return reduce(lambda c, b: c.when(b[1], b[0]), branches[1:], F.when(branches[0][1], branches[0][0]))


def split_sides(standard: DataFrame, drop_empty: bool = True) -> DataFrame:
    """One row per review side with its cleaned text, from one pass over the table."""
    both = F.array(
        F.struct(F.lit("positive").alias("sentiment_side"), F.col("positive_text").alias("raw_text")),
        F.struct(F.lit("negative").alias("sentiment_side"), F.col("negative_text").alias("raw_text")),
    )
    rows = standard.select("source_row_id", "platform", *K.METADATA_COLUMNS, F.inline(both))
    field = source_field(F.col("platform"), F.col("sentiment_side"))
    prefix = F.when(F.col("platform") == "glassdoor", K.ID_PREFIX["glassdoor"]).otherwise(
        K.ID_PREFIX["ambitionbox"])
    segments = rows.select(
        F.concat_ws("_", prefix, "source_row_id", F.lower(field)).alias("review_id"),
        "source_row_id",
        "platform",
        field.alias("source_side"),
        "sentiment_side",
        side_name(F.col("platform"), F.col("sentiment_side")).alias("side"),
        *K.METADATA_COLUMNS,
        T.clean_text(F.col("raw_text")).alias("review_text"),
    )
    return drop_blank(segments) if drop_empty else segments


def union_sides(*segments: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), segments)


def review_segments(platform_a: DataFrame, platform_b: DataFrame) -> DataFrame:
    """Standardise, split and stack two raw platform tables that carry ``source_row_id``."""
    return union_sides(
        split_sides(standardize_columns(platform_a, "glassdoor")),
        split_sides(standardize_columns(platform_b, "ambitionbox")),
    )


def drop_blank(df: DataFrame, text: str = "review_text") -> DataFrame:
    return df.where(F.length(text) > 0)


def keep_side(df: DataFrame, keep: str, drop: str) -> DataFrame:
    """Rows whose ``keep`` text is not blank, without the ``drop`` column."""
    return df.where(F.length(T.fill_strip(F.col(keep))) > 0).drop(drop)


def first_n(df: DataFrame, n: int, order: str = "row_ordinal") -> DataFrame:
    """The first ``n`` rows by ordinal; 0 means all."""
    return df.where(F.col(order) < n) if n > 0 else df


def detect_text_column(df: DataFrame, candidates: list[str] | None = None) -> str:
    for name in candidates or K.TEXT_COLUMNS:
        if name in df.columns:
            return name
    raise ValueError(f"no review text column among {df.columns}")


def text_versions(df: DataFrame, text: str = "review_text") -> DataFrame:
    return df.withColumns({
        "review_text_original": F.col(text),
        "review_text_clean": T.collapse_spaces(F.coalesce(F.col(text), F.lit(""))),
        "review_text_normalized": T.normalize_for_dedup(F.col(text)),
    })


def text_quality(df: DataFrame, text: str = "review_text", stop_words: list[str] | None = None,
                 min_tokens: int = 3) -> DataFrame:
    """Token count and a low-information flag: fewer than ``min_tokens`` content words."""
    stop_words = stop_words or K.english_stop_words()
    words = F.size(T.words(F.coalesce(F.col(text), F.lit(""))))
    content = F.size(T.content_words(F.coalesce(F.col(text), F.lit("")), stop_words))
    return df.withColumns({
        "token_count": words,
        "content_token_count": content,
        "low_information": content < min_tokens,
        "segment_quality": F.when(content < min_tokens, "low_information").otherwise("ok"),
    })


def ensure_score_columns(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Add a missing ``Classification`` or category column as null; empty labels become null."""
    categories = categories or K.CATEGORIES
    label = (F.nullif(F.col("Classification"), F.lit("")) if "Classification" in df.columns
             else F.lit(None).cast("string"))
    added = {c: F.lit(None).cast("double") for c in categories if c not in df.columns}
    return df.withColumns({"Classification": label, **added})


def _require(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise ValueError(f"missing column {column}; have {df.columns}")


def non_hr(df: DataFrame, column: str = "classification") -> DataFrame:
    _require(df, column)
    return df.where(F.lower(F.col(column).cast("string")) == "non hr")


def non_hr_loose(df: DataFrame, column: str = "classification") -> DataFrame:
    _require(df, column)
    return df.where(F.lower(T.fill_strip(F.col(column).cast("string"))) == "non hr")


def hr_confidence(score: Column) -> Column:
    """``max(s, 1 - s)`` of the score clamped to 0..1."""
    s = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return F.greatest(s, 1 - s)


def is_confident(confidence: Column, minimum: float = 0.70) -> Column:
    return F.round(confidence, 9) >= minimum


def is_borderline(confidence: Column, low: float = 0.40, high: float = 0.70) -> Column:
    return F.round(confidence, 9).between(low, high)


def confidence_filter(df: DataFrame, minimum: float = 0.70,
                      column: str = "classification_confidence") -> DataFrame:
    return df.where(is_confident(F.col(column), minimum))


def borderline_queue(df: DataFrame, low: float = 0.40, high: float = 0.70,
                     column: str = "classification_confidence") -> DataFrame:
    return df.where(is_borderline(F.col(column), low, high))


def score_at_least(df: DataFrame, threshold: float = K.SEED_THRESHOLD, column: str = "score") -> DataFrame:
    return df.where(F.round(column, 9) >= threshold)


def existing_label_first(given: Column, computed: Column) -> Column:
    return F.coalesce(F.nullif(T.fill_strip(given), F.lit("")), computed)


def group_mode(df: DataFrame, mode: str = "four_source_groups") -> DataFrame:
    """Add ``group_key``: the side, the sentiment side across platforms, or one group."""
    keys = {
        "four_source_groups": F.col("side"),
        "sentiment_side_groups": F.concat(F.col("sentiment_side"), F.lit("_all")),
        "full_unified_group": F.lit("all"),
    }
    if mode not in keys:
        raise ValueError(f"unknown grouping mode {mode}")
    return df.withColumn("group_key", keys[mode])


def unprocessed(rows: DataFrame, done: DataFrame, key: str = "review_id") -> DataFrame:
    """Rows that are not labelled yet."""
    return rows.join(done.select(key), key, "left_anti")


def token_filter(tokens: DataFrame, entities: DataFrame | None = None, min_length: int = 3) -> DataFrame:
    """Re-join the useful lemmas of an annotated token table, then the entity texts, per document.

    ``tokens``: doc_id, pos, lemma, pos_tag, is_stop, is_punct. ``entities``: doc_id, ord, text.
    Every document of the token table is kept, with empty text when nothing qualifies.
    """
    useful = (F.col("pos_tag").isin("ADJ", "NOUN", "PROPN", "VERB") & ~F.col("is_stop")
              & ~F.col("is_punct") & (F.length("lemma") >= min_length))
    parts = tokens.select("doc_id", F.lit(0).alias("kind"), F.col("pos").cast("int").alias("at"),
                          F.when(useful, F.lower("lemma")).alias("word"))
    if entities is not None:
        long_enough = F.length("text") >= min_length
        parts = parts.unionByName(entities.select(
            "doc_id", F.lit(1).alias("kind"), F.col("ord").cast("int").alias("at"),
            F.when(long_enough, F.lower("text")).alias("word")))
    placed = F.when(F.col("word").isNotNull(), F.struct("kind", "at", "word"))
    return parts.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(placed)), lambda p: p["word"]), " ")
        .alias("processed_text"))
