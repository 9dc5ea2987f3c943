"""n-grams, keyword tables and TF-IDF weights as relational plans.

A text is one row, so everything that belongs to one document is decided by partitioning the texts
by document id once. After that the per-document counts need no further exchange: the shuffle moves
raw text, not the several times larger n-gram rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom import constants as K
from reviewloom.functions import text as T
from reviewloom.operators import counts as X
from reviewloom.session import materialize


def by_document(df: DataFrame, doc: str, *columns: str) -> DataFrame:
    """Only the needed columns, hash-partitioned by document id.

    The partition count is fixed at ``spark.sql.shuffle.partitions``: adaptive coalescing judges by
    bytes of text, and n-grams make about ten times as many bytes of it.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(doc, *columns).repartition(count, doc)


def ngrams(df: DataFrame, text: str = "review_text", lo: int = 1, hi: int = 3,
           stop_words: list[str] | None = None, bridge: bool = True,
           keep_empty: bool = False) -> DataFrame:
    """One row per n-gram occurrence, with ``term`` and ``ngram_len`` in place of the text.

    Stop words go first, so n-grams bridge the gaps they leave; with ``bridge=False`` only words
    that were neighbours in the text form an n-gram. ``keep_empty`` keeps one row with a null term
    for a text without any word. No shuffle and no per-row Python.
    """
    stop_words = K.english_stop_words() if stop_words is None else stop_words
    keys = [c for c in df.columns if c != text]
    if bridge:
        first = T.content_words(F.col(text), stop_words)
    else:
        # A stop word stays in place as an empty string and later voids the n-grams it is part of.
        first = F.transform(T.words(F.col(text)), lambda w: F.when(~w.isin(stop_words), w).otherwise(""))
    token_rows = df.select(*keys, first.alias("w1"))
    shifted = token_rows.select("*", *[
        F.slice("w1", i, F.size("w1")).alias(f"w{i}") for i in range(2, hi + 1)])
    zipped = F.arrays_zip(*[F.col(f"w{i}") for i in range(1, hi + 1)])
    generate = F.inline_outer if keep_empty else F.inline
    windows = shifted.select(*keys, generate(zipped))
    grams = []
    for n in range(lo, hi + 1):
        parts = [F.col(f"w{i}") for i in range(1, n + 1)]
        whole = F.col(f"w{n}").isNotNull()
        if not bridge:
            for part in parts:
                whole = whole & (part != "")
        # Every row passes on its first n-gram even when null, so keep_empty rows survive.
        grams.append(F.struct(
            F.when(whole, F.concat_ws(" ", *parts)).alias("term"), F.lit(n).alias("ngram_len")))
    rows = windows.select(*keys, F.inline(F.array(*grams)))
    if keep_empty:
        return rows.where(F.col("term").isNotNull() | (F.col("ngram_len") == lo))
    return rows.where(F.col("term").isNotNull())


def term_counts(grams: DataFrame, *keys: str) -> DataFrame:
    """Occurrences of each term per document."""
    return grams.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def document_terms(texts: DataFrame, doc: str, text: str, lo: int = 1, hi: int = 3, stop_words: list[str] | None = None) -> DataFrame:
    """``(doc, ngram_len, terms, tf)``: the distinct n-grams of every document (the rows of one id) and their counts."""
    stop_words = K.english_stop_words() if stop_words is None else stop_words
    return X.term_lists(X.by_words(texts, [doc], T.content_words(F.col(text), stop_words), text), lo, hi)


def keyword_table(texts: DataFrame, doc: str = "review_id", text: str = "review_text",
                  min_df: int = K.KEYWORD_MIN_DF, max_features: int = K.KEYWORD_MAX_FEATURES,
                  ngram_max: int = K.KEYWORD_NGRAM_MAX, stop_words: list[str] | None = None,
                  normalize: bool = True, preprocessing: str = "basic_regex_stopword") -> DataFrame:
    """The ``max_features`` most frequent n-grams found in at least ``min_df`` documents.

    When no n-gram reaches ``min_df`` the floor is 1. That is settled on the kept rows alone: those
    that reach the floor sort first, so either all kept rows that count reach it or none exists.
    """
    body = T.normalize_for_nlp(F.col(text)) if normalize else F.col(text)
    stop_words = K.english_stop_words() if stop_words is None else stop_words
    words = X.by_words(texts, [doc], T.content_words(body, stop_words), text)
    stats = X.term_totals(words, 1, ngram_max, frequent_words(words, min_df, max_features)).withColumnRenamed("total", "frequency")
    reached = F.col("df") >= min_df
    kept = (stats.withColumn("reached", reached)
            .orderBy(F.desc("reached"), F.desc("frequency"), F.asc("term")).limit(max_features))
    # The window spans the at most max_features rows of the limit, already in one partition.
    any_reached = F.max("reached").over(W.partitionBy())
    return (kept.withColumn("any_reached", any_reached)
            .where(F.col("reached") == F.col("any_reached"))
            .select(F.col("term").alias("keyword"),
                    F.col("frequency").cast("int").alias("frequency"),
                    F.col("ngram_len").cast("int").alias("ngram_len"),
                    F.lit(preprocessing).alias("preprocessing"),
                    F.when(F.col("reached"), min_df).otherwise(1).alias("min_df_used"))
            .orderBy(F.desc("frequency"), F.asc("keyword")))


#: Words that are looked up in the tasks; with more of them nothing is left out.
KNOWN_WORDS = 65_536


def frequent_words(words: DataFrame, min_df: int, max_features: int, most: Column | None = None) -> list[str] | None:
    """The only words that the ``max_features`` most frequent n-grams can hold, or null if that is not settled.

    An n-gram is no more frequent than its words, nor in more documents. So with ``max_features`` words that reach ``min_df``
    (and are in no more documents than ``most``), no n-gram is kept that holds a word rarer than all of these.
    """
    reached = materialize(X.term_totals(words, 1, 1).where(F.col("df") >= min_df).select("term", "total", "df"), "words")
    listed = reached if most is None else reached.where(F.col("df") <= most)
    top = listed.orderBy(F.desc("total")).limit(max_features).agg(F.count("*").alias("n"), F.min("total").alias("least")).first()
    if top["n"] < max_features:
        return None
    known = reached.where(F.col("total") >= top["least"]).select("term").limit(KNOWN_WORDS + 1).collect()
    return [r["term"] for r in known] if len(known) <= KNOWN_WORDS else None


def collocations(texts: DataFrame, doc: str = "review_id", text: str = "review_text",
                 sizes: tuple[int, int] = (2, 3), min_frequency: int = 3,
                 stop_words: list[str] | None = None) -> DataFrame:
    """Pairs and triples of neighbouring content words that occur often enough."""
    source = texts.select(doc, F.col(text).alias("text"))
    grams = ngrams(source, "text", sizes[0], sizes[1], stop_words, bridge=False)
    return (grams.groupBy("term", "ngram_len").agg(F.count("*").alias("frequency"))
            .where(F.col("frequency") >= min_frequency)
            .select(F.col("term").alias("phrase"), F.col("ngram_len").cast("int").alias("ngram_len"),
                    "frequency"))


def smooth_idf(n_docs: Column, df: Column) -> Column:
    """``ln((1 + N) / (1 + df)) + 1``."""
    return F.log((1 + n_docs) / (1 + df)) + 1


def keyed_group(df: DataFrame, group: str) -> DataFrame:
    """The group column as a one-field struct, so that null is a group like any other in every join."""
    return df.withColumn(group, F.struct(F.col(group).alias("value")))


def plain_group(group: str) -> Column:
    return F.col(f"{group}.value").alias(group)


def tfidf(texts: DataFrame, group: str = "side", doc: str = "review_id",
          text: str = "review_text", ngram_max: int = 3,
          stop_words: list[str] | None = None) -> DataFrame:
    """Unit-length TF-IDF weights, fitted per group: ``(group, doc, term, weight)``.

    The groups are those of the texts; a null one is a group too. Blocks of documents are weighted where their words are,
    with the frequencies that come back to them (:func:`counts.frequencies`).
    """
    stop_words = K.english_stop_words() if stop_words is None else stop_words
    blocks = X.in_blocks(texts, group, doc, text, T.content_words(F.col(text), stop_words))
    # One row per group.
    sizes = {r[group]: r["n"] for r in texts.groupBy(group).agg(F.count("*").alias("n")).collect()}

    def give(block: X.Block, dfs) -> pa.Table:
        n_docs, squares, parts = np.array([sizes[g] for g in block.groups], float), np.zeros(len(block.first)), []
        for n in range(1, ngram_max + 1):
            own, number, tf = block.counts(n)
            raw = tf * (np.log((1 + n_docs[block.group[own]]) / (1 + dfs(n, own, number))) + 1)
            squares += np.bincount(own, raw * raw, len(squares))
            parts.append((n, own, number, raw))
        length = np.sqrt(squares)
        return pa.concat_tables([pa.table([
            *block.rows(own), block.terms(n).take(pa.array(number)), pa.array(raw / length[own])],
            names=[group, doc, "term", "weight"]) for n, own, number, raw in parts])

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in (group, doc))
    return X.weigh(blocks, ngram_max, give, f"{kinds}, term string, weight double")


def unit_weights(raw: DataFrame, keys: list[str], *extra: str) -> DataFrame:
    """Divide ``raw`` by its Euclidean length per document; column ``weight``.

    A document's rows are its own vocabulary, so the window frame is bounded by one text.
    """
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(*keys)))
    return raw.select(*keys, "term", (F.col("raw") / length).alias("weight"), *extra)


def feature_stop_words() -> list[str]:
    """The English stop list without its negations."""
    return [w for w in K.english_stop_words() if w not in ("no", "not", "nor")]


def feature_words(texts: DataFrame, doc: str, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """``(doc, words)`` with accents stripped and negation kept."""
    stop_words = feature_stop_words() if stop_words is None else stop_words
    return X.by_words(texts, [doc], T.content_words(T.strip_accents(F.col(text)), stop_words), text)


def vocabulary(totals: DataFrame, n_docs: Column, max_features: int = 15000, max_df: float = 0.92,
               min_df: int = 5) -> DataFrame:
    """The most frequent terms within the document-frequency limits: (term, df, idf).

    ``totals``: term, total, df. At most ``max_features`` rows, so users of this table broadcast it.
    """
    return (totals.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
            .orderBy(F.desc("total"), F.asc("term")).limit(max_features)
            .select("term", "df", smooth_idf(n_docs, F.col("df")).alias("idf")))


def sublinear_weights(tf: DataFrame, words: DataFrame, doc: str) -> DataFrame:
    """Unit-length ``(1 + ln tf) * idf`` of the vocabulary terms: (doc, term, weight, df)."""
    raw = tf.join(F.broadcast(words), "term").select(
        doc, "term", "df", ((1 + F.log(F.col("tf"))) * F.col("idf")).alias("raw"))
    return unit_weights(raw, [doc], "df")


def text_features(texts: DataFrame, doc: str = "review_id", text: str = "review_text",
                  max_features: int = 15000, ngram_max: int = 2, max_df: float = 0.92,
                  min_df: int = 5, stop_words: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Sublinear TF-IDF over the capped vocabulary: (doc, term, weight, df).

    The texts, which are read once for every pass, are written once. Only totals of terms are shuffled by term. The vocabulary is settled first, as a table of its own; then each
    document meets it where its words are, and gives its weights alone. ``known``: the vocabulary, where it was settled before (:func:`text_vocabulary`).
    """
    if known is None:
        texts = materialize(texts.select(doc, text), "texts")
    words = feature_words(texts, doc, text, stop_words)
    known = feature_vocabulary(texts, words, max_features, ngram_max, max_df, min_df) if known is None else known
    return X.sublinear_rows(words, X.lexicon_of(known, "idf", "df"), ngram_max)


def text_vocabulary(texts: DataFrame, doc: str = "review_id", text: str = "review_text", max_features: int = 15000, max_df: float = 0.92,
                    min_df: int = 5) -> DataFrame:
    """The vocabulary of :func:`text_features` and :func:`theme_scores` for these texts, which are a table of files: (term, df, idf)."""
    return feature_vocabulary(texts, feature_words(texts, doc, text), max_features, 2, max_df, min_df)


def feature_vocabulary(texts: DataFrame, words: DataFrame, max_features: int, ngram_max: int, max_df: float, min_df: int) -> DataFrame:
    n_docs = texts.agg(F.count("*").alias("n")).scalar()
    known = frequent_words(words, min_df, max_features, max_df * n_docs)
    return materialize(vocabulary(X.term_totals(words, 1, ngram_max, known), n_docs, max_features, max_df, min_df), "vocabulary")


def theme_scores(texts: DataFrame, themes: DataFrame, names: list[str], doc: str = "review_id",
                 text: str = "review_text", max_features: int = 15000, max_df: float = 0.92,
                 min_df: int = 5, known: DataFrame | None = None) -> DataFrame:
    """Cosine of every text to every seed theme in the feature space: (doc, theme_*...).

    ``themes``: category, text. The theme weights are one array per vocabulary term, so all themes are scored where the
    words of a document are, which gives one row. ``known`` is as in :func:`text_features`.
    """
    if known is None:
        texts = materialize(texts.select(doc, text), "texts")
    words = feature_words(texts, doc, text)
    known = feature_vocabulary(texts, words, max_features, 2, max_df, min_df) if known is None else known
    theme_source = themes.select("category", T.strip_accents(F.col("text")).alias("text"))
    theme_tf = term_counts(ngrams(theme_source, "text", 1, 2, feature_stop_words()), "category")
    theme_weights = sublinear_weights(theme_tf, known, "category").groupBy("term").agg(F.array(*[
        F.coalesce(F.sum(F.when(F.col("category") == c, F.col("weight"))), F.lit(0.0)) for c in names
    ]).alias("themes"))
    # A document without a vocabulary term stays, at zero.
    lexicon = known.join(theme_weights, "term", "left").withColumn("themes", F.coalesce("themes", F.array(*[F.lit(0.0) for _ in names])))
    scored = X.theme_rows(words, X.lexicon_of(lexicon, "idf", "themes"), 2, len(names))
    return scored.select(doc, *[F.col("themes")[i].alias(f"theme_{c}") for i, c in enumerate(names)])
