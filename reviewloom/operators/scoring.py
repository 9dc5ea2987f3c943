"""Scores of texts against seed categories, and the labels that follow from them."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom import constants as K
from reviewloom.functions import text as T
from reviewloom.functions import vectors as V
from reviewloom.operators import counts as X
from reviewloom.operators import terms as N
from reviewloom.session import discard, materialize


def score_column(category: str) -> str:
    return f"score_{category}"


def profile_documents(seeds: DataFrame) -> DataFrame:
    """One text per category: each term as often as its weight says, in dictionary order.

    A term is repeated ``clamp(bround(5 * score), 1, 5)`` times; half rounds to even.
    """
    repeat = F.least(F.greatest(F.bround(F.col("score") * 5).cast("int"), F.lit(1)), F.lit(5))
    placed = seeds.select("category", F.struct(
        F.col("term_ord").alias("at"), F.array_repeat("term", repeat).alias("words")).alias("entry"))
    ordered = F.array_sort(F.collect_list("entry"))
    joined = F.array_join(F.flatten(F.transform(ordered, lambda e: e["words"])), " ")
    return placed.groupBy("category").agg(joined.alias("text"))


class TfidfModel(NamedTuple):
    """A fitted model as tables of terms. ``terms``: group, term, idf, counts (per category, null for words of texts alone);
    ``lengths``: group, one column per category with the length of its profile."""

    terms: DataFrame
    lengths: DataFrame
    categories: list[str]
    ngram_max: int = 3
    stop_words: list[str] | None = None


def text_terms(texts: DataFrame, group: str, doc: str, text: str, ngram_max: int,
               stop_words: list[str] | None) -> DataFrame:
    """Term counts per text; a text without words keeps one row with a null term."""
    stop_words = K.english_stop_words() if stop_words is None else stop_words
    words = X.by_words(texts, [group, doc], T.content_words(F.col(text), stop_words), text)
    return X.term_counts(words, 1, ngram_max, keep_empty=True).select(group, doc, "term", "tf")


def _hashed(df: DataFrame, group: str) -> DataFrame:
    """``term`` as a 64-bit hash of group and term; equality of hashes stands for equality. Null stays null."""
    return df.withColumn("term", F.when(F.col("term").isNotNull(), F.xxhash64(group, "term")))


def profile_terms(seeds: DataFrame, categories: list[str], ngram_max: int, stop_words: list[str] | None) -> DataFrame:
    """``(term, profile_df, counts)`` of the categories' profiles; ``counts``: one number per category."""
    profile_tf = N.term_counts(
        N.ngrams(profile_documents(seeds), "text", 1, ngram_max, stop_words), "category")
    return profile_tf.groupBy("term").agg(
        F.count("*").alias("profile_df"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("tf"))), F.lit(0))
                  .cast("double") for c in categories]).alias("counts"))


def _fit(keyed: DataFrame, tf: DataFrame, seeds: DataFrame, categories: list[str] | None, group: str, ngram_max: int,
         stop_words: list[str] | None) -> TfidfModel:
    profiled = dictionary_categories(seeds)
    categories = categories or profiled
    text_df = tf.where(F.col("term").isNotNull()).groupBy(group, "term").agg(
        F.count("*").alias("text_df"))
    profiles = profile_terms(seeds, categories, ngram_max, stop_words)
    # One row per group.
    sizes = keyed.groupBy(group).agg((F.count("*") + F.lit(len(profiled))).alias("n_docs"))
    everywhere = profiles.withColumn(group, F.explode(sizes.agg(F.collect_list(group)).scalar()))
    known = F.coalesce("text_df", F.lit(0)) + F.coalesce("profile_df", F.lit(0))
    idf = N.smooth_idf(F.col("n_docs"), known)
    terms = (text_df.join(everywhere, [group, "term"], "left").join(sizes, group)
             .select(group, "term", idf.alias("idf"), "counts"))
    weighted = (everywhere.join(text_df, [group, "term"], "left").join(sizes, group)
                .select(group, idf.alias("idf"), "counts"))
    lengths = weighted.groupBy(group).agg(*[
        F.sqrt(F.sum(F.pow(F.col("idf") * F.col("counts")[i], F.lit(2.0)))).alias(f"profile{i}")
        for i in range(len(categories))])
    return TfidfModel(terms, lengths, categories, ngram_max, stop_words)


def _scored(tf: DataFrame, model: TfidfModel, group: str, doc: str) -> DataFrame:
    weight = F.col("tf") * F.col("idf")
    dots = [F.sum(weight * F.col("idf") * F.col("counts")[i]).alias(f"dot{i}")
            for i in range(len(model.categories))]
    per_doc = tf.join(model.terms, [group, "term"], "left").groupBy(group, doc).agg(
        F.sqrt(F.sum(weight * weight)).alias("length"), *dots)
    scores = [F.coalesce(F.try_divide(F.col(f"dot{i}"), F.col("length") * F.col(f"profile{i}")),
                         F.lit(0.0)).alias(score_column(c))
              for i, c in enumerate(model.categories)]
    return per_doc.join(model.lengths, group, "left").select(N.plain_group(group), doc, *scores)


def tfidf_scores(texts: DataFrame, seeds: DataFrame, categories: list[str] | None = None,
                 group: str = "side", doc: str = "review_id",
                 text: str = "review_text", ngram_max: int = 3,
                 stop_words: list[str] | None = None, stored: bool = False) -> DataFrame:
    """TF-IDF cosine of every text to every category profile: ``(group, doc, score_*...)``.

    Categories come from the dictionary unless given. Document frequencies are fitted per group over
    its texts and the profiles; the groups are those of the texts, null being one. Texts are shuffled by document into
    blocks. A block sends its n-grams once, as hashes, to be counted, gets back the frequencies of those that other
    documents have too, and scores all categories where its words are. The profiles, as large as the dictionary, are
    sent to the tasks. A text without words keeps its row with zero scores. ``stored`` is as in :func:`counts.in_blocks`.
    """
    stops = K.english_stop_words() if stop_words is None else stop_words
    profiles, profiled = profiles_of(seeds, categories, ngram_max, stop_words)
    blocks = X.in_blocks(texts, group, doc, text, T.content_words(F.col(text), stops), stored)
    # One number per group, and one per group and term of the profiles.
    n_docs = {g: n + profiled for g, n in X.rows_of_groups(blocks).items()}
    listed = X.hashes_in_groups(list(n_docs), profiles.hashes)
    answers = materialize(X.packed_frequencies(blocks, ngram_max, listed=np.unique(listed)), "frequencies")
    lengths = profiles.lengths(n_docs, listed, X.listed_counts(answers))
    answers = answers.where(F.col("block") != X.NO_BLOCK)
    return _weighed(blocks, texts, profiles, n_docs, lengths, ngram_max, answers, False)


class Profiles(NamedTuple):
    """The terms of the categories' profiles by their hash, in order: in how many profiles, and how often in each."""

    hashes: np.ndarray
    df: np.ndarray
    counts: np.ndarray
    categories: list[str]

    def lengths(self, n_docs: dict, listed: np.ndarray, found: dict[int, int]) -> dict:
        """For each group the lengths of the profiles, from the documents of the group that ``listed`` hashes were found in."""
        out = {}
        for (g, n), hashes in zip(n_docs.items(), listed):
            df = self.df + np.array([found.get(int(h), 0) for h in hashes], float)
            out[g] = np.sqrt((((np.log((1 + n) / (1 + df)) + 1)[:, None] * self.counts) ** 2).sum(axis=0))
        return out


def profiles_of(seeds: DataFrame, categories: list[str] | None, ngram_max: int, stop_words: list[str] | None) -> tuple[Profiles, int]:
    """The profiles, and how many categories the dictionary has."""
    profiled = dictionary_categories(seeds)
    categories = categories or profiled
    return _by_hash(profile_terms(seeds, categories, ngram_max, stop_words).collect(), categories), len(profiled)


def _by_hash(rows: list, categories: list[str]) -> Profiles:
    hashes = X.term_hashes([r["term"].split(" ") for r in rows])
    order = np.argsort(hashes)
    return Profiles(hashes[order], np.array([r["profile_df"] for r in rows], float)[order],
                    np.array([r["counts"] for r in rows], float).reshape(len(rows), len(categories))[order], categories)


def _weighed(blocks: DataFrame, texts: DataFrame, profiles: Profiles, n_docs: dict, lengths: dict, ngram_max: int, answers: DataFrame,
             known_only: bool) -> DataFrame:
    """Scores of the texts of ``blocks`` by the frequencies that came back. With ``known_only`` an n-gram in none of the counted
    texts counts for nothing, nor does a text of a group that ``n_docs`` has not."""
    group, doc = blocks.columns[1:3]
    categories = profiles.categories

    def give(block: X.Block, dfs) -> pa.Table:
        many, sizes = len(block.first), np.array([n_docs.get(g, 0) for g in block.groups], float)
        squares, dots = np.zeros(many), np.zeros((many, len(categories)))
        for n in range(1, ngram_max + 1):
            own, number, tf = block.counts(n)
            df, at = dfs(n, own, number), X.found_at(block.hashes(n).view(np.int64), profiles.hashes)[number]
            counted = df > 0
            met = np.flatnonzero((at >= 0) & counted if known_only else at >= 0)
            df[met] += profiles.df[at[met]]
            idf = np.log((1 + sizes[block.group[own]]) / (1 + df)) + 1
            if known_only:
                idf[~counted] = 0
            squares += np.bincount(own, (tf * idf) ** 2, many)
            for i in range(len(categories)):
                dots[:, i] += np.bincount(own[met], tf[met] * idf[met] ** 2 * profiles.counts[at[met], i], many)
        none = np.zeros(len(categories))
        below = np.sqrt(squares)[:, None] * np.array([lengths.get(g, none) for g in block.groups])[block.group]
        scores = np.divide(dots, below, out=np.zeros_like(dots), where=below > 0)
        return pa.table([*block.rows(np.arange(many)), *(pa.array(scores[:, i]) for i in range(len(categories)))],
                        names=[group, doc, *map(score_column, categories)])

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in (group, doc))
    return X.weigh(blocks, ngram_max, give, kinds + "".join(f", `{score_column(c)}` double" for c in categories), answers)


class FrozenTfidf(NamedTuple):
    """A model that :func:`freeze_tfidf` wrote. ``terms``: the n-grams of the texts by their hashes and in how many texts of a group each
    is (:func:`counts.fitted_frequencies`); ``profiles``: term, profile_df, counts (per category); ``groups``: group, n_docs
    (its texts and the profiles), lengths (of the profiles, per category)."""

    terms: DataFrame
    profiles: DataFrame
    groups: DataFrame
    categories: list[str]
    ngram_max: int = 3
    stop_words: list[str] | None = None


def freeze_tfidf(texts: DataFrame, seeds: DataFrame, folder: str, categories: list[str] | None = None,
                 group: str = "side", doc: str = "review_id", text: str = "review_text", ngram_max: int = 3,
                 stop_words: list[str] | None = None, stored: bool = False) -> FrozenTfidf:
    """Fit on ``texts`` and write the model to ``folder``, so that other texts can be scored without their frequencies.

    Terms are written as 64-bit hashes of group and n-gram; equality of hashes stands for equality. ``stored`` is as in
    :func:`counts.in_blocks`.
    """
    spark = texts.sparkSession
    stops = K.english_stop_words() if stop_words is None else stop_words
    profiled = dictionary_categories(seeds)
    categories = categories or profiled
    profile_terms(seeds, categories, ngram_max, stop_words).coalesce(1).write.mode("overwrite").parquet(f"{folder}/profiles")
    profiles = _by_hash(spark.read.parquet(f"{folder}/profiles").collect(), categories)
    kept = texts.select(group, doc, text) if stored else materialize(texts.select(group, doc, text), "texts")
    blocks = X.in_blocks(kept, group, doc, text, T.content_words(F.col(text), stops), True)
    X.fitted_frequencies(blocks, ngram_max).write.mode("overwrite").parquet(f"{folder}/terms")
    n_docs = {g: n + len(profiled) for g, n in X.rows_of_groups(blocks).items()}
    if not stored:
        discard(kept)
    listed = X.hashes_in_groups(list(n_docs), profiles.hashes)
    lengths = profiles.lengths(n_docs, listed, X.fitted_counts(spark.read.parquet(f"{folder}/terms"), np.unique(listed)))
    kind = texts.schema[group].dataType.simpleString()
    spark.createDataFrame([(g, n, lengths[g].tolist()) for g, n in n_docs.items()], f"`{group}` {kind}, n_docs long, lengths array<double>"
                          ).coalesce(1).write.mode("overwrite").parquet(f"{folder}/groups")
    spark.createDataFrame(
        [(categories, ngram_max, stop_words)], "categories array<string>, ngram_max int, stop_words array<string>"
    ).coalesce(1).write.mode("overwrite").parquet(f"{folder}/about")
    return load_tfidf(spark, folder)


def load_tfidf(spark: SparkSession, folder: str) -> FrozenTfidf:
    """The model that :func:`freeze_tfidf` wrote."""
    about = spark.read.parquet(f"{folder}/about").first()
    return FrozenTfidf(*(spark.read.parquet(f"{folder}/{name}") for name in ("terms", "profiles", "groups")),
                       about["categories"], about["ngram_max"], about["stop_words"])


def frozen_tfidf_scores(texts: DataFrame, model: FrozenTfidf, group: str = "side", doc: str = "review_id",
                        text: str = "review_text", stored: bool = False) -> DataFrame:
    """Scores of texts by a fitted model: ``(group, doc, score_*...)``.

    Terms that the model does not know count for nothing, not even for a text's length; a text of a group that
    the model was not fitted on scores 0. Blocks of texts send their n-grams, as hashes, to the model's ranges, get back
    its frequencies and score where their words are. ``stored`` is as in :func:`counts.in_blocks`.
    """
    stops = K.english_stop_words() if model.stop_words is None else model.stop_words
    profiles = _by_hash(model.profiles.collect(), model.categories)
    # One row per group.
    about = model.groups.toArrow()
    groups = about.column(0).to_pylist()
    n_docs, lengths = (dict(zip(groups, about.column(k).to_pylist())) for k in ("n_docs", "lengths"))
    blocks = X.in_blocks(texts, group, doc, text, T.content_words(F.col(text), stops), stored)
    answers = X.answers_of(model.terms, blocks, model.ngram_max)
    return _weighed(blocks, texts, profiles, n_docs, lengths, model.ngram_max, answers, True)


def primary_category(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Best category and its score; the first category wins ties."""
    categories = categories or K.CATEGORIES
    scores = [F.col(score_column(c)) for c in categories]
    rounded = [F.round(s, 9) for s in scores]
    return df.withColumns({
        "primary_category": V.argmax_name(rounded, categories),
        "primary_category_score": F.greatest(*scores),
    })


def hr_label(df: DataFrame, threshold: float, backend: str, categories: list[str] | None = None,
             hr_categories: list[str] | None = None) -> DataFrame:
    """Sum of the HR category scores that exist, and the label at ``>= threshold``."""
    categories = categories or K.CATEGORIES
    present = [c for c in (hr_categories or K.HR_CATEGORIES) if c in categories]
    total = reduce(lambda a, b: a + b, [F.col(score_column(c)) for c in present], F.lit(0.0))
    return df.withColumn("hr_score", total).withColumns({
        "classification": F.when(F.round("hr_score", 9) >= threshold, "HR").otherwise("Non HR"),
        "classification_threshold_used": F.lit(threshold),
        "classification_backend": F.lit(backend),
    })


def label_scores(scores: DataFrame, backend: str, categories: list[str] | None = None,
                 threshold: float | None = None) -> DataFrame:
    if threshold is None:
        threshold = K.TFIDF_THRESHOLD if backend == "tfidf" else K.EMBEDDING_THRESHOLD
    return hr_label(primary_category(scores, categories), threshold, backend, categories)


def label_evidence(labelled: DataFrame, given: str | None = None) -> DataFrame:
    """``labelled`` with ``classification_confidence``, ``classification_method`` and ``classification_reason``.

    A label given in column ``given`` goes first, with confidence 1 and method ``existing``; the others keep their computed label, with
    the larger of the clamped HR score and what it lacks to 1, and the backend as method. The reason names the sum and
    threshold, and the best category if it scored at all.
    """
    existing = F.nullif(T.fill_strip(F.col(given).cast("string")), F.lit("")) if given else F.lit(None).cast("string")
    score = F.least(F.greatest(F.col("hr_score"), F.lit(0.0)), F.lit(1.0))
    above = F.when(F.round("hr_score", 9) >= F.col("classification_threshold_used"), ">=").otherwise("<")
    best = F.when(F.col("primary_category_score") > 0, F.concat(F.lit(", best category "), "primary_category")).otherwise(F.lit(""))
    computed = F.concat(F.format_string("hr_score %.4f ", "hr_score"), above,
                        F.format_string(" %.2f", "classification_threshold_used"), best)
    return labelled.withColumns({
        "classification": F.coalesce(existing, "classification"),
        "classification_confidence": F.when(existing.isNotNull(), F.lit(1.0)).otherwise(F.greatest(score, 1 - score)),
        "classification_method": F.when(existing.isNotNull(), F.lit("existing")).otherwise(F.col("classification_backend")),
        "classification_reason": F.when(existing.isNotNull(), F.lit("given with the row")).otherwise(computed)})


def category_centroids(seed_vectors: DataFrame, weighted: bool = False, unit_inputs: bool = True,
                       unit_output: bool = True) -> DataFrame:
    """Mean vector per category: ``(category, category_ord, centroid)``.

    ``seed_vectors``: category, category_ord, vector and, when weighted, score.
    """
    vector = V.l2_normalize(F.col("vector")) if unit_inputs else V.as_double(F.col("vector"))
    weight = F.col("score") if weighted else F.lit(1.0)
    mean = Summarizer.mean(array_to_vector(vector), weight.cast("double"))
    grouped = seed_vectors.groupBy("category", "category_ord").agg(
        vector_to_array(mean).alias("centroid"))
    if unit_output:
        grouped = grouped.withColumn("centroid", V.l2_normalize(F.col("centroid")))
    return grouped


def centroid_list(centroids: DataFrame, categories: list[str]) -> Column:
    """All centroids as one scalar, in category order; its size is that of the category list."""
    listed = centroids.where(F.col("category").isin(categories))
    return listed.agg(F.map_from_entries(F.collect_list(F.struct("category", "centroid")))
                      .alias("m")).scalar()


def embedding_scores(vectors: DataFrame, centroids: DataFrame, categories: list[str] | None = None,
                     doc: str = "review_id", vector: str = "vector") -> DataFrame:
    """Clamped cosine of every vector to every category centroid: ``(doc, score_*...)``.

    The centroids arrive as one scalar value, so this is a narrow map over the vectors.
    """
    categories = categories or K.CATEGORIES
    rows = vectors.select(doc, V.l2_normalize(F.col(vector)).alias("_unit"),
                          centroid_list(centroids, categories).alias("_centroids"))
    return rows.select(doc, *[
        F.coalesce(V.clamp0(V.dot(F.col("_unit"), F.element_at("_centroids", F.lit(c)))), F.lit(0.0))
        .alias(score_column(c)) for c in categories])


#: Terms of a dictionary that a task holds at once, and rows that meet a block of a larger dictionary there.
BLOCK_TERMS, BLOCK_ROWS = 4096, 4096


def older_scores(vectors: DataFrame, seed_vectors: DataFrame, categories: list[str] | None = None,
                 doc: str = "review_id", vector: str = "vector", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Best weighted similarity to any single seed term of each category, one column per category.

    A dictionary of up to ``block_terms`` terms is sent to the tasks and each Arrow batch is one matrix product
    per category. A larger one is cut into blocks that meet chunks of the rows, and the best of a row's blocks is
    taken afterwards; nothing is gathered then. A row without a vector scores 0. ``doc`` must be unique.
    """
    categories = categories or K.CATEGORIES
    entries = seed_vectors.where(F.col("category").isin(categories) & F.col("vector").isNotNull()).select(
        "category", "score", V.l2_normalize(F.col("vector")).alias("v"))
    few = entries.limit(block_terms + 1).collect()
    if len(few) > block_terms:
        return _blocked_older_scores(vectors, entries, categories, doc, vector, block_terms)
    blocks = _by_category([r["category"] for r in few], [r["v"] for r in few], [r["score"] for r in few], categories)

    @F.pandas_udf("array<double>")
    def best(batch: pd.Series) -> pd.Series:
        return pd.Series(list(np.nan_to_num(_best_terms(batch, blocks), nan=0.0)))

    scored = vectors.select(doc, best(vector).alias("_s"))
    return scored.select(doc, *[F.col("_s")[i].alias(c) for i, c in enumerate(categories)])


def _by_category(names, rows, weights, categories: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    names = np.asarray(names, dtype=object)
    out = []
    for c in categories:
        own = np.flatnonzero(names == c)
        out.append((np.array([rows[i] for i in own], dtype=float), np.array([weights[i] for i in own], dtype=float)))
    return out


def _best_terms(batch: pd.Series, blocks: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Best weighted cosine per row and category; nan where there is no vector or no term."""
    out = np.full((len(batch), len(blocks)), np.nan)
    known = np.flatnonzero(batch.notna().to_numpy())
    if len(known):
        x = np.stack(batch.iloc[known].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), V.TINY)
        for k, (m, w) in enumerate(blocks):
            if len(w):
                out[known, k] = ((x @ m.T) * w).max(axis=1)
    return out


def _blocked_older_scores(vectors: DataFrame, entries: DataFrame, categories: list[str], doc: str, vector: str,
                          block_terms: int) -> DataFrame:
    n_blocks = -(-entries.count() // block_terms)
    n_chunks = max(1, -(-vectors.count() // BLOCK_ROWS))
    kind = vectors.schema[doc].dataType.simpleString()
    terms = entries.select(
        "category", "score", "v", F.pmod(F.xxhash64("category", "score", "v"), F.lit(n_blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"))
    rows = vectors.select(
        F.col(doc).alias("doc"), F.col(vector).alias("vector"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
        F.pmod(F.xxhash64(doc), F.lit(n_chunks)).cast("int").alias("chunk"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        blocks = _by_category(right["category"].to_numpy(), right["v"].to_numpy(), right["score"].to_numpy(), categories)
        found = _best_terms(left["vector"], blocks)
        return pd.DataFrame({"doc": left["doc"], **{f"s{i}": found[:, i] for i in range(len(categories))}})

    schema = f"doc {kind}, " + ", ".join(f"s{i} double" for i in range(len(categories)))
    met = rows.groupBy("block", "chunk").cogroup(terms.groupBy("block", "chunk")).applyInPandas(best, schema)
    # No term of the category in the block: not a number, which must not win.
    return met.groupBy("doc").agg(*[F.coalesce(F.max(F.nanvl(f"s{i}", F.lit(None).cast("double"))), F.lit(0.0)).alias(c)
                                    for i, c in enumerate(categories)]).withColumnRenamed("doc", doc)


def older_label(scores: DataFrame, threshold: float = K.OLDER_THRESHOLD) -> DataFrame:
    """``HR`` when the two HR categories together exceed the threshold strictly."""
    present = [c for c in K.OLDER_HR_CATEGORIES if c in scores.columns]
    total = reduce(lambda a, b: a + b, [F.col(c) for c in present], F.lit(0.0))
    return scores.withColumn(
        "Classification", F.when(F.round(total, 9) > threshold, "HR").otherwise("Non HR"))


def attach_embeddings(df: DataFrame, embeddings: DataFrame | None = None, key: str = "review_id",
                      text: str = "review_text", encoder=None) -> DataFrame:
    """Add ``vector`` from a vector table keyed like ``df``, or from a caller's pandas UDF.

    Every row stays; one that the table does not hold gets a null vector.
    """
    if (embeddings is None) == (encoder is None):
        raise ValueError("give either a vector table or an encoder")
    if encoder is not None:
        return df.withColumn("vector", encoder(F.col(text)))
    return df.join(embeddings.select(key, "vector"), key, "left")


def dictionary_categories(seeds: DataFrame) -> list[str]:
    """The categories of a dictionary in its own order; one row per category is read."""
    rows = seeds.groupBy("category").agg(F.min("category_ord").alias("at")).orderBy("at", "category").collect()
    return [r["category"] for r in rows]


def classify(segments: DataFrame, seeds: DataFrame, backend: str = "auto",
             vectors: DataFrame | None = None, seed_vectors: DataFrame | None = None,
             categories: list[str] | None = None, stored: bool = False) -> DataFrame:
    """Segments with scores and labels. ``auto`` uses vectors when they are given, else TF-IDF.

    Categories, their names and order, come from the dictionary unless given. A segment without a
    vector scores 0 everywhere. ``stored`` is as in :func:`counts.in_blocks`.
    """
    categories = categories or dictionary_categories(seeds)
    if backend not in ("auto", "tfidf", "sentence_transformer"):
        raise ValueError(f"unsupported classification backend {backend}")
    if backend == "auto":
        backend = "tfidf" if vectors is None or seed_vectors is None else "sentence_transformer"
    if backend == "tfidf":
        scores = tfidf_scores(segments, seeds, categories, stored=stored).drop("side")
    else:
        if vectors is None or seed_vectors is None:
            raise ValueError("the embedding backend needs vectors and seed vectors")
        every = attach_embeddings(segments.select("review_id"), vectors)
        scores = embedding_scores(every, category_centroids(seed_vectors, weighted=True), categories)
    return segments.join(label_scores(scores, backend, categories), "review_id")


def phrase_matches(df: DataFrame, phrases: dict[str, list[str]], doc: str = "review_id",
                   text: str = "review_text") -> DataFrame:
    """``(doc, label, phrase, hits)`` for every listed phrase that occurs in a text, as whole words.

    Only where a word begins some phrase are the n-grams of the phrases' lengths built, and only those that are a phrase
    leave the text; the phrase list, which the caller holds, is part of the expression. Hits of one phrase do not overlap:
    where a phrase can overlap itself, they are taken from the left.
    """
    spark = df.sparkSession
    listed = {}
    for label, group in phrases.items():
        for phrase in group:
            words = T.phrase_words(phrase)
            if words:
                own = next((k for k in range(1, len(words)) if words[k:] == words[:len(words) - k]), None)
                # A phrase listed twice under one label counts twice.
                times = listed.get((label, " ".join(words)), (0, 0, False))[0] + 1
                listed[label, " ".join(words)] = (times, len(words), own is not None)
    table = spark.createDataFrame(
        [(label, phrase, *about) for (label, phrase), about in listed.items()],
        "label string, term string, times int, length int, overlaps boolean")
    empty = F.array().cast("array<struct<at:int,term:string>>")
    rows = df.select(doc, T.words_of(F.col(text)).alias("_w"))
    terms = list(dict.fromkeys(phrase for _, phrase in listed))
    begins = F.when(F.size("_w") > 0, F.filter(
        F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.get("_w", i).isin(list(dict.fromkeys(p.split(" ")[0] for p in terms)))))
    rows = rows.select(doc, "_w", begins.alias("_i"))

    def grams_of(n: int) -> Column:
        own = [p.split(" ") for p in terms if p.count(" ") == n - 1]
        # The first two words decide nearly always, before a string is built.
        begins = F.filter("_i", lambda i: reduce(lambda a, b: a & b, [
            F.get("_w", i + k).isin(list(dict.fromkeys(p[k] for p in own))) for k in range(min(n, 2))]))
        said = F.transform(begins, lambda i: F.struct(
            i.alias("at"), (F.get("_w", i) if n == 1 else F.array_join(F.slice("_w", i + 1, F.lit(n)), " ")).alias("term")))
        return said if n == 1 else F.filter(said, lambda g: g["term"].isin([" ".join(p) for p in own]))

    lengths = sorted({n for _, n, _ in listed.values()})
    grams = F.concat(*[F.coalesce(grams_of(n), empty) for n in lengths]) if lengths else empty
    met = rows.select(doc, F.inline(grams)).join(table, "term").groupBy(doc, "label", "term", "times", "length", "overlaps").agg(
        F.sort_array(F.collect_list("at")).alias("_at"))
    apart = F.aggregate("_at", F.struct(F.lit(0).alias("hits"), F.lit(-1).alias("free")), lambda acc, x: F.when(
        x >= acc["free"], F.struct((acc["hits"] + 1).alias("hits"), (x + F.col("length")).alias("free"))).otherwise(acc))["hits"]
    hits = F.when(F.col("overlaps"), apart).otherwise(F.size("_at"))
    return met.select(doc, "label", F.col("term").alias("phrase"), (hits * F.col("times")).cast("long").alias("hits"))


def regex_factor_counts(df: DataFrame, phrases: dict[str, list[str]], doc: str = "review_id",
                        text: str = "review_text") -> DataFrame:
    """Whole-word phrase hits per category: ``(doc, hits_*...)``."""
    found = phrase_matches(df, phrases, doc, text).groupBy(doc).agg(*[
        F.coalesce(F.sum(F.when(F.col("label") == c, F.col("hits"))), F.lit(0)).alias(f"hits_{c}") for c in phrases])
    return df.select(doc).join(found, doc, "left").select(
        doc, *[F.coalesce(f"hits_{c}", F.lit(0)).alias(f"hits_{c}") for c in phrases])


def regex_factor_score(df: DataFrame, phrases: dict[str, list[str]], doc: str = "review_id",
                       text: str = "review_text") -> DataFrame:
    """Hits divided by the largest count of the category in the corpus: ``(doc, regex_*...)``."""
    # Written, as the largest counts are known after all others.
    counts = materialize(regex_factor_counts(df, phrases, doc, text), "phrase-counts")
    largest = counts.agg(F.struct(*[F.max(f"hits_{c}").alias(c) for c in phrases]).alias("m")).scalar()
    top = counts.withColumn("_top", largest)
    return top.select(doc, *[
        F.coalesce(F.try_divide(F.col(f"hits_{c}").cast("double"), F.col("_top")[c]), F.lit(0.0))
        .alias(f"regex_{c}") for c in phrases])


def hybrid_score(regex: Column, tfidf: Column, embedding: Column | None = None) -> Column:
    """0.60 regex + 0.40 TF-IDF, or 0.40 / 0.30 / 0.30 with an embedding score."""
    if embedding is None:
        return 0.60 * regex + 0.40 * tfidf
    return 0.40 * regex + 0.30 * tfidf + 0.30 * embedding


def phrase_overlap(df: DataFrame, phrases: list[str], doc: str = "review_id",
                   text: str = "review_text") -> DataFrame:
    """Number of different dictionary phrases present in each text."""
    found = phrase_matches(df, {"phrase": list(dict.fromkeys(map(T.phrase_key, phrases)))}, doc, text)
    counted = found.groupBy(doc).agg(F.count("*").alias("_o"))
    return df.select(doc).join(counted, doc, "left").select(
        doc, F.coalesce("_o", F.lit(0)).cast("int").alias("phrase_overlap"))


def hr_rule_score(texts: DataFrame, tfidf_hr: DataFrame, phrases: list[str],
                  signals: list[str] | None = None, doc: str = "review_id",
                  text: str = "review_text") -> DataFrame:
    """0.35 signal share + 0.25 phrase share + 0.40 TF-IDF HR score: (doc, hr_rule_score).

    A share is a count divided by the largest count in the corpus. ``tfidf_hr``: doc, hr_score.
    """
    signals = signals or K.HR_SIGNALS
    found = phrase_matches(texts, {"signal": signals, "phrase": list(dict.fromkeys(map(T.phrase_key, phrases)))}, doc, text)
    found = found.groupBy(doc).agg(
        F.sum(F.when(F.col("label") == "signal", F.col("hits"))).alias("_s"),
        F.count_if(F.col("label") == "phrase").alias("_o"))
    # Written, as the largest counts are known after all others.
    counted = materialize(texts.select(doc).join(found, doc, "left").select(
        doc, F.coalesce("_s", F.lit(0)).alias("_s"), F.coalesce("_o", F.lit(0)).alias("_o")), "phrase-counts")
    top = counted.agg(F.struct(F.max("_s").alias("s"), F.max("_o").alias("o")).alias("m")).scalar()
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    rules = counted.withColumn("_m", top).select(
        doc, (0.35 * share(F.col("_s"), F.col("_m")["s"])
              + 0.25 * share(F.col("_o"), F.col("_m")["o"])).alias("_rules"))
    return rules.join(tfidf_hr.select(doc, "hr_score"), doc).select(
        doc, (F.col("_rules") + 0.40 * F.col("hr_score")).alias("hr_rule_score"))
