"""Resumable runs as streams: what a checkpoint has seen is not done again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewloom import constants as K
from reviewloom.operators import scoring as C
from reviewloom.operators import seeds as E
from reviewloom.operators import segments as S


def stream_seed_merge(keyword_vectors: DataFrame, base: DataFrame, centroids: DataFrame, folder: str,
                      checkpoint: str, threshold: float = K.SEED_THRESHOLD,
                      top_n: int = K.OLDER_SEED_TOP_N, categories: list[str] | None = None) -> StreamingQuery:
    """Grow a dictionary from a stream of ``(keyword, vector)``, one version per micro-batch.

    Every batch merges its matches into the newest complete version that is older than itself and
    writes version ``batch=<id>``, so a batch that is run again after a failure writes the same
    table: the merge takes maxima and does not count. Read the result with :func:`latest_seeds`.
    """
    fields = "category string, category_ord int, term string, score double, source string, term_ord int"
    given = base.select("category", F.col("category_ord").cast("int").alias("category_ord"),
                        F.lower("term").alias("term"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        matched = S.score_at_least(E.best_category(batch, centroids, categories), threshold).select(
            "category", F.col("category_ord").cast("int").alias("category_ord"),
            F.lower("keyword").alias("term"), F.round("score", 9).alias("score"),
            F.lit(K.EXPANSION_SOURCE).alias("source"))
        known = _versions(spark, folder)
        earlier = [v for v in known if v < batch_id]
        old = (spark.read.schema(fields).parquet(f"{folder}/batch={max(earlier)}") if earlier
               else spark.createDataFrame([], fields))
        merged = E.seed_merge(old, matched, given, top_n)
        (merged.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in fields.split(", ")])
         .coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}"))

    return (keyword_vectors.writeStream.foreachBatch(merge)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _versions(spark, folder: str) -> list[int]:
    """Numbers of the versions whose write has finished."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def latest_seeds(spark, folder: str) -> DataFrame:
    """The newest complete dictionary of :func:`stream_seed_merge`."""
    return spark.read.parquet(f"{folder}/batch={_versions(spark, folder)[-1]}")


def _stream_scored(rows: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Score every micro-batch by itself and write it as ``batch=<id>``, which a repeated batch writes again.

    Nothing is kept between batches: ``score`` joins the batch with fixed tables. Read the result with :func:`scored_rows`.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return (rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def scored_rows(spark, folder: str) -> DataFrame:
    """All finished batches of a scoring stream."""
    parts = [f"{folder}/batch={v}" for v in _versions(spark, folder)]
    if not parts:
        raise FileNotFoundError(f"no finished batch in {folder}")
    return spark.read.parquet(*parts)


def stream_classify_tfidf(texts: DataFrame, model: C.FrozenTfidf, folder: str, checkpoint: str, group: str = "side",
                          doc: str = "review_id", text: str = "review_text", threshold: float | None = None) -> StreamingQuery:
    """Score and label a stream of texts by a frozen TF-IDF model (:func:`~reviewloom.operators.scoring.freeze_tfidf`).

    A text's scores depend on the model and on itself alone, so how the stream is cut into batches does not matter. A batch is read
    from the stream's source by each pass over it.
    """
    def score(batch: DataFrame) -> DataFrame:
        scores = C.frozen_tfidf_scores(batch, model, group, doc, text, stored=True)
        return C.label_scores(scores, "tfidf", model.categories, threshold)

    return _stream_scored(texts, score, folder, checkpoint)


def stream_classify_older(vectors: DataFrame, dictionary: DataFrame, folder: str, checkpoint: str,
                          categories: list[str] | None = None, doc: str = "review_id",
                          threshold: float = K.OLDER_THRESHOLD) -> StreamingQuery:
    """Score and label a stream of vectors by the best single term of each category.

    ``dictionary``: category, score, vector; a fixed table of any size, read anew by every batch.
    """
    def score(batch: DataFrame) -> DataFrame:
        return C.older_label(C.older_scores(batch, dictionary, categories, doc), threshold)

    return _stream_scored(vectors, score, folder, checkpoint)


def stream_classify(vectors: DataFrame, centroids: DataFrame, path: str, checkpoint: str,
                    categories: list[str] | None = None, doc: str = "review_id") -> StreamingQuery:
    """Score and label a stream of ``(review_id, vector)`` rows and append them to a table.

    Stateless: the centroids are a fixed model.
    """
    scores = C.embedding_scores(vectors, centroids, categories, doc)
    labelled = C.label_scores(scores, "sentence_transformer", categories)
    return (labelled.writeStream.format("parquet").option("path", path).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
