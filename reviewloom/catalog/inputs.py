"""How the given tables stand in for the two raw review tables, and for vectors and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewloom import constants as K
from reviewloom.operators import segments as S
from reviewloom.operators import terms as N
from reviewloom.session import discard, materialize

VECTOR_CATEGORIES = K.CATEGORIES[:10]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given text table, spread over the cores when its file has fewer row groups than cores."""
    scan = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def raw_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the first platform: the first line is the upside, the rest the downside."""
    documents = text_table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    at = F.instr("text", "\n")
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("source_row_id"),
        F.col("source").alias("Company"),
        F.col("quality").cast("string").alias("Rating"),
        F.col("lang").alias("Location"),
        F.substring_index("text", "\n", 1).alias("Pros"),
        F.when(at > 0, F.substr("text", at + 1)).alias("Cons"),
    )


def raw_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as the second platform: assistant turns are the downside."""
    assistant = F.col("role") == "assistant"
    return text_table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("source_row_id"),
        F.col("role").alias("Company"),
        F.when(~assistant, F.col("text")).alias("Likes"),
        F.when(assistant, F.col("text")).alias("Dislikes"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.review_segments(raw_a(spark, sf_dir), raw_b(spark, sf_dir))


def stored_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scoring reads of the segments, written once."""
    return materialize(segments(spark, sf_dir).select("side", "review_id", "review_text"), "segments")


def ranked_seeds(keywords: DataFrame, per_category: int = 4) -> DataFrame:
    """A dictionary made of the most frequent single words, dealt out to the categories in turn."""
    count = per_category * len(K.CATEGORIES)
    ranked = (keywords.where(F.col("ngram_len") == 1)
              .orderBy(F.desc("frequency"), F.asc("keyword")).limit(count))
    # The window spans the few rows of the limit.
    numbered = ranked.select("keyword", (F.row_number().over(
        W.orderBy(F.desc("frequency"), F.asc("keyword"))) - 1).alias("rank"))
    names = F.array(*[F.lit(c) for c in K.CATEGORIES])
    ord_ = F.col("rank") % len(K.CATEGORIES)
    turn = F.floor(F.col("rank") / len(K.CATEGORIES))
    return numbered.select(
        F.element_at(names, (ord_ + 1).cast("int")).alias("category"),
        ord_.cast("int").alias("category_ord"),
        F.col("keyword").alias("term"),
        turn.cast("int").alias("term_ord"),
        F.round(1 - 0.1 * turn, 4).alias("score"),
        F.lit(K.BASE_SOURCE).alias("source"),
    )


def corpus_seeds(spark: SparkSession, sf_dir: str, texts: DataFrame | None = None) -> DataFrame:
    """The dictionary of the corpus as a stage of its own: a few rows, written once. ``texts``: :func:`stored_segments`, if there are some."""
    own = stored_segments(spark, sf_dir) if texts is None else None
    seeds = materialize(ranked_seeds(N.keyword_table(own if texts is None else texts)), "seeds")
    discard(own)
    return seeds


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("vector"), "label")


def seed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a seed term of the category its label names."""
    names = F.array(*[F.lit(c) for c in VECTOR_CATEGORIES])
    return vectors(spark, sf_dir).select(
        F.element_at(names, F.col("label") + 1).alias("category"),
        F.col("label").alias("category_ord"),
        F.format_string("v%06d", "vec_id").alias("term"),
        F.lit(1.0).alias("score"),
        "vector",
    )
