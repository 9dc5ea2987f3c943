"""A corpus run of five stages over ``documents``; each stage works on all that the one before kept.

Toxic documents go; recurring lines go from the texts; one document of each group of near duplicates stays; sources
are mixed to their target weights (a document used twice is there twice, an unused one is not); what is left is
packed into sequences. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import line_dedup, mixing, ngram_join, packing, toxicity
from reviewloom.llm.common import KeyFilter, keep, table
from reviewloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _row():
    return F.xxhash64("doc_id", "text")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose key is not in ``gone`` (row). Only rows that a bitmap of the keys does not clear move to the join."""
    gone = keep(gone.select("row").distinct(), "pipeline-gone")
    may = KeyFilter.of(gone, "row")

    @F.pandas_udf("boolean")
    def named(row):
        import pandas as pd

        return pd.Series(may(row.to_numpy().view("uint64")))

    keyed = docs.withColumn("__row", _row()).withColumn("__may", named("__row"))
    asked = keyed.where("__may").join(gone.withColumnRenamed("row", "__row"), "__row", "left_anti")
    return keyed.where("NOT __may").unionByName(asked).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of toxicity score 0.7 or more.

    Null and empty texts score as texts without words; repeated rows go or stay together; an empty table stays empty.
    """
    scores = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scores.where("predicted = 1"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; ``n_chars`` follows the text. Every document stays.

    Null texts stay null, empty ones empty; a text that loses all its lines becomes empty; repeated rows are treated alike.
    """
    out = line_dedup.drop_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("dropped_lines") > 0, F.length("text").cast("long")).otherwise(
        F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates; of rows equal in all columns one stays."""
    found = keep(ngram_join.similar_components(docs), "pipeline-components")
    left = _without(docs, found.where("NOT keeper"))
    # Rows of one id and text are one document: where there are several, one stays.
    many = keep(found.where("keeper AND n_shingles > 0").groupBy("row").count().where("count > 1").select("row"), "pipeline-repeated")
    may = KeyFilter.of(many, "row")

    @F.pandas_udf("boolean")
    def repeated(row):
        import pandas as pd

        return pd.Series(may(row.to_numpy().view("uint64")))

    keyed = left.withColumn("__row", _row()).withColumn("__may", repeated("__row"))
    once = keyed.where("__may AND text RLIKE '[^ \\\\t-\\\\r]'").dropDuplicates(["doc_id", "text"])
    blank = keyed.where("__may AND NOT coalesce(text RLIKE '[^ \\\\t-\\\\r]', false)")
    return keyed.where("NOT __may").unionByName(once).unionByName(blank).select(*COLUMNS)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix uses it.

    Texts without words (null ones too) take part with size 0; repeated rows are one document and used alike; a null source
    comes last; an empty table stays empty.
    """
    used, _ = mixing.mix_sources(docs)
    uses = used.select(F.col("id"), F.col("seeded"), F.col("repeats")).where("repeats > 0")
    uses = keep(uses.groupBy("seeded").agg(F.max("repeats").alias("repeats")), "pipeline-uses")
    seeded = F.xxhash64(F.lit(1), F.col("doc_id"), F.col("text"))
    return (docs.withColumn("seeded", seeded).join(uses, "seeded")
            .withColumn("__use", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences of at most 4,096 tokens.

    A null text is empty: its end mark alone. Repeated rows are packed each; no documents, no pieces.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_recurring_lines), ("ngram_join", keep_one_of_similar),
          ("source_mixing", mix_to_targets), ("best_fit_packing", pack)]

#: Models, templates and tokens are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = keep(docs, f"pipeline-{name}")
    return docs
