"""The corpus pipeline: from documents to packed training sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all rows of docs and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs. Every stage but the last returns the
columns of documents; what a stage drops doesn't come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlab.llm import jaccard, language, mixing, packing, quality
from contestlab.llm.common import drop_path, new_path, read


def aside(docs: DataFrame, *columns: str) -> DataFrame:
    """All columns of docs as one, out of the way of names that a stage makes, and the columns that it works on."""
    return docs.select(F.struct("*").alias("__own"), *columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is sure enough; the model learns from a bounded sample of the labelled ones. Null and
    letterless texts are rejected; repeated rows are judged alike; where nothing is labelled, nothing can be told and all go."""
    model = language.fit(language.training_part(docs))
    return language.identify(aside(docs, "text"), model).where(~F.col("lang_rejected")).select("__own.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose posterior quality is high enough. Null and empty texts fail the base
    rules; repeated rows, null keys and extra columns stay as they are."""
    return quality.keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): the smallest doc_id."""
    return jaccard.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. A null source is a source; empty texts have no
    words to take and go; repeated rows are taken alike."""
    taken = mixing.documents_mix(aside(docs, "doc_id", "source", "text")).where("repeats > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("__own.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each document with its place in a sequence. A null text is one piece of one id; repeated rows and null
    keys have places of their own; extra columns are left out."""
    return packing.packed_documents(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("source_mix", source_mix), ("best_fit_packing", best_fit_packing)]

#: Seeded selection, learned models and packing can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote is deleted as soon as the next one has read it."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
