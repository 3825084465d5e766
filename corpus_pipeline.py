"""From raw documents to token ids: five stages over the tables of a folder.

Each stage is a function of (session, documents, folder of tables); between
stages the rows are Parquet in the shared folder.  Every stage but the last
returns the columns of ``documents``, extra ones of any name included.

Nulls and edge cases: ``language`` takes away null, empty and letterless texts,
whatever their key; rows with a null key pass ``near_copies`` and are judged by
their text elsewhere; of repeated rows one stays (``near_copies``), and of
similar texts that with the smallest key; ``benchmarks`` and ``pseudonyms`` read
texts of any length whole; empty tables give an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.functions.storage import stored
from voxspark.llm import op01_pii, op04_join, op05_bpe, op06_decontaminate, op09_language


LEAST_SCORE = 0.5  # of a language's share of the posterior


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those of which no language has half of the posterior, go."""
    free = "_" * (1 + max(map(len, docs.columns)))  # longer than any name there is
    found = op09_language.identify(docs, into=(free + "lang", free + "score"))
    return found.where((F.col(free + "lang") != "und") & (F.col(free + "score") >= LEAST_SCORE)).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return op04_join.drop_near_copies(docs).select(docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a test item go."""
    return op06_decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gets pseudonyms; n_chars follows the text."""
    kinds = "_" * (1 + max(map(len, docs.columns))) + "kinds"
    out = op01_pii.pseudonymise(docs, into=kinds)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(kinds) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, with digests of the ids and of the decoded text."""
    return op05_bpe.encode_texts(docs.select("doc_id", "lang", "source", "text"), op05_bpe.default_path(), ids="ids")


STAGES = [("language", language), ("near_copies", near_copies), ("benchmarks", benchmarks), ("pseudonyms", pseudonyms), ("tokens", tokens)]

#: tokenizing, language models and their training are beyond SQL; tests compare with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
