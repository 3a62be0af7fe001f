"""Corpus preparation: language, near duplicates, benchmark passages, personal data, mixture.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``documents``. ``run``
writes each stage's result to the shared folder and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.llm import bag_minhash, language, mixing, surrogates, winnow
from ordertide.llm.text import table
from ordertide.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the character models accept; those without a letter or unlike every language go."""
    judged = language.identify(docs, language.fit(docs))
    return judged.where(~F.col("_rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return bag_minhash.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    marked = winnow.mark_benchmark_words(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(F.octet_length("_hit") == 0).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in their texts and n_chars counted again."""
    return surrogates.replace_entities(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that meets the target shares, with each document's tokens, rate and weight."""
    kept = mixing.mix_sources(docs)
    return kept.select(*docs.columns, F.col("_tokens").alias("n_tokens"), F.col("_rate").alias("rate"), F.col("_weight").alias("weight"))


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("personal_data", replace_personal_data), ("mixture", mix)]
#: Language models, signatures and keyed permutations are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
