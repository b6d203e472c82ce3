"""A corpus pipeline of five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. ``run`` writes each stage's rows as
Parquet to the shared folder and reads them again as the next one's input, so
a lost executor costs a re-read of the last stage and nothing before it.

SQL cannot express the stages (a fitted classifier, fingerprints, a keyed
permutation, a tokenizer); tests hold the rows against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acequia.llm import decontaminate, language, packing, pii, simhash
from acequia.llm.queries import table, tokenizer_file
from acequia.session import materialize, ship_package

SHINGLE, DISTANCE = 3, 3
LANGUAGES, LEAST_SCORE = None, language.LEAST_SCORE


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of ``LANGUAGES`` (None: any that was learned); a null ``lang`` gets the prediction.

    Texts without a letter go, and predictions less sure than ``LEAST_SCORE``.
    Without one text of a known language all documents stay, with a warning.
    """
    ship_package(spark)
    return language.keep_identified(docs, wanted=LANGUAGES, least_score=LEAST_SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    ship_package(spark)
    return simhash.keep_first(docs, shingle=SHINGLE, distance=DISTANCE)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark texts."""
    ship_package(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values in their texts replaced by pseudonyms."""
    return pii.pseudonymised(docs, pii.session_key(spark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences."""
    ship_package(spark)
    return packing.pack_documents(docs, tokenizer_file(spark), with_ids=False).drop("ids")


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
