"""A corpus pipeline: stages in order, each over everything that the one before it kept.

A stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's ``docs``. All
but the last return the columns of ``documents``. Empty tables pass through every stage; null texts end at the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.llm import langid, mixing, near, packing, pii
from voltloom.llm.tables import read_table, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay, with ``lang`` set to it; texts without a letter or with an ambiguous codeword go."""
    name = pii.free_name(docs, "language")
    rows = docs.where(docs["doc_id"].isNotNull() & ~langid.held_out(docs["doc_id"]))
    found = langid.identify(docs, langid.train(rows.select("text", "lang")), name)
    sure = (F.col(f"{name}.pred") != langid.UNKNOWN) & ~F.col(f"{name}.ambiguous")
    return found.where(sure).withColumn("lang", F.col(f"{name}.pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return near.dedupe(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data becomes its kind, and n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.copies(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: Classifier, join and packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
