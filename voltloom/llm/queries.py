"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bitpack, langid, lm_score, mixing, near, notices, oracles, packing, pii, quality, ranked_search, toxicity, trie
from .tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep(fn) if fn else keep


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notices.scan(read_table(spark, sf_dir, "documents"))
    return found.withColumn("n_matches", F.size("matches").cast("long")).drop("matches")


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_documents(read_table(spark, sf_dir, "labels"))
    return quality.judge(read_table(spark, sf_dir, "documents"), trusted)


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_documents(read_table(spark, sf_dir, "labels"))
    return lm_score.rank(read_table(spark, sf_dir, "documents"), trusted)


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


@query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read_table(spark, sf_dir, "documents")))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.join(read_table(spark, sf_dir, "documents"))


@query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(read_table(spark, sf_dir, "embeddings"))
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.label(read_table(spark, sf_dir, "documents"))


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.encode(read_table(spark, sf_dir, "documents"))


@query
def op10_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


@query(sql=oracles.TRIE)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(read_table(spark, sf_dir, "conversations"))


@query(sql=oracles.SEARCH)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.withColumn("n_neighbours", F.size("evidence").cast("long")).withColumn("nearest_cosine", F.try_element_at("evidence.cosine", F.lit(1))).drop("evidence")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py, each written and read again."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
