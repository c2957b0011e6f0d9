"""The corpus pipeline over ``documents``: quality filter, near-duplicates, repeated passages, mixing to target weights, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the shared folder as Parquet and reads
again as the next stage's ``docs``, so a lost executor never sets a later stage back to the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm import mixing, quality, sentencepiece_fst, simhash, substring_dedup
from quotelake.llm.common import bounded_batches, materialize


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores below 0.5. Null and empty texts have the bias' score; repeated rows are scored alike;
    without labels all stay (a score of 0.5); an empty table stays empty; other columns are kept whatever their names."""
    bounded_batches(spark)
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each group of near-duplicates (five-word shingles, similarity 0.8). Null ids stay; null, empty and
    blank texts are one group; of rows with one id and text one stays; texts under one id are compared like any others."""
    bounded_batches(spark)
    return simhash.keep_one_of_each(spark, docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more out of all but the first document that holds them; n_chars follows the text. Null texts and null ids stay as they are;
    a text of which only white space is left goes; rows repeated under one id lose what the others lose."""
    bounded_batches(spark)
    cut = substring_dedup.remove_repeats(spark, docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their targets. Null sources are one source; texts without words are taken as their source's rate says;
    a source without words isn't taken; null ids draw like one id."""
    bounded_batches(spark)
    return mixing.mix_documents(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document the mix took. Null and empty texts have none; rows are independent."""
    bounded_batches(spark)
    return sentencepiece_fst.encode_documents(spark, docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup_stage),
    ("mixing sources to target weights", mix_to_weights),
    ("SentencePiece encoding and decoding", tokens),
]

#: SQL can't express the classifier; the pipeline is tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
