"""The corpus pipeline: quality rules, near-dedup, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet in the
shared folder and read again as the next stage's docs.  Side tables come from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidara.llm.byte_bpe import encode_decode
from evidara.llm.common import materialize, spread, table
from evidara.llm.mixing import apply_mix
from evidara.llm.quality_rules import keep_good
from evidara.llm.queries import bpe_pattern, vocabulary
from evidara.llm.simhash import keep_one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules keep."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (five-word shingles, similarity 0.8)."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights."""
    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, proved by decoding them again."""
    return encode_decode(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), bpe_pattern(), with_ids=True)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("source_mixing", mixing), ("byte_bpe", tokens)]

#: Near-dedup and rounding to copies have no SQL form; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
