"""Sentence-level grounding, refusals and citations.

Input is one row a query with ``answer`` and ``candidates`` (an array of at most a few structs in
rank order), so a sentence meets its own query's candidates inside the row: no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions.text import fused_dot, hash_embedding, let, lexical_overlap, sentences, tokens3
from evidara.operators.answer import REFUSAL

THRESHOLD = 0.25
METHODS = ("lexical", "embedding")


def _score(method: str, encoder: Callable[[Column], Column] | None) -> tuple[Callable, Callable]:
    """(prepare a text once, compare two prepared texts)."""
    if method == "lexical":
        return tokens3, lexical_overlap
    if method == "embedding":
        return encoder or hash_embedding, fused_dot
    raise ValueError(f"unknown grounding method {method!r}; use one of {METHODS}")


def verify(answers: DataFrame, threshold: float = THRESHOLD, method: str = "lexical", encoder: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, sent_pos, sentence, supported, best_chunk_id, best_score) of every sentence.

    The best candidate is the first of the highest positive score; supported compares the
    unrounded score with ``threshold``.  Without candidates the score is 0 and the id null.
    """
    prepare, compare = _score(method, encoder)
    ready = answers.select("query_id", F.posexplode(sentences(F.col("answer"))).alias("sent_pos", "sentence"), F.transform(F.coalesce("candidates", F.array().cast(answers.schema["candidates"].dataType)), lambda c: F.named_struct(F.lit("chunk_id"), c["chunk_id"], F.lit("prepared"), prepare(c["text"]))).alias("c"))

    def best(p: Column) -> Column:
        scores = F.transform(F.col("c"), lambda c, i: F.struct(compare(p, c["prepared"]).alias("s"), (-i).alias("first"), c["chunk_id"].alias("chunk_id")))
        return F.array_max(F.filter(scores, lambda x: x["s"] > 0))

    found = ready.withColumn("b", let(prepare(F.col("sentence")), best))
    s = F.coalesce("b.s", F.lit(0.0))
    return found.select("query_id", "sent_pos", "sentence", (s >= threshold).alias("supported"), F.col("b.chunk_id").alias("best_chunk_id"), F.bround(s, 4).alias("best_score"))


def ratios(verdicts: DataFrame, queries: DataFrame, threshold: float = THRESHOLD, min_ratio: float = THRESHOLD) -> DataFrame:
    """(query_id, n_sentences, n_supported, grounding_ratio, passed, refusal) of every query.

    passed uses the unrounded ratio and ``threshold``, the refusal the rounded one and ``min_ratio``.
    """
    per = verdicts.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("supported").cast("long")).alias("k"))
    all_ = queries.select("query_id").join(per, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n_sentences"), F.coalesce("k", F.lit(0)).alias("n_supported"))
    raw = F.when(F.col("n_sentences") > 0, F.col("n_supported") / F.col("n_sentences")).otherwise(0.0)
    rounded = F.bround(raw, 4)
    return all_.select("query_id", "n_sentences", "n_supported", rounded.alias("grounding_ratio"), (raw >= threshold).alias("passed"), F.when(rounded < min_ratio, REFUSAL).otherwise("").alias("refusal"))


def citations(verdicts: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a supported sentence with its chunk's metadata; nulls where the chunk is unknown."""
    wanted = [c for c in ("indicator_code", "indicator_name", "page_start", "page_end") if c in chunks.columns]
    side = chunks.select(F.col("chunk_id").alias("best_chunk_id"), *wanted)
    return verdicts.where("supported").join(side, "best_chunk_id", "left").select("query_id", "sent_pos", "sentence", F.col("best_chunk_id").alias("chunk_id"), "best_score", *wanted)
