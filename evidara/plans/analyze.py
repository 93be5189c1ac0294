"""End-to-end plans: retrieve, rerank, answer, ground, cite for a whole batch of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions.plan import union
from evidara.operators import answer, evaluate, ground, lexical, ranking
from evidara.operators.chunk import chunk_units


def candidates_of(ranked: DataFrame, corpus: DataFrame, queries: DataFrame | None = None, id: str = "chunk_id") -> DataFrame:
    """Ranked ids with their chunk's columns, and the query text if ``queries`` is given."""
    joined = ranked.join(corpus.drop("score", "rank", "embedding"), id, "left")
    return joined if queries is None else joined.join(queries.select("query_id", "query"), "query_id")


def retrieve_and_rerank(queries: DataFrame, corpus: DataFrame, k_retrieve: int = 20, n_rerank: int = 5, legs: tuple[str, ...] = ("bm25", "dense"), fusion: str = "rrf", scorer: Callable[[Column, Column], Column] = ranking.lexical_scorer, index=None) -> DataFrame:
    found = ranking.hybrid(queries, corpus, k_retrieve, fusion=fusion, legs=legs, index=index)
    return ranking.rerank(candidates_of(found, corpus, queries), n_rerank, scorer)


def analyze(
    queries: DataFrame, corpus: DataFrame, retrieved: DataFrame | None = None, grounding_method: str = "lexical", grounding_threshold: float = ground.THRESHOLD, generate: Callable[[DataFrame], DataFrame] | None = None, k_retrieve: int = 20, n_rerank: int = 5, legs: tuple[str, ...] = ("bm25", "dense"), index=None
) -> dict[str, DataFrame]:
    """answers, verdicts, ratios and citations of every query.

    ``retrieved`` (query_id, rank, chunk columns) replaces retrieval; ``generate`` adds an
    ``answer`` column in place of the template.  The answer stands beside a refusal, it is not
    replaced by it.
    """
    if grounding_method not in ground.METHODS:
        raise ValueError(f"unknown grounding method {grounding_method!r}")
    if retrieved is None:
        retrieved = retrieve_and_rerank(queries, corpus, k_retrieve, n_rerank, legs, index=index).withColumn("rank", F.col("new_rank"))
    asked = queries.select("query_id", "query").join(answer.gather(retrieved), "query_id", "left")
    answers = generate(asked) if generate else asked.withColumn("answer", answer.template_answer(F.col("candidates")))
    verdicts = ground.verify(answers, grounding_threshold, grounding_method)
    return {
        "answers": answers,
        "verdicts": verdicts,
        "ratios": ground.ratios(verdicts, queries, grounding_threshold),
        "citations": ground.citations(verdicts, corpus.withColumn("chunk_id", F.col("chunk_id").cast("string"))),
    }


def evidence_for_items(units: DataFrame, queries: DataFrame, size: int = 1024, overlap: int = 128, k: int = 5) -> DataFrame:
    """Flagship: chunk units, find k chunks for each query by BM25, ground the query's own sentences in them and cite."""
    chunks = chunk_units(units, size, overlap)
    found = lexical.search(queries, chunks, k)
    asked = queries.select("query_id", F.col("query").alias("answer")).join(answer.gather(candidates_of(found, chunks)), "query_id", "left")
    return ground.citations(ground.verify(asked), chunks)


def evaluate_methods(lists: dict[str, DataFrame], gold: DataFrame, code: str = "code", ks: tuple[int, ...] = evaluate.KS) -> DataFrame:
    """Macro recall and precision of named ranked lists (query_id, rank, code) in one plan."""
    out = None
    for name, ranked in lists.items():
        one = evaluate.ordered_codes(ranked, code).withColumn("method", F.lit(name))
        out = one if out is None else union(out, one)
    return evaluate.evaluate(out, gold, ks, ("method",))
