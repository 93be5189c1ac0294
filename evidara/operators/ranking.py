"""Routing, rank fusion, hybrid retrieval and reranking for batches of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions.plan import union
from evidara.functions.text import hash_embedding, let, lexical_overlap, tokens3
from evidara.operators import dense, lexical

#: Topic families and their keywords, matched as substrings.
FAMILY_KEYWORDS = {
    "planeacion": ["planning", "planeacion", "presupuesto", "budget", "needs assessment", "needs", "procurement plan", "plan", "preparation", "tender strategy", "method"],
    "competencia-licitacion": [
        "tender", "competencia", "competition", "bid", "licitacion", "bidding", "collusion", "bid rigging", "market", "rfp", "invitation", "shortlisted", "pre-qualification", "qualification", "open tender", "restricted",
    ],
    "adjudicacion": ["award", "adjudicacion", "selection", "winner", "awarded", "supplier", "contractor", "proposal evaluation", "evaluacion", "best value", "lowest price", "negotiated"],
    "ejecucion-contrato": [
        "contract", "ejecucion", "implementation", "delivery", "performance", "payment", "milestone", "disbursement", "completion", "extension", "variation", "fraud", "integrity", "subcontract", "guarantee", "warranty",
    ],
}
#: Descriptions for the similarity fallback.
FAMILY_DESCRIPTIONS = {
    "planeacion": "Risks during procurement planning, budgeting, needs assessment and procurement strategy.",
    "competencia-licitacion": "Risks during the tender phase, bidding process, competition, collusion and bid rigging.",
    "adjudicacion": "Risks during the award phase, supplier selection, proposal evaluation and contracting.",
    "ejecucion-contrato": "Risks during contract execution, delivery, payments, milestones, variations and completion.",
}
DEFAULT_FAMILY = "competencia-licitacion"
RRF_K = 60


def canonical_family(c: Column) -> Column:
    """One slug for families: a slash becomes a hyphen."""
    return F.replace(c, F.lit("/"), F.lit("-"))


def votes(query: Column, keywords=None) -> dict[str, Column]:
    """Number of each family's keywords that occur in the lower-cased query."""
    low = F.lower(F.coalesce(query, F.lit("")))
    out = {}
    for family, words in (keywords or FAMILY_KEYWORDS).items():
        n = F.lit(0)
        for w in words:
            n = n + low.contains(w).cast("int")
        out[family] = n
    return out


def route(query: Column, keywords=None) -> Column:
    """All families with the most votes, in table order; empty without any vote."""
    counts = F.array(*[F.struct(F.lit(f).alias("family"), n.alias("n")) for f, n in votes(query, keywords).items()])
    return let(counts, lambda a: let(F.array_max(F.transform(a, lambda x: x["n"])), lambda m: F.transform(F.filter(a, lambda x: (x["n"] == m) & (m > 0)), lambda x: x["family"])))


def route_by_similarity(query: Column, descriptions=None, encoder: Callable[[Column], Column] | None = None) -> Column:
    """The family whose description is most similar; ties by table order, the default if none is."""
    enc = encoder or hash_embedding

    def pick(q: Column) -> Column:
        scored = F.array(*[F.struct(F.bround(dense.dot(q, enc(F.lit(d))), 6).alias("s"), F.lit(-i).alias("i"), F.lit(f).alias("family")) for i, (f, d) in enumerate((descriptions or FAMILY_DESCRIPTIONS).items())])
        return let(F.array_max(scored), lambda best: F.when(best["s"] > 0, best["family"]).otherwise(F.lit(DEFAULT_FAMILY)))

    return let(enc(F.coalesce(query, F.lit(""))), pick)


def route_queries(queries: DataFrame, keywords=None, descriptions=None) -> DataFrame:
    """(query_id, families, by): votes first, similarity for queries without any."""
    voted = queries.select("query_id", "query", route(F.col("query"), keywords).alias("voted"))
    none = F.size("voted") == 0
    families = F.when(none, F.array(route_by_similarity(F.col("query"), descriptions))).otherwise(F.col("voted"))
    return voted.select("query_id", families.alias("families"), F.when(none, F.lit("similarity")).otherwise(F.lit("keywords")).alias("by"))


def rrf(a: DataFrame, b: DataFrame, k: int = RRF_K, id: str = "chunk_id") -> DataFrame:
    """(query_id, id, score, rank): reciprocal rank fusion; ties keep the first list's order, then the second's."""
    both = union(a.select("query_id", id, F.col("rank").alias("ra"), F.lit(None).cast("int").alias("rb")), b.select("query_id", id, F.lit(None).cast("int").alias("ra"), F.col("rank").alias("rb")))
    part = lambda c: F.coalesce(1.0 / (F.col(c) + k), F.lit(0.0))
    fused = both.groupBy("query_id", id).agg(F.min("ra").alias("ra"), F.min("rb").alias("rb")).withColumn("score", F.bround(part("ra") + part("rb"), 6))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("ra").asc_nulls_last(), F.col("rb").asc_nulls_last(), id)
    return fused.withColumn("rank", F.row_number().over(order)).select("query_id", id, "score", "rank")


def weighted(a: DataFrame, b: DataFrame, alpha: float = 0.5, id: str = "chunk_id") -> DataFrame:
    """Min-max scores of each list, (1 - alpha) of the first and alpha of the second; absent is 0."""

    def scaled(x: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("query_id")
        low, high = F.min("score").over(w), F.max("score").over(w)
        return x.select("query_id", id, ((F.col("score") - low) / F.when(high - low == 0, 1.0).otherwise(high - low)).alias(name))

    joined = scaled(a, "sa").join(scaled(b, "sb"), ["query_id", id], "full_outer")
    total = (1 - alpha) * F.coalesce("sa", F.lit(0.0)) + alpha * F.coalesce("sb", F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), id)
    return joined.withColumn("score", F.bround(total, 6)).withColumn("rank", F.row_number().over(order)).select("query_id", id, "score", "rank")


def hybrid(queries: DataFrame, corpus: DataFrame, k: int = 10, family: str | None = None, fusion: str = "rrf", alpha: float = 0.5, legs: tuple[str, ...] = ("bm25", "dense"), id: str = "chunk_id", text: str = "text", family_column: str = "family", index=None) -> DataFrame:
    """(query_id, rank, id, score): both legs fetch 3k, are fused and cut to k.

    ``index`` is a stored ``InvertedIndex`` of the corpus, which the BM25 leg then reads in place of texts.
    ``corpus`` has an ``embedding`` and ``queries`` too if the dense leg is used.  Unknown
    methods raise before anything runs; a failing leg is an error, not a silent empty list.
    """
    if fusion not in ("rrf", "weighted"):
        raise ValueError(f"unknown fusion method {fusion!r}")
    if not legs or set(legs) - {"bm25", "dense"}:
        raise ValueError(f"legs must be of 'bm25' and 'dense', got {legs}")
    part = corpus if family is None else corpus.where(F.col(family_column) == family)
    none = queries.select("query_id", F.lit(None).cast(corpus.schema[id].dataType).alias(id), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")
    if "bm25" not in legs:
        a = none
    else:
        a = lexical.search(queries, corpus, 3 * k, id, text, family, family_column) if index is None else index.search(queries, 3 * k, family)
    b = dense.search(queries, part, 3 * k, id) if "dense" in legs else none
    fused = rrf(a, b, id=id) if fusion == "rrf" else weighted(a, b, alpha, id)
    return fused.where(F.col("rank") <= k).select("query_id", "rank", id, "score")


def lexical_scorer(query: Column, text: Column) -> Column:
    """Default pair scorer: share of the query's tokens found in the text (no cross-encoder)."""
    return lexical_overlap(tokens3(query), tokens3(text))


def rerank(candidates: DataFrame, top_n: int = 5, scorer: Callable[[Column, Column], Column] = lexical_scorer) -> DataFrame:
    """Best ``top_n`` candidates of each query by ``scorer``, ties by previous rank.

    ``candidates`` has query_id, rank, query, text and whatever else; it gains rerank_score and
    new_rank.  The scorer runs after retrieval's cut, on few rows a query.
    """
    scored = candidates.withColumn("rerank_score", F.bround(scorer(F.col("query"), F.col("text")), 6))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= top_n)


def rerank_movement(before: DataFrame, after: DataFrame, n: int = 5, id: str = "chunk_id") -> DataFrame:
    """(query_id, new_members, moved): how far the reranked top n differs from the first one."""
    a = before.where(F.col("rank") <= n).select("query_id", id, F.col("rank").alias("old_rank"))
    b = after.where(F.col("new_rank") <= n).select("query_id", id, "new_rank")
    joined = b.join(a, ["query_id", id], "left")
    return joined.groupBy("query_id").agg(
        F.sum(F.col("old_rank").isNull().cast("long")).alias("new_members"),
        F.sum((F.col("old_rank").isNull() | (F.col("old_rank") != F.col("new_rank"))).cast("long")).alias("moved"),
    )
