"""Retrieval and answer metrics over whole batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions.ship import ship_by_value
from evidara.functions.text import let, scan

KS = (3, 5)


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Share of the distinct relevant items among the first k; 1 if nothing is relevant."""
    rel = F.array_distinct(relevant)
    top = F.slice(retrieved, 1, max(k, 0)) if k > 0 else F.slice(retrieved, 1, 0)
    return F.when(F.size(rel) > 0, F.size(F.array_intersect(top, rel)) / F.size(rel)).otherwise(F.lit(1.0))


def precision_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Distinct relevant items among the first k over k itself; 0 for k <= 0."""
    if k <= 0:
        return F.lit(0.0)
    return F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant)) / F.lit(float(k))


def ordered_codes(ranked: DataFrame, code: str = "code", distinct: bool = True) -> DataFrame:
    """(query_id, codes): codes in rank order, nulls dropped, first occurrences only."""
    codes = F.transform(F.sort_array(F.collect_list(F.when(F.col(code).isNotNull(), F.struct("rank", F.col(code).alias("c"))))), lambda x: x["c"])
    return ranked.groupBy("query_id").agg((F.array_distinct(codes) if distinct else codes).alias("codes"))


def evaluate(retrieved: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., k, recall, precision, n_queries): macro means, joined on query_id.

    ``retrieved`` has query_id, codes and the ``by`` columns (such as method); gold queries
    without a result count as retrieving nothing.
    """
    g = gold.select("query_id", "relevant")
    if by:
        g = retrieved.select(*by).distinct().crossJoin(F.broadcast(g)) if by else g  # methods are few
    joined = g.join(retrieved, [*by, "query_id"], "left").withColumn("codes", F.coalesce("codes", F.array().cast(retrieved.schema["codes"].dataType)))
    rows = [F.struct(F.lit(k).alias("k"), recall_at(F.col("codes"), F.col("relevant"), k).alias("r"), precision_at(F.col("codes"), F.col("relevant"), k).alias("p")) for k in ks]
    long = joined.select(*by, F.explode(F.array(*rows)).alias("m")).select(*by, "m.*")
    return long.groupBy(*by, "k").agg(F.bround(F.avg("r"), 4).alias("recall"), F.bround(F.avg("p"), 4).alias("precision"), F.count(F.lit(1)).alias("n_queries"))


def mean_grounding(results: DataFrame, column: str = "grounding_ratio") -> DataFrame:
    """One row; missing ratios count 0 and no rows give 0."""
    return results.agg(F.coalesce(F.avg(F.coalesce(F.col(column), F.lit(0.0))), F.lit(0.0)).alias("mean_grounding_ratio"))


def best_and_worst(scores: DataFrame, score: str = "recall") -> DataFrame:
    """(kind, query_id, score): the first best and first worst query."""
    best = scores.orderBy(F.col(score).desc(), "query_id").limit(1).select(F.lit("best").alias("kind"), "query_id", F.col(score).alias("score"))
    worst = scores.orderBy(F.col(score).asc(), "query_id").limit(1).select(F.lit("worst").alias("kind"), "query_id", F.col(score).alias("score"))
    return best.unionByName(worst)


def unknown_gold(gold: DataFrame, corpus_codes: DataFrame) -> DataFrame:
    """(query_id, code): gold codes that the corpus lacks."""
    return gold.select("query_id", F.explode("relevant").alias("code")).join(corpus_codes.select("code"), "code", "left_anti").select("query_id", "code")


def _rouge_l(prediction: str | None, reference: str | None) -> float:
    import re

    a, b = (re.findall(r"[^\W_]+", (x or "").lower()) for x in (prediction, reference))
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return round(2 * row[-1] / (len(a) + len(b)), 4)


def _pairwise(score):
    @F.pandas_udf("double")
    def run(prediction: pd.Series, reference: pd.Series) -> pd.Series:
        return pd.Series([score(a, b) for a, b in zip(prediction, reference, strict=True)], dtype="float64")

    return run


def rouge_l(prediction: str, reference: str) -> Column:
    """ROUGE-L F over lower-cased word tokens (unstemmed); no JVM expression has a table of cells."""
    return _pairwise(_rouge_l)(prediction, reference)


def _grams(tokens: Column, n: int) -> Column:
    """The n-grams of a token array, each with the number of its occurrence, so that sets of them count as bags.

    They are strings, which array functions hash, unlike structs.
    """
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    made = F.array_sort(F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " ")))
    after = lambda s, x: F.struct(x.alias("gram"), F.when(s["gram"] == x, s["k"] + 1).otherwise(1).alias("k"))
    number = lambda s, x: F.when(s["gram"] == x, s["k"] + 1).otherwise(1).cast("string")
    named = lambda g: scan(g, F.struct(F.lit("").alias("gram"), F.lit(0).alias("k")), after, lambda s, x: F.array(F.concat(number(s, x), F.lit(" "), x)), "string")
    return let(made, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.transform(g, lambda x: F.concat(F.lit("1 "), x))).otherwise(named(g)))


def bleu(prediction: str | Column, reference: str | Column, order: int = 4, floor: float = 0.1) -> Column:
    """Sentence BLEU over blank-separated tokens; a zero n-gram count becomes ``floor``, no common token gives 0.

    Linear in the texts; null and blank texts give 0.
    """
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+", -1), lambda x: x != "")

    def score(a: Column, b: Column) -> Column:
        shared = F.array(*[F.size(F.array_intersect(_grams(a, n), _grams(b, n))) for n in range(1, order + 1)])
        size = lambda c: F.size(c).cast("double")

        def of(m: Column) -> Column:
            logs = [F.log(F.when(F.get(m, F.lit(n)) > 0, F.get(m, F.lit(n)).cast("double")).otherwise(floor) / F.greatest(F.lit(1.0), size(a) - n)) / order for n in range(order)]
            brevity = F.when(F.size(a) > F.size(b), 1.0).otherwise(F.exp(1 - size(b) / size(a)))
            return F.when(F.get(m, F.lit(0)) > 0, brevity * F.exp(sum(logs[1:], logs[0]))).otherwise(0.0)

        return let(shared, of)

    column = lambda c: F.col(c) if isinstance(c, str) else c
    return let(words(column(prediction)), lambda a: let(words(column(reference)), lambda b: score(a, b)))


def mean_bleu(pairs: DataFrame, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """(n_pairs, bleu): the mean over pairs whose reference isn't blank, rounded to four digits; null without any."""
    real = pairs.where(F.coalesce(F.col(reference), F.lit("")).rlike(r"(?U)\S"))
    return real.agg(F.count(F.lit(1)).alias("n_pairs"), F.bround(F.avg(bleu(prediction, reference)), 4).alias("bleu"))


def grounding_summary(ratios: DataFrame) -> DataFrame:
    return ratios.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n_sentences").alias("n_sentences"), F.sum("n_supported").alias("n_supported"), F.sum((F.col("refusal") != "").cast("long")).alias("n_refused"))


def first_per_code(ranked: DataFrame, code: str = "code") -> DataFrame:
    """(query_id, code, rank): each code's first rank."""
    return ranked.where(F.col(code).isNotNull()).groupBy("query_id", code).agg(F.min("rank").alias("rank"))




ship_by_value(__name__)
