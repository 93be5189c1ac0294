"""BM25 (Okapi) over a corpus DataFrame, for a batch of queries at once.

Parameters follow the usual defaults (Robertson & Zaragoza 2009): idf = ln(N - df + .5) -
ln(df + .5), a negative idf becomes epsilon times the mean raw idf of the vocabulary, and every
repetition of a query token counts.

Search scores inside the document's row: the weighted terms of a batch of queries travel to the
tasks, one pass over the texts multiplies each batch of documents with them and keeps the best k a
query, so the shuffle carries k rows a query and batch instead of a row for every query and
document that share a term.  Beyond QUERY_TERMS the terms stay in a table and are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.functions.ship import ship_by_value
from evidara.functions.text import tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
QUERY_BYTES = 4 << 20  #: of query texts whose weighted terms may travel with the tasks
ROOM = 4_000_000  #: scores, or weights of terms, that a task holds at once (32 MB)
DIGITS = 6


def postings(corpus: DataFrame, id: str = "chunk_id", text: str = "text") -> DataFrame:
    """(id, term, tf) of the whole corpus."""
    return corpus.select(id, F.explode(tokens(F.col(text))).alias("term")).groupBy(id, "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(corpus: DataFrame, text: str = "text") -> DataFrame:
    """One row: n_docs and avgdl."""
    return corpus.select(F.size(tokens(F.col(text))).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def _vocabulary(corpus: DataFrame, text: str) -> DataFrame:
    """(term, df, n_docs, tokens) of one pass: the two sums over a term's rows add up to those of the corpus.

    Each document counts with its first term; the null term has those without any.
    """
    row = corpus.select(tokens(F.col(text)).alias("toks")).select(F.size("toks").cast("long").alias("dl"), F.posexplode_outer(F.array_distinct("toks")).alias("pos", "term"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    sums = row.groupBy("term").agg(F.count("term").alias("df"), F.sum(first.cast("long")).alias("n_docs"), F.sum(F.when(first, F.col("dl")).otherwise(0)).alias("tokens"))
    return sums.where("df >= 0 and n_docs >= 0 and tokens >= 0")  # always so; it keeps all columns wherever this is used, so that all uses share one shuffle


def _idf(vocabulary: DataFrame, epsilon: float) -> DataFrame:
    """(term, df, idf, n_docs, avgdl) of every term; negative idf values replaced."""
    n = F.broadcast(vocabulary.agg(F.sum("n_docs").alias("n"), F.sum("tokens").alias("dls")))  # one row
    # df is 0 for the null term; a filter on the term itself would go below the count and part its shuffle from the others'
    raw = vocabulary.where("df > 0").select("term", "df").crossJoin(n).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = F.broadcast(raw.agg(F.avg("raw").alias("mean_raw")))  # one row
    idf = F.when(F.col("raw") < 0, epsilon * F.col("mean_raw")).otherwise(F.col("raw"))
    return raw.crossJoin(mean).select("term", "df", idf.alias("idf"), F.col("n").alias("n_docs"), (F.col("dls") / F.col("n")).alias("avgdl"))


def term_idf(corpus: DataFrame, text: str = "text", epsilon: float = EPSILON) -> DataFrame:
    """(term, df, idf) of the whole vocabulary; negative values replaced."""
    return _idf(_vocabulary(corpus, text), epsilon).select("term", "df", "idf")


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def contributions(queries: DataFrame, corpus: DataFrame, id: str = "chunk_id", text: str = "text", k1: float = K1, b: float = B, epsilon: float = EPSILON, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, value): what each shared term adds to a document's score.

    Statistics are those of ``corpus``; only documents of ``allowed`` (default: all) are scored.
    The texts are read once for the vocabulary's statistics and once for term counts.
    """
    asked = _asked(queries)
    docs = (corpus if allowed is None else allowed).select(id, tokens(F.col(text)).alias("toks")).select(id, F.size("toks").alias("dl"), F.explode("toks").alias("term"))
    tf = docs.join(asked.select("term").distinct(), "term", "left_semi").groupBy(id, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighted = tf.join(_idf(_vocabulary(corpus, text), epsilon), "term").select("term", id, weight.alias("w"))
    return weighted.join(asked, "term").select("query_id", id, (F.col("qtf") * F.col("w")).alias("value"))


def score(queries: DataFrame, corpus: DataFrame, id: str = "chunk_id", text: str = "text", **parameters) -> DataFrame:
    """(query_id, id, score) of every query and document that share a term."""
    return contributions(queries, corpus, id, text, **parameters).groupBy("query_id", id).agg(F.sum("value").alias("score"))


class TermTable:
    """Weights of (term, query), dense in blocks of queries that ROOM allows."""

    def __init__(self, rows: list[tuple], queries: list) -> None:
        place = {q: i for i, q in enumerate(queries)}
        by_query: list[list[tuple[str, float]]] = [[] for _ in queries]
        for q, term, weight in rows:
            by_query[place[q]].append((term, weight))
        self.blocks, start = [], 0
        while start < len(queries):
            terms, end = dict.fromkeys(t for t, _ in by_query[start]), start + 1
            while end < len(queries) and (end + 1 - start) * (len(terms) + len(by_query[end])) <= ROOM:
                terms |= dict.fromkeys(t for t, _ in by_query[end])
                end += 1
            index = {t: i for i, t in enumerate(terms)}
            q, t, w = zip(*((i - start, index[t], w) for i in range(start, end) for t, w in by_query[i]), strict=True) if terms else ((), (), ())
            self.blocks.append((queries[start:end], index, np.array(q, np.int64), np.array(t, np.int64), np.array(w, np.float64)))
            start = end


def _best(ids: list, scores: np.ndarray, k: int) -> list[int]:
    """Positions of the k best, ties by id; all that tie with the k-th are compared."""
    near = np.nonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])[0] if len(scores) > k else np.arange(len(scores))
    return sorted(near.tolist(), key=lambda j: (-scores[j], ids[j] is None, ids[j]))[:k]


def _scored(corpus: DataFrame, table: TermTable, query_type: T.DataType, k: int, id: str, text: str, k1: float, b: float, avgdl: float) -> DataFrame:
    """(query_id, id, score): of each Arrow batch of documents the best k of every query."""
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([T.StructField("query_id", query_type), T.StructField(id, corpus.schema[id].dataType), T.StructField("score", T.DoubleType())])
    query_kind, blocks = to_arrow_type(query_type), table.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, index, q, t, w in blocks:
                weights = np.zeros((len(index), len(names)))
                weights[t, q] = w
                step = max(1, ROOM // max(1, len(names)))
                for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                    ids, toks = part.column(0).to_pylist(), part.column(1)
                    at = np.asarray(toks.offsets)
                    words = toks.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
                    known = np.array([index.get(x, -1) for x in words.dictionary.to_pylist()] or [-1], dtype=np.int64)
                    term = known[np.asarray(words.indices)] if len(words) else np.zeros(0, np.int64)
                    dl = np.diff(at).astype(float)
                    doc = np.repeat(np.arange(len(ids)), np.diff(at))[term >= 0]
                    pair, tf = np.unique(doc * max(1, len(index)) + term[term >= 0], return_counts=True)
                    doc, term = np.divmod(pair, max(1, len(index)))
                    value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / avgdl)) if len(pair) else np.zeros(0)
                    scores = np.zeros((len(ids), len(names)))
                    some = max(1, ROOM // max(1, len(names)))  # pairs whose rows of weights fit at once
                    for i in range(0, len(pair), some):
                        rows, first = np.unique(doc[i : i + some], return_index=True)
                        scores[rows] += np.add.reduceat(value[i : i + some, None] * weights[term[i : i + some]], first, axis=0)
                    scores = np.round(scores, DIGITS)
                    out_q, out_d, out_s = [], [], []
                    for j, name in enumerate(names):
                        best = _best(ids, scores[:, j], k)
                        out_q += [name] * len(best)
                        out_d += [ids[i] for i in best]
                        out_s += scores[best, j].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(out_q, query_kind), pa.array(out_d, batch.schema.field(0).type), pa.array(out_s, pa.float64())], ["query_id", id, "score"])

    return corpus.select(id, tokens(F.col(text)).alias("toks")).mapInArrow(run, schema)


def search(queries: DataFrame, corpus: DataFrame, k: int = 10, id: str = "chunk_id", text: str = "text", family: str | None = None, family_column: str = "family", k1: float = K1, b: float = B, epsilon: float = EPSILON, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, id, score): the best ``k`` documents of each query, zero scores included.

    ``family`` filters before ranking; statistics stay those of the whole corpus.  Every row of
    ``corpus`` is a document of its own.  Equal scores rank by id.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if not 0 <= b <= 1 or k1 < 0 or epsilon < 0:
        raise ValueError("need k1 >= 0, 0 <= b <= 1 and epsilon >= 0")
    for frame, names in ((queries, ("query_id", "query")), (corpus, (id, text, *([] if family is None else [family_column])))):
        for c in names:
            if c not in frame.columns:
                raise ValueError(f"no column {c!r}")
    if (queries.agg(F.sum(F.octet_length("query"))).first()[0] or 0) > query_bytes:
        from evidara.operators.inverted import InvertedIndex
        from evidara.sources.store import new_path

        facet = None if family is None else family_column
        return InvertedIndex.build(corpus, new_path(corpus.sparkSession, "bm25"), id, text, facet, k1=k1, b=b, epsilon=epsilon).search(queries, k, family)
    allowed = corpus if family is None else corpus.where(F.col(family_column) == family)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id).asc_nulls_last())
    every = queries.select("query_id").distinct()
    known = _asked(queries).join(_idf(_vocabulary(corpus, text), epsilon), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), "avgdl")
    asked = every.join(known, "query_id", "left").collect()  # bounded by the queries' bytes
    avgdl = next((r["avgdl"] for r in asked if r["term"] is not None), 1.0)
    table = TermTable([(r["query_id"], r["term"], r["w"]) for r in asked if r["term"] is not None], list(dict.fromkeys(r["query_id"] for r in asked)))
    found = _scored(allowed, table, queries.schema["query_id"].dataType, k, id, text, k1, b, avgdl)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", id, "score")


ship_by_value(__name__)
