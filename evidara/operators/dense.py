"""Dense vectors: encoding, exact nearest neighbours, an inverted-file index, audits.

Exact search streams the corpus once in Arrow batches; each batch multiplies with the block of
query vectors in numpy and keeps its best k for each query in two arrays, so the shuffle carries k rows a
query and batch.  More queries than one block stay in a table: a task holds a block of them, past which the
corpus streams in pieces.  Ranks use scores rounded to six digits, then the id, so engines agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.functions.plan import union
from evidara.functions.ship import ship_by_value
from evidara.functions.text import dot, hash_embedding, norm

DIGITS = 6
ROW_BLOCK, QUERY_STEP = 4096, 512  #: corpus rows and queries scored at once, 8 MB of scores in single precision
QUERY_BLOCK = 4096  #: query vectors that travel with the tasks at most, or whose best rows a task holds at once
CARRIED_BYTES = 32 << 20  #: of query vectors that travel with the tasks at most
PIECE_BYTES, BLOCK_BYTES = 64 << 20, 16 << 20  #: vectors of the corpus and of the queries that a task holds where queries stay in a table


def embed(df: DataFrame, text: str = "text", encoder: Callable[[Column], Column] | None = None, out: str = "embedding", is_query: bool = False, prefix: bool = False) -> DataFrame:
    """Add an L2-normalised vector; ``encoder`` maps a text column to one (default: hashing).

    ``prefix`` puts ``query: `` or ``passage: `` before the text, as E5 models want it.
    """
    c = F.col(text)
    if prefix:
        c = F.concat(F.lit("query: " if is_query else "passage: "), c)
    return df.withColumn(out, (encoder or hash_embedding)(c))


#: Metadata of a vector-store document.
PAYLOAD = ("chunk_id", "family", "indicator_code", "indicator_name", "block_type", "page_start", "page_end")


def _payload(chunks: DataFrame) -> Column:
    meta = F.struct(*[F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in PAYLOAD])
    return F.struct(F.coalesce("text", F.lit("")).alias("page_content"), meta.alias("metadata"))


def payloads(chunks: DataFrame) -> DataFrame:
    """(document): chunks as struct<page_content, metadata>; absent columns are null."""
    return chunks.select(_payload(chunks).alias("document"))


def vector_store(chunks: DataFrame, text: str = "text", encoder: Callable[[Column], Column] | None = None) -> DataFrame:
    """(chunk_id, family, document, embedding) of chunks; ``sources.tables.save_index`` keeps it, by family if wanted."""
    return embed(chunks, text, encoder).select("chunk_id", F.col("family") if "family" in chunks.columns else F.lit(None).cast("string").alias("family"), _payload(chunks).alias("document"), "embedding")


def quick_query(queries: DataFrame, store: DataFrame, k: int = 5, family: str | None = None, encoder: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, rank, score, document): the k nearest documents of each query text, of one family if given."""
    found = search(embed(queries, "query", encoder), store if family is None else store.where(F.col("family") == family), k, "chunk_id")
    return found.join(store.select("chunk_id", "document"), "chunk_id").select("query_id", "rank", "score", "document")


def dimension(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(dim, n) of the vectors; one row means that all have one dimension."""
    return vectors.groupBy(F.size(column).alias("dim")).agg(F.count(F.lit(1)).alias("n"))


def norm_audit(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    n = vectors.select(norm(F.col(column)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("n_vectors"), F.bround(F.min("n"), DIGITS).alias("min_norm"), F.bround(F.max("n"), DIGITS).alias("max_norm"), F.bround(F.avg("n"), DIGITS).alias("mean_norm"))


def validate(vectors: DataFrame, column: str = "embedding") -> int:
    """The common dimension; ValueError if there are no vectors or several dimensions."""
    dims = [r["dim"] for r in dimension(vectors, column).limit(2).collect()]
    if len(dims) != 1 or dims[0] <= 0:
        raise ValueError(f"vectors must be non-empty and of one dimension, found {dims}")
    return dims[0]


def positions(corpus: DataFrame, id: str, start: int = 0) -> DataFrame:
    """(pos, id): consecutive positions in id order, for callers that need integer handles.

    Ranges of ids, their counts, then offsets: no single task sorts the corpus.  The ranges are cut
    at fixed quantiles, so a recomputed partition falls into the same ones.
    """
    parts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = corpus.select(id)
    cuts = [r[0] for r in ids.where(F.col(id).isNotNull()).orderBy(F.xxhash64(id), id).limit(20 * parts).orderBy(id).collect()]  # a bounded sample decides only on balance
    cuts = sorted(set(cuts[20::20]))
    part = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(id))), F.lit(0)) if cuts else F.lit(0)
    ranged = ids.withColumn("part", F.when(F.col(id).isNull(), -1).otherwise(part))
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(id))
    return ranged.withColumn("i", inside).join(F.broadcast(before), "part").select((F.col("before") + F.col("i") - 1 + start).alias("pos"), id)  # a row a range


def resolve(positions_: DataFrame, wanted: DataFrame, id: str) -> DataFrame:
    """Names of positions; unknown ones become UNKNOWN."""
    return wanted.join(positions_, "pos", "left").withColumn(id, F.coalesce(F.col(id).cast("string"), F.lit("UNKNOWN")))


def matrix_of(column) -> np.ndarray:
    """The vectors of an Arrow list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(column.flatten(), dtype=np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _longest(vectors: np.ndarray) -> float:
    return float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max(initial=0.0)))


class _Best:
    """Of each query the ``k`` rows of the largest rounded inner product among those met so far.

    Rows are met by place, their order in ids, so that of equal scores the first met is the one to keep.
    The state is two arrays of ``k`` a query, whatever the number of rows.
    """

    def __init__(self, n_queries: int, k: int, n_rows: int, digits: int | None = DIGITS) -> None:
        """``digits``: to which the scores are rounded; None leaves them as they are."""
        self.k, self.none, self.digits = k, n_rows, digits
        self.room = 0.0 if digits is None else 10.0**-digits  # for rounding
        self.score, self.place = np.full((n_queries, k), -np.inf), np.full((n_queries, k), n_rows, np.int64)

    def meet(self, queries: np.ndarray, rows: np.ndarray, places: np.ndarray, own: np.ndarray | None = None) -> None:
        """Score the queries numbered ``own`` (default: all), whose vectors are ``queries``, with some rows.

        Products in single precision, with a bound on their error, tell which rows may be among the best; those alone
        are scored in double precision.
        """
        far, wide = _longest(queries), _longest(rows)
        single = len(rows) > 4 * self.k and far * wide < 1e30  # False for what isn't finite, too
        if single:
            queries32, rows32 = queries.astype(np.float32), rows.astype(np.float32)
            slack = (queries.shape[1] + 8) * 2.0**-23 * far * wide + 1e-30  # rounded inputs, products, sums and limit
        for at in range(0, len(queries), QUERY_STEP):
            numbers, asks = np.arange(len(queries))[at : at + QUERY_STEP], queries[at : at + QUERY_STEP]
            numbers = numbers if own is None else own[numbers]
            waiting: list[tuple] = []
            for i in range(0, len(rows), ROW_BLOCK):
                some, at_places = rows[i : i + ROW_BLOCK], places[i : i + ROW_BLOCK]
                last = self.score[numbers, -1] - self.room
                scores = queries32[at : at + QUERY_STEP] @ rows32[i : i + ROW_BLOCK].T if single else asks @ some.T
                query, column = self._reaching(scores, last, slack if single else 0.0)
                if single and 8 * len(query) > scores.size:  # many ties: whole products take less memory
                    scores = asks @ some.T
                    query, column = self._reaching(scores, last, 0.0)
                    waiting.append((query, scores[query, column], at_places[column]))
                elif single:
                    exact = np.einsum("ij,ij->i", asks[query], some[column])
                    kept = exact >= last[query]
                    waiting.append((query[kept], exact[kept], at_places[column[kept]]))
                else:
                    waiting.append((query, scores[query, column], at_places[column]))
                if sum(len(x[0]) for x in waiting) >= self.k * len(numbers):  # the limits rise as rows are kept
                    self._keep(numbers, waiting)
                    waiting = []
            self._keep(numbers, waiting)

    def _reaching(self, scores: np.ndarray, last: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of queries and columns whose scores, wrong by up to ``slack``, may reach the queries' limits."""
        last = last - slack
        if scores.shape[1] > self.k and np.isneginf(last).any():
            known = scores if slack else np.where(np.isnan(scores), -np.inf, scores)
            last = np.maximum(last, np.partition(known, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k] - self.room - 2 * slack)
        hit = (scores >= last.astype(scores.dtype)[:, None]).reshape(-1)
        if hit.size % 8 == 0:  # few hits: look for them eight at a time
            eights = np.flatnonzero(hit.view(np.uint64))
            at = (8 * eights[:, None] + np.arange(8)).reshape(-1)[hit.reshape(-1, 8)[eights].reshape(-1)]
        else:
            at = np.flatnonzero(hit)
        return np.divmod(at, scores.shape[1])

    def _keep(self, numbers: np.ndarray, waiting: list[tuple]) -> None:
        if not sum(len(x[0]) for x in waiting):
            return
        query, values, places = (np.concatenate(x) for x in zip(*waiting, strict=True))
        values = (values if self.digits is None else np.round(values, self.digits)) + 0.0
        used, first = np.unique(query, return_inverse=True)
        held = np.repeat(np.arange(len(used)), self.k)
        row = np.concatenate([held, first.reshape(-1)])
        score = np.concatenate([self.score[numbers[used]].reshape(-1), values])
        place = np.concatenate([self.place[numbers[used]].reshape(-1), places])
        order = np.lexsort((place, -score, row))
        row = row[order]
        inside = np.arange(len(row)) - np.searchsorted(row, np.arange(len(used)))[row]
        kept = order[inside < self.k]
        self.score[numbers[used]], self.place[numbers[used]] = score[kept].reshape(-1, self.k), place[kept].reshape(-1, self.k)

    def part(self, start: int, end: int) -> _Best:
        """What was kept for the queries from ``start`` to ``end``."""
        out = _Best(0, self.k, self.none, self.digits)
        out.score, out.place = self.score[start:end], self.place[start:end]
        return out

    def found(self, names: pa.Array, ids: pa.Array) -> list[pa.Array]:
        """(query, id, score) of what was kept; ``ids`` by place."""
        real = self.place < self.none
        return [names.take(pa.array(np.nonzero(real)[0])), ids.take(pa.array(self.place[real])), pa.array(self.score[real], pa.float64())]


def _in_order(ids: pa.Array) -> np.ndarray:
    """Positions of ids in their order, nulls last."""
    return pc.sort_indices(ids, null_placement="at_end").to_numpy()


def flat(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def arrow_type(t: T.DataType):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def _found_schema(queries: DataFrame, corpus: DataFrame, id: str) -> T.StructType:
    return T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(id, corpus.schema[id].dataType), T.StructField("score", T.DoubleType())])


def _carried(rows: list, corpus: DataFrame, schema: T.StructType, k: int, id: str, vector: str) -> DataFrame:
    """One pass over the corpus with one block of query vectors in every task."""
    names, matrix = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)
    kind = arrow_type(schema["query_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(1).is_valid())  # here, as a filter in the plan would compute encoded vectors twice
            if b.num_rows:
                b = b.take(pa.array(_in_order(b.column(0))))
                best = _Best(len(names), k, b.num_rows)
                best.meet(matrix, matrix_of(b.column(1)), np.arange(b.num_rows))
                yield pa.RecordBatch.from_arrays(best.found(pa.array(names, kind), b.column(0)), schema.names)

    return corpus.select(id, vector).mapInArrow(run, schema)


def blocks_of(n_queries: int, wide: int, corpus: DataFrame) -> int:
    """Of so many queries of ``wide`` numbers: blocks of BLOCK_BYTES, or smaller ones, two a core."""
    return max(1, -(-n_queries * 8 * wide // BLOCK_BYTES), min(2 * corpus.sparkSession.sparkContext.defaultParallelism, -(-n_queries // QUERY_STEP)))


def streamed(asked: DataFrame, rows: DataFrame, blocks: int) -> DataFrame:
    """Rows of both, which have equal columns and ``asked`` a ``block``: a block's task gets its queries (``kind`` 0), then all rows (1)."""
    every = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = union(asked.withColumn("kind", F.lit(0)), every.withColumn("kind", F.lit(1)))
    return both.repartitionById(blocks, "block").sortWithinPartitions("block", "kind")


def meetings(batches: Iterator[pa.RecordBatch], bytes_: int) -> Iterator[tuple[pa.Table, pa.Table]]:
    """Of what ``streamed`` deals: a block's queries with rows whose vectors (in double precision) have about ``bytes_``, until all have met.

    Such a piece of the rows comes with the same object for the same block.
    """
    block, asked, held, size = None, None, [], 0
    for b in batches:
        keys = np.stack([b.column("block").to_numpy(), b.column("kind").to_numpy()])
        cuts = [0, *(np.nonzero((np.diff(keys) != 0).any(axis=0))[0] + 1).tolist(), b.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            (now, kind), some = keys[:, start].tolist(), b.slice(start, end - start)
            if now != block:
                if asked is not None and held:
                    yield asked, pa.Table.from_batches(held)
                block, asked, held, size = now, None, [], 0
            if kind == 1 and asked is None:
                if not held:
                    continue  # nothing is asked here
                asked, held = pa.Table.from_batches(held), []
            held.append(some)
            if kind == 1:
                size += 8 * len(some.column("vector").flatten())
                if size >= bytes_:
                    yield asked, pa.Table.from_batches(held)
                    held, size = [], 0
    if asked is not None and held:
        yield asked, pa.Table.from_batches(held)


def _blocked(queries: DataFrame, corpus: DataFrame, schema: T.StructType, k: int, id: str, vector: str) -> DataFrame:
    """Blocks of queries stay in their tasks and the corpus streams past, k rows a query and piece of the corpus.

    A row of the corpus is copied once a block (32,768 queries of 64 dimensions), a query not at all.
    """
    rows = corpus.select(F.col(id).alias("id"), F.col(vector).alias("vector")).where("vector is not null")
    asked = queries.select("query_id", F.col(vector).alias("vector")).where("vector is not null")
    n, wide = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks = blocks_of(n, wide or 1, corpus)
    single = rows.schema["vector"].dataType.elementType == asked.schema["vector"].dataType.elementType == T.FloatType()
    one = F.col("vector").cast("array<float>" if single else "array<double>").alias("vector")
    left = asked.select(F.expr(f"cast(pmod(xxhash64(query_id), {blocks}) as int)").alias("block"), "query_id", F.lit(None).cast(rows.schema["id"].dataType).alias("id"), one)
    right = rows.select(F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id"), "id", one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, piece in meetings(batches, PIECE_BYTES):
            ids = flat(piece.column("id"))
            order = _in_order(ids)
            ids, rows = ids.take(pa.array(order)), matrix_of(piece.column("vector"))[order]
            for i in range(0, block.num_rows, QUERY_BLOCK):
                some = block.slice(i, QUERY_BLOCK)
                best = _Best(some.num_rows, k, len(rows))
                best.meet(matrix_of(some.column("vector")), rows, np.arange(len(rows)))
                yield pa.RecordBatch.from_arrays(best.found(flat(some.column("query_id")), ids), schema.names)

    return streamed(left, right, blocks).mapInArrow(run, schema)


def _paired(queries: DataFrame, corpus: DataFrame, schema: T.StructType, k: int, id: str, vector: str, cell: str | None = None, n_queries: int | None = None) -> DataFrame:
    """Blocks of queries against pieces of the corpus, one pair a task; both are cut by hashes of their ids.

    A row of the corpus is copied once a block (32,768 queries of 64 dimensions), a query once a piece.

    ``cell`` is a column of the corpus whose values the queries list in ``cells``; only rows of these cells are scored.
    Without it the blocks stay where they are and all rows stream past.
    Every piece has rows of every cell, so a query is copied once a piece, not once a cell.
    """
    if cell is None:
        return _blocked(queries, corpus, schema, k, id, vector)
    rows = corpus.select(id, vector, F.col(cell).alias("cell")).where(F.col(vector).isNotNull())
    asked = queries.select("query_id", F.col(vector).alias("_q"), "cells").where(F.col("_q").isNotNull())
    n_rows, wide = rows.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    count = lambda n, most: max(1, -(-n // max(1, most // (8 * max(1, wide or 1)))))
    pieces, blocks = count(n_rows, PIECE_BYTES), count(asked.count() if n_queries is None else n_queries, BLOCK_BYTES)
    dealt = lambda c, n: F.expr(f"cast(pmod(xxhash64({c}), {n}) as int)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # rows without an id are dealt by their vector, as all of them have one hash
    left = rows.select(id, vector, "cell", F.when(F.col(id).isNull(), dealt(f"`{vector}`", pieces)).otherwise(dealt(f"`{id}`", pieces)).alias("_p"), every(blocks).alias("_b"))
    right = asked.select("query_id", "_q", "cells", dealt("query_id", blocks).alias("_b"), every(pieces).alias("_p"))
    kinds = [arrow_type(f.dataType) for f in schema]

    def run(piece: pa.Table, block: pa.Table) -> pa.Table:
        made: list[list] = [[], [], []]
        if piece.num_rows and block.num_rows:
            ids = flat(piece.column(id))
            order = _in_order(ids)
            ids, rows = ids.take(pa.array(order)), matrix_of(piece.column(vector))[order]
            own = piece.column("cell").to_numpy()[order]
            by_cell = np.argsort(own, kind="stable")
            known, first = np.unique(own[by_cell], return_index=True)
            members = dict(zip(known.tolist(), np.split(by_cell, first[1:]), strict=True))
            for i in range(0, block.num_rows, QUERY_BLOCK):
                some = block.slice(i, QUERY_BLOCK)
                best, asks = _Best(some.num_rows, k, len(rows)), matrix_of(some.column("_q"))
                lists = flat(some.column("cells"))
                query, at = np.repeat(np.arange(some.num_rows), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()
                by_list = np.argsort(at, kind="stable")
                wanted, first = np.unique(at[by_list], return_index=True)
                for c, numbers in zip(wanted.tolist(), np.split(query[by_list], first[1:]), strict=True):
                    if c in members:
                        best.meet(asks[numbers], rows[members[c]], members[c], numbers)
                for all_, part in zip(made, best.found(flat(some.column("query_id")), ids), strict=True):
                    all_.append(part)
        return pa.Table.from_arrays([pa.chunked_array(x, kind) for x, kind in zip(made, kinds, strict=True)], schema.names)

    return left.groupBy("_p", "_b").cogroup(right.groupBy("_p", "_b")).applyInArrow(run, schema)


def _ranked(found: DataFrame, k: int, id: str) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id).asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", id, "score")


def search(queries: DataFrame, corpus: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", query_block: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): the k corpus vectors of the largest inner product.

    Up to ``query_block`` (QUERY_BLOCK, of CARRIED_BYTES) query vectors are fetched and travel with the tasks,
    one pass over the corpus; more are never fetched but dealt into blocks, past which the corpus streams.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    schema, query_block = _found_schema(queries, corpus, id), query_block or QUERY_BLOCK
    asked = queries.select("query_id", vector).where(F.col(vector).isNotNull())
    width = asked.select(F.size(vector)).first()
    query_block = min(query_block, max(1, CARRIED_BYTES // (8 * max(1, width[0] if width else 1))))
    rows = asked.limit(query_block + 1).collect()
    if not rows:
        found = corpus.sparkSession.createDataFrame([], schema)
    elif len(rows) <= query_block:
        found = _carried(rows, corpus, schema, k, id, vector)
    else:
        found = _paired(queries, corpus, schema, k, id, vector)
    return _ranked(found, k, id)


def search_expressions(queries: DataFrame, corpus: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The same by expressions alone; every pair is scored in the JVM, so only for small tables."""
    q = queries.select("query_id", F.col(vector).alias("_q"))
    pairs = corpus.select(id, vector).crossJoin(q).select("query_id", id, F.bround(dot(F.col("_q"), F.col(vector)), DIGITS).alias("score"))
    return _ranked(pairs, k, id)


def search_filtered(queries: DataFrame, corpus: DataFrame, k: int, facet: str, value, mode: str = "pre", oversample: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Search within ``facet == value``.

    ``pre`` filters before scoring and always finds k if there are k.  ``post`` keeps those of
    the unfiltered best ``oversample * k`` that pass, which may be fewer than k.
    """
    if mode == "pre":
        return search(queries, corpus.where(F.col(facet) == value), k, id, vector)
    if mode != "post":
        raise ValueError("mode must be 'pre' or 'post'")
    wide = search(queries, corpus, k * oversample, id, vector)
    passed = wide.join(corpus.where(F.col(facet) == value).select(id), id, "left_semi")
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return passed.withColumn("rank", again).where(F.col("rank") <= k).select("query_id", "rank", id, "score")


class InvertedFile:
    """Approximate search: rows are assigned to centroids, queries probe the nearest lists.

    Centroids come from k-means on at most ``sample`` vectors (documented bound); every row is
    assigned.  There are about as many lists as the square root of the number of vectors, unless
    ``lists`` says otherwise.  Scores are exact inner products, only the candidates are approximate.
    """

    def __init__(self, corpus: DataFrame, lists: int | None = None, sample: int = 20_000, rounds: int = 8, seed: int = 42, id: str = "vec_id", vector: str = "embedding"):
        self.id, self.vector = id, vector
        picked = corpus.select(vector).where(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.col(id), F.lit(seed))).limit(sample).collect()
        if not picked:
            raise ValueError("no vectors to index")
        data = np.array([r[0] for r in picked], dtype=np.float64)
        if lists is None:
            n = len(data) if len(data) < sample else corpus.where(F.col(vector).isNotNull()).count()
            lists = round(n**0.5)
        lists = max(1, min(lists, len(data)))
        self.centroids = data[:lists].copy()
        for _ in range(rounds):
            nearest = np.argmax(data @ self.centroids.T - 0.5 * (self.centroids**2).sum(axis=1), axis=1)
            for c in range(lists):
                own = data[nearest == c]
                if len(own):
                    self.centroids[c] = own.mean(axis=0)
        self.rows = self._assign(corpus.where(F.col(vector).isNotNull()), 1, id).select(id, vector, F.get("cells", F.lit(0)).alias("cell"))

    def _assign(self, df: DataFrame, n: int, key: str) -> DataFrame:
        """(key, vector, cells): the ``n`` nearest cells, nearest first."""
        centroids, vector = self.centroids, self.vector
        schema = T.StructType([df.schema[key], df.schema[vector], T.StructField("cells", T.ArrayType(T.IntegerType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (whole.slice(i, ROW_BLOCK) for whole in batches for i in range(0, whole.num_rows, ROW_BLOCK)):
                v = matrix_of(b.column(1)).reshape(b.num_rows, centroids.shape[1])
                near = np.argsort(-(v @ centroids.T - 0.5 * (centroids**2).sum(axis=1)), axis=1, kind="stable")[:, :n]
                cells = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * near.shape[1], pa.array(near.reshape(-1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cells], schema.names)

        return df.select(key, vector).mapInArrow(run, schema)

    def save(self, path: str, mode: str = "error") -> None:
        """The rows by cell, so that a search reads the probed cells' files alone."""
        self.rows.repartition("cell").write.mode(mode).partitionBy("cell").parquet(path)
        self.rows = self.rows.sparkSession.read.parquet(path).withColumn("cell", F.col("cell").cast("int"))

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None) -> DataFrame:
        """(query_id, rank, id, score); by default five eighths of the lists are probed.

        Queries list the cells that they probe and are scored with those cells' rows alone.
        """
        if k <= 0:
            raise ValueError("k must be positive")
        n = max(1, min(-(-5 * len(self.centroids) // 8) if probes is None else probes, len(self.centroids)))
        asked = self._assign(queries.where(F.col(self.vector).isNotNull()), n, "query_id")
        rows = self.rows
        if n < len(self.centroids):  # cells that no query probes needn't be read
            rows = rows.join(F.broadcast(asked.select(F.explode("cells").alias("cell")).distinct()), "cell", "left_semi")
        return _ranked(_paired(asked, rows, _found_schema(queries, rows, self.id), k, self.id, self.vector, "cell"), k, self.id)


class Cells:
    """Exact search that passes over whole cells.

    A cell is a list of an ``InvertedFile``: its centre and the largest distance of its rows from it.  No row of a
    cell scores more than ``q . centre + |q| * radius``.  Each query first searches the few cells nearest to it;
    the k-th score found there is a limit that the true k-th can't be below, so the second round takes
    the cells alone whose bound reaches the limit, and its answer is exact.  Bounds are small tables, one row a cell.
    Vectors far from each other in all directions, like random ones, leave next to nothing to pass over.
    """

    def __init__(self, file: InvertedFile):
        self.file, centroids, vector = file, file.centroids, file.vector
        self.radius = np.zeros(len(centroids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = b.column(1).to_numpy()
                far = np.linalg.norm(matrix_of(b.column(0)).reshape(len(cell), centroids.shape[1]) - centroids[cell], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(far, pa.float64())], ["cell", "far"])

        far = file.rows.select(vector, "cell").mapInArrow(run, "cell int, far double").groupBy("cell").agg(F.max("far").alias("radius"))
        for r in far.collect():  # one row a cell
            self.radius[r["cell"]] = r["radius"]

    def chosen(self, queries: DataFrame, k: int, probes: int = 2) -> DataFrame:
        """(query_id, vector, cell): the cells that each query has to search."""
        return self._chosen(queries, k, probes).select("query_id", self.file.vector, F.explode("cells").alias("cell"))

    def _chosen(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query_id, vector, cells)."""
        if k <= 0 or probes <= 0:
            raise ValueError("k and probes must be positive")
        f, centroids, radius = self.file, self.file.centroids, self.radius
        asked = queries.select("query_id", f.vector).where(F.col(f.vector).isNotNull())
        first = f.search(asked, k, probes)
        limits = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("limit"))
        schema = T.StructType([asked.schema["query_id"], asked.schema[f.vector], T.StructField("cells", T.ArrayType(T.IntegerType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (whole.slice(i, ROW_BLOCK) for whole in batches for i in range(0, whole.num_rows, ROW_BLOCK)):
                v = matrix_of(b.column(1)).reshape(b.num_rows, centroids.shape[1])
                limit = b.column(2).fill_null(-np.inf).to_numpy()
                bound = v @ centroids.T + np.linalg.norm(v, axis=1)[:, None] * radius
                row, cell = np.nonzero(bound * (1 + 1e-9) + 10.0**-DIGITS + 1e-9 >= limit[:, None])  # room for rounded scores
                ends = np.searchsorted(row, np.arange(len(v) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(cell.astype(np.int32)))], schema.names)

        return asked.join(limits, "query_id", "left").select("query_id", f.vector, "limit").mapInArrow(run, schema)

    def search(self, queries: DataFrame, k: int = 5, probes: int = 2) -> DataFrame:
        """(query_id, rank, id, score), as exact ``search`` gives them."""
        f = self.file
        chosen, n = self._chosen(queries, k, probes), queries.where(F.col(f.vector).isNotNull()).count()
        return _ranked(_paired(chosen, f.rows, _found_schema(queries, f.rows, f.id), k, f.id, f.vector, "cell", n), k, f.id)

    def report(self, chosen: DataFrame) -> DataFrame:
        """One row: queries, pairs of query and cell, and how many of them were passed over."""
        n = chosen.agg(F.countDistinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("searched"))
        pairs = F.col("n_queries") * len(self.radius)
        return n.select("n_queries", pairs.alias("pairs"), (pairs - F.col("searched")).alias("skipped"))


def recall(found: DataFrame, exact: DataFrame, id: str = "vec_id") -> DataFrame:
    """(n, hits, recall) of found pairs against the exact ones."""
    both = exact.select("query_id", id).join(found.select("query_id", id).withColumn("hit", F.lit(1)), ["query_id", id], "left")
    return both.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits")).withColumn("recall", F.bround(F.col("hits") / F.col("n"), 4))


ship_by_value(__name__)
