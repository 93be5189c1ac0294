"""Stored inverted index for BM25 with block maxima.

One pass over the texts inverts them inside the tasks, without a shuffle: a task collects documents until a
shard is full (SHARD_DOCS documents, SHARD_TOKENS tokens or WORDS words, one facet a shard) or all that are open hold
OPEN_BYTES, which closes the largest; documents come in batches of BATCH_BYTES and a shard is written some terms at a time, so
that a task holds little besides; a shard has a vocabulary of its own, numbers its documents by id, and
writes each term's postings into the folder of the term's bucket, in blocks of BLOCK with their range of documents
and the largest frequency and smallest length among them, which bound every impact in the block whatever the
parameters are.  Searches read the blocks of the asked terms alone, never a text.

A shard is searched as one task for a block of queries.  It is cut into windows of WINDOW documents.  The
bounds of the blocks that have documents in a window bound every score in it; windows are met in order of
their bounds, and a query skips a window whose bound is below its k-th score so far; frequencies in
windows that all queries skip are never looked at.  The bound is exact, so
nothing is lost.  It prunes well for queries of few or rare terms and little for long ones: with items of some
38 words no bound by window can, since some document of a window has each frequent term often.

Scores are those of ``lexical.search``: rounded to six digits, ties by id, documents without a shared term
score zero.  A negative weight, possible in tiny corpora only, switches the bounds off for its block of queries.

Nulls: a null text has no terms; null ids come last; a null facet is a facet.  Every row is a document of its
own.  An empty corpus finds nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.functions.plan import batches_of
from evidara.functions.ship import ship_by_value
from evidara.functions.text import tokens
from evidara.operators.dense import arrow_type
from evidara.operators.lexical import DIGITS, EPSILON, K1, B
from evidara.sources.store import stored

SHARD_DOCS, SHARD_TOKENS = 32_768, 2_000_000  #: a shard is closed when it reaches one of them; some 50 MB when it is written, up to 200 when it is searched by a full block
DOCS_AT_ONCE, TOKENS_AT_ONCE = 64, 262_144  #: documents, or their tokens, between two looks at the limits
WORDS = 1_000_000  #: different words of a shard, counted anew in each of its pieces
OPEN_BYTES, PIECE_BYTES = 48 << 20, 2_048  #: what all open shards of a task hold, whatever the number of facets, and a piece's share besides its tokens
BATCH_BYTES = 8 << 20  #: of tokens that a task of the build gets at once, one document at least; Spark's default is 64 MB, and two batches are held
BLOCK, WINDOW = 128, 128
PAIRS_AT_ONCE = 262_144  #: tokens of a shard whose postings are made, or bounds taken, at once, one term at least
BLOCKS_A_BATCH = 8_192
BUCKETS, DOCS = 16, -1  #: folders of postings by a hash of the term, and the folder of the documents
QUERIES, QUERY_WEIGHTS = 512, 16_384  #: about so many queries, and terms of queries, make a block; their product bounds its weights, 64 MB
SLACK = 10.0**-DIGITS  #: scores this near may be equal when rounded


class Shard:
    """Documents of one facet that a task is collecting: ids, numbers of tokens, and pieces of tokens, each with its own vocabulary."""

    def __init__(self, facet) -> None:
        self.facet, self.ids, self.lengths, self.tokens, self.size, self.words, self.bytes = facet, [], [], [], 0, 0, 0

    def add(self, ids: list, lengths: np.ndarray, tokens: pa.DictionaryArray | np.ndarray) -> None:
        """``tokens`` may be numbers of one vocabulary, too."""
        self.ids += ids
        self.lengths.append(lengths)
        self.tokens.append(tokens)
        self.size += len(tokens)
        self.words += len(tokens.dictionary) if isinstance(tokens, pa.DictionaryArray) else 0
        self.bytes += tokens.nbytes + PIECE_BYTES

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.size >= SHARD_TOKENS or self.words >= WORDS

    def numbered(self) -> pa.Array:
        """The vocabulary of all pieces, whose tokens become its numbers."""
        merged = pa.chunked_array(self.tokens).unify_dictionaries()
        self.tokens = [np.asarray(c.indices) for c in merged.chunks]
        return merged.chunk(0).dictionary

    def rows(self, shard: int, words: pa.Array | list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The documents in order of their ids, then the blocks of postings in order of their terms."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.string())
        n, length = len(self.ids), np.concatenate(self.lengths)
        order = np.array(sorted(range(n), key=lambda i: (self.ids[i] is None, self.ids[i])))
        place = np.empty(n, np.int32)
        place[order] = np.arange(n)
        docs = {"id": pa.array([self.ids[i] for i in order], schema.field("id").type), "pos": pa.array(range(n), pa.int32()), "length": pa.array(length[order].astype(np.int32))}
        yield self._batch(shard, n, docs, schema)
        pair, at, doc = np.empty(self.size, np.int64), 0, 0
        for lengths in self.lengths:
            some = self.tokens.pop(0)
            own = pair[at : at + len(some)]
            np.multiply(some, n, out=own, dtype=np.int64)
            own += np.repeat(place[doc : doc + len(lengths)], lengths)
            at, doc = at + len(some), doc + len(lengths)
            del some
        pair.sort()
        length, at = length[order].astype(np.int32), 0
        while at < len(pair):
            end = len(pair)
            if at + PAIRS_AT_ONCE < end:  # where a term begins, the next one's if this is a single term
                term = pair[at + PAIRS_AT_ONCE] // n
                end = np.searchsorted(pair, term * n)
                end = end if end > at else np.searchsorted(pair, (term + 1) * n)
            for made in postings(pair[at:end], n, length):
                made["term"] = words.take(pa.array(made["term"])).cast(schema.field("term").type)
                yield self._batch(shard, len(made["term"]), made, schema)
            at = end

    def _batch(self, shard: int, n: int, made: dict, schema: pa.Schema) -> pa.RecordBatch:
        made |= {"shard": pa.array([shard] * n, pa.int64()), "facet": pa.array([self.facet] * n, schema.field("facet").type)}
        return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(n, f.type) for f in schema], schema=schema)


def postings(pair: np.ndarray, n: int, length: np.ndarray) -> Iterator[dict]:
    """Blocks of the postings of some terms, from all their tokens in order as ``term * n + place``; ``length`` by place."""
    new = np.ones(len(pair), bool)
    new[1:] = pair[1:] != pair[:-1]
    each = np.nonzero(new)[0].astype(np.int32)
    tf, pair = np.diff(each, append=np.int32(len(pair))), pair[each]
    term, pos = (pair // n).astype(np.int32), (pair % n).astype(np.int32)
    del pair, each, new
    start = np.nonzero(np.diff(term, prepend=np.int32(-1)))[0].astype(np.int32)
    inside = np.arange(len(term), dtype=np.int32) - np.repeat(start, np.diff(start, append=len(term)))
    first = np.nonzero(inside % BLOCK == 0)[0]
    del inside
    ends, near = np.append(first, len(term)), length[pos]
    for i in range(0, len(first), BLOCKS_A_BATCH):
        own = ends[i : i + BLOCKS_A_BATCH + 1]
        a, z = own[0], own[-1]
        lists = lambda x: pa.ListArray.from_arrays(pa.array((own - a).astype(np.int32)), pa.array(x[a:z]))  # noqa: B023, E731
        most, least = (f.reduceat(x[a:z], own[:-1] - a) for f, x in ((np.maximum, tf), (np.minimum, near)))
        yield {"most_tf": pa.array(most), "least_length": pa.array(least), "term": term[own[:-1]], "docs": lists(pos), "tfs": lists(tf), "lengths": lists(near)}


def pieces(lists: pa.ListArray, facets: list) -> Iterator[tuple[object, list[int], np.ndarray, pa.DictionaryArray]]:
    """(facet, rows, numbers of tokens, tokens) of a few documents of one facet."""
    rows_of: dict = {}
    for i, f in enumerate(facets):
        rows_of.setdefault(f, []).append(i)
    length = np.diff(np.asarray(lists.offsets).astype(np.int64))
    for f, rows in rows_of.items():
        before = np.cumsum(length[rows]) - length[rows]
        ends = np.diff(np.arange(len(rows)) // DOCS_AT_ONCE) + np.diff(before // TOKENS_AT_ONCE)
        for some in np.split(np.array(rows), np.nonzero(ends)[0] + 1):
            own = lists.take(pa.array(some))
            yield f, some.tolist(), length[some], own.flatten().dictionary_encode()


def shards(batches: Iterator[pa.RecordBatch], number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of all shards, numbered from ``number`` + 1, of documents (id, facet, tokens)."""
    open_: dict = {}
    held = 0

    def closed(shard: Shard) -> Iterator[pa.RecordBatch]:
        nonlocal number, held
        number, held = number + 1, held - shard.bytes
        yield from shard.rows(number, shard.numbered(), schema)
        pa.default_memory_pool().release_unused()

    for b in batches:
        ids = b.column(0).to_pylist()
        for f, rows, lengths, tokens in pieces(b.column(2), b.column(1).to_pylist()):
            shard = open_.setdefault(f, Shard(f))
            held -= shard.bytes
            shard.add([ids[r] for r in rows], lengths, tokens)
            held += shard.bytes
            if shard.full():
                yield from closed(open_.pop(f))
            while held > OPEN_BYTES:
                yield from closed(open_.pop(max(open_, key=lambda x: open_[x].bytes)))
    while open_:
        yield from closed(open_.popitem()[1])


def inverted(corpus: DataFrame, id: str, text: str, facet: str | None) -> DataFrame:
    """Rows of documents (shard, facet, id, pos, length) and of blocks (shard, facet, term, docs, tfs, lengths, most_tf, least_length)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ints, kind = T.ArrayType(T.IntegerType()), T.StringType() if facet is None else corpus.schema[facet].dataType
    types = [("shard", T.LongType()), ("facet", kind), ("id", corpus.schema[id].dataType), ("pos", T.IntegerType()), ("length", T.IntegerType()), ("term", T.StringType()), ("docs", ints), ("tfs", ints), ("lengths", ints), ("most_tf", T.IntegerType()), ("least_length", T.IntegerType())]
    schema = T.StructType([T.StructField(c, t) for c, t in types])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from shards(batches, TaskContext.get().partitionId() << 32, arrow)

    wanted = corpus.select(F.col(id).alias("id"), (F.lit(None).cast("string") if facet is None else F.col(facet)).alias("facet"), tokens(F.col(text)).alias("toks"))
    return wanted.mapInArrow(run, schema)


class Searcher:
    """A shard's blocks of the terms of a block of queries, and the search in it."""

    def __init__(self, blocks: pa.Table, weights: list[dict], n_docs: int, impact) -> None:
        self.n = n_docs
        self.queries = list(dict.fromkeys(x["q"] for x in weights))
        own = set(blocks.column("term").unique().to_pylist())  # the shard's, no others have a place in the matrix
        terms = {t: i for i, t in enumerate(dict.fromkeys(x["term"] for x in weights if x["term"] in own))}
        self.weight = np.zeros((len(self.queries), len(terms)))
        row = {q: i for i, q in enumerate(self.queries)}
        for x in weights:
            if x["term"] in terms:
                self.weight[row[x["q"]], terms[x["term"]]] = x["w"]
        self.windows = -(-n_docs // WINDOW)
        self.most = np.zeros((len(terms), self.windows))
        name = pc.index_in(blocks.column("term"), pa.array(list(terms), blocks.schema.field("term").type)).to_numpy()
        size, docs = pc.list_value_length(blocks.column("docs")).to_numpy(), pc.list_flatten(blocks.column("docs")).to_numpy()
        window = (docs // WINDOW).astype(np.min_scalar_type(self.windows + 1))
        block_most = impact(blocks.column("most_tf").to_numpy(), blocks.column("least_length").to_numpy())
        at, step = np.append(0, np.cumsum(size)), max(1, PAIRS_AT_ONCE // BLOCK)
        for i in range(0, len(size), step):  # some blocks at a time, as each of their documents takes a row here
            some, pairs = slice(i, i + step), slice(at[i], at[min(i + step, len(size))])
            np.maximum.at(self.most, (np.repeat(name[some], size[some]), window[pairs]), np.repeat(block_most[some], size[some]))
        order = np.argsort(window, kind="stable")
        self.cut = np.searchsorted(window[order], np.arange(self.windows + 1, dtype=window.dtype))
        self.docs, self.term, self.impact = docs[order], np.repeat(name, size)[order], impact
        self.tf, self.length = (pc.list_flatten(blocks.column(c)).to_numpy()[order] for c in ("tfs", "lengths"))

    def search(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every query the k best (score, place; place ``n`` where there are fewer), and the windows it met."""
        n_q = len(self.queries)
        score, place, met = np.full((n_q, k), -np.inf), np.full((n_q, k), self.n, np.int64), np.zeros(n_q, np.int64)
        bound = self.weight @ self.most
        if (self.weight < 0).any():
            bound = np.full_like(bound, np.inf)
        best_bound = bound.max(axis=0) if n_q else np.zeros(self.windows)
        for w in np.lexsort((np.arange(self.windows), -best_bound)).tolist():
            last, tie = score[:, -1], bound[:, w] <= 0
            # a window that can only tie with the last place matters where its ids are smaller
            use = np.nonzero(np.where(tie, (last < 0) | ((last <= SLACK) & (w * WINDOW < place[:, -1])), bound[:, w] >= last - SLACK))[0]
            if not len(use):
                continue
            met[use] += 1
            a, z = self.cut[w], self.cut[w + 1]
            terms, column = np.unique(self.term[a:z], return_inverse=True)
            dense = np.zeros((min(WINDOW, self.n - w * WINDOW), len(terms)))
            dense[self.docs[a:z] - w * WINDOW, column] = self.impact(self.tf[a:z], self.length[a:z])
            own = np.round(self.weight[np.ix_(use, terms)] @ dense.T, DIGITS) + 0.0
            ids = np.broadcast_to(np.arange(w * WINDOW, w * WINDOW + own.shape[1]), own.shape)
            both, where = np.concatenate([score[use], own], axis=1), np.concatenate([place[use], ids], axis=1)
            order = np.lexsort((where, -both), axis=-1)[:, :k]
            score[use], place[use] = np.take_along_axis(both, order, 1), np.take_along_axis(where, order, 1)
        return score, place, met


def _bucket() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


def _raw_idf(terms: DataFrame, n: int) -> DataFrame:
    return terms.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))


class InvertedIndex:
    """docs (shard, facet, pos, id), postings (bucket, shard, facet, term, ...), terms (term, df), shards (shard, facet, n).

    ``k1``, ``b`` and ``epsilon`` belong to the search, not to what is stored.
    """

    def __init__(self, spark: SparkSession, path: str, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> None:
        if not 0 <= b <= 1 or k1 < 0 or epsilon < 0:
            raise ValueError("need k1 >= 0, 0 <= b <= 1 and epsilon >= 0")
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        self.spark, self.path, self.k1, self.b = spark, path, k1, b
        self.about = json.loads(spark.read.text(f"{path}/about").first()[0])
        both = spark.read.schema(T.StructType.fromJson(self.about["schema"])).parquet(f"{path}/inverted")
        self.shards = read("shards")
        self.docs = both.where(F.col("bucket") == DOCS).select("shard", "facet", "pos", "id")
        self.postings = both.where(F.col("bucket") != DOCS)
        self.id = self.about["id"]
        raw = _raw_idf(read("terms"), self.about["n_docs"])
        self.terms = raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(epsilon * self.about["mean_raw"])).otherwise(F.col("raw")).alias("idf"))

    @classmethod
    def build(cls, corpus: DataFrame, path: str, id: str = "chunk_id", text: str = "text", facet: str | None = None, **parameters: float) -> InvertedIndex:
        """Write the index of ``corpus`` to ``path``; ``about`` is written last and marks it as whole."""
        spark = corpus.sparkSession
        bucket = F.when(F.col("pos").isNotNull(), F.lit(DOCS)).otherwise(_bucket())
        rows = inverted(corpus, id, text, facet).withColumn("bucket", bucket).sortWithinPartitions("bucket", "term", "pos")
        with batches_of(spark, BATCH_BYTES):
            rows.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/inverted")
        both = spark.read.schema(rows.schema).parquet(f"{path}/inverted")
        docs = both.where(F.col("bucket") == DOCS)
        docs.groupBy("shard", "facet").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")).write.parquet(f"{path}/shards")
        both.where(F.col("bucket") != DOCS).groupBy("term").agg(F.sum(F.size("docs")).alias("df")).write.parquet(f"{path}/terms")
        n, length = spark.read.parquet(f"{path}/shards").agg(F.sum("n"), F.sum("tokens")).first()
        n = n or 0
        mean = _raw_idf(spark.read.parquet(f"{path}/terms"), n).agg(F.avg("raw")).first()[0]
        about = json.dumps({"id": id, "n_docs": n, "avgdl": (length or 0) / n if n else 0.0, "mean_raw": mean or 0.0, "schema": rows.schema.jsonValue()})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/about")
        return cls(spark, path, **parameters)

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, int]:
        """(q, qb, term, w) of every query, with a null term where it has none that is known, and the number of blocks.

        Queries are dealt into blocks by a hash; ``q`` is the query's id.
        """
        every = queries.select("query_id", tokens(F.col("query")).alias("toks"))
        n, terms = every.select(F.countDistinct("query_id"), F.sum(F.size(F.array_distinct("toks")))).first()
        blocks = max(1, -(-(n or 0) // QUERIES), -(-(terms or 0) // QUERY_WEIGHTS))
        asked = every.select("query_id", F.explode_outer("toks").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
        known = asked.join(self.terms.select("term", "idf"), "term", "left")
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
        rows = known.select(F.col("query_id").alias("q"), block.alias("qb"), F.when(F.col("idf").isNotNull(), F.col("term")).alias("term"), (F.col("qtf") * F.col("idf")).alias("w"))
        return stored(rows.distinct()), blocks

    def walks(self, queries: DataFrame, k: int = 10, facet=None) -> DataFrame:
        """(query_id, shard, windows, met, places, scores): of every query and shard the k best."""
        if k <= 0:
            raise ValueError("k must be positive")
        kind = queries.schema["query_id"].dataType
        types = [("query_id", kind), ("shard", T.LongType()), ("windows", T.IntegerType()), ("met", T.IntegerType()), ("places", T.ArrayType(T.IntegerType())), ("scores", T.ArrayType(T.DoubleType()))]
        schema = T.StructType([T.StructField(c, t) for c, t in types])
        own = lambda df: df if facet is None else df.where(F.col("facet") == facet)
        asked, n_blocks = self._asked(queries)
        wanted = asked.where("term is not null").select("qb", "term", _bucket().alias("bucket")).distinct()
        folders = [r[0] for r in wanted.select("bucket").distinct().collect()]  # at most BUCKETS
        read = own(self.postings).where(F.col("bucket").isin(folders)).join(wanted, ["bucket", "term"])
        left = read.select("shard", "qb", "term", "docs", "tfs", "lengths", "most_tf", "least_length")
        blocks = asked.groupBy("qb").agg(F.collect_list(F.struct("q", "term", "w")).alias("weights"))  # a block has a bounded size
        pairs = own(self.shards).select(F.col("shard"), "n", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("qb"))
        right = pairs.join(blocks, "qb")

        k1, b, average = self.k1, self.b, self.about["avgdl"] or 1.0

        def impact(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
            return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows:
                return pa.Table.from_batches([], schema=arrow)
            s = Searcher(left, right.column("weights")[0].as_py(), right.column("n")[0].as_py(), impact)
            score, place, met = s.search(k)
            real = place < s.n
            out = [s.queries, [right.column("shard")[0].as_py()] * len(met), [s.windows] * len(met), met.tolist(), [p[r].tolist() for p, r in zip(place, real, strict=True)], [x[r].tolist() for x, r in zip(score, real, strict=True)]]
            return pa.Table.from_arrays([pa.array(x, arrow_type(t)) for x, (_, t) in zip(out, types, strict=True)], schema.names)

        arrow = pa.schema([(c, arrow_type(t)) for c, t in types])
        return left.groupBy("shard", "qb").cogroup(right.groupBy("shard", "qb")).applyInArrow(run, schema)

    def search(self, queries: DataFrame, k: int = 10, facet=None) -> DataFrame:
        """(query_id, rank, id, score): the best ``k`` documents, of one facet if given, zero scores included."""
        return self.ranked(self.walks(queries, k, facet), k)

    def ranked(self, walks: DataFrame, k: int) -> DataFrame:
        rows = walks.select("query_id", "shard", F.explode(F.arrays_zip("places", "scores")).alias("r")).select("query_id", "shard", F.col("r.places").alias("pos"), F.col("r.scores").alias("score"))
        by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc())
        near = rows.withColumn("_r", F.rank().over(by_score)).where(F.col("_r") <= k).drop("_r")  # all that tie with the k-th
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        named = near.join(self.docs.select("shard", "pos", "id"), ["shard", "pos"])
        return named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(self.id), "score")


ship_by_value(__name__)
