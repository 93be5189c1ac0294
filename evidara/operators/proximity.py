"""Approximate nearest neighbours by navigable proximity graphs, one a shard.

Rows are dealt into shards by a hash.  A task links each vector of its shard to its ``m`` nearest, by
distance, and back, keeps the nearest ``2 m`` of these links, and joins what is still apart, so that a graph
is one piece.  A hash of the vector gives it a level, one in ``m`` of each level going up another; every level has
links of its own.  Equal vectors are one node with several ids, so copies don't shut
themselves off.  The graph is stored as rows: a node with its vector, its ids, its radius and its links a level.

With ``across`` (the default) a node is linked across the shards, too: to its ``m`` nearest of the whole corpus.  That
compares all pairs, as nothing else finds the nearest of vectors that lie far from each other in all directions: blocks of
nodes stay in their tasks and all nodes stream past, so a task's memory is bounded, while the time is quadratic.

A search for a vector that is indexed starts at its node and scores the nodes linked to it across the shards, in
their shards.  These hold all that is nearer than the last of them, so where the ``k`` best are, no shard is walked.

All other searches walk every shard, from the linked nodes, too, if there are any.  A walk starts from all nodes of the top level and walks each level best first: the nearest node not yet
expanded scores its unseen neighbours, and the walk ends when that node is farther than the last of the ``ef``
best.  It also ends, exactly, as soon as a node has been expanded whose ``m`` nearest enclose the query with all its
``ef`` best: whatever is nearer than the node's radius, the distance of its ``m``-th nearest, is among its links.
What a query found in all shards is merged.  Scores are exact inner products, rounded and tied as in
exact search; only which rows are met is approximate.  Walks go by distance, which for vectors of one
length is the order of inner products.

A shard's rows come first and stay in its task; queries stream past them, any number.  Shards have a bounded
size, so building costs a bounded number of products a row, but for the links across shards.

Null vectors are not indexed and not searched for; null ids come last among ties; an empty corpus finds nothing.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.functions.plan import union
from evidara.functions.ship import ship_by_value
from evidara.operators import dense
from evidara.operators.dense import DIGITS, arrow_type, matrix_of
from evidara.sources import store

M, EF, SHARD_ROWS = 32, 64, 16_384
SLACK = 1e-6  #: room for rounded distances where a walk ends
BLOCK = 1024  #: rows whose distances to their shard are computed at once
WALKS = 128  #: queries of a shard that are worth a task of their own
TIE = 4 * 10.0**-DIGITS  #: squared distances this close may have scores that round to one


def halved(vectors: np.ndarray, last: np.ndarray | float) -> np.ndarray:
    """Vectors one longer: ``[q, 1]`` and ``[c, -c . c / 2]`` have the largest product where the distance is smallest."""
    return np.concatenate([vectors, np.broadcast_to(last, len(vectors))[:, None]], axis=1)


def half_square(vectors: np.ndarray) -> np.ndarray:
    return 0.5 * (vectors * vectors).sum(axis=1)


def others(best: dense._Best, own: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the first ``m`` kept without the places in ``own``, the queries' own."""
    order = np.argsort(best.place == own[:, None], axis=1, kind="stable")[:, :m]
    return np.take_along_axis(best.place, order, axis=1), np.take_along_axis(best.score, order, axis=1)


def nearest(vectors: np.ndarray, members: np.ndarray, m: int) -> np.ndarray:
    """Positions in ``vectors`` of the ``m`` members nearest to each member, nearest first, fewer if there are fewer."""
    own, count, places = vectors[members], min(m, len(members) - 1), np.arange(len(members))
    half, out = half_square(own), np.zeros((len(members), max(count, 0)), np.int64)
    if np.isfinite(half).all():
        best = dense._Best(len(own), count + 1, len(own), None)
        best.meet(halved(own, 1.0), halved(own, -half), places)
        out = others(best, places, count)[0]
        if (out < len(own)).all():
            return members[out]
    for i in range(0, len(own), BLOCK):  # numbers too large to order
        near = own[i : i + BLOCK] @ own.T - half
        near[np.arange(len(near)), np.arange(i, i + len(near))] = -np.inf
        best = np.argpartition(-near, count - 1, axis=1)[:, :count] if count else np.zeros((len(near), 0), np.int64)
        order = np.argsort(-np.take_along_axis(near, best, axis=1), axis=1, kind="stable")
        out[i : i + BLOCK] = np.take_along_axis(best, order, axis=1)
    return members[out]


def pieces(links: dict[int, list[int]]) -> list[list[int]]:
    """Connected pieces of a graph whose links go both ways."""
    seen, out = set(), []
    for start in links:
        if start in seen:
            continue
        seen.add(start)
        piece = [start]
        for node in piece:
            for other in links[node]:
                if other not in seen:
                    seen.add(other)
                    piece.append(other)
        out.append(piece)
    return out


def linked(vectors: np.ndarray, members: np.ndarray, m: int) -> dict[int, list[int]]:
    """Links of a level: the nearest ones, both ways, cut to ``2 m`` nearest a node, then one piece made of all."""
    near = nearest(vectors, members, m)
    links: dict[int, set[int]] = {int(x): set(near[i].tolist()) for i, x in enumerate(members)}
    for i, x in enumerate(members):
        for other in near[i, : (m + 1) // 2].tolist():
            links[other].add(int(x))
    half, kept = 0.5 * (vectors * vectors).sum(axis=1), {}
    for node, others in links.items():
        o = np.fromiter(others, np.int64, len(others))
        kept[node] = o.tolist() if len(o) <= 2 * m else o[np.argsort(half[o] - vectors[o] @ vectors[node], kind="stable")[: 2 * m]].tolist()
    both = {node: list(others) for node, others in kept.items()}
    for node, others in kept.items():
        for other in others:
            both[other].append(node)
    while len(parts := pieces(both)) > 1:
        for part in sorted(parts, key=len)[:-1]:  # a piece is linked to the node outside that is nearest to its first
            inside = set(part)
            rest = np.array([x for x in members.tolist() if x not in inside])
            x, y = part[0], int(rest[np.argmax(vectors[rest] @ vectors[part[0]] - half[rest])])
            for a, b in ((x, y), (y, x)):
                kept[a].append(b)
                both[a].append(b)
    return kept


def built(vectors: np.ndarray, m: int) -> list[list[list[int]]]:
    """For each node its links by level; every node has level 0."""
    u = np.array([(zlib.crc32(v.tobytes()) + 1) / 2.0**32 for v in vectors])
    level = np.floor(-np.log(u) / math.log(m)).astype(int) if len(u) else np.zeros(0, int)
    out: list[list[list[int]]] = [[] for _ in vectors]
    for up in range(int(level.max(initial=-1)) + 1):
        members = np.nonzero(level >= up)[0]
        links = linked(vectors, members, m)
        for node in members.tolist():
            out[node].append(sorted(links[node]))
    return out


def radii(vectors: np.ndarray, m: int) -> np.ndarray:
    """For each node the distance of its ``m``-th nearest, which level 0 links; infinite where all others are linked."""
    if len(vectors) <= m + 1:
        return np.full(len(vectors), np.inf)
    out = np.zeros(len(vectors))
    last = nearest(vectors, np.arange(len(vectors)), m)[:, -1]
    for i in range(0, len(vectors), BLOCK):
        out[i : i + BLOCK] = np.linalg.norm(vectors[i : i + BLOCK] - vectors[last[i : i + BLOCK]], axis=1)
    return out


class Graph:
    """A shard's nodes, ready to be scored, and to be walked once a walk is asked for."""

    def __init__(self, nodes: pa.Table) -> None:
        nodes = nodes.sort_by("node").combine_chunks()
        self.vectors = matrix_of(nodes.column("vector"))
        self.names = dense.flat(nodes.column("ids"))
        self.nodes, self.links = nodes, None

    def _open(self) -> None:
        self.half = 0.5 * (self.vectors * self.vectors).sum(axis=1)
        self.radius = self.nodes.column("radius").to_numpy()
        self.ids = self.names.to_pylist()
        links = self.nodes.column("links").to_pylist()
        self.top = max(map(len, links)) - 1
        self.entries = np.array([i for i, x in enumerate(links) if len(x) - 1 == self.top])
        self.links = [{i: np.array(x[level], np.int64) for i, x in enumerate(links) if len(x) > level} for level in range(self.top + 1)]
        self.seen = np.zeros(len(links), np.int64)
        self.turn = 0

    def scored(self, queries: pa.Array, nodes: pa.Array) -> tuple[list[int], pa.Array, pa.Array]:
        """For each query the number of its ``nodes``, their ids and scores; both are list columns."""
        numbers = pc.list_value_length(nodes).to_numpy()
        query, at = np.repeat(np.arange(len(nodes)), numbers), np.asarray(nodes.flatten())
        scores = np.round(np.einsum("ij,ij->i", matrix_of(queries)[query], self.vectors[at]), DIGITS) + 0.0
        names = self.names.take(pa.array(at))
        copies = pc.list_value_length(names).to_numpy()
        ends = np.concatenate([[0], np.cumsum(np.bincount(query, copies, len(nodes)))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, x) for x in (names.flatten(), pa.array(np.repeat(scores, copies)))]
        return numbers.tolist(), *lists

    def walk(self, q: np.ndarray, ef: int, also: np.ndarray) -> tuple[list[int], int]:
        """The ``ef`` nearest nodes that a walk finds, ``also`` from some on level 0, and how many different vectors it scored."""
        if self.links is None:
            self._open()
        known: dict[int, float] = {}

        def score(at: np.ndarray) -> np.ndarray:
            out = self.vectors[at] @ q - self.half[at]
            known.update(zip(at.tolist(), out.tolist(), strict=True))
            return out

        start, length = self.entries, float(q @ q)
        distance = lambda s: math.sqrt(max(0.0, length - 2 * s))
        score(start)
        for level in range(self.top, -1, -1):
            if level == 0 and len(also):
                score(also)
                start = np.union1d(start, also)
            self.turn += 1
            self.seen[start] = self.turn
            best = heapq.nlargest(ef, ((known[i], i) for i in start.tolist()))
            waiting = [(-s, i) for s, i in best]
            heapq.heapify(waiting)
            heapq.heapify(best)
            while waiting:
                far, node = heapq.heappop(waiting)
                if len(best) >= ef and -far < best[0][0]:
                    break
                near = self.links[level][node]
                near = near[self.seen[near] != self.turn]
                self.seen[near] = self.turn
                fresh = np.array([i for i in near.tolist() if i not in known], np.int64)
                if len(fresh):
                    score(fresh)
                for i in near.tolist():
                    s = known[i]
                    if len(best) < ef:
                        heapq.heappush(best, (s, i))
                        heapq.heappush(waiting, (-s, i))
                    elif s > best[0][0]:
                        heapq.heapreplace(best, (s, i))
                        heapq.heappush(waiting, (-s, i))
                if level == 0 and len(best) >= ef and distance(-far) + distance(best[0][0]) < self.radius[node] - SLACK:
                    break
            start = np.array([i for _, i in best])
        return start.tolist(), len(known)

    def search(self, q: np.ndarray, k: int, ef: int, also: np.ndarray) -> tuple[list, list[float], int]:
        nodes, scored = self.walk(q, max(k, ef), also)
        scores = np.round(self.vectors[nodes] @ q, DIGITS).tolist()
        rows = [(s, x) for s, node in zip(scores, nodes, strict=True) for x in self.ids[node][:k]]  # a node's ids are in order
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1]))
        return [x for _, x in rows[:k]], [s for s, _ in rows[:k]], scored


def across(rows: DataFrame, m: int) -> DataFrame:
    """(shard, node, near, far, reach): of every node itself and the ``m`` nearest of all shards.

    ``near`` has their places by shard, ``far`` the ascending squared distances of the ``m``, ``reach`` is the last of these,
    or infinite where all others are there.  A block of nodes stays in its task, and all nodes stream past it.
    """
    n, wide = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks = dense.blocks_of(n, wide or 1, rows)
    every = rows.select((F.shiftleft(F.col("shard").cast("long"), 32) + F.col("node")).alias("code"), "vector")
    asked = every.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int"))
    schema = T.StructType.fromDDL("shard int, node int, near array<struct<shard:int,nodes:array<int>>>, far array<double>, reach double")

    def found(codes: np.ndarray, vectors: np.ndarray, best: dense._Best) -> pa.RecordBatch:
        place, score = others(best, codes, m)
        real = place < best.none
        square = np.maximum(2 * (half_square(vectors)[:, None] - score), 0.0)
        reach = np.full(len(codes), np.inf)
        if n > m + 1:  # what isn't finite reaches nothing
            reach = np.where(real.all(axis=1) & np.isfinite(square[:, -1]), square[:, -1], 0.0)
        near = np.sort(np.concatenate([codes[:, None], place], axis=1), axis=1)
        kept = near < best.none
        row, near = np.nonzero(kept)[0], near[kept]
        shard = near >> 32
        first = np.nonzero(np.diff(row, prepend=-1) | np.diff(shard, prepend=-1))[0]
        nodes = pa.ListArray.from_arrays(np.append(first, len(near)).astype(np.int32), pa.array((near & 0xFFFFFFFF).astype(np.int32)))
        places = pa.StructArray.from_arrays([pa.array(shard[first].astype(np.int32)), nodes], ["shard", "nodes"])
        ends = lambda x, many: np.searchsorted(x, np.arange(many + 1)).astype(np.int32)
        near = pa.ListArray.from_arrays(ends(row[first], len(codes)), places)
        far = pa.ListArray.from_arrays(ends(np.nonzero(real)[0], len(codes)), pa.array(square[real]))
        own = [pa.array(x.astype(np.int32)) for x in (codes >> 32, codes & 0xFFFFFFFF)]
        return pa.RecordBatch.from_arrays([*own, near, far, pa.array(reach)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, codes, vectors, best = None, None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            for i in range(0, 0 if best is None else len(codes), BLOCK):
                yield found(codes[i : i + BLOCK], vectors[i : i + BLOCK], best.part(i, i + BLOCK))

        for now, piece in dense.meetings(batches, dense.BLOCK_BYTES):
            if now is not block:
                yield from done()
                block, codes, vectors = now, now.column("code").to_numpy(), matrix_of(now.column("vector"))
                asks, best = halved(vectors, 1.0), dense._Best(len(codes), m + 1, np.iinfo(np.int64).max, None)
            v = matrix_of(piece.column("vector"))
            best.meet(asks, halved(v, -half_square(v)), piece.column("code").to_numpy())
        yield from done()

    return dense.streamed(asked, every, blocks).mapInArrow(run, schema)


class GraphIndex:
    """Rows (shard, node, ids, radius, vector, links, near, far, reach) of the graphs, the last three linking across shards.

    ``id`` and ``vector`` name the corpus' columns.
    """

    def __init__(self, rows: DataFrame, id: str = "vec_id", vector: str = "embedding") -> None:
        self.rows, self.id, self.vector = rows, id, vector

    @classmethod
    def build(cls, corpus: DataFrame, id: str = "vec_id", vector: str = "embedding", m: int = M, shard_rows: int = SHARD_ROWS, across_shards: bool = True) -> GraphIndex:
        if m < 2 or shard_rows < 1:
            raise ValueError("m must be 2 or more and shard_rows positive")
        rows = corpus.select(F.col(id).alias("id"), F.col(vector).alias("vector")).where("vector is not null")
        copies = F.array_sort(F.collect_list(F.struct(F.isnull("id").alias("none"), "id")))  # null ids last
        points = store.stored(rows.groupBy("vector").agg(F.transform(copies, lambda x: x["id"]).alias("ids")))
        shards = max(1, -(-points.count() // shard_rows))
        id_type, kind = corpus.schema[id].dataType, corpus.schema[vector].dataType
        types = [("shard", T.IntegerType()), ("node", T.IntegerType()), ("ids", T.ArrayType(id_type)), ("radius", T.DoubleType()), ("vector", kind), ("links", T.ArrayType(T.ArrayType(T.IntegerType())))]
        schema = T.StructType([T.StructField(c, t) for c, t in types])

        def run(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            every = matrix_of(table.column("vector"))
            order = np.lexsort(every.T[::-1])  # whatever order the shuffle left
            vectors, table = every[order], table.take(pa.array(order))
            shard = [table.column("shard")[0].as_py()] * len(vectors)
            made = [pa.array(list(c), arrow_type(t)) for c, t in ((shard, types[0][1]), (range(len(vectors)), types[1][1]), (radii(vectors, m).tolist(), types[3][1]), (built(vectors, m), types[5][1]))]
            return pa.Table.from_arrays([made[0], made[1], table.column("ids"), made[2], table.column("vector"), made[3]], schema.names)

        dealt = points.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
        graphs = dealt.groupBy("shard").applyInArrow(run, schema)
        if across_shards:
            graphs = store.stored(graphs)
            graphs = graphs.join(across(graphs, m), ["shard", "node"])
        return cls(graphs, id, vector)

    def save(self, path: str, mode: str = "error") -> GraphIndex:
        self.rows.write.mode(mode).option("compression", "zstd").parquet(path)
        return GraphIndex.load(self.rows.sparkSession, path, self.id, self.vector)

    @classmethod
    def load(cls, spark: SparkSession, path: str, id: str = "vec_id", vector: str = "embedding") -> GraphIndex:
        return cls(spark.read.parquet(path), id, vector)

    def walks(self, queries: DataFrame, k: int = 5, ef: int = EF) -> DataFrame:
        """(query_id, scored, ids, scores): of every query and shard the best k and the number of vectors scored."""
        if k <= 0 or ef <= 0:
            raise ValueError("k and ef must be positive")
        spark, id_type = self.rows.sparkSession, queries.schema["query_id"].dataType
        shards = (self.rows.agg(F.max("shard")).first()[0] or 0) + 1
        single = all(x.schema[c].dataType == T.ArrayType(T.FloatType(), x.schema[c].dataType.containsNull) for x, c in ((self.rows, "vector"), (queries, self.vector)))
        wide = lambda c: F.col(c).cast("array<float>" if single else "array<double>").alias("vector")
        asked = queries.select("query_id", wide(self.vector)).where("vector is not null")
        cores = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
        parts = max(1, min(-(-cores // shards), -(-asked.count() // WALKS)))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        null = lambda t: F.lit(None).cast(t)
        none = lambda t: F.array().cast(t)  # noqa: E731  null lists make the size check of Arrow batches quadratic
        left = self.rows.select("shard", every(parts).alias("part"), F.lit(0).alias("kind"), "node", F.slice("ids", 1, k).alias("ids"), "radius", wide("vector"), "links", null(id_type).alias("query_id"), none("array<int>").alias("nodes"), F.lit(False).alias("walk"))
        visit = lambda shard, nodes, walk: F.struct(shard.alias("shard"), nodes.alias("nodes"), F.lit(walk).alias("walk"))
        walked = lambda nodes: F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda x: visit(x, nodes(x), True))
        visits = walked(lambda x: none("array<int>"))
        if "near" in self.rows.columns:
            homes = self.rows.select(wide("vector"), "near", "far", "reach").withColumn("hash", F.xxhash64("vector"))
            asked = asked.withColumn("hash", F.xxhash64("vector")).join(homes, ["hash", "vector"], "left")
            last = F.element_at(F.concat(F.array(F.lit(0.0)), "far"), F.least(F.lit(k), F.size("far") + 1))
            here = lambda x: F.coalesce(F.get(F.filter("near", lambda y: y["shard"] == x), F.lit(0))["nodes"], none("array<int>"))
            near = F.transform("near", lambda x: visit(x["shard"], x["nodes"], False))
            visits = F.when(last + TIE < F.col("reach"), near).otherwise(walked(here))  # a stranger has no reach
        place = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
        right = asked.select("query_id", "vector", place.alias("part"), F.explode(visits).alias("visit"))
        right = right.select("visit.shard", "part", F.lit(1).alias("kind"), null("int").alias("node"), none(left.schema["ids"].dataType).alias("ids"), null("double").alias("radius"), "vector", none(left.schema["links"].dataType).alias("links"), "query_id", "visit.nodes", "visit.walk")
        dealt = union(left, right).withColumn("cell", F.col("shard") * parts + F.col("part")).repartitionById(shards * parts, "cell").sortWithinPartitions("cell", "kind", "node")
        types = [("query_id", id_type), ("scored", T.IntegerType()), ("ids", self.rows.schema["ids"].dataType), ("scores", T.ArrayType(T.DoubleType()))]
        schema = T.StructType([T.StructField(c, t) for c, t in types])
        kinds = [arrow_type(t) for _, t in types]

        def answered(graph: Graph, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            walk = part.column("walk")
            at_home, walking = part.filter(pc.invert(walk)), part.filter(walk)
            for i in range(0, at_home.num_rows, BLOCK):
                some = at_home.slice(i, BLOCK)
                numbers, ids, scores = graph.scored(some.column("vector"), some.column("nodes"))
                yield pa.RecordBatch.from_arrays([some.column("query_id"), pa.array(numbers, kinds[1]), ids.cast(kinds[2]), scores.cast(kinds[3])], schema.names)
            if walking.num_rows:
                also = [np.array(x, np.int64) for x in walking.column("nodes").to_pylist()]
                found = [graph.search(q, k, ef, x) for q, x in zip(matrix_of(walking.column("vector")), also, strict=True)]
                out = [walking.column("query_id").to_pylist(), [f[2] for f in found], [f[0] for f in found], [f[1] for f in found]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], schema.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell, nodes, graph = None, [], None
            for b in batches:
                keys = np.stack([b.column("cell").to_numpy(), b.column("kind").to_numpy()])
                cuts = [0, *(np.nonzero((np.diff(keys) != 0).any(axis=0))[0] + 1).tolist(), b.num_rows]
                for start, end in zip(cuts, cuts[1:], strict=False):
                    if start == end:
                        continue
                    c, kind = keys[:, start].tolist()
                    if c != cell:
                        cell, nodes, graph = c, [], None
                    part = b.slice(start, end - start)
                    if kind == 0:
                        nodes.append(part)
                        continue
                    if graph is None:
                        if not nodes:
                            continue  # an empty shard
                        graph, nodes = Graph(pa.Table.from_batches(nodes)), []
                    yield from answered(graph, part)

        return dealt.mapInArrow(run, schema)

    def search(self, queries: DataFrame, k: int = 5, ef: int = EF) -> DataFrame:
        """(query_id, rank, id, score): the k best that the walks of all shards found."""
        return ranked(self.walks(queries, k, ef), k, self.id)


def ranked(walks: DataFrame, k: int, id: str) -> DataFrame:
    rows = walks.select("query_id", F.explode(F.arrays_zip("scores", "ids")).alias("r")).select("query_id", F.col("r.ids").alias(id), F.col("r.scores").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id).asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", id, "score")


def walk_report(walks: DataFrame, exact: DataFrame, k: int, id: str = "vec_id") -> DataFrame:
    """One row: n exact neighbours, hits among them, recall, and the mean number of vectors scored a query."""
    hits = exact.select("query_id", id).join(ranked(walks, k, id).select("query_id", id).withColumn("hit", F.lit(1)), ["query_id", id], "left")
    scored = walks.groupBy("query_id").agg(F.sum("scored").alias("scored")).agg(F.avg("scored").alias("mean_scored"))
    found = hits.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"))
    return found.crossJoin(F.broadcast(scored)).select("n", "hits", F.bround(F.col("hits") / F.col("n"), 4).alias("recall"), "mean_scored")  # one row each


ship_by_value(__name__)
