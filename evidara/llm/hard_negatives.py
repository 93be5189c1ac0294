"""Hard-negative mining by norm-bucketed search.

For every anchor the positives are its best ``n_positives`` other rows of the same label; for every
anchor and positive the hard negatives are the best ``n_negatives`` rows of other labels whose
score lies in a window below the positive's.  A score is the integer inner product of vectors whose
components became ``floor(scale * x)``; higher scores come first, ties by smaller id.

Both searches are one scan.  Candidates are dealt by a hash of their row into stripes, each sorted by
descending norm; anchors, in blocks of at most ``BLOCK``, meet every stripe.  A task streams its stripe
in buckets of ``BUCKET`` rows.  A bucket's first norm times the anchor's norm bounds all its scores
(Cauchy-Schwarz); where that is below the lower limit of every window of an anchor, or below the score of
its running k-th negative, the anchor skips the bucket, and where all anchors do, the rest of the
stripe, whose norms are smaller still.  The bound is exact, so nothing is lost; on vectors of
one length, like the embeddings here, it prunes next to nothing.  A task holds its anchors and one bucket,
never a stripe, a label or a group of copies.  A stripe and anchor yield at most ``n_negatives`` rows a
positive, which a window then ranks.

Rows with a null label, a null vector, or a null or non-finite component (also after scaling) take no
part.  Rows are told apart by their place, so a repeated row is a row of its own, also a positive
of its copy.  A null id is no anchor, comes last among ties and is returned as null.  Vectors of different
lengths are scored over their common components.  Anchors without a positive or a fitting negative give no row;
neither do empty tables.  Only the three named columns are read, so others can't clash.
Vectors so long that a score might not fit a long are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.llm.common import materialize, ship_by_value, tidy

BLOCK = 32_768  #: anchors that a task holds, some 40 MB at 64 dimensions
STRIPE = 262_144  #: candidates that a task streams, more or less
FEW = 2_048  #: candidates that aren't worth a task of their own
BUCKET = 2_048  #: candidates that are scored, or skipped, together
CHUNK = 256  #: anchors scored against a bucket at once, 4 MB of scores
NO_ID = np.iinfo(np.int64).max  #: stands for a null id, after all others
NEVER = -(1 << 62)  #: below every score


def _rows(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components as doubles (nulls as NaN), the row of each, and the rows' lengths."""
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    wide = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    return values, np.repeat(np.arange(len(column)), wide), wide


def matrix(column: pa.ListArray, scale: int) -> np.ndarray:
    """The scaled, floored vectors; shorter ones end in zeros."""
    values, row, wide = _rows(column)
    width = int(wide.max()) if len(wide) else 0
    values = np.floor(scale * values)
    if len(wide) and (wide == width).all():
        return values.reshape(len(wide), width)
    out = np.zeros((len(wide), width))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(wide) - wide, wide)] = values
    return out


def usable(vectors: DataFrame, id: str, label: Column, vector: str, scale: int) -> DataFrame:
    """(id, label, square, vector) of the rows that take part; square is the scaled vector's squared length."""
    kind = vectors.schema[vector].dataType
    schema = T.StructType([T.StructField(c, t) for c, t in (("id", T.LongType()), ("label", T.LongType()), ("square", T.DoubleType()), ("vector", kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.compute.and_(b.column(1).is_valid(), b.column(2).is_valid()))
            values, row, _ = _rows(b.column(2))
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(scale * values)
            whole = np.bincount(row, weights=~np.isfinite(scaled), minlength=b.num_rows) == 0
            with np.errstate(over="ignore", invalid="ignore"):
                square = np.bincount(row, weights=np.where(np.isfinite(scaled), scaled, 0) ** 2, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(square.astype(float), pa.float64()), b.column(2)], schema.names).filter(pa.array(whole, pa.bool_()))

    return vectors.select(F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("vector")).mapInArrow(tidy(run), schema)


class Anchors:
    """The anchors of a cell with their windows and the best found so far of each window."""

    def __init__(self, tables: list[pa.Table], k: int, scale: int, same: bool) -> None:
        t = pa.concat_tables(tables).combine_chunks()
        self.k, self.same, self.scale = k, same, scale
        self.row, self.label = (t.column(c).to_numpy() for c in ("row", "label"))
        self.length = np.sqrt(t.column("square").to_numpy())
        self.vectors = matrix(t.column("vector").chunk(0) if t.num_rows else t.column("vector").combine_chunks(), scale)
        given = t.column("positives").to_pylist()
        self.windows = 1 if same else max((len(x) for x in given), default=0)
        shape = (t.num_rows, self.windows)
        self.low, self.high = np.full(shape, NEVER), np.full(shape, -NEVER)
        if not same:  # 30 * positive <= 100 * negative <= 90 * positive, in whole numbers
            self.low, self.high = np.full(shape, 1), np.zeros(shape, np.int64)
            for i, row in enumerate(given):
                for j, p in enumerate(row):
                    self.low[i, j], self.high[i, j] = -(-3 * p["score"] // 10), 9 * p["score"] // 10
        self.open = self.low <= self.high
        self.score = np.repeat((self.low - 1)[..., None], k, axis=2)
        self.id = np.full((*shape, k), NO_ID)
        self.of_label = {x: np.nonzero(self.label == x)[0] for x in np.unique(self.label)} if same else {}

    def wanted(self, label) -> np.ndarray:
        """Positions of the anchors that a run of candidates may serve; one label a run where labels must agree."""
        return self.of_label.get(label, np.zeros(0, np.int64)) if self.same else np.arange(len(self.row))

    def least(self, at: np.ndarray) -> np.ndarray:
        """The score below which a candidate is of no use to an anchor: each window's limit or k-th score."""
        need = np.where(self.open[at], np.maximum(self.low[at], self.score[at, :, -1]), -NEVER)
        return need.min(axis=1) if self.windows else np.full(len(at), -NEVER)

    def active(self, at: np.ndarray, longest: float) -> np.ndarray:
        """Those whose Cauchy-Schwarz bound against the bucket reaches what they need."""
        return at[self.length[at] * longest * (1 + 1e-9) + 1 >= self.least(at)]

    def meet(self, at: np.ndarray, bucket: pa.RecordBatch) -> None:
        ids = bucket.column("id").fill_null(NO_ID).to_numpy()
        rows, labels = bucket.column("row").to_numpy(), bucket.column("label").to_numpy()
        block = matrix(bucket.column("vector"), self.scale)
        wide = min(block.shape[1], self.vectors.shape[1])
        block, longest = block[:, :wide], np.sqrt(bucket.column("square").to_numpy().max())
        for i in range(0, len(at), CHUNK):
            some = at[i : i + CHUNK]
            own = self.vectors[some, :wide]
            if self.length[some].max() * longest < 2.0**52:  # sums are exact in doubles
                scores = (own @ block.T).astype(np.int64)
            else:
                scores = own.astype(np.int64) @ block.T.astype(np.int64)
            a, c = np.nonzero(scores >= self.least(some)[:, None])
            ok = rows[c] != self.row[some[a]] if self.same else labels[c] != self.label[some[a]]
            a, c = a[ok], c[ok]
            s, anchor = scores[a, c], some[a]
            for w in range(self.windows):
                fit = (s >= np.maximum(self.score[anchor, w, -1], self.low[anchor, w])) & (s <= self.high[anchor, w])
                if fit.any():
                    self._offer(anchor[fit], w, s[fit], ids[c[fit]])

    def _offer(self, anchor: np.ndarray, w: int, s: np.ndarray, ids: np.ndarray) -> None:
        """Merge new rows with the best of their anchors' window."""
        k, touched = self.k, np.unique(anchor)
        a = np.concatenate([np.repeat(touched, k), anchor])
        s = np.concatenate([self.score[touched, w].reshape(-1), s])
        ids = np.concatenate([self.id[touched, w].reshape(-1), ids])
        order = np.lexsort((ids, -s, a))
        first = np.searchsorted(a[order], touched)
        keep = order[(first[:, None] + np.arange(k)).reshape(-1)]
        self.score[touched, w], self.id[touched, w] = s[keep].reshape(-1, k), ids[keep].reshape(-1, k)

    def found(self) -> Iterator[pa.RecordBatch]:
        """(row, window, score, id) of all that was found."""
        for i in range(0, len(self.row), 4096):
            part = slice(i, i + 4096)
            a, w, r = np.nonzero(self.score[part] >= self.low[part][..., None])
            ids = self.id[part][a, w, r]
            yield pa.RecordBatch.from_arrays([pa.array(self.row[part][a]), pa.array(w.astype(np.int32)), pa.array(self.score[part][a, w, r]), pa.array(ids, mask=ids == NO_ID)], ["row", "window", "score", "id"])


def scan(anchors: DataFrame, rows: DataFrame, n_rows: int, n_anchors: int, k: int, scale: int, same: bool) -> DataFrame:
    """(row, window, score, id): of each anchor's window the best k of every stripe."""
    spark = rows.sparkSession
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stripes = max(1, min(cores, -(-n_rows // FEW)), -(-n_rows // STRIPE))
    blocks = max(1, -(-n_anchors // BLOCK))
    deal = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["row", "id", "label", "square", "vector"]
    none = F.lit(None).cast(anchors.schema["positives"].dataType)
    left = anchors.select(*columns, "positives", F.lit(0).alias("kind"), deal(blocks, 1).alias("b"), every(stripes).alias("s"))
    right = rows.select(*columns, none.alias("positives"), F.lit(1).alias("kind"), every(blocks).alias("b"), deal(stripes, 2).alias("s"))
    both = left.unionByName(right).withColumn("cell", F.col("b") * stripes + F.col("s")).drop("b", "s")
    run_of = ["label"] if same else []
    dealt = both.repartition(stripes * blocks, "cell").sortWithinPartitions("cell", "kind", *run_of, F.col("square").desc(), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, state, done, wanted = None, [], None, None, None
        for b in batches:
            keys = np.stack([b.column("cell").to_numpy(), b.column("kind").to_numpy(), b.column("label").to_numpy() if same else np.zeros(b.num_rows, np.int64)])
            cuts = [0, *(np.nonzero((np.diff(keys) != 0).any(axis=0))[0] + 1).tolist(), b.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                c, kind, label = keys[:, start].tolist()
                if c != cell:
                    if state is not None:
                        yield from state.found()
                    cell, waiting, state, done = c, [], None, None
                if kind == 0:
                    waiting.append(pa.Table.from_batches([b.slice(start, end - start)]))
                    continue
                if state is None:
                    if not waiting:
                        continue  # no anchor in this block
                    state, waiting = Anchors(waiting, k, scale, same), []
                if done == label:
                    continue  # the rest of the run is too short for every anchor
                wanted = state.wanted(label)
                for i in range(start, end, BUCKET):
                    bucket = b.slice(i, min(BUCKET, end - i))
                    near = state.active(wanted, float(np.sqrt(bucket.column("square")[0].as_py())))
                    if not len(near):
                        done = label
                        break
                    state.meet(near, bucket)
        if state is not None:
            yield from state.found()

    return dealt.mapInArrow(tidy(run), "row long, window int, score long, id long")


def mine(vectors: DataFrame, is_anchor: Column, id: str = "vec_id", label: Column | str = "label", vector: str = "embedding", n_positives: int = 5, n_negatives: int = 10, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``id``, an integer column.  ``label`` is a column or its name, of integers.
    """
    if n_positives < 1 or n_negatives < 1 or scale < 1:
        raise ValueError("n_positives, n_negatives and scale must be positive")
    label = F.col(label) if isinstance(label, str) else label
    marked = vectors.select(F.col(id), label.alias("_label"), F.col(vector))
    rows = materialize(usable(marked, id, F.col("_label"), vector, scale).withColumn("row", F.monotonically_increasing_id()))
    # The condition names the id by its own name; the result of the scan calls it id.
    asked = rows.withColumnRenamed("id", id).where(is_anchor).withColumnRenamed(id, "id").withColumn("positives", F.lit(None).cast("array<struct<score: bigint, id: bigint>>"))
    n_rows, longest = rows.agg(F.count(F.lit(1)), F.max("square")).first()
    if (longest or 0) >= 2.0**59:
        raise ValueError("vectors are too long for scores to be longs")
    n_anchors = asked.count()
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    best = scan(asked, rows, n_rows, n_anchors, n_positives, scale, True).withColumn("nth", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("nth") <= n_positives)
    listed = best.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "score", "id"))), lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias("positives"))
    ready = materialize(asked.drop("positives").join(listed, "row"))
    found = scan(ready, rows, n_rows, n_anchors, n_negatives, scale, False)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row", "window").orderBy(*order))).where(F.col("rank") <= n_negatives)
    out = ranked.withColumnRenamed("id", "negative_id").join(ready.select("row", F.col("id").alias("anchor_id"), "positives"), "row")
    positive = F.get("positives", F.col("window"))
    return out.select("anchor_id", positive["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))


ship_by_value(__name__)
