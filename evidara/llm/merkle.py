"""Merkle manifest of a dataset by superblock reduction.

Every row is a leaf, the SHA-256 of its columns; leaves of one group (a language) stand in order of
doc_id and are hashed together ``fanout`` at a time until one node is left, the group's subroot.  The
subroots, in order of their groups, make a tree of the same kind, whose top is the dataset's root.
A row's proof lists, level by level up to the root, the digests to its left and to its right.

A group of any size is reduced by superblocks of ``fanout ** levels`` consecutive nodes: one task
collapses a superblock by ``levels`` levels at once, the superblocks' roots are the nodes of the next
round, and a few rounds serve any number of rows (4,096 leaves a superblock: three for 10**10).
On the way back each superblock meets the proof of its own root and gives its nodes theirs, the
lower part in front of the upper one.  So no task sees more than a superblock, however large a group is, and
only one number a round reaches the driver.

Places in a group are counted in ranges of (group, doc_id, leaf) whose counts per range and group
give the offsets; a range may end within equal rows, so no key is too large for a task.

Nulls: a null column is ``-`` in the leaf; a null group is a group of its own and comes first; null
doc_ids come first in their group.  Rows with one doc_id stand in order of their leaves; equal rows
are leaves of their own.  Texts are hashed whole.  Only the columns asked for are read, so others
can't clash; an empty table gives no rows and has no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.llm.common import materialize, ship_by_value

FANOUT, LEVELS = 2, 12
PROOF = T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))


def leaf_of(columns: Sequence[Column]) -> Column:
    """SHA-256 in hex of the columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level["before"], node, level["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 in hex of all the proof's digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda level: F.concat(level["before"], level["after"])), ""), 256)


def layers(nodes: list[str], n: int, fanout: int, levels: int) -> list[list[str]]:
    """The nodes and what they become level by level, within a superblock of a group of ``n`` nodes.

    A group that fits one superblock stops where one node is left; others go up by all levels.
    """
    out, whole = [nodes], n <= fanout**levels
    for _ in range(levels):
        if whole and len(nodes) == 1:
            break
        nodes = [hashlib.sha256("".join(nodes[i : i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def beside(nodes: list[str], fanout: int) -> tuple[list[str], list[str]]:
    """For each node the digests to its left and to its right in its run."""
    before, after = [], []
    for i in range(0, len(nodes), fanout):
        run = nodes[i : i + fanout]
        before += ["".join(run[:j]) for j in range(len(run))]
        after += ["".join(run[j + 1 :]) for j in range(len(run))]
    return before, after


def proofs(nodes: list[str], n: int, upper: list[dict], fanout: int, levels: int) -> pa.Array:
    """Proofs of a superblock's nodes: their levels inside it, then those of its root."""
    import numpy as np

    lower = layers(nodes, n, fanout, levels)[:-1]
    place, left, right, columns = np.arange(len(nodes)), [], [], []
    for level in lower:
        before, after = beside(level, fanout)
        columns.append(place + len(left))
        left, right, place = left + before, right + after, place // fanout
    for level in upper:
        columns.append(np.full(len(nodes), len(left)))
        left, right = [*left, level["before"]], [*right, level["after"]]
    at = pa.array(np.stack(columns, axis=1).reshape(-1) if columns else np.zeros(0, np.int64), pa.int64())
    both = pa.StructArray.from_arrays([pa.array(x, pa.string()).take(at) for x in (left, right)], ["before", "after"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1) * len(columns), pa.int32()), both)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``g``) and their place ``idx`` in the group by ``order``, and its number of rows ``n``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, "g", *order, "_tie")
    placed = materialize(ranged.withColumn("_part", F.spark_partition_id()))  # written, so a range's number is fixed
    counts, of_group = placed.groupBy("_part", "g").agg(F.count(F.lit(1)).alias("_rows")), Window.partitionBy("g")
    earlier = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", "g", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"), F.sum("_rows").over(of_group).alias("n"))
    nth = F.row_number().over(Window.partitionBy("_part", "g").orderBy(*order, "_tie"))
    return placed.withColumn("_nth", nth).join(offsets, ["_part", "g"]).withColumn("idx", F.col("_before") + F.col("_nth") - 1).select(*rows.columns, "idx", "n")


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("idx").combine_chunks()


def collapse(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(g, idx, n, digest): the roots of the superblocks of ``nodes``, of the same columns."""

    def run(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        g, idx, n = (table.column(c)[0].as_py() for c in ("g", "idx", "n"))
        root = layers(table.column("digest").to_pylist(), n, fanout, levels)[-1][0]
        width = fanout**levels
        return pa.table({"g": pa.array([g], pa.string()), "idx": pa.array([idx // width], pa.int64()), "n": pa.array([-(-n // width)], pa.int64()), "digest": pa.array([root], pa.string())})

    blocks = nodes.select("g", "idx", "n", "digest", _block(fanout, levels)).groupBy("g", "block")
    return blocks.applyInArrow(run, "g string, idx long, n long, digest string")


def _block(fanout: int, levels: int) -> Column:
    return F.expr(f"idx div {fanout**levels}").alias("block")


def expand(nodes: DataFrame, upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` with proof, subroot and root, given those of their superblocks' roots."""
    own = nodes.select(*nodes.columns, _block(fanout, levels))
    above = upper.select("g", F.col("idx").alias("block"), "proof", "subroot", "root")
    text = [T.StructField(c, T.StringType()) for c in ("subroot", "root")]
    schema = T.StructType([*nodes.schema.fields, T.StructField("proof", PROOF), *text])

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        table = _in_order(table)
        up = above.to_pylist()[0]
        proof = proofs(table.column("digest").to_pylist(), table.column("n")[0].as_py(), up["proof"], fanout, levels)
        same = [pa.array([up[c]], pa.string()).take(pa.array([0] * table.num_rows)) for c in ("subroot", "root")]
        return pa.Table.from_arrays([*(table.column(c) for c in table.column_names if c != "block"), proof, *same], [*(c for c in table.column_names if c != "block"), "proof", "subroot", "root"])

    return own.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(run, schema)


def _rounds(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The nodes of every round, the last with one node a group."""
    out = [nodes]
    while True:
        out.append(materialize(collapse(out[-1], fanout, levels)))
        if (out[-1].agg(F.max("n")).first()[0] or 1) == 1:
            return out


def _down(rounds: list[DataFrame], upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    for nodes in reversed(rounds[:-1]):
        upper = expand(nodes, upper, fanout, levels)
    return upper


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id", keep: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(``order``, ``group``, leaf, subroot, root, proof) of every row, and the columns of ``keep``.

    ``columns`` make the leaf.  ``keep`` are further values of a row that the result shall carry, for
    example the leaf of a copy that is to be checked.
    """
    if fanout < 2 or levels < 1:
        raise ValueError("fanout must be 2 or more and levels positive")
    kept = F.struct(F.col(order).alias("order"), F.col(group).alias("group"), *[c.alias(f"keep_{name}") for name, c in (keep or {}).items()])
    g = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit(""))  # '' is the null group
    rows = materialize(docs.select(g.alias("g"), leaf_of([F.col(c) for c in columns]).alias("digest"), kept.alias("kept")))
    leaves = materialize(numbered(rows, ["kept.order", "digest"]))
    rounds = _rounds(leaves, fanout, levels)
    subroots = rounds[-1].select(F.lit("").alias("g"), "digest", F.struct(F.col("g").alias("of")).alias("kept"))
    top = _rounds(materialize(numbered(subroots, ["kept.of"])), fanout, levels)
    none = F.array().cast(PROOF)
    summit = top[-1].select("g", "idx", none.alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    above = _down(top, summit, fanout, levels).select(F.col("kept.of").alias("g"), F.lit(0).cast("long").alias("idx"), "proof", F.col("digest").alias("subroot"), "root")
    out = _down(rounds, materialize(above), fanout, levels)
    return out.select(F.col("kept.order").alias(order), F.col("kept.group").alias(group), F.col("digest").alias("leaf"), "subroot", "root", "proof", *[F.col(f"kept.keep_{name}").alias(name) for name in keep or {}])


def verified(leaf: Column, proof: Column, root: Column) -> Column:
    """Whether the leaf is the one that the proof was made for."""
    return fold(leaf, proof) == root


ship_by_value(__name__)
