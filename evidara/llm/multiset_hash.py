"""Document fingerprints by a homomorphic multiset hash of paragraphs.

Every paragraph (line, cut further after sentence ends) expands by SHAKE-128 to a wide vector: 16
lanes of 64 bits and 128 signs.  A document's fingerprint is the sum of its paragraphs' vectors,
lane by lane modulo 2**64.  The order of paragraphs doesn't matter, and inserting or deleting one
adds or subtracts its vector without the rest of the text.

The wide lanes decide equality: equal multisets have equal fingerprints, and two whose counts
differ agree in a lane with a chance of at most 2**-(64 - k), 2**k the largest power of two that
divides all the differences; that is 2**-1024 for all lanes at k = 0 and 2**-528 at k = 31, and no
text has 2**31 paragraphs.

The sums of the signs, which for that reason fit 32 bits, measure overlap: the squared distance of
two of them over the number of lanes estimates in how many paragraphs they differ, so
``likeness = 1 - |a - b|^2 / (|a|^2 + |b|^2)``, held within 0 and 1, is about the shared share of
paragraphs (standard error about 0.1), 1 for equal and near 0 for unrelated documents.

Nulls are empty texts; an empty text is one empty paragraph.  A null doc_id comes first.  Rows of
one doc_id are ordered by a hash of their text; equal rows are rows of their own, in any order, as
that doesn't show.  Texts of any length are hashed whole, BLOCK paragraphs at a time.  Only doc_id
and text are read, so other columns can't clash; an empty table gives an empty result, and the only
document of a table is its own follower.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.llm.common import materialize, ship_by_value, tidy

WIDE = 16  #: lanes of 64 hashed bits
SIGNS = 128  #: lanes of random signs
CUT = re.compile(r"\n|(?<=[.!?]) ")
BLOCK = 1 << 14  #: paragraphs whose vectors are summed at once
SLICE_ROWS = 256  #: documents whose results a Python worker holds at once


def paragraphs(text: str) -> list[str]:
    return CUT.split(text)


def vector(parts: list[str]) -> np.ndarray:
    """Sum of the paragraphs' vectors modulo 2**64: the wide lanes, then the signs'."""
    total = np.zeros(WIDE + SIGNS, dtype=np.uint64)
    for i in range(0, len(parts), BLOCK):
        block = parts[i : i + BLOCK]
        size = 8 * WIDE + SIGNS // 8
        raw = np.frombuffer(b"".join([hashlib.shake_128(p.encode()).digest(size) for p in block]), np.uint8).reshape(-1, size)
        total[:WIDE] += np.ascontiguousarray(raw[:, : 8 * WIDE]).view("<u8").sum(axis=0, dtype=np.uint64)
        ones = np.unpackbits(np.ascontiguousarray(raw[:, 8 * WIDE :]), axis=1).sum(axis=0, dtype=np.int64)
        total[WIDE:] += (2 * ones - len(block)).view(np.uint64)
    return total


def insert(fingerprint: np.ndarray, parts: list[str]) -> np.ndarray:
    return fingerprint + vector(parts)


def delete(fingerprint: np.ndarray, parts: list[str]) -> np.ndarray:
    return fingerprint - vector(parts)


def to_bytes(v: np.ndarray) -> bytes:
    """8 bytes for each wide lane, then 4 for each sign lane."""
    return v[:WIDE].astype(">u8").tobytes() + v[WIDE:].view(np.int64).astype(">i4").tobytes()


def to_hex(v: np.ndarray) -> str:
    return to_bytes(v).hex()


def from_hex(s: str) -> np.ndarray:
    raw = bytes.fromhex(s)
    return np.concatenate([np.frombuffer(raw[: 8 * WIDE], ">u8").astype(np.uint64), np.frombuffer(raw[8 * WIDE :], ">i4").astype(np.int64).view(np.uint64)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common paragraphs, 0 to 1; 1 exactly if the fingerprints are equal."""
    if np.array_equal(a, b):
        return 1.0
    x, y = a[WIDE:].view(np.int64).astype(float), b[WIDE:].view(np.int64).astype(float)
    norm = float(x @ x + y @ y)
    return min(1.0, max(0.0, 1.0 - float((x - y) @ (x - y)) / norm)) if norm else 0.0


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many first code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


MADE = [("n_chars", T.LongType(), pa.int64()), ("edited_sha256", T.StringType(), pa.string()), ("fingerprint", T.BinaryType(), pa.binary()), ("edited_fingerprint", T.BinaryType(), pa.binary()), ("near_edited", T.DoubleType(), pa.float64()), ("near_next", T.DoubleType(), pa.float64())]


def compare(text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    """The result row of one document, given its follower."""
    new = edited(text, following)
    v = vector(paragraphs(new))
    return len(text), hashlib.sha256(new.encode()).hexdigest(), to_bytes(own), to_bytes(v), likeness(own, v), likeness(own, other)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS))


def fingerprint_with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """doc_id and MADE (fingerprints in hex) for every document; its follower is the next by doc_id, the first for the last.

    One shuffle carries the texts into doc_id ranges.  Each sorted range emits the result of
    every row but its last, and the texts of its first and last row; those, two a range, are
    then paired across ranges and finished the same way.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "tie", "row"]  # the row's place only lets a range end within equal rows
    rows = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    id_type = docs.schema["doc_id"]
    extra = [T.StructField("part", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("open_text", T.StringType())]
    schema = T.StructType([id_type, *(T.StructField(c, t) for c, t, _ in MADE), *extra])
    kinds = [*(k for _, _, k in MADE), pa.int32(), pa.string(), pa.string()]
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, id_kind, first = None, None, True
        blank = (None,) * len(MADE)

        def pack(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, [id_kind, *kinds], strict=True)], names)

        for b in slices(batches):
            id_kind, out = b.schema.field(0).type, []
            for doc_id, text, part in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                text = text or ""
                v = vector(paragraphs(text))
                if first:
                    out.append((doc_id, *blank, part, "first", text))
                    first = False
                else:
                    out.append((last[0], *compare(last[1], last[2], text, v), part, "done", None))
                last = (doc_id, text, v, part)
            yield pack(out)
        if last is not None:
            yield pack([(last[0], *blank, last[3], "last", last[1])])

    found = materialize(rows.mapInArrow(tidy(run), schema))
    firsts = found.where("kind = 'first'").select("part")
    after = Window.orderBy("part")
    follower = F.coalesce(F.lead("part").over(after), F.min("part").over(Window.partitionBy()))
    pairs = firsts.select("part", follower.alias("next_part"))  # one row a range
    lasts = found.where("kind = 'last'").select("doc_id", "part", F.col("open_text").alias("text")).join(pairs, "part")
    heads = found.where("kind = 'first'").select(F.col("part").alias("next_part"), F.col("open_text").alias("following"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text, following in zip(b.column("text").to_pylist(), b.column("following").to_pylist(), strict=True):
                out.append(compare(text, vector(paragraphs(text)), following, vector(paragraphs(following))))
            cols = list(zip(*out, strict=True)) if out else [()] * len(MADE)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), k) for c, (_, _, k) in zip(cols, MADE, strict=True))], ["doc_id", *(m[0] for m in MADE)])

    closed = T.StructType([id_type, *(T.StructField(c, t) for c, t, _ in MADE)])
    ends = lasts.join(heads, "next_part").select("doc_id", "text", "following").mapInArrow(tidy(finish), closed)
    out = found.where("kind = 'done'").select("doc_id", *(m[0] for m in MADE)).unionByName(ends)
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


ship_by_value(__name__)
