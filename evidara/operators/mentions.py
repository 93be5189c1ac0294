"""Which of many names stand in which of many texts, by an equi-join on each name's rarest piece.

A name is cut into grams of some bytes, of which it keeps the minimizers: the least hash of every run of ``w``
consecutive grams.  A text that holds the name holds these runs, so the name's minimizers are among the
text's own, and a text needs only about two in ``w + 1`` of its grams.  Each name takes the one that is rarest
among the texts as its key; texts meet names on equal keys, and what meets is verified in the text's row.  So
no text is compared with every name, whatever the number of both, and nothing is fetched.

Names of 15 bytes or more use grams of 8 in runs of 8, those of 4 or more all grams of 4, shorter ones are their
own gram; classes without a name cost nothing.

Null texts and null or empty names match nothing.  A name that stands in a text several times counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara.functions.ship import ship_by_value
from evidara.sources.store import stored

CLASSES = ((8, 8), (4, 1), (3, 1), (2, 1), (1, 1))  #: bytes a gram and grams a run, by falling length of the names
STEP = 1 << 20  #: grams of a text that are hashed at once


def class_of(n_bytes: int) -> int:
    """Index of the class that serves a name of so many bytes."""
    return next(i for i, (q, w) in enumerate(CLASSES) if n_bytes >= q + w - 1)


def grams(raw: bytes, q: int, w: int) -> np.ndarray:
    """Different minimizers of a text, as hashes."""
    found, last = [], len(raw) - q - w + 2  # runs
    for start in range(0, max(0, last), STEP):
        part = np.frombuffer(raw[start : min(start + STEP, last) + q + w - 2], np.uint8).astype(np.uint64)
        n = len(part) - q + 1
        value = np.full(n, q, np.uint64)
        for j in range(q):
            value = (value ^ part[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        if w > 1:
            value = np.lib.stride_tricks.sliding_window_view(value, w).min(axis=1)
        found.append(np.unique(value))
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64)


def _grams_of(rows: DataFrame, keys: list[str], text: str, classes: list[int], own_class: bool) -> DataFrame:
    """(*keys, gram): of every text the grams of ``classes``, or of its own class alone."""
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("gram", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                found = []
                for t in part.column(len(keys)):
                    raw = (t.as_py() or "").encode()
                    wanted = ([class_of(len(raw))] if raw else []) if own_class else classes
                    found.append(np.concatenate([np.zeros(0, np.int64), *(grams(raw, *CLASSES[c]) for c in wanted)]))
                take = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([*(part.column(j).take(take) for j in range(len(keys))), pa.array(np.concatenate(found))], schema.names)

    return rows.select(*keys, text).mapInArrow(run, schema)


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst): every ``dst`` of ``names`` that stands in a ``text`` of ``src``, each pair once."""
    wanted = stored(names.select("dst").where("dst <> ''").distinct())
    size = F.octet_length("dst")
    case = F.lit(len(CLASSES) - 1)
    for i, (q, w) in reversed(list(enumerate(CLASSES))):
        case = F.when(size >= q + w - 1, i).otherwise(case)
    classes = sorted(r[0] for r in wanted.select(case.alias("c")).distinct().collect())  # five at most
    of_names = stored(_grams_of(wanted, ["dst"], "dst", classes, True))
    keyed = texts.where("text is not null").select("src", "text", F.sha2("text", 256).alias("of"))
    met = stored(_grams_of(keyed, ["src", "of"], "text", classes, False).join(of_names.select("gram").distinct(), "gram", "left_semi"))
    counts = met.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    keys = of_names.join(counts, "gram", "left").groupBy("dst").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")).where("best.n > 0").select("dst", F.col("best.gram").alias("gram"))
    near = met.join(keys, "gram").select("src", "of", "dst").groupBy("src", "of").agg(F.collect_set("dst").alias("near"))
    once = keyed.groupBy("src", "of").agg(F.first("text").alias("text"))  # copies of one text of a src
    same = once["src"].eqNullSafe(near["src"]) & (once["of"] == near["of"])
    held = once.join(near, same).select(once["src"], F.explode(F.filter(near["near"], lambda d: once["text"].contains(d))).alias("dst"))
    return held.distinct()


ship_by_value(__name__)
