"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

One pass over the whole texts turns each into fourteen transformed statistics (length, word length,
vocabulary, symbols, capitals, digits, punctuation, repetition, entropy, line length), mostly logarithms of
rates.  They are kept as whole multiples of 1/1024, so every sum below is exact and reruns agree.

Each class (label 1, label 0) is a normal density.  Its mean and covariance come from sums over all
labelled rows that aren't held out: each task adds up counts, values and products, a table of some 240 numbers
reaches the driver whatever the number of rows.  The class covariance is shrunk towards the pooled one, as if
``WEIGHT`` rows of that had been seen too, and ``RIDGE`` of the way towards a sphere.  The Cholesky factors
are computed once and travel with the tasks; a score is the posterior of label 1, from the difference
of the Mahalanobis log-densities and the classes' shares.

Held out is a row whose CRC-32 of doc_id as text divides by ``FOLDS``.  Labels, language, source and doc_id
are never inputs of a score.

A null text is empty, and an empty text is scored like any other.  A null doc_id has no label and
counts as held out.  Null labels don't count; a document with several labels is good if any is 1.
Repeated rows are trained and scored one by one, and equal texts get equal scores.  With labels of
one class only every score is that class; without any all scores are 0.5.  Only the named columns are
read, so others can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import materialize, process_cache, ship_by_value, tidy

UNIT = 1024  #: statistics are multiples of one UNIT-th
WEIGHT, RIDGE = 30, 0.01
FOLDS, THRESHOLD = 5, 0.3
RARE = 0.01  #: added to rates before their logarithm
NAMES = ("words", "word_length", "vocabulary", "symbols", "capitals", "digits", "punctuation", "bangs", "other_characters", "repeats", "repeated_lines", "top_word", "entropy", "line_length")
SIZE = len(NAMES)
LETTER, CAPITAL, DIGIT, SYMBOL, MARK, BANG = (1 << i for i in range(6))


def _kinds() -> np.ndarray:
    """Flags of every code point of the basic plane; those beyond it count as no letters."""
    found = process_cache().get("character kinds")
    if found is None:
        found = np.zeros(1 << 16, np.uint8)
        for i in range(1 << 16):
            c = chr(i)
            found[i] = LETTER * c.isalpha() + CAPITAL * c.isupper() + DIGIT * c.isdigit() + SYMBOL * (c in "#*$%&|<>") + MARK * (c in ".,;:?") + BANG * (c == "!")
        process_cache()["character kinds"] = found
    return found


def _repeated(words: list[bytes]) -> tuple[int, int, int]:
    """Different words, uses of the most frequent one, and three-word windows that occur more than once."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(ids) < 3:
        return len(known), int(np.bincount(ids).max()) if len(ids) else 0, 0
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    times = np.unique(pairs[:-1] * len(known) + ids[2:], return_counts=True)[1]
    return len(known), int(np.bincount(ids).max()), int(times[times > 1].sum())


def statistics(text: str | None) -> list[int]:
    """The transformed statistics in whole UNITs."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    kinds = np.bincount(_kinds()[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0xFFFF)], minlength=64)
    of = lambda kind: int(kinds[[i for i in range(64) if i & kind]].sum())
    n, letters = max(1, len(words)), max(1, len(text) - sum(map(text.count, " \t\n\v\f\r")))
    different, top, repeats = _repeated(words)
    lines = Counter(x for x in raw.split(b"\n") if x.strip())
    n_lines = max(1, lines.total())
    used = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = used[used > 0] / max(1, len(raw))
    rate = lambda x, whole: math.log(x / whole + RARE)
    values = (
        math.log1p(len(words)),
        math.log1p(letters / n),
        math.log((different + 1) / (len(words) + 1)),
        rate(of(SYMBOL), n),
        rate(of(CAPITAL), letters),
        rate(of(DIGIT), letters),
        rate(of(MARK), n),
        rate(of(BANG), n),
        rate(max(0, letters - of(LETTER)), letters),
        rate(repeats, n),
        rate(n_lines - max(1, len(lines)), n_lines),
        rate(top, n),
        float(-(share * np.log2(share)).sum()),
        math.log1p(len(words) / n_lines),
    )
    return [round(UNIT * v) for v in values]


def described(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, x): the statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column(1)]
            flat = pa.array(np.array(x, np.int32).reshape(-1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * SIZE, pa.int32()), flat)], [id, "x"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(tidy(run), f"`{id}` {kind}, x array<int>")


def held_out(id: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(id).cast("string"), "UTF-8")) % folds == 0, F.lit(True))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, SIZE)


UPPER = np.triu_indices(SIZE)


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Of each class of (good, x): its number of rows, the sums of the statistics and of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {0: np.zeros(1 + SIZE + len(UPPER[0]), np.int64), 1: np.zeros(1 + SIZE + len(UPPER[0]), np.int64)}
        for b in batches:
            good, x = b.column(0).to_numpy(), _matrix(b.column(1))
            for label, total in sums.items():
                own = x[good == label]
                total += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own)[UPPER]])
        for label, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array(total)], ["good", "place", "part"])

    parts = rows.select("good", "x").mapInArrow(tidy(run), "good int, place int, part long")
    total = parts.groupBy("good", "place").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("total")).collect()  # two classes of 120 numbers
    out: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for label in (0, 1):
        v = [t for _, t in sorted((r["place"], int(r["total"])) for r in total if r["good"] == label)]
        if v and v[0]:
            square = np.zeros((SIZE, SIZE))
            square[UPPER] = [x / UNIT**2 for x in v[1 + SIZE :]]
            out[label] = v[0], np.array([x / UNIT for x in v[1 : 1 + SIZE]]), square + np.triu(square, 1).T
    return out


@dataclass
class QuadraticDiscriminant:
    """Means, Cholesky factors and log shares of the classes, in standardised statistics."""

    centre: np.ndarray
    spread: np.ndarray
    classes: dict[int, tuple[np.ndarray, np.ndarray, float]]

    @classmethod
    def fit(cls, found: dict[int, tuple[int, np.ndarray, np.ndarray]], weight: float = WEIGHT, ridge: float = RIDGE) -> QuadraticDiscriminant:
        if not found:
            return cls(np.zeros(SIZE), np.ones(SIZE), {})
        n = sum(x[0] for x in found.values())
        centre = sum(x[1] for x in found.values()) / n
        spread = np.sqrt(np.maximum(np.diag(sum(x[2] for x in found.values())) / n - centre**2, 0))
        spread[spread < 1e-3] = 1.0  # a statistic without variation
        mean, cov = {}, {}
        for label, (k, total, square) in found.items():
            mean[label] = (total / k - centre) / spread
            cov[label] = (square / k - np.outer(total / k, total / k)) / np.outer(spread, spread)
        pooled = sum(found[c][0] * cov[c] for c in found) / n
        classes = {}
        for label, (k, _, _) in found.items():
            shrunk = (k * cov[label] + weight * pooled) / (k + weight)
            level = max(float(np.trace(shrunk)) / SIZE, 1e-3)
            factor = np.linalg.cholesky((1 - ridge) * shrunk + ridge * level * np.eye(SIZE))
            classes[label] = mean[label], factor, math.log(k / n)
        return cls(centre, spread, classes)

    def log_density(self, label: int, z: np.ndarray) -> np.ndarray:
        mean, factor, share = self.classes[label]
        u = np.linalg.solve(factor, (z - mean).T)
        return share - 0.5 * (u * u).sum(axis=0) - np.log(np.diag(factor)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        """The posterior of label 1 of rows of statistics in UNITs."""
        if len(self.classes) < 2:
            return np.full(len(x), {(): 0.5, (0,): 0.0, (1,): 1.0}[tuple(self.classes)])
        z = (x / UNIT - self.centre) / self.spread
        return 1 / (1 + np.exp(np.clip(self.log_density(0, z) - self.log_density(1, z), -700, 700)))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = FOLDS, weight: float = WEIGHT, ridge: float = RIDGE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = materialize(described(docs))
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"))
    model = QuadraticDiscriminant.fit(moments(rows.where(F.col("doc_id").isNotNull() & ~held_out(folds=folds)).join(good, "doc_id")), weight, ridge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, score double, predicted int").select("doc_id", held_out(folds=folds).alias("held_out"), "score", "predicted")


ship_by_value(__name__)
