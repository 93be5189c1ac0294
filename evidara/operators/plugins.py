"""Plug-in points for real models: encoders, pair scorers and generators.

Each wraps two callables: ``load()`` builds the model once per Python worker, the other applies
it to a whole Arrow batch.  The result fits wherever a default expression does.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evidara.functions.ship import ship_by_value


def once_per_worker(key: str, load: Callable[[], object]) -> object:
    """The model of this worker process, loaded at its first use."""
    cache = sys.__dict__.setdefault("_evidara_models", {})
    if key not in cache:
        cache[key] = load()
    return cache[key]


def encoder(load: Callable[[], object], encode: Callable[[object, list[str]], list[list[float]]], batch_size: int = 32) -> Callable[[Column], Column]:
    """A text encoder: ``encode(model, texts)`` returns one vector a text, which is L2-normalised."""
    key = uuid.uuid4().hex

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = once_per_worker(key, load)
        for b in batches:
            texts, out = [t or "" for t in b], []
            for i in range(0, len(texts), batch_size):
                for v in encode(model, texts[i : i + batch_size]):
                    size = sum(x * x for x in v) ** 0.5
                    out.append([float(x) / size if size else 0.0 for x in v])
            yield pd.Series(out, dtype=object)

    return lambda text: run(text)


def pair_scorer(load: Callable[[], object], score: Callable[[object, list[tuple[str, str]]], list[float]]) -> Callable[[Column, Column], Column]:
    """A cross-encoder for reranking: ``score(model, pairs)`` returns one number a pair."""
    key = uuid.uuid4().hex

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = once_per_worker(key, load)
        for q, t in batches:
            yield pd.Series([float(x) for x in score(model, list(zip(q.fillna(""), t.fillna(""), strict=True)))], dtype="float64")

    return lambda query, text: run(query, text)


ship_by_value(__name__)
