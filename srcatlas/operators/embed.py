"""Vectors of texts from a pluggable model; the default is deterministic hashed n-grams.

A model is a function texts -> matrix, made once per Python worker by a factory,
so that an iterator of Arrow batches pays for loading it once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what a query starts with before it is embedded.
QUERY_PREFIX = "Represent this query for searching relevant code: "
#: Tokens beyond this do not change a vector (the cap of the usual models).
MOST_TOKENS = 512

Model = Callable[[list[str]], np.ndarray]


def hashed_ngrams(dim: int = 768) -> Model:
    """Counts of hashed words and word pairs, with signs; needs no files."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float64)
        for row, text in enumerate(texts):
            words = text.lower().split()[:MOST_TOKENS]
            for gram in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
                h = zlib.crc32(gram.encode())
                out[row, h % dim] += 1.0 if h & 0x80000000 else -1.0
        return out

    return embed


def units(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(size > 0, m / np.where(size > 0, size, 1), m).astype(np.float32)


def unit(vector: Column) -> Column:
    """array<float> of unit length; a zero vector stays as it is."""

    @F.pandas_udf("array<float>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([units(np.asarray(v, np.float64)[None])[0] for v in rows])

    return run(vector)


def embedding(text: Column, factory: Callable[[], Model] = hashed_ngrams, batch: int = 32, prefix: str = "") -> Column:
    """array<float> of unit length for each text; null counts as empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            values = [prefix + (t or "") for t in texts]
            parts = [units(model(values[k : k + batch])) for k in range(0, len(values), batch)]
            yield pd.Series([v for p in parts for v in p])

    return run(text)


def embed_chunks(chunks: DataFrame, factory: Callable[[], Model] = hashed_ngrams, batch: int = 32) -> DataFrame:
    return chunks.withColumn("vector", embedding(F.col("content"), factory, batch))


def embed_query(text: str, factory: Callable[[], Model] = hashed_ngrams) -> list[float]:
    """One query is one row: it is embedded on the driver."""
    return units(factory()([QUERY_PREFIX + text]))[0].tolist()
