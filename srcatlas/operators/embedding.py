"""Embedding texts: an interface and a deterministic offline default, hashed words and word pairs.

No quality parity with a trained model is claimed; the default keeps pipelines runnable and testable without a network.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns a text column into an array<float> column.
Embedder = Callable[[Column], Column]
DEFAULT_SIZE = 128
_WORD = re.compile(r"\w+")


def _hashed(text: str, size: int) -> np.ndarray:
    words = _WORD.findall(text.lower())
    h = np.fromiter((zlib.crc32(w.encode()) for w in [*words, *map(" ".join, zip(words, words[1:]))]), np.int64)
    v = np.bincount(h % size, np.where(h >> 20 & 1, 1.0, -1.0), size) if len(h) else np.zeros(size)
    norm = np.linalg.norm(v)
    return (v / norm if norm else v).astype(np.float32)


def hashed_words(size: int = DEFAULT_SIZE) -> Embedder:
    """Unit vectors of signed hashes of words and word pairs, in Arrow batches; empty and null texts have the zero vector."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: _hashed(t, size))

    return embed


def embed_chunks(chunks: DataFrame, text: Column, embedder: Embedder | None = None, column: str = "vector") -> DataFrame:
    """Chunks with a vector per text."""
    return chunks.withColumn(column, (embedder or hashed_words())(text))
