"""Embeddings: a provider runs once per Arrow batch stream; offline, vectors come from hashes of the text.

A provider is a callable that takes a list of texts and returns a list of vectors. It is built in
the task by `make`, so that a model is loaded once per Python worker.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[list[float]]]


def hash_vector(text: str, dim: int) -> list[float]:
    """A unit vector of normal numbers seeded by the text's SHA-256."""
    r = random.Random(int(hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), 16) % 2**32)
    v = np.array([r.gauss(0, 1) for _ in range(dim)])
    return (v / max(float(np.linalg.norm(v)), 1e-9)).tolist()


def congruential_vector(text: str, dim: int = 1536) -> list[float]:
    """Numbers of a linear congruential sequence (1664525, 1013904223, 2**32) seeded by the text's MD5, in [-1, 1)."""
    x, out = int(hashlib.md5(text.encode("utf-8", "replace")).hexdigest()[:8], 16), []
    for _ in range(dim):
        x = (1664525 * x + 1013904223) % 2**32
        out.append(x / 2**31 - 1)
    return out


def offline_provider(dim: int = 1024) -> Provider:
    return lambda texts: [hash_vector(t, dim) for t in texts]


def embedded(texts: str | Column, make: Callable[[], Provider], batch: int = 128) -> Column:
    """array<float> of each text; null texts embed as empty ones."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provide = make()
        for s in parts:
            said = s.fillna("").tolist()
            out = [v for i in range(0, len(said), batch) for v in provide(said[i : i + batch])]
            yield pd.Series(out, dtype=object)

    return run(texts)


def checked_dimension(rows: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Fails in the task that meets a vector of another length."""
    return rows.withColumn(vector, F.when(F.size(vector) == dim, F.col(vector)).otherwise(F.raise_error(F.format_string("a vector of %d dimensions", F.size(vector))).cast("array<float>")))
