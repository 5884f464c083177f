"""Embedders: functions from texts to unit vectors. The default is a deterministic hash, for tests and offline use."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .batches import by_parts

DIM, QUERY_PREFIX = 384, "query: "
Embedder = Callable[[list[str]], np.ndarray]
_MASK = (1 << 64) - 1
_GROW, _STEP = 6364136223846793005, 1442695040888963407


def hash_embed(texts: list[str], dim: int = DIM) -> np.ndarray:
    """(texts, dim) float32: FNV-1a of the UTF-16 units seeds a linear congruential generator that fills the vector."""
    seeds = []
    for t in texts:
        h = 1469598103934665603
        for u in np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16).tolist():
            h = ((h ^ u) * 1099511628211) & _MASK
        seeds.append(h | 1)
    state = np.array(seeds, np.uint64)
    out = np.empty((len(texts), dim))
    for i in range(dim):
        state = state * np.uint64(_GROW) + np.uint64(_STEP)
        out[:, i] = (state >> np.uint64(33)).astype(np.float64) / (1 << 31) - 1
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return (out.astype(np.float32).astype(np.float64) / np.where(norm > 0, norm, 1)).astype(np.float32)


def embed(text: Column, embedder: Embedder = hash_embed) -> Column:
    """Vectors of a column of texts; null for null. The embedder sees part of a batch at a time."""
    kind = pa.list_(pa.float32())

    def part(x: pa.Array) -> pa.Array:
        texts = x.to_pylist()
        some = [t for t in texts if t is not None]
        vectors = iter(embedder(some) if some else [])
        return pa.array([None if t is None else next(vectors) for t in texts], kind)

    @F.arrow_udf(ArrayType(FloatType()))
    def run(x: pa.Array) -> pa.Array:
        return by_parts(part, kind, x)

    return run(text)


def embed_query(query: str, embedder: Embedder = hash_embed, prefix: str = "") -> list[float]:
    """Models that tell queries from documents want QUERY_PREFIX."""
    return embedder([prefix + query])[0].tolist()
