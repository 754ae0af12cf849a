"""Embeddings: a pluggable embedder behind an iterator pandas UDF, cache-aware runs, and their manifest."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 384


def hashing_embedder(dim: int = DIM) -> Callable[[list[str]], np.ndarray]:
    """The offline default: words hashed to signed places, unit length. A model is passed in its stead."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1.0 if h >> 31 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


def embed(texts: Column, make: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_embedder) -> Column:
    """Vectors of texts; make() is called once a worker task, so a model is loaded once for many batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            yield pd.Series(list(model([x or "" for x in s])))

    return run(texts)


def embed_missing(chunks: DataFrame, cache: DataFrame, key: str = "hash", content: str = "text", make=hashing_embedder) -> DataFrame:
    """(key, vector) of all chunks: those in the cache as they are, each other text embedded once."""
    wanted = chunks.groupBy(key).agg(F.min(content).alias(content))
    known = cache.select(key, "vector").join(wanted.select(key), key, "left_semi")
    missing = wanted.join(cache.select(key), key, "left_anti")
    return known.unionByName(missing.select(key, embed(F.col(content), make).alias("vector")))


def check_dimension(vector: Column, dim: int) -> Column:
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(F.concat(F.lit("dimension "), F.size(vector).cast("string"), F.lit(f" is not {dim}"))))


def manifest(chunks: DataFrame, skip: str = "skip_reason") -> DataFrame:
    """embedded, and a count for each reason to skip."""
    n = lambda name: F.sum((F.col(skip) == name).cast("long")).alias(name)
    return chunks.agg(F.sum(F.col(skip).isNull().cast("long")).alias("embedded"), *[F.coalesce(n(x), F.lit(0)).alias(x) for x in ("reusable_component", "contaminated", "cta_heavy", "boilerplate_heavy")])
