"""Vector expressions over arrays of numbers; all arithmetic is double."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STUB_DIMENSIONS = 1536


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, zero: float = 0.0) -> Column:
    """Cosine similarity; zero where a vector has no length (0.0 for dedup, 1.0 for drift)."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(zero))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - similarity; 1.0 where a vector has no length."""
    return 1 - cosine(a, b)


def ema(current: Column, new: Column, alpha: float = 0.1) -> Column:
    return F.zip_with(doubles(current), doubles(new), lambda c, n: F.round((1 - alpha) * c + alpha * n, 6))


def centroids(df: DataFrame, keys: list[str], vector: str, digits: int | None = 6, name: str = "centroid") -> DataFrame:
    """Element-wise means by keys. Elements are averaged before anything is gathered: one small row for each key and element."""
    parts = df.select(*keys, F.posexplode(doubles(F.col(vector))).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg("_x").alias("_m"))
    mean = F.round("_m", digits) if digits is not None else F.col("_m")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_i"), mean.alias("m"))))
    return parts.groupBy(*keys).agg(F.transform(ordered, lambda x: x["m"]).alias(name))


def stub_vector(text: str | None, dimensions: int = STUB_DIMENSIONS) -> list[float]:
    seed = int(hashlib.md5((text or "").encode()).hexdigest(), 16)
    return [round(math.sin(seed + i) * 0.5, 6) for i in range(dimensions)]


def stub_embeddings(texts: DataFrame, column: str, dimensions: int = STUB_DIMENSIONS) -> DataFrame:
    """A deterministic stand-in for a model: sin(seed + i) / 2 with the text's MD5 as the seed, 6 digits. Arrow batches, as the seed has 128 bits."""

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(embedding=[stub_vector(t, dimensions) for t in b[column]])

    schema = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes) + ", embedding array<double>"
    return texts.mapInPandas(embed, schema)
