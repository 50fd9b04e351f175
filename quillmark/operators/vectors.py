"""Similarities of texts by their embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """In double precision; null where either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def normalize(a: Column, least: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(least))
    return F.transform(a, lambda x: (x.cast("double") / n).cast("float"))


def mean_pool(tokens: Column, mask: Column, least: float = 1e-9) -> Column:
    """The mean of token vectors (array<array<float>>) whose mask is not 0."""
    kept = F.filter(F.zip_with(tokens, mask, lambda t, m: F.when(m != 0, t)), lambda t: t.isNotNull())
    zero = F.transform(F.get(tokens, 0), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, t: F.zip_with(s, t, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: (x / F.greatest(F.size(kept).cast("double"), F.lit(least))).cast("float"))


#: An encoder gives a function from texts to a matrix of unit rows; it is made once for each worker's task.
Encoder = Callable[[], Callable[[list[str]], np.ndarray]]


def hashed_encoder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a sentence encoder: hashed word counts, of unit length. It knows no meaning."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for row, text in zip(out, texts):
            for w in (text or "").lower().split():
                h = zlib.crc32(w.encode())
                row[h % dims] += 1 if h & 1 << 20 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def embed(texts: DataFrame, text_col: str, encoder: Encoder = hashed_encoder, batch: int = 32) -> DataFrame:
    """Distinct texts with their embedding, so that a text that many rows share is encoded once."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder()
        for got in batches:
            values = got.to_pylist()
            parts = [encode(values[k : k + batch]) for k in range(0, len(values), batch)]
            yield pa.array([row.tolist() for p in parts for row in p], pa.list_(pa.float32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    distinct = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    return distinct.select("text", F.arrow_udf(run, "array<float>")("text").alias("embedding"))


def text_similarity(rows: DataFrame, left: str, right: str, encoder: Encoder = hashed_encoder, out: str = "similarity") -> DataFrame:
    """``rows`` with the cosine of two text columns: each distinct text is encoded once, then looked up twice."""
    a, b = F.coalesce(F.col(left), F.lit("")), F.coalesce(F.col(right), F.lit(""))
    both = rows.select(a.alias("t")).union(rows.select(b.alias("t")))
    known = embed(both, "t", encoder)
    x, y = known.select(F.col("text").alias("_x"), F.col("embedding").alias("_u")), known.select(F.col("text").alias("_y"), F.col("embedding").alias("_v"))
    joined = rows.join(x, a == F.col("_x")).join(y, b == F.col("_y"))
    return joined.withColumn(out, dot(F.col("_u"), F.col("_v"))).drop("_x", "_y", "_u", "_v")


def code_summary_similarity(rows: DataFrame, encoder: Encoder = hashed_encoder) -> DataFrame:
    """A headerless evaluation table (method, summary) with similarity."""
    return text_similarity(rows, "method", "summary", encoder)


def summary_similarity(rows: DataFrame, encoder: Encoder = hashed_encoder, threshold: float = 0.5) -> DataFrame:
    """A headed evaluation table (comment, comment1) with similarity and whether it reaches the threshold."""
    return text_similarity(rows, "comment", "comment1", encoder).withColumn("similar", F.col("similarity") >= threshold)
