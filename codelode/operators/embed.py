"""Vectors of texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import QUERY_PREFIX
from ..functions.parts import parts
from ..functions.vectors import has_dim

Embedder = Callable[[list[str]], list[list[float]]]
WORD = re.compile("[a-z0-9_]+")
#: Words whose bucket a stream of batches keeps.
KEPT_WORDS = 1 << 18


class Buckets(dict):
    """Bucket by word: the MD5 of a word as a 128-bit number, modulo dim. What is kept is bounded."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = bucket = int.from_bytes(md5(word.encode(), usedforsecurity=False).digest(), "big") % self.dim
        return bucket

    def counts(self, text: str | None) -> np.ndarray:
        """Words of a lower-case text by bucket."""
        found = WORD.findall(text or "")
        return np.bincount(np.fromiter(map(self.__getitem__, found), np.int64, len(found)), minlength=self.dim)


def hash_embed(text: Column, dim: int) -> Column:
    """Counts of words by hash bucket, to unit length. A text with no words gives zeros; null stays null."""

    @F.arrow_udf("array<double>")
    def unit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = Buckets(dim)
        for batch in batches:
            for (texts,) in parts(batch):
                table = np.stack([buckets.counts(t) for t in texts.to_pylist()]).astype(float)
                norms = np.sqrt((table * table).sum(axis=1, keepdims=True))
                ends = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim)
                yield pa.ListArray.from_arrays(ends, pa.array((table / np.where(norms > 0, norms, 1)).ravel()), mask=texts.is_null())

    return unit(F.lower(text))


def bucket_counts(text: Column, dim: int) -> Column:
    """bucket, n of the buckets that a text's words fall into."""

    @F.arrow_udf("array<struct<bucket: int, n: long>>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = Buckets(dim)
        for batch in batches:
            for (texts,) in parts(batch):
                table = np.stack([buckets.counts(t) for t in texts.to_pylist()])
                row, bucket = np.nonzero(table)
                ends = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(table[row, bucket])], ["bucket", "n"])
                yield pa.ListArray.from_arrays(pa.array(ends), pairs)

    return count(F.lower(text))


def hash_embed_rows(texts: DataFrame, key: list[str], text: str, dim: int) -> DataFrame:
    """The same for texts that may be many rows of a key, as counts: key, bucket, weight of the buckets that aren't zero.

    Texts are counted where they are read; only counts by bucket are shuffled, once.
    """
    counted = texts.select(*key, bucket_counts(F.col(text), dim).alias("_c")).repartition(*key)
    counts = counted.select(*key, F.inline("_c")).groupBy(*key, "bucket").agg(F.sum("n").alias("n"))
    norm = F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double")).over(Window.partitionBy(*key)))
    return counts.select(*key, "bucket", (F.col("n") / norm).alias("weight"))


def with_embedder(df: DataFrame, factory: Callable[[], Embedder], text: str = "embed_text", batch: int = 32, query: bool = False) -> DataFrame:
    """Adds `embedding` by a model that `factory` loads once per batch stream; questions get the instruction that goes before them."""
    prefix = QUERY_PREFIX if query else ""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in parts:
            filled = [prefix + (t or "") for t in texts]
            yield pd.Series([v for i in range(0, len(filled), batch) for v in model(filled[i : i + batch])])

    return df.withColumn("embedding", embed(text))


def check_dim(vectors: DataFrame, dim: int, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows whose vector has the dimension, and the others."""
    return vectors.filter(has_dim(F.col(column), dim)), vectors.filter(~has_dim(F.col(column), dim))
