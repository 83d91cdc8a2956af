"""Column expressions on vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_of(word: Column, dim: int) -> Column:
    """MD5 of a word as a 128-bit number, modulo dim (below 2^30): eight digits at a time."""
    digest = F.md5(word.cast("binary"))
    parts = F.array(*[F.conv(F.substring(digest, i, 8), 16, 10).cast("long") for i in (1, 9, 17, 25)])
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, d: (a * (2**32 % dim) + d) % dim).cast("int")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    scaled = lambda n: F.transform(vector, lambda x: x.cast("double") / n)
    return F.element_at(F.transform(F.array(norm(vector)), lambda n: scaled(F.when(n > 0, n).otherwise(1.0))), 1)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / F.when(n > 0, n)).otherwise(0.0)


def has_dim(vector: Column, dim: int) -> Column:
    return F.coalesce(F.size(vector) == dim, F.lit(False))
