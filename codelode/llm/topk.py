"""Exact top-k search by inner product of integer vectors.

Vectors are processed by descending length. They are turned so that the first coordinates carry most of the corpus's
energy (singular vectors of all vectors, from one distributed sum of products); an inner product is then at most the
partial sum over some coordinates plus the product of the two remaining lengths (Cauchy-Schwarz). What can't reach the
k-th best score found so far is dropped; the rest is computed exactly on the integers.

The longest `HEAD` vectors give every query a first bound. Then queries meet all vectors in blocks: both are dealt at
random into blocks of bounded size, and each pair of blocks is one group. A block hands on at most k rows per query.

Vectors that are null, empty, hold null or non-finite components, or have another than the most frequent number of
components take no part. Ties go to the smaller id, then to the row. Repeated rows are separate candidates, and a query
leaves out its own row only. Scores beyond a long are clipped to it. Null ids sort first. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import first_k, matrix, of_common_length, sound

#: Rows of the first block, of a block of candidates, of a block of queries, and of a step inside a block.
HEAD, CANDIDATES, QUERIES, STEP = 1024, 16_384, 1_024, 256
#: Largest number up to which doubles hold every integer.
EXACT = 2.0**53


def prepared(vectors: DataFrame, id_column: str, vector: Column, is_query: Column) -> tuple[DataFrame, int]:
    """row, id, is_query, length, v (binary longs) of the vectors that take part."""
    usable, d = of_common_length(vectors.select(F.col(id_column).cast("long").alias("id"), is_query.alias("is_query"), vector.alias("v")).filter("v is not null"), "v")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b["v"].flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(-1, d)
            yield pa.RecordBatch.from_arrays([b["row"], b["id"], b["is_query"], b["length"], pa.array([r.tobytes() for r in flat], pa.binary())], names=b.schema.names)

    rows = usable.select(F.monotonically_increasing_id().alias("row"), "id", F.coalesce("is_query", F.lit(False)).alias("is_query"), length.alias("length"), "v")
    return stored(rows.mapInArrow(run, "row long, id long, is_query boolean, length double, v binary")), d


def rotation(rows: DataFrame, d: int) -> np.ndarray:
    """The singular vectors of all rows, those of the largest singular value first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            x = matrix(b["v"].to_pylist(), "<i8", d).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "x"])

    sums = rows.select("v").mapInArrow(run, "i int, x array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("x")[j]) for j in range(d)]).alias("x"))
    gram = np.zeros((d, d))
    for r in sums.collect():  # d rows of d numbers
        gram[r.i] = r.x
    return np.linalg.eigh(gram)[1][:, ::-1] if np.isfinite(gram).all() else np.eye(d)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of two matrices row by row, exact."""
    if not len(q):
        return np.zeros(0, np.int64)
    if float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < EXACT:
        return np.einsum("ij,ij->i", q, c)
    exact = (q.astype(object) * c.astype(object)).sum(axis=1)
    return np.array([max(-(2**63), min(2**63 - 1, x)) for x in exact], dtype=np.int64)


def search_block(q: pd.DataFrame, c: pd.DataFrame, d: int, turn: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of `c` for each row of `q`, those that can't reach q.bound left out."""
    c = c.sort_values(["length", "row"], ascending=[False, True])
    qv, cv, q_row, c_row, c_id = matrix(q["v"], "<i8", d), matrix(c["v"], "<i8", d), q["row"].to_numpy(), c["row"].to_numpy(), c["id"].fillna(-(2**63)).to_numpy(np.int64)
    qr, cr, q_len, c_len = qv @ turn, cv @ turn, q["length"].to_numpy(), c["length"].to_numpy()
    bound, cuts = q["bound"].to_numpy(float).copy(), [d // 4, d // 2]
    rest = lambda x: [np.sqrt(np.maximum((x[:, n:] ** 2).sum(axis=1), 0)) for n in cuts]
    q_rest, c_rest = rest(qr), rest(cr)
    best = [np.zeros(0, np.int64)] * 3  # position of the query, position of the candidate, score
    for a in range(0, len(c), STEP):
        b = min(a + STEP, len(c))
        slack = 0.5 + 1e-9 * q_len * c_len[a]
        alive = np.flatnonzero(q_len * c_len[a] >= bound - slack)
        if not len(alive):
            break  # all that follow are shorter
        qi, ci, need = alive, np.arange(a, b), (bound - slack)[alive]
        partial = np.zeros((len(qi), len(ci)))
        for i, (low, high) in enumerate(zip([0, *cuts], [*cuts, d])):  # a product of blocks for each stretch of coordinates
            partial += qr[qi, low:high] @ cr[ci, low:high].T
            hope = (partial + q_rest[i][qi, None] * c_rest[i][None, ci] if high < d else partial) >= need[:, None]
            rows, columns = np.flatnonzero(hope.any(axis=1)), np.flatnonzero(hope.any(axis=0))
            qi, ci, need, partial, hope = qi[rows], ci[columns], need[rows], partial[np.ix_(rows, columns)], hope[np.ix_(rows, columns)]
        at = np.nonzero(hope)
        qi, ci = qi[at[0]], ci[at[1]]
        keep = q_row[qi] != c_row[ci]
        qi, ci = qi[keep], ci[keep]
        found = [np.r_[x, y] for x, y in zip(best, (qi, ci, scores(qv[qi], cv[ci])))]
        at = first_k(found[0], (-found[2], c_id[found[1]], c_row[found[1]]), k)
        best = [x[at] for x in found]
        held = np.bincount(best[0], minlength=len(q))
        full = np.flatnonzero(held >= k)
        bound[full] = np.maximum(bound[full], best[2][np.cumsum(held)[full] - 1])
    qi, ci, s = best
    return pd.DataFrame({"query_row": q_row[qi], "query_id": q["id"].array[qi], "row": c_row[ci], "vec_id": c["id"].array[ci], "score": s})


def top_products(vectors: DataFrame, id_column: str, vector: Column, is_query: Column, k: int) -> DataFrame:
    """For each row that is a query, the k other rows of the largest inner product: query_id, rank, vec_id, score."""
    rows, d = prepared(vectors, id_column, vector, is_query)
    n, m = rows.agg(F.count("*"), F.count_if("is_query")).first()
    turn = rotation(rows, d) if n else np.eye(1)
    head = rows.orderBy(F.desc("length"), "row").limit(HEAD).drop("is_query").toPandas()

    def first_bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for q in batches:
            q["bound"] = -np.inf
            found = search_block(q, head, d, turn, k)
            kth = found.groupby("query_row")["score"].agg(["size", "min"])
            kth = kth[kth["size"] >= k]["min"]
            yield q.assign(bound=q["row"].map(kth).fillna(-np.inf).astype(float))

    queries = rows.filter("is_query").drop("is_query").mapInPandas(first_bound, "row long, id long, length double, v binary, bound double")
    blocks, query_blocks = math.ceil(max(n, 1) / CANDIDATES), math.ceil(max(m, 1) / QUERIES)
    dealt = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    c = rows.drop("is_query").select("*", dealt(blocks).alias("block"), every(query_blocks).alias("query_block"))
    q = queries.select("*", dealt(query_blocks).alias("query_block"), every(blocks).alias("block"))
    keys = ["block", "query_block"]

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return search_block(q, c, d, turn, k)

    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(search, "query_row long, query_id long, row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(vector: Column, by: int = 64) -> Column:
    """floor(by * x) of every component as double; null unless the vector takes part."""
    return F.when(sound(vector), F.transform(vector, lambda x: F.floor(F.lit(float(by)) * x.cast("double"))))
