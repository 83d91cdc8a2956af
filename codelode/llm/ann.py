"""Approximate nearest neighbours by cosine: stable projections, a kd-tree, and a chi-square stopping test.

Unit vectors (whose squared distance is 2 - 2 * cosine) are projected by Gaussian, hence 2-stable, weights to `DIMENSIONS`
coordinates. A neighbour at squared distance s has a projected squared distance of s times a chi-square variable, so once
the next projected neighbour lies beyond quantile(CONFIDENCE) times the k-th best squared distance found so far, each of
the true k is among those already verified with probability CONFIDENCE or more, and the search stops.

The tree's upper levels are fitted on the projections of at most `SAMPLE` rows; every row is then indexed in its cell. A cell of
many rows, such as copies of one vector, is dealt into slices of bounded size with the cell's box. Each query searches its
own cell first, which gives a distance, and then only the cells whose boxes pass the test. Inside a slice the lower
levels are built over all its rows, and leaves are visited in the order of their distance.

Vectors that are null, empty, zero, hold null or non-finite components, or have another than the most frequent number of
components take no part; those of any other length do, however large or small. Ties go to the smaller id, then to the row. Repeated rows are separate candidates, and a query leaves out
its own row only. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import seeded, stored
from .vectors import matrix, of_common_length, sound

DIMENSIONS, CONFIDENCE, SEED = 8, 0.985, 11
#: Rows that the upper levels are fitted on, rows of a slice, rows of a leaf, queries of a group, leaves a step.
SAMPLE, SLICE, LEAF, QUERIES, STEP = 16_384, 8_192, 256, 2_048, 4


def chi_square_quantile(p: float, dimensions: int) -> float:
    """The quantile for an even number of dimensions, by bisection of the closed form."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dimensions // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def splits(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A balanced kd-tree as a heap of (axis, value): the children of node i are 2 i + 1 and 2 i + 2."""
    tree, level = [], [points]
    for _ in range(depth):
        below = []
        for x in level:
            axis = int(np.ptp(x, axis=0).argmax()) if len(x) else 0
            value = float(np.median(x[:, axis])) if len(x) else 0.0
            tree.append((axis, value))
            left = x[:, axis] < value
            below += [x[left], x[~left]]
        level = below
    return tree


def cell_of(points: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    """The leaf of the upper levels that each point falls into."""
    node, inner = np.zeros(len(points), int), len(tree)
    if inner:
        axis, value = np.array([a for a, _ in tree]), np.array([v for _, v in tree])
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] >= value[node])
    return node - inner


def leaves(points: np.ndarray) -> list[np.ndarray]:
    """The lower levels: positions of the points of each leaf."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        axis = int(np.ptp(points[at], axis=0).argmax()) if len(at) else 0
        if len(at) <= LEAF:
            done.append(at)
        else:
            half = len(at) // 2
            at = at[np.argpartition(points[at, axis], half)]
            todo += [at[:half], at[half:]]
    return done


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    gap = np.maximum(np.maximum(low[None] - points[:, None], points[:, None] - high[None]), 0)
    return (gap**2).sum(axis=2)


def search_slice(q: pd.DataFrame, c: pd.DataFrame, d: int, k: int, limit: float) -> pd.DataFrame:
    """For each query the k nearest rows of a slice, as far as the stopping test lets the search go; q.far: a squared distance already reached by k rows."""
    qv, cv, qp, cp = matrix(q["v"], "<f8", d), matrix(c["v"], "<f8", d), matrix(q["p"], "<f8", DIMENSIONS), matrix(c["p"], "<f8", DIMENSIONS)
    q_row, c_row, c_id = q["row"].to_numpy(), c["row"].to_numpy(), c["id"].fillna(-(2**63)).to_numpy(np.int64)
    q_len, c_len = np.sqrt((qv**2).sum(axis=1)), np.sqrt((cv**2).sum(axis=1))
    parts = leaves(cp)
    low, high = np.array([cp[x].min(axis=0) for x in parts]), np.array([cp[x].max(axis=0) for x in parts])
    reached, nearest_boxes = q["far"].to_numpy(float), box_distance(qp, low, high)
    query, hits, scored = [], [], []
    for i in range(len(q)):
        near, far = nearest_boxes[i], reached[i]
        order = np.argsort(near, kind="stable")
        at, score = np.zeros(0, np.int64), np.zeros(0)
        for a in range(0, len(order), STEP):
            if near[order[a]] > limit * far:
                break
            new = np.concatenate([parts[j] for j in order[a : a + STEP] if near[j] <= limit * far])
            new = new[(((cp[new] - qp[i]) ** 2).sum(axis=1) <= limit * far) & (c_row[new] != q_row[i])]
            exact = (cv[new] * qv[i]).sum(axis=1) / (c_len[new] * q_len[i])
            at, score = np.r_[at, new], np.r_[score, exact]
            best = np.lexsort((c_row[at], c_id[at], -score))[:k]
            at, score = at[best], score[best]
            if len(at) == k:
                far = min(far, max(0.0, 2 - 2 * score[-1]) + 1e-9)
        query.append(np.full(len(at), i))
        hits.append(at)
        scored.append(score)
    i, at, score = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((query, np.int64), (hits, np.int64), (scored, float)))
    return pd.DataFrame({"query_row": q_row[i], "query_id": q["id"].array[i], "row": c_row[at], "vec_id": c["id"].array[at], "score": score})


FOUND = "query_row long, query_id long, row long, vec_id long, score double"


def nearest(vectors: DataFrame, id_column: str, vector: Column, is_query: Column, k: int) -> DataFrame:
    """For each row that is a query, the k nearest other rows found: query_id, rank, vec_id, score (cosine)."""
    usable = vectors.select(F.col(id_column).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.when(sound(vector), F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    usable, d = of_common_length(usable.filter(F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))), "v")
    weights = np.random.default_rng(SEED).standard_normal((max(d, 1), DIMENSIONS))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            # by a power of two, which changes no cosine: squares of what is left neither vanish nor overflow
            v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])
            p = v / np.sqrt((v**2).sum(axis=1, keepdims=True)) @ weights
            yield pa.RecordBatch.from_arrays([b["row"], b["id"], b["is_query"], *[pa.array([r.tobytes() for r in x], pa.binary()) for x in (v, p)]], names=["row", "id", "is_query", "v", "p"])

    rows = stored(usable.select(F.monotonically_increasing_id().alias("row"), "id", "is_query", "v").mapInArrow(project, "row long, id long, is_query boolean, v binary, p binary"))
    n = rows.count()
    sample = matrix([r.p for r in rows.select("p").orderBy(seeded(SEED, "row")).limit(SAMPLE).collect()], "<f8", DIMENSIONS)
    depth = max(0, min(math.ceil(math.log2(max(n, 1) / SLICE)), int(math.log2(max(len(sample), 1) / 16)) if len(sample) >= 16 else 0))
    tree = splits(sample, depth)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = cell_of(matrix(b["p"].to_pylist(), "<f8", DIMENSIONS), tree)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=[*b.schema.names, "cell"])

    indexed = stored(rows.mapInArrow(index, "row long, id long, is_query boolean, v binary, p binary, cell int"))

    def boxes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = {}
        for b in batches:
            p, cell = matrix(b["p"].to_pylist(), "<f8", DIMENSIONS), b["cell"].to_numpy()
            for j in np.unique(cell):
                x = p[cell == j]
                low, high, m = known.get(int(j), (np.inf, -np.inf, 0))
                known[int(j)] = [np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0)), m + len(x)]
        yield pa.RecordBatch.from_arrays([pa.array(known.keys(), pa.int32()), *[pa.array([x[i].tolist() for x in known.values()], pa.list_(pa.float64())) for i in (0, 1)], pa.array([x[2] for x in known.values()], pa.int64())], names=["cell", "low", "high", "m"])

    axes = range(DIMENSIONS)
    # At most SAMPLE / 16 cells: a bounded table.
    cells = indexed.select("p", "cell").mapInArrow(boxes_of, "cell int, low array<double>, high array<double>, m long").groupBy("cell").agg(F.array(*[F.min(F.col("low")[j]) for j in axes]).alias("low"), F.array(*[F.max(F.col("high")[j]) for j in axes]).alias("high"), F.sum("m").alias("m")).orderBy("cell").toPandas()
    low, high = (np.array(cells[x].tolist()).reshape(-1, DIMENSIONS) for x in ("low", "high"))
    number, slices = cells["cell"].to_numpy(), -(-cells["m"].to_numpy(np.int64) // (2 * SLICE))
    slices_of = F.create_map(*[F.lit(int(x)) for pair in zip(number, slices) for x in pair]) if n else F.create_map(F.lit(0), F.lit(1))
    limit = chi_square_quantile(CONFIDENCE, DIMENSIONS)
    c = indexed.select("row", "id", "v", "p", "cell", F.pmod(seeded(SEED, "row"), slices_of[F.col("cell")]).cast("int").alias("slice"))
    queries = indexed.filter("is_query").select("row", "id", "v", "p", "cell")
    routed = "row long, id long, v binary, p binary, far double, cell int, slice int"

    def visits(own: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for q in batches:
                if own:
                    at = np.arange(len(q)), np.searchsorted(number, q["cell"].to_numpy())
                else:
                    at = np.nonzero((box_distance(matrix(q["p"], "<f8", DIMENSIONS), low, high) <= limit * q["far"].to_numpy()[:, None]) & (number[None] != q["cell"].to_numpy()[:, None]))
                qi, ci = np.repeat(at[0], slices[at[1]]), np.repeat(at[1], slices[at[1]])
                piece = np.concatenate([np.arange(slices[x]) for x in at[1]]) if len(at[1]) else np.zeros(0, int)
                yield q.iloc[qi][["row", "id", "v", "p", "far"]].assign(cell=number[ci], slice=piece)

        return run

    def search(sent: DataFrame) -> DataFrame:
        groups = sent.groupBy("cell", "slice").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
        keys = ["cell", "slice", "group"]
        left = sent.join(groups, ["cell", "slice"]).withColumn("group", F.pmod(seeded(SEED, "row"), F.col("groups")).cast("int")).drop("groups")
        right = c.join(groups, ["cell", "slice"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda q, c: search_slice(q, c, d, k, limit), FOUND)

    first = stored(search(queries.withColumn("far", F.lit(float("inf"))).mapInPandas(visits(True), routed)))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    kth = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(F.col("query_row").alias("row"), (2 - 2 * F.col("score") + 1e-9).alias("far"))
    others = queries.join(kth, "row", "left").withColumn("far", F.greatest(F.coalesce("far", F.lit(float("inf"))), F.lit(0.0)))
    found = first.unionByName(search(others.mapInPandas(visits(False), routed)))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
