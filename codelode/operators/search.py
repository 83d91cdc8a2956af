"""Searching chunks: by vector, by lines, and from a chunk to what is round it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine

#: Questions of a repository that meet its chunks at once, and about so many of its chunks.
BLOCK, SLICE = 1024, 8192


def best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, repo, score (cosine; 0 with a zero vector): the k best chunks of the question's repository, ties by id.

    queries: query_id, repo, vector; chunks: id, repo, embedding. Vectors that are null, hold a null, or haven't the questions' usual
    dimension take no part. A repository's chunks are dealt into slices by their number, each slice meets
    the repository's questions in blocks, and hands on its k best per question, so that only those are shuffled again.
    """
    queries = queries.select(*[F.col(c).alias(c) for c in ("query_id", "repo", "vector")])  # apart from chunks, where both come from one table
    usual = queries.select(F.mode(F.size("vector"), True).alias("d")).first().d if queries.columns else None
    sound = lambda c: F.coalesce(F.size(c) == F.lit(usual), F.lit(False)) & ~F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(True))
    slices = chunks.groupBy("repo").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("_slices"))
    queries, chunks = queries.filter(sound("vector")), chunks.filter(sound("embedding"))
    left = queries.select("query_id", "repo", "vector", F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)).alias("_h"))
    blocks = left.groupBy("repo").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks")).join(slices, "repo")
    left = left.join(blocks, "repo").select("query_id", "repo", "vector", (F.col("_h") % F.col("_blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("slice"))
    right = chunks.join(blocks, "repo").select("id", "repo", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_blocks") - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("id"), F.col("_slices")).cast("int").alias("slice"))
    keys = ["repo", "block", "slice"]
    id_type, query_type = chunks.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
            vectors, ids = unit(np.stack(c["embedding"]).astype(float)), c["id"].to_numpy()
            wanted = unit(np.stack(q["vector"]).astype(float))
            for i, query_id in enumerate(q["query_id"]):
                s = (vectors * wanted[i]).sum(axis=1)
                at = np.lexsort((ids, -s))[:k]
                out.append(pd.DataFrame({"query_id": query_id, "id": ids[at], "repo": q["repo"].iloc[0], "score": s[at]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "id", "repo", "score"])

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, f"query_id {query_type}, id {id_type}, repo string, score double")
    return best(found, k).select("query_id", "rank", "id", "repo", "score")


def top_k_sql(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The same by column expressions, for few questions: broadcast if Spark finds them small."""
    scored = queries.join(chunks, "repo").select("query_id", "id", "repo", cosine(F.col("vector"), F.col("embedding")).alias("score"))
    return best(scored, k).select("query_id", "rank", "id", "repo", "score")


def overlapping(ranges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that share a line with a range (repo, path, first_line, last_line), with the range's columns."""
    hit = (F.col("start_line") <= F.col("last_line")) & (F.col("end_line") >= F.col("first_line"))
    return ranges.join(chunks, ["repo", "path"]).filter(hit)


def expand_parents(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, rank, and context: all chunks round a hit, within its parent's lines, in the order of lines.

    hits: query_id, rank, repo, path, parent_start_line, parent_end_line. A context is bounded by the tokens of a parent.
    """
    ranges = hits.select("query_id", "rank", "repo", "path", F.col("parent_start_line").alias("first_line"), F.col("parent_end_line").alias("last_line"))
    part = F.struct("start_line", "chunk_index", "end_line", "id", "text")
    return overlapping(ranges, chunks).groupBy("query_id", "rank").agg(F.array_sort(F.collect_list(part)).alias("context"))
