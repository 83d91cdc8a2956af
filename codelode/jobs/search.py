"""Answers questions: spark-submit codelode/jobs/search.py QUESTIONS ROOT OUT (Parquet of query_id, repo, text; the index's folder; where hits go)."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codelode.config import QUERY_PREFIX, Settings
from codelode.jobs.index_run import stored_table
from codelode.operators.embed import hash_embed
from codelode.operators.search import expand_parents, top_k


def main(questions: str, root: str, out: str, k: int = 5) -> None:
    spark = SparkSession.builder.appName("search").getOrCreate()
    dim = Settings().vector_size
    asked = spark.read.parquet(questions).select("query_id", "repo", hash_embed(F.concat(F.lit(QUERY_PREFIX), "text"), dim).alias("vector"))
    chunks = stored_table(spark, root, "chunks", asked)  # of the folders that the questions' repositories are in
    hits = top_k(asked, chunks.select("id", "repo", "embedding"), k)
    placed = hits.join(chunks.select("id", "path", "parent_start_line", "parent_end_line"), "id")
    expand_parents(placed, chunks).join(hits, ["query_id", "rank"]).write.mode("overwrite").parquet(out)


if __name__ == "__main__":
    main(*sys.argv[1:4])
