"""The stream over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import language_of
from ..jobs.shared import cut, shared_dir
from ..streaming.index_stream import index_stream, stored_chunks
from .fixtures import LISTING2_SQL, LISTING_SQL, SELECTED2_SQL, SELECTED_SQL, SETTINGS, listing, listing2
from ..operators.select import select_files
from .registry import query


@query(f"WITH {LISTING_SQL}, {SELECTED_SQL} SELECT repo, path, blob_sha FROM selected WHERE path NOT LIKE '%.ipynb' AND regexp_matches(text, '[^\\s]') GROUP BY ALL")
def sm1_index_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected files landed and indexed as a stream: those of which chunks are stored."""
    root = f"{shared_dir(spark)}/codelode-{uuid.uuid4().hex}"
    files = select_files(listing(spark, sf_dir), SETTINGS).filter(language_of(F.col("path")) != "notebook")
    files.select("repo", F.when(F.col("path") == "README.md", F.concat(F.lit("README"), F.col("ord").cast("string"), F.lit(".md"))).otherwise(F.col("path")).alias("path"), "blob_sha", "text").write.parquet(f"{root}/landed")
    index_stream(spark, f"{root}/landed", root, SETTINGS).awaitTermination()
    return stored_chunks(spark, root).select("repo", F.regexp_replace("path", r"^README\d+\.md$", "README.md").alias("path"), "blob_sha").distinct()


NAME_SQL = "CASE WHEN path LIKE '%README.md' THEN 'README' || ord || '.md' ELSE path END"


@query(f"WITH {LISTING_SQL}, {LISTING2_SQL}, {SELECTED2_SQL} SELECT repo, {NAME_SQL} AS path, blob_sha, true AS embedded FROM selected2 WHERE path NOT LIKE '%.ipynb' AND regexp_matches(text, '[^\\s]')")
def sm1_stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits landed and indexed one after the other, the second with its changed, new and gone files: files of which chunks are stored at the end, and whether all have vectors."""
    root = f"{shared_dir(spark)}/codelode-{uuid.uuid4().hex}"
    name = F.when(F.col("path").endswith("README.md"), F.concat(F.lit("README"), F.col("ord").cast("string"), F.lit(".md"))).otherwise(F.col("path"))
    old, new = (cut(select_files(f(spark, sf_dir), SETTINGS).filter(language_of(F.col("path")) != "notebook").select("repo", name.alias("path"), "blob_sha", "text")) for f in (listing, listing2))
    gone = old.join(new, ["repo", "path"], "left_anti").select("repo", "path", F.lit(None).cast("string").alias("blob_sha"), F.lit(None).cast("string").alias("text"))
    for files in (old, new.unionByName(gone)):
        files.write.mode("append").parquet(f"{root}/landed")
        index_stream(spark, f"{root}/landed", root, SETTINGS, files_per_batch=1_000).awaitTermination()
    return stored_chunks(spark, root).groupBy("repo", "path", "blob_sha").agg(F.every(F.size("embedding") == SETTINGS.vector_size).alias("embedded"))
