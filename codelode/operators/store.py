"""The tables of an index: chunks, file ledger, repositories, job log. Upserts and deletes give the new table; writing is separate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Folders that a stored table is dealt into by repository.
BUCKETS = 64


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """`existing` with the rows of `new` in place of those with their keys. Of several new rows with a key, the last by `order` holds."""
    if order:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new.select(existing.columns))


def delete_files(chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and the number deleted per repository (repo, deleted), when the files (repo, path) go."""
    keys = ["repo", "path"]
    return chunks.join(gone.select(keys), keys, "left_anti"), chunks.join(gone.select(keys), keys, "left_semi").groupBy("repo").agg(F.count("*").alias("deleted"))


def delete_repos(table: DataFrame, repos: DataFrame) -> DataFrame:
    return table.join(repos.select("repo"), "repo", "left_anti")


def lookup(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the asked keys; a key that isn't there gives nulls."""
    return keys.join(table, keys.columns, "left")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("repo").agg(F.count("*").alias("chunks"))


def list_repos(repos: DataFrame) -> DataFrame:
    return repos.orderBy("slug")


def job_event(job: str, repo: Column, status: str, **fields: Column) -> list[Column]:
    """Columns of one event of a job's life: queued, running, then succeeded or failed."""
    return [F.lit(job).alias("id"), repo.alias("repo"), F.lit(status).alias("status"), *[v.alias(k) for k, v in fields.items()], F.current_timestamp().alias("updated_at")]


def current_jobs(events: DataFrame, keys: list[str] = ["id"]) -> DataFrame:
    """The newest event of each job (keys, updated_at, seq, ...)."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("updated_at"), F.desc("seq"))
    return events.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The job of each repository that started last; of several, the one with the least id."""
    order = Window.partitionBy("repo").orderBy(F.desc("started_at"), "id")
    return jobs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def with_bucket(table: DataFrame) -> DataFrame:
    return table.withColumn("bucket", F.pmod(F.xxhash64("repo"), F.lit(BUCKETS)).cast("int"))


def write(table: DataFrame, path: str, touched: DataFrame | None = None) -> None:
    """Writes a table in folders by a hash of the repository; with `touched` (repo), only the folders of these are replaced.

    The folder that a table is read from mustn't be the one it is written to.
    """
    rows, spark = with_bucket(table), table.sparkSession
    dealt = lambda df: df.repartition("bucket", F.pmod(F.xxhash64("path"), F.lit(8)))
    if touched is None:
        dealt(rows).write.mode("overwrite").partitionBy("bucket").parquet(path)
        return
    buckets = with_bucket(touched).select("bucket").distinct()
    dealt(rows.join(buckets, "bucket", "left_semi")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    # A folder that gets no row isn't overwritten: where all rows of a bucket are gone, its folder goes (BUCKETS names at most).
    for bucket in buckets.join(rows.select("bucket").distinct(), "bucket", "left_anti").collect():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket.bucket}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
