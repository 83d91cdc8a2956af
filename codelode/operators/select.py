"""Choosing which listed files to index. listing: repo, path, size, ..."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.paths import skip_reason


def with_reason(listing: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return listing.withColumn("skip_reason", skip_reason(F.col("path"), F.col("size"), settings))


def select_files(listing: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return with_reason(listing, settings).filter("skip_reason is null").drop("skip_reason")


def skip_counts(listing: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """repo, skip_reason, files."""
    return with_reason(listing, settings).filter("skip_reason is not null").groupBy("repo", "skip_reason").agg(F.count("*").alias("files"))


def size_guard(selected: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """repo, files, bytes, rejected (why, or null): a repository beyond a limit is rejected, the others go on."""
    per_repo = selected.groupBy("repo").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    files = F.concat(F.col("files").cast("string"), F.lit(f" files, the limit is {settings.repo_files}"))
    size = F.concat(F.col("bytes").cast("string"), F.lit(f" bytes, the limit is {settings.repo_bytes}"))
    return per_repo.withColumn("rejected", F.when(F.col("files") > settings.repo_files, files).when(F.col("bytes") > settings.repo_bytes, size))
