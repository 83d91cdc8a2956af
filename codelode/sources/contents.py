"""Contents of listed files (`landed` has how they are read): accepted or refused, and what a fetch came to.

wanted: repo, path, size, blob_sha, ... of the files asked for. contents: repo, path, content (bytes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.paths import max_bytes
from ..functions.text import decode_text, git_blob_sha
from ..jobs.shared import cut


def merge_contents(wanted: DataFrame, raw: DataFrame, unpacked: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """repo, path, content, via, method: the archive for repositories of more than a threshold of wanted files, single files for the others.

    A broken archive's repository takes the paths that the archive hasn't given as single files.
    """
    large = wanted.groupBy("repo").agg(F.count("*").alias("n")).filter(F.col("n") > settings.archive_from).select("repo")
    keys = wanted.select("repo", "path")
    given = unpacked.filter("path is not null").join(large, "repo", "left_semi").join(keys, ["repo", "path"], "left_semi").select("repo", "path", "content").withColumn("via", F.lit("tarball"))
    broken = unpacked.filter("broken").select("repo").distinct().join(large, "repo", "left_semi")
    single = raw.join(keys, ["repo", "path"], "left_semi")
    ordinary = single.join(large, "repo", "left_anti")
    fallen_back = single.join(broken, "repo", "left_semi").join(given, ["repo", "path"], "left_anti")
    method = large.join(broken.withColumn("_broken", F.lit(True)), "repo", "left").select("repo", F.when(F.col("_broken"), "tarball+raw").otherwise("tarball").alias("method"))
    rest = ordinary.unionByName(fallen_back).select("repo", "path", "content").withColumn("via", F.lit("raw"))
    return given.unionByName(rest).join(method, "repo", "left").withColumn("method", F.coalesce("method", F.lit("raw")))


def accept(fetched: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds refused (why, or null) and text to files (path, blob_sha, content). The first rule that holds gives the reason."""
    content = F.col("content")
    text = decode_text(content)
    refused = F.when(F.octet_length(content) > max_bytes(F.col("path"), settings), "too_large").when(git_blob_sha(content) != F.col("blob_sha"), "integrity_mismatch").when(text.isNull(), "binary")
    return fetched.withColumn("refused", refused).withColumn("text", F.when(F.col("refused").isNull(), text))


def missing(wanted: DataFrame, unpacked: DataFrame, failed: DataFrame) -> DataFrame:
    """repo, path, reason: failed ones with their reason, and wanted paths that an archive doesn't hold."""
    absent = wanted.select("repo", "path").join(unpacked, ["repo", "path"], "left_anti").join(failed, ["repo", "path"], "left_anti")
    return failed.select("repo", "path", "reason").unionByName(absent.withColumn("reason", F.lit("missing_in_archive")))


def guarded(wanted: DataFrame, landed: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a batch may index, what it refuses, and whom it leaves alone.

    wanted: repo, path, blob_sha; landed: repo, path, content. Gives accepted files (repo, path, blob_sha, text, bytes); the quarantine (repo,
    path, blob_sha, reason): refused contents by the first rule of `accept` that holds, and not_found where nothing has landed; and aborted
    repositories (repo, message): those of which more bytes are accepted than the limit, or more than a share of the wanted files failed.
    Of an aborted repository nothing is accepted. A file that landed twice counts once: accepted if one of its contents is.
    """
    found = wanted.select("repo", "path", "blob_sha").join(landed.select("repo", "path", "content"), ["repo", "path"], "left")
    judged = accept(found, settings).withColumn("reason", F.when(F.col("content").isNull(), "not_found").otherwise(F.col("refused")))
    best = F.min_by(F.struct("reason", "text", F.octet_length("content").alias("bytes")), F.struct(F.col("reason").isNotNull(), "reason"))
    files = judged.groupBy("repo", "path", "blob_sha").agg(best.alias("b")).select("repo", "path", "blob_sha", "b.*")
    files = cut(files)
    failed = files.filter("reason is not null")
    first = failed.withColumn("nth", F.row_number().over(Window.partitionBy("repo").orderBy("path"))).filter("nth <= 5")  # no more than five a task meet
    listed = first.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "reason"))), lambda f: F.concat(f["path"], F.lit(": "), f["reason"])), ", ").alias("listed"))
    counts = files.groupBy("repo").agg(F.count("*").alias("requested"), F.count("reason").alias("failed"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("bytes").cast("long"))), F.lit(0)).alias("bytes"))
    many = F.concat(F.col("failed").cast("string"), F.lit(" of "), F.col("requested").cast("string"), F.lit(" files failed: "), "listed")
    large = F.concat(F.col("bytes").cast("string"), F.lit(f" bytes, the limit is {settings.repo_bytes}"))
    message = F.when(F.col("bytes") > settings.repo_bytes, large).when(F.col("failed") > F.col("requested") * settings.failed_share, many)
    aborted = counts.join(listed, "repo", "left").select("repo", message.alias("message")).filter("message is not null")
    accepted = files.filter("reason is null").join(aborted, "repo", "left_anti").select("repo", "path", "blob_sha", "text", "bytes")
    return accepted, failed.select("repo", "path", "blob_sha", "reason"), aborted


def byte_guard(accepted: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """repo, bytes, aborted of accepted files (repo, size)."""
    return accepted.groupBy("repo").agg(F.sum("size").alias("bytes")).withColumn("aborted", F.col("bytes") > settings.repo_bytes)


def fetch_report(wanted: DataFrame, outcome: DataFrame) -> DataFrame:
    """repo, method, requested, fetched, bytes, failed (path -> reason) of wanted files and their outcome (repo, path, size, refused, method)."""
    known = wanted.select("repo", "path").join(outcome, ["repo", "path"], "left").withColumn("refused", F.when(F.col("size").isNull(), "not_found").otherwise(F.col("refused")))
    bad = F.when(F.col("refused").isNotNull(), F.struct("path", "refused"))
    return known.groupBy("repo").agg(F.coalesce(F.max("method"), F.lit("raw")).alias("method"), F.count("*").alias("requested"), F.count_if(F.col("refused").isNull()).alias("fetched"), F.coalesce(F.sum(F.when(F.col("refused").isNull(), F.col("size"))), F.lit(0)).alias("bytes"), F.map_from_entries(F.array_sort(F.collect_list(bad))).alias("failed"))


def failure_guard(report: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds aborted and message: more than a share of the files failed; the message lists the first five."""
    n = F.size("failed")
    first = F.transform(F.slice(F.array_sort(F.map_keys("failed")), 1, 5), lambda p: F.concat(p, F.lit(": "), F.col("failed")[p]))
    aborted = (F.col("requested") > 0) & (n > F.col("requested") * settings.failed_share)
    return report.withColumn("aborted", aborted).withColumn("message", F.when(F.col("aborted"), F.concat(n.cast("string"), F.lit(" of "), F.col("requested").cast("string"), F.lit(" files failed: "), F.array_join(first, ", "))))
