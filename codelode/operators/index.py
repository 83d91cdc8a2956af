"""Incremental indexing: what changed, what to do about it, and what a run came to.

heads: repo, commit_sha, forced (of the snapshots to index); repos: repo, indexed_sha, embedding_model, file_count; selected: repo,
path, blob_sha, size; ledger: repo, path, blob_sha of what is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILE = ["repo", "path"]


def plan(heads: DataFrame, repos: DataFrame, model: str) -> DataFrame:
    """Adds action to heads: `skip` what is up to date, `reset` what was forced or has vectors of another model, else `update`."""
    known = heads.join(repos.select("repo", "indexed_sha", "embedding_model"), "repo", "left")
    other = F.col("embedding_model").isNotNull() & (F.col("embedding_model") != model)
    action = F.when(F.col("forced") | other, "reset").when(F.col("indexed_sha") == F.col("commit_sha"), "skip").otherwise("update")
    return known.withColumn("action", action).drop("indexed_sha", "embedding_model")


def reset(table: DataFrame, planned: DataFrame) -> DataFrame:
    """A table without the rows of repositories that start anew."""
    return table.join(planned.filter("action = 'reset'").select("repo"), "repo", "left_anti")


def diff(selected: DataFrame, ledger: DataFrame) -> DataFrame:
    """repo, path, blob_sha, status: added, changed, unchanged or removed."""
    new, old = selected.select(*FILE, F.col("blob_sha").alias("_new")), ledger.select(*FILE, F.col("blob_sha").alias("_old"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_new") == F.col("_old"), "unchanged").otherwise("changed")
    return new.join(old, FILE, "full_outer").select(*FILE, F.coalesce("_new", "_old").alias("blob_sha"), status.alias("status"))


def to_fetch(changes: DataFrame, readmes: DataFrame) -> DataFrame:
    """repo, path, index_it: new and changed files, and the README of each repository, which is fetched in any case."""
    changed = changes.filter("status in ('added', 'changed')").select(*FILE).withColumn("index_it", F.lit(True))
    return changed.unionByName(readmes.select(*FILE).join(changed, FILE, "left_anti").withColumn("index_it", F.lit(False)))


def apply(chunks: DataFrame, ledger: DataFrame, changes: DataFrame, new_chunks: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks and ledger after a run: those of removed files go; those of files that were done (repo, path, blob_sha) are replaced.

    Write the ledger last: a file counts as done only once its chunks are stored. A changed file that failed keeps its old
    chunks and its old hash, so that the next run takes it again.
    """
    gone = changes.filter("status = 'removed'").select(*FILE).unionByName(done.select(*FILE))
    kept = chunks.join(gone, FILE, "left_anti").unionByName(new_chunks.join(done.select(*FILE), FILE, "left_semi").select(chunks.columns))
    return kept, ledger.join(gone, FILE, "left_anti").unionByName(done.select(ledger.columns))


def job_progress(batches: DataFrame) -> DataFrame:
    """Adds files_done and chunks_written so far to stored batches (job, seq, files, chunks)."""
    upto = Window.partitionBy("job").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return batches.withColumns({"files_done": F.sum("files").over(upto), "chunks_written": F.sum("chunks").over(upto)})


def summary(planned: DataFrame, repos: DataFrame, changes: DataFrame, outcome: DataFrame, chunks: DataFrame, written: DataFrame) -> DataFrame:
    """A row per repository of heads: files selected, fetched, unchanged, removed, failed, redactions, chunks written and stored.

    outcome: repo, path, failed (why, or null), redactions of the files that were fetched to be indexed. What was up to date reports
    its stored number of files as selected and unchanged.
    """
    status = lambda s: F.count_if(F.col("status") == s)
    by_change = changes.groupBy("repo").agg((F.count("*") - status("removed")).alias("files_selected"), status("unchanged").alias("files_unchanged"), status("removed").alias("files_removed"))
    bad = F.when(F.col("failed").isNotNull(), F.struct("path", "failed"))
    by_outcome = outcome.groupBy("repo").agg(F.count_if(F.col("failed").isNull()).alias("files_fetched"), F.map_from_entries(F.array_sort(F.collect_list(bad))).alias("failed"), F.sum(F.when(F.col("failed").isNull(), F.col("redactions"))).alias("redactions"))
    stored = chunks.groupBy("repo").agg(F.count("*").alias("chunk_count"))
    new = written.groupBy("repo").agg(F.count("*").alias("chunks_written"))
    rows = planned.select("repo", "action").join(repos.select("repo", "file_count"), "repo", "left")
    for part in (by_change, by_outcome, stored, new):
        rows = rows.join(part, "repo", "left")
    skipped = F.col("action") == "skip"
    number = lambda c, skip: F.coalesce(F.when(skipped, skip).otherwise(F.col(c)), F.lit(0)).cast("long").alias(c)
    zero, all_ = F.lit(0), F.col("file_count")
    return rows.select("repo", skipped.alias("up_to_date"), number("files_selected", all_), number("files_fetched", zero), number("files_unchanged", all_), number("files_removed", zero), F.coalesce("failed", F.create_map().cast("map<string,string>")).alias("failed"), number("redactions", zero), number("chunks_written", zero), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def repo_records(heads: DataFrame, selected: DataFrame, failed: DataFrame) -> DataFrame:
    """repo, file_count, indexed_sha: the commit counts as indexed only if no selected file failed."""
    counts = selected.groupBy("repo").agg(F.count("*").alias("_n"))
    bad = selected.select(*FILE).join(failed.select(*FILE), FILE, "left_semi").groupBy("repo").agg(F.count("*").alias("_bad"))
    n = F.coalesce("_bad", F.lit(0))
    joined = heads.join(counts, "repo", "left").join(bad, "repo", "left")
    return joined.select("repo", (F.coalesce("_n", F.lit(0)) - n).alias("file_count"), F.when(n == 0, F.col("commit_sha")).alias("indexed_sha"))
