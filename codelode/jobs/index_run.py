"""One run over the snapshots of many repositories: what changed is verified, read, chunked, embedded and stored, what is gone is deleted.

The index is a folder of tables kept as deltas (`operators.tablelog`): chunks with embeddings, the ledger of files, records of
repositories, quarantined contents, and the log of jobs. Chunks are written first, then the ledger, then the records; all of them become
visible in one commit, together with the job's end. A run that breaks off leaves its job as failed, with type and message, and the index as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.redaction import redact_documents
from ..operators import index, repomap, store
from ..operators.chunk import chunk_documents
from ..operators.embed import hash_embed
from ..operators.readers import read_documents
from ..operators.select import select_files, size_guard
from ..operators.tablelog import Table, TableLog, Version
from ..sources.contents import guarded
from .shared import cut

KEY = ["repo", "path", "blob_sha"]
#: Contents (repo, path, content: bytes), or what gives those of wanted files (repo, commit_sha, path, blob_sha, size), such as `landed.contents_in`.
Contents = DataFrame | Callable[[DataFrame], DataFrame]
TABLES = {
    "chunks": Table(
        "id string, repo string, path string, blob_sha string, language string, chunk_index int, start_line int, end_line int, parent_start_line int, parent_end_line int, "
        "scope string, text string, embed_text string, token_count int, embedding array<float>",
        ("repo", "path"),
    ),
    "ledger": Table("repo string, path string, blob_sha string", ("repo", "path")),
    "repos": Table("repo string, indexed_sha string, embedding_model string, file_count long", ("repo",)),
    "quarantine": Table("id string, repo string, path string, blob_sha string, reason string"),
    "jobs": Table("id string, repo string, status string, error string, files_total long, files_done long, chunks_written long, updated_at timestamp, seq int"),
}
#: States of a job, in order.
QUEUED, RUNNING, ENDED = 0, 1, 2
#: Characters of text that make a chunk, about.
CHUNK_CHARS = 1_000


def open_index(spark: SparkSession, root: str) -> TableLog:
    return TableLog(spark, root, TABLES)


def stored_table(spark: SparkSession, root: str, name: str, repos: DataFrame | None = None) -> DataFrame:
    """A table of the index as last committed; with `repos` (repo), only the folders that these are in are read."""
    log = open_index(spark, root)
    return log.read(log.latest(), name, repos)


def jobs(spark: SparkSession, root: str) -> DataFrame:
    """The newest event of every job."""
    return store.current_jobs(stored_table(spark, root, "jobs"), keys=["id", "repo"])


class JobLog:
    """Events of one run's jobs, a job per repository."""

    def __init__(self, log: TableLog, job: str):
        self.log, self.job = log, job

    def events(self, repos: DataFrame, status: str, seq: int, **fields) -> DataFrame:
        """Rows of repos (repo, ...) as events; fields: columns."""
        known = {"error": F.lit(None).cast("string"), "files_total": F.lit(None).cast("long"), "files_done": F.lit(0).cast("long"), "chunks_written": F.lit(0).cast("long")} | fields
        return repos.select(*store.job_event(self.job, F.col("repo"), status, **known), F.lit(seq).alias("seq"))

    def write(self, base: Version, repos: DataFrame, status: str, seq: int, **fields) -> Version:
        return self.log.commit(base, {"jobs": [self.log.stage("jobs", self.events(repos, status, seq, **fields), 1)[0]]}, info={"job": self.job, "status": status})


def run(heads: DataFrame, listing: DataFrame, contents: Contents, root: str, settings: Settings = Settings(), model: str = "hash") -> DataFrame:
    """Indexes heads (repo, full_name, ref, commit_sha, forced) by listing (repo, ord, path, blob_sha, size) and landed contents
    (repo, path, content: bytes; or a function that fetches those of the files that are new or changed, and of READMEs, once for the run); gives
    the summary of the run, a row per head, with `refused`: why a repository was left alone, or null.

    What is up to date is skipped; what was forced, or has vectors of another model, starts anew. A repository beyond the limits of
    size, or of which too many contents failed, is left as it is. A file whose content has not landed, has another hash than its listing
    says, is too large or not text is quarantined: it keeps its old chunks and hash, its repository doesn't count
    as indexed, and the next run takes it again. Repeated heads, paths and contents count once.
    """
    spark = heads.sparkSession
    log = open_index(spark, root)
    heads, base = heads.dropDuplicates(["repo"]), log.latest()
    known = cut(log.read(base, "repos", heads))
    planned = cut(index.plan(heads, known, model))
    active = planned.filter("action <> 'skip'")
    if active.isEmpty():
        return summarized(log, base, planned, known, spark.createDataFrame([], "repo string, path string, blob_sha string, status string"), spark.createDataFrame([], "repo string, path string, failed string, redactions int"), spark.createDataFrame([], "repo string"), spark.createDataFrame([], "repo string, refused string"))
    job = JobLog(log, uuid.uuid4().hex)
    base = job.write(base, active, "queued", QUEUED)
    try:
        return indexed(log, job, base, heads, planned, known, listing, contents, settings, model)
    except Exception as e:
        job.write(log.latest(), active, "failed", ENDED, error=F.lit(f"{type(e).__name__}: {str(e)[:500]}"))
        raise


def indexed(log: TableLog, job: JobLog, base: Version, heads: DataFrame, planned: DataFrame, known: DataFrame, listing: DataFrame, contents: Contents, settings: Settings, model: str) -> DataFrame:
    active = planned.filter("action <> 'skip'")
    files = listing.join(active.select("repo"), "repo", "left_semi").dropDuplicates(["repo", "path"])
    chosen = select_files(files, settings)
    too_large = cut(size_guard(chosen, settings).filter("rejected is not null").select("repo", F.col("rejected").alias("refused")))
    chosen = cut(chosen.join(too_large, "repo", "left_anti").select("repo", "ord", "path", "blob_sha"))
    ledger = index.reset(log.read(base, "ledger", active), active)
    # only what the run's repositories have is compared
    changes = cut(index.diff(chosen, ledger.join(active.join(too_large, "repo", "left_anti").select("repo"), "repo", "left_semi")))
    wanted = changes.filter("status in ('added', 'changed')").select(KEY)
    base = job.write(base, active.join(wanted.groupBy("repo").agg(F.count("*").alias("n")), "repo", "left"), "running", RUNNING, files_total=F.coalesce("n", F.lit(0)).cast("long"))
    readme_keys = repomap.find_readme(chosen).join(chosen, ["repo", "path"]).select(KEY)
    if not isinstance(contents, DataFrame):
        asked = wanted.unionByName(readme_keys).distinct().join(active.select("repo", "commit_sha"), "repo").join(files.select("repo", "path", "size"), ["repo", "path"])
        contents = cut(contents(asked).select("repo", "path", "content"))
    accepted, quarantined, aborted = guarded(wanted, contents, settings)
    refused = cut(too_large.unionByName(aborted.select("repo", F.col("message").alias("refused"))))
    active = cut(active.join(refused, "repo", "left_anti"))
    mine = active.select("repo")
    changes = changes.join(mine, "repo", "left_semi")
    read = cut(redact_documents(read_documents(accepted.select(*KEY, "text"))))
    readmes = guarded(readme_keys.join(mine, "repo", "left_semi"), contents, settings)[0].select("repo", "text")
    maps = redact_documents(repomap.build(active.select("repo", "full_name", "ref", "commit_sha"), files.join(mine, "repo", "left_semi"), chosen, readmes))
    documents = read.unionByName(maps.select(read.columns))
    chunked = chunk_documents(documents, settings).withColumn("embedding", hash_embed(F.col("embed_text"), settings.vector_size).cast("array<float>"))
    size = read.agg(F.sum(F.length("text"))).first()[0] or 0
    done, failed = read.select(KEY), cut(quarantined.join(mine, "repo", "left_semi"))
    # what a run replaces: files that are gone, files that were done (they may have no chunks now), everything of what starts anew
    gone = changes.filter("status = 'removed'").select("repo", "path").unionByName(done.select("repo", "path")).unionByName(active.filter("action = 'reset'").select("repo", F.lit(None).cast("string").alias("path")))
    dead = log.stage_gone(gone.distinct())
    new, said = log.stage("chunks", chunked, size // CHUNK_CHARS, tokens=F.sum("token_count"))
    after, _ = log.stage("ledger", done, 1)
    counts = index.repo_records(active.select("repo", "commit_sha"), chosen, failed).withColumn("embedding_model", F.lit(model))
    records, _ = log.stage("repos", counts, 1)
    written = log.rows_of("chunks", new, None).select("repo", "path") if new.rows else log.empty("chunks").select("repo", "path")
    per_repo = mine.join(written.groupBy("repo").agg(F.count("*").alias("chunks")), "repo", "left").join(done.groupBy("repo").agg(F.count("*").alias("files")), "repo", "left").join(wanted.groupBy("repo").agg(F.count("*").alias("n")), "repo", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    ends = job.events(per_repo, "succeeded", ENDED, files_total=number("n"), files_done=number("files"), chunks_written=number("chunks"))
    ends = ends.unionByName(job.events(refused, "failed", ENDED, error=F.concat(F.lit("Refused: "), "refused")))
    segments = {
        "chunks": [replace(new, gone=dead.gone)], "ledger": [replace(after, gone=dead.gone)], "repos": [records],
        "quarantine": [log.stage("quarantine", quarantined.withColumn("id", F.lit(job.job)), 1)[0]], "jobs": [log.stage("jobs", ends, 1)[0]],
    }
    now = log.commit(base, segments, touched=mine, info={"job": job.job, "status": "succeeded", "chunks": said["rows"], "tokens": said["tokens"] or 0})
    outcome = done.select("repo", "path").join(read.select("repo", "path", F.size("findings").alias("redactions")), ["repo", "path"], "left").withColumn("failed", F.lit(None).cast("string"))
    outcome = outcome.unionByName(failed.select("repo", "path", F.lit(None).cast("int").alias("redactions"), F.col("reason").alias("failed")))
    return summarized(log, now, planned, known, changes, outcome, written, refused)


def summarized(log: TableLog, version: Version, planned: DataFrame, known: DataFrame, changes: DataFrame, outcome: DataFrame, written: DataFrame, refused: DataFrame) -> DataFrame:
    """The summary of a run as of the version that it has committed."""
    counted = log.read(version, "chunks", planned).join(planned.select("repo"), "repo", "left_semi")
    return index.summary(planned, known, changes, outcome, counted, written).join(refused, "repo", "left")
