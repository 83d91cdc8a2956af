"""Upserts, deletes, lookups, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from .fixtures import LISTING2_SQL, LISTING_SQL, listing, listing2, table
from .registry import query

JOBS_SQL = "jobs AS (SELECT 'r' || user_id AS repo, event_id AS id, ts AS started_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' WHEN 'view' THEN 'running' ELSE 'queued' END AS status, floor(value)::BIGINT AS files FROM events)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "view", "running").otherwise("queued")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("repo"), F.col("event_id").alias("id"), F.col("ts").alias("started_at"), kind.alias("status"), F.floor("value").cast("long").alias("files"))


@query(f"WITH {LISTING_SQL}, {LISTING2_SQL} SELECT repo, path, ord, blob_sha FROM v2 UNION ALL SELECT repo, path, ord, blob_sha FROM listing WHERE ord NOT IN (SELECT ord FROM v2)")
def st1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second commit's files over the first one's."""
    keep = ["repo", "path", "ord", "blob_sha"]
    return store.upsert(listing(spark, sf_dir).select(keep), listing2(spark, sf_dir).select(keep), ["ord"])


@query(f"WITH {JOBS_SQL} SELECT repo, id, status, files FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY started_at DESC, id DESC) AS n FROM jobs) WHERE n = 1")
def st2_upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as upserts of a repository's record: the last one of the batch holds."""
    rows = jobs(spark, sf_dir).withColumn("seq", F.struct("started_at", "id"))
    return store.upsert(rows.limit(0), rows, ["repo"], "seq").select("repo", "id", "status", "files")


@query(f"WITH {LISTING_SQL}, {LISTING2_SQL} SELECT repo, count(*) AS deleted FROM listing WHERE ord % 13 = 5 GROUP BY repo")
def jn8_delete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the first commit that the second one lacks."""
    unique = F.concat("path", F.lit("#"), F.col("ord").cast("string"))
    old, new = listing(spark, sf_dir).withColumn("path", unique), listing2(spark, sf_dir).withColumn("path", unique)
    return store.delete_files(old, old.join(new, ["repo", "path"], "left_anti"))[1]


@query(f"WITH {LISTING_SQL} SELECT repo, ord, blob_sha FROM listing WHERE ord % 13 <> 5")
def jn8_kept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that stay when these files go."""
    old = listing(spark, sf_dir).withColumn("path", F.concat("path", F.lit("#"), F.col("ord").cast("string")))
    return store.delete_files(old, old.filter("ord % 13 = 5"))[0].select("repo", "ord", "blob_sha")


@query(f"WITH {JOBS_SQL}, late AS (SELECT repo, id, status FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY started_at DESC, id DESC) AS n FROM jobs WHERE id % 3 = 0) WHERE n = 1), early AS (SELECT repo, max(id) AS id, 'old' AS status FROM jobs GROUP BY repo) SELECT * FROM late UNION ALL SELECT * FROM early ANTI JOIN late USING (repo)")
def st2_upsert_onto_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event as an upsert onto a record of each repository; records without one stay."""
    rows = jobs(spark, sf_dir).withColumn("seq", F.struct("started_at", "id"))
    known = rows.groupBy("repo").agg(F.max("id").alias("id")).withColumn("status", F.lit("old"))
    return store.upsert(known, rows.filter("id % 3 = 0"), ["repo"], "seq")


@query(f"WITH {LISTING_SQL} SELECT repo, ord, path FROM listing WHERE repo NOT LIKE '%7'")
def jn8_delete_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = listing(spark, sf_dir)
    return store.delete_repos(files, files.filter("repo like '%7'").select("repo").distinct()).select("repo", "ord", "path")


@query(f"WITH {JOBS_SQL}, k AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0) SELECT k.id, repo, status FROM k LEFT JOIN jobs USING (id)")
def jn9_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by id, some of which don't exist."""
    keys = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"))
    return store.lookup(jobs(spark, sf_dir), keys).select("id", "repo", "status")


@query(f"WITH {LISTING_SQL} SELECT repo, count(*) AS chunks FROM listing GROUP BY repo")
def ag9_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.chunk_counts(listing(spark, sf_dir))


@query(f"WITH {JOBS_SQL} SELECT repo, id, status FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY started_at DESC, id) AS n FROM jobs) WHERE n = 1")
def wn1_latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_jobs(jobs(spark, sf_dir)).select("repo", "id", "status")


@query("SELECT source AS slug, count(*) AS files FROM documents GROUP BY source ORDER BY source")
def tk2_list_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.list_repos(table(spark, sf_dir, "documents").groupBy(F.col("source").alias("slug")).agg(F.count("*").alias("files")))


FILES_SQL = "f AS (SELECT repo, path || '#' || ord AS path, ord, blob_sha FROM listing), f2 AS (SELECT repo, path || '#' || ord AS path, ord, blob_sha FROM v2)"


@query(f"""WITH {LISTING_SQL}, {LISTING2_SQL}, {FILES_SQL},
  one AS (SELECT repo, path, ord, blob_sha FROM f WHERE ord % 13 <> 5 AND ord % 7 <> 3 UNION ALL SELECT repo, path, ord, blob_sha FROM f2 WHERE ord < 1000000000 AND ord % 7 = 3),
  two AS (SELECT * FROM one WHERE repo NOT LIKE '%7' UNION ALL SELECT repo, path, ord, blob_sha FROM f2 WHERE ord >= 1000000000)
SELECT repo, path, CASE WHEN ord % 5 = 1 THEN 'third' ELSE blob_sha END AS blob_sha FROM two WHERE ord < 1000000000 OR ord % 5 <> 1 UNION ALL SELECT repo, path, 'third' FROM f2 WHERE ord >= 1000000000 AND ord % 5 = 1""")
def st1_table_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger kept as deltas: the first commit's files; those that the second one changes, and without those that it lacks; without the repositories that
    end in 7, and with its copies; a third hash for every fifth file that is there; compacted before the last of these, and after it."""
    import uuid

    from ..jobs.shared import shared_dir
    from ..operators.tablelog import Table, TableLog

    log = TableLog(spark, f"{shared_dir(spark)}/codelode-{uuid.uuid4().hex}", {"files": Table("repo string, path string, blob_sha string", ("repo", "path"))})
    named = lambda df: df.select("repo", F.concat_ws("#", "path", F.col("ord").cast("string")).alias("path"), "ord", "blob_sha")
    old, new = named(listing(spark, sf_dir)), named(listing2(spark, sf_dir))

    def commit(rows: DataFrame, gone: DataFrame | None = None) -> None:
        dead = [log.stage_gone(gone)] if gone is not None else []
        log.commit(log.latest(), {"files": [*dead, log.stage("files", rows, old.count())[0]]})

    commit(old)
    commit(new.filter("ord < 1000000000 and ord % 7 = 3"), old.filter("ord % 13 = 5"))
    commit(new.filter("ord >= 1000000000"), old.filter("repo like '%7'").select("repo", F.lit(None).cast("string").alias("path")).distinct())
    log.compact(2)
    commit(log.read(log.latest(), "files").filter("cast(substring_index(path, '#', -1) as long) % 5 = 1").withColumn("blob_sha", F.lit("third")))
    log.compact(2, whole=True)
    return log.read(log.latest(), "files")


@query(f"WITH {LISTING_SQL} SELECT repo, ord, path, blob_sha FROM listing")
def snk1_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written in folders by repository and read again."""
    import uuid

    from ..jobs.shared import shared_dir

    path = f"{shared_dir(spark)}/codelode-{uuid.uuid4().hex}"
    rows = listing(spark, sf_dir).select("repo", "ord", "path", "blob_sha")
    store.write(rows, path)
    return spark.read.schema(rows.schema).parquet(path).select(rows.columns)
