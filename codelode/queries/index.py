"""Plans, changes and summaries of indexing runs. The first commit's selected files are what is stored, the second commit is what comes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import index
from ..operators.select import select_files
from .fixtures import LISTING2_SQL, LISTING_SQL, SELECTED2_SQL, SELECTED_SQL, SETTINGS, listing, listing2, table
from .registry import query
from .store import JOBS_SQL, jobs

#: README files of a repository share their path, so the second and further ones are told apart by their number.
U = "CASE WHEN path LIKE '%README.md' THEN path || '#' || ord % 1000000000 ELSE path END"
BOTH_SQL = f"""{LISTING_SQL}, {LISTING2_SQL}, {SELECTED_SQL}, {SELECTED2_SQL}, n AS (SELECT * REPLACE ({U} AS path) FROM selected2), o AS (SELECT * REPLACE ({U} AS path) FROM selected),
  ch AS (SELECT repo, path, coalesce(n.blob_sha, o.blob_sha) AS blob_sha, CASE WHEN o.blob_sha IS NULL THEN 'added' WHEN n.blob_sha IS NULL THEN 'removed' WHEN n.blob_sha = o.blob_sha THEN 'unchanged' ELSE 'changed' END AS status FROM n FULL JOIN o USING (repo, path))"""


def old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    unique = F.expr("CASE WHEN path LIKE '%README.md' THEN concat(path, '#', cast(ord % 1000000000 AS string)) ELSE path END")
    old, new = (select_files(f(spark, sf_dir), SETTINGS).withColumn("path", unique) for f in (listing, listing2))
    return old, new


def heads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Segments of customers as forced or not, commits by key; what is known of those that have an even key."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    repo = F.concat(F.lit("r"), k.cast("string")).alias("repo")
    return c.select(repo, F.concat(F.lit("c"), (k % 4).cast("string")).alias("commit_sha"), (k % 10 == 4).alias("forced")), c.filter(k % 2 == 0).select(repo, F.when(k % 3 == 0, "c0").otherwise("c2").alias("indexed_sha"), F.when(k % 7 == 0, "old").otherwise("new").alias("embedding_model"), k.cast("long").alias("file_count"))


@query("""SELECT 'r' || c_custkey AS repo, CASE WHEN c_custkey % 10 = 4 OR (c_custkey % 2 = 0 AND c_custkey % 7 = 0) THEN 'reset'
  WHEN c_custkey % 2 = 0 AND CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 2 END = c_custkey % 4 THEN 'skip' ELSE 'update' END AS action FROM customer""")
def jn2_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.plan(*heads(spark, sf_dir), "new").select("repo", "action")


@query("SELECT 'r' || o_custkey AS repo, o_orderkey FROM orders WHERE NOT (o_custkey % 10 = 4 OR (o_custkey % 2 = 0 AND o_custkey % 7 = 0)) OR o_custkey NOT IN (SELECT c_custkey FROM customer)")
def st5_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored rows of customers' repositories."""
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("repo"), "o_orderkey")
    return index.reset(rows, index.plan(*heads(spark, sf_dir), "new"))


@query(f"WITH {BOTH_SQL} SELECT * FROM ch")
def jn1_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_and_new(spark, sf_dir)
    return index.diff(new, old)


README_SQL = "rm AS (SELECT repo, min_by(path, ord) AS path FROM n WHERE path LIKE 'README.md%' GROUP BY repo)"


@query(f"WITH {BOTH_SQL}, {README_SQL}, c AS (SELECT repo, path FROM ch WHERE status IN ('added', 'changed')) SELECT repo, path, true AS index_it FROM c UNION ALL SELECT repo, path, false FROM rm ANTI JOIN c USING (repo, path)")
def st4_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = old_and_new(spark, sf_dir)
    readmes = new.filter("path like 'README.md%'").groupBy("repo").agg(F.min_by("path", "ord").alias("path"))
    return index.to_fetch(index.diff(new, old), readmes)


#: Every ninth file fails.
DONE_SQL = "done AS (SELECT repo, path, n.blob_sha FROM n JOIN ch USING (repo, path) WHERE status IN ('added', 'changed') AND ord % 9 <> 1)"


@query(f"""WITH {BOTH_SQL}, {DONE_SQL}, gone AS (SELECT repo, path FROM ch WHERE status = 'removed' UNION ALL SELECT repo, path FROM done)
SELECT 'ledger' AS kind, repo, path, blob_sha FROM o ANTI JOIN gone USING (repo, path) UNION ALL SELECT 'ledger', repo, path, blob_sha FROM done
UNION ALL SELECT 'chunk', repo, path, blob_sha FROM o ANTI JOIN gone USING (repo, path) UNION ALL SELECT 'chunk', repo, path, blob_sha FROM done""")
def st3_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run in which every ninth file fails; a file has one chunk."""
    old, new = old_and_new(spark, sf_dir)
    changes, keep = index.diff(new, old), ["repo", "path", "blob_sha"]
    done = new.filter("ord % 9 <> 1").join(changes.filter("status in ('added', 'changed')").select("repo", "path"), ["repo", "path"]).select(keep)
    chunks, ledger = index.apply(old.select(keep), old.select(keep), changes, new.select(keep), done)
    return chunks.withColumn("kind", F.lit("chunk")).unionByName(ledger.withColumn("kind", F.lit("ledger")))


@query(f"WITH {JOBS_SQL} SELECT id AS seq, repo AS job, sum(files) OVER w AS files_done, sum(files * 2) OVER w AS chunks_written FROM jobs WINDOW w AS (PARTITION BY repo ORDER BY id ROWS UNBOUNDED PRECEDING)".replace("sum(files) OVER w", "(sum(files) OVER w)::BIGINT").replace("sum(files * 2) OVER w", "(sum(files * 2) OVER w)::BIGINT"))
def wn2_job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = jobs(spark, sf_dir).select(F.col("repo").alias("job"), F.col("id").alias("seq"), "files", (F.col("files") * 2).alias("chunks"))
    return index.job_progress(batches).select("seq", "job", "files_done", "chunks_written")


@query(f"""WITH {BOTH_SQL}, f AS (SELECT repo, path, CASE WHEN ord % 9 = 1 THEN 'timeout' END AS failed FROM n JOIN ch USING (repo, path) WHERE status IN ('added', 'changed')),
  a AS (SELECT repo, count(*) FILTER (WHERE status <> 'removed') AS files_selected, count(*) FILTER (WHERE status = 'unchanged') AS files_unchanged, count(*) FILTER (WHERE status = 'removed') AS files_removed FROM ch GROUP BY repo),
  b AS (SELECT repo, count(*) FILTER (WHERE failed IS NULL) AS files_fetched, coalesce(string_agg(CASE WHEN failed IS NOT NULL THEN path || ': ' || failed END, ', ' ORDER BY path), '') AS failed FROM f GROUP BY repo),
  c AS (SELECT repo, count(*) AS chunk_count FROM o GROUP BY repo)
SELECT repo, repo LIKE '%3' AS up_to_date, CASE WHEN repo LIKE '%3' THEN 7 ELSE files_selected END AS files_selected, CASE WHEN repo LIKE '%3' THEN 0 ELSE coalesce(files_fetched, 0) END AS files_fetched, CASE WHEN repo LIKE '%3' THEN 7 ELSE files_unchanged END AS files_unchanged,
  CASE WHEN repo LIKE '%3' THEN 0 ELSE files_removed END AS files_removed, coalesce(failed, '') AS failed, CASE WHEN repo LIKE '%3' THEN 0 ELSE coalesce(files_fetched, 0) END AS redactions, CASE WHEN repo LIKE '%3' THEN 0 ELSE coalesce(files_fetched, 0) END AS chunks_written, chunk_count
FROM a LEFT JOIN b USING (repo) LEFT JOIN c USING (repo)""")
def ag10_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories that end in 3 are up to date; every ninth file fails; each file has a redaction and a chunk."""
    old, new = old_and_new(spark, sf_dir)
    changes = index.diff(new, old)
    planned = new.select("repo").distinct().withColumn("action", F.when(F.col("repo").endswith("3"), "skip").otherwise("update"))
    known = planned.select("repo", F.lit(7).cast("long").alias("file_count"))
    outcome = new.join(changes.filter("status in ('added', 'changed')").select("repo", "path"), ["repo", "path"]).select("repo", "path", F.when(F.col("ord") % 9 == 1, "timeout").alias("failed"), F.lit(1).alias("redactions"))
    done = index.summary(planned, known, changes, outcome, old, outcome.filter("failed is null"))
    failed = F.array_join(F.transform(F.array_sort(F.map_entries("failed")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    return done.withColumn("failed", failed)


@query(f"WITH {BOTH_SQL} SELECT repo, count(*) FILTER (WHERE ord % 70 <> 1) AS file_count, CASE WHEN count(*) FILTER (WHERE ord % 70 = 1) = 0 THEN 'c2' END AS indexed_sha FROM n GROUP BY repo")
def ag11_repo_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = old_and_new(spark, sf_dir)[1]
    heads = new.select("repo", "commit_sha").distinct()
    return index.repo_records(heads, new, new.filter("ord % 70 = 1"))


#: README files again, each in a folder of its own, so that their names keep their suffix.
OWN_SQL = r"regexp_replace(path, '^(.*)README\.md#(\d+)$', 'd\2/\1README.md')"
RUN_SQL = f"""s1 AS (SELECT repo, {OWN_SQL} AS path, blob_sha FROM o WHERE path NOT LIKE '%.ipynb'), s2 AS (SELECT repo, {OWN_SQL} AS path, blob_sha, ord FROM n WHERE path NOT LIKE '%.ipynb'),
  lost AS (SELECT repo, path FROM s2 ANTI JOIN s1 USING (repo, path, blob_sha) WHERE ord % 31 = 4),
  kept AS (SELECT repo, path, coalesce(s1.blob_sha, s2.blob_sha) AS blob_sha FROM s2 LEFT JOIN s1 USING (repo, path) WHERE (repo, path) IN (SELECT (repo, path) FROM lost) AND s1.blob_sha IS NOT NULL
    UNION ALL SELECT repo, path, blob_sha FROM s2 WHERE (repo, path) NOT IN (SELECT (repo, path) FROM lost))"""


@query(f"""WITH {BOTH_SQL}, {RUN_SQL}, h AS (SELECT repo FROM s2 UNION SELECT repo FROM s1), bad AS (SELECT repo, count(*) AS bad FROM lost GROUP BY repo), c AS (SELECT repo, count(*) AS selected FROM s2 GROUP BY repo)
SELECT 'ledger' AS kind, repo, path, blob_sha AS value FROM kept
UNION ALL SELECT 'chunk', repo, path, blob_sha FROM kept
UNION ALL SELECT 'record', repo, (coalesce(selected, 0) - coalesce(bad, 0))::VARCHAR, CASE WHEN bad IS NULL THEN 'c2' END FROM h LEFT JOIN c USING (repo) LEFT JOIN bad USING (repo)
UNION ALL SELECT 'quarantined', repo, path, 'not_found' FROM lost
UNION ALL SELECT 'job', repo, NULL, 'succeeded' FROM h UNION ALL SELECT 'job', repo, NULL, 'succeeded' FROM (SELECT DISTINCT repo FROM s1)""")
def snk1_index_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the index job, the second commit after the first, with a few contents that have not landed: chunks (by file), ledger, records, quarantine and jobs."""
    import uuid

    from ..jobs import index_run
    from ..jobs.shared import cut, shared_dir

    root = f"{shared_dir(spark)}/codelode-{uuid.uuid4().hex}"
    everything = Settings(file_cap=SETTINGS.file_cap, repo_files=1 << 40, repo_bytes=1 << 50, failed_share=1.0)
    own = F.regexp_replace("path", r"^(.*)README\.md#(\d+)$", "d$2/$1README.md")
    both = [cut(f.filter("path not like '%.ipynb'").select("repo", "commit_sha", "ord", own.alias("path"), "blob_sha", "size", "text")) for f in old_and_new(spark, sf_dir)]
    repos = both[0].select("repo").unionByName(both[1].select("repo")).distinct()
    for n, files in enumerate(both):
        heads = (repos if n else both[0].select("repo").distinct()).select("repo", F.col("repo").alias("full_name"), F.lit("main").alias("ref"), F.lit(f"c{n + 1}").alias("commit_sha"), F.lit(False).alias("forced"))
        landed = files.filter("ord % 31 <> 4") if n else files
        index_run.run(heads, files.drop("text"), landed.select("repo", "path", F.encode("text", "UTF-8").alias("content")), root, everything)
    stored = lambda t: index_run.stored_table(spark, root, t)
    row = lambda df, kind, path, value: df.select(F.lit(kind).alias("kind"), "repo", path.alias("path"), value.alias("value"))
    path, sha = F.col("path"), F.col("blob_sha")
    parts = [
        row(stored("ledger"), "ledger", path, sha), row(stored("chunks").filter("path <> '<repo-map>'").select("repo", "path", "blob_sha").distinct(), "chunk", path, sha),
        row(stored("repos"), "record", F.col("file_count").cast("string"), F.col("indexed_sha")), row(stored("quarantine"), "quarantined", path, F.col("reason")),
        row(index_run.jobs(spark, root), "job", F.lit(None).cast("string"), F.col("status")),
    ]
    return reduce(DataFrame.unionByName, parts)
