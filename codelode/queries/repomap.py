"""What a repository holds, at a glance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import repomap
from ..operators.select import select_files
from .chunks import LANGUAGE_SQL
from .fixtures import LISTING_SQL, SELECTED_SQL, SETTINGS, listing
from .registry import query

OWN_SQL = "own AS (SELECT * FROM listing WHERE NOT list_has_any(string_split(path, '/')[:-2], ['build', 'vendor', 'node_modules']))"
LANGUAGES_SQL = f"""lang AS (SELECT repo, sum(n)::BIGINT AS files, string_agg(language || ' ' || n, ', ' ORDER BY n DESC, first) AS languages
  FROM (SELECT repo, {LANGUAGE_SQL.replace("'text'", "'other'")} AS language, count(*) AS n, min(ord) AS first FROM selected GROUP BY ALL) GROUP BY repo)"""


@query(f"WITH {LISTING_SQL}, {SELECTED_SQL}, {LANGUAGES_SQL} SELECT * FROM lang")
def ag7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repomap.languages(select_files(listing(spark, sf_dir), SETTINGS))


@query(f"WITH {LISTING_SQL}, {SELECTED_SQL} SELECT repo, min_by(path, ord) AS path FROM selected WHERE lower(path) LIKE 'readme.md' GROUP BY repo")
def ag12_find_readme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repomap.find_readme(select_files(listing(spark, sf_dir), SETTINGS))


SUMMARY_SQL = """summary AS (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY part, k)::INT AS ord, line FROM (
    SELECT repo, 0 AS part, k, k || ' (' || count(*) || ' files)' AS line FROM (SELECT repo, array_to_string(p[1:least(2, len(p) - 1)], '/') || '/' AS k FROM (SELECT repo, string_split(path, '/') AS p FROM own) WHERE len(p) > 1) GROUP BY repo, k
    UNION ALL SELECT repo, 1, path, path FROM own WHERE path NOT LIKE '%/%'))"""


@query(f"WITH {LISTING_SQL}, {OWN_SQL}, {SUMMARY_SQL} SELECT * FROM summary")
def ag8_summary_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.paths import is_vendored

    return repomap.summary_tree(listing(spark, sf_dir).filter(~is_vendored(F.col("path"))))


FULL_SQL = """full_tree AS (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY path, inner_ DESC, depth)::INT AS ord, repeat('  ', depth - 1) || name || CASE WHEN inner_ THEN '/' ELSE '' END AS line FROM (
    SELECT repo, min(path) AS path, d AS depth, p[d] AS name, true AS inner_ FROM (SELECT repo, path, string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/'))))::INT AS d FROM own) GROUP BY repo, d, p[d], array_to_string(p[1:d], '/')
    UNION ALL SELECT repo, path, len(string_split(path, '/'))::INT, string_split(path, '/')[-1], false FROM own))"""


@query(f"WITH {LISTING_SQL}, {OWN_SQL}, {FULL_SQL} SELECT * FROM full_tree")
def wn5_full_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.paths import is_vendored

    return repomap.full_tree(listing(spark, sf_dir).filter(~is_vendored(F.col("path"))))


@query(f"""WITH {LISTING_SQL}, {SELECTED_SQL}, {OWN_SQL}, {LANGUAGES_SQL}, {SUMMARY_SQL}, {FULL_SQL}, np AS (SELECT repo, count(*) AS n FROM own GROUP BY repo),
  t AS (SELECT repo, n, string_agg(line, chr(10) ORDER BY ord) AS tree FROM (SELECT * FROM full_tree JOIN np USING (repo) WHERE n <= 150 UNION ALL SELECT * FROM summary JOIN np USING (repo) WHERE n > 150) GROUP BY ALL),
  rm AS (SELECT repo, arg_min(trim(text, ' ' || chr(10)), ord) AS r FROM selected WHERE path = 'README.md' GROUP BY repo)
SELECT repo, md5('## Overview' || chr(10) || 'Repository: ' || repo || ' @ main (commit c1)' || chr(10) || 'Indexed files: ' || files || ' (' || languages || ')' || chr(10) || chr(10) ||
  '## Directory structure (' || n || ' files)' || chr(10) || tree || chr(10) || coalesce(chr(10) || '## README excerpt' || chr(10) || CASE WHEN length(r) > 1500 THEN r[1:1500] || chr(10) || '...' ELSE r END || chr(10), '')) AS text_md5 FROM lang JOIN t USING (repo) LEFT JOIN rm USING (repo)""")
def ch7_repo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = listing(spark, sf_dir)
    indexed = select_files(files, SETTINGS)
    heads = files.select("repo", F.col("repo").alias("full_name"), F.lit("main").alias("ref"), "commit_sha").distinct()
    readmes = indexed.filter("path = 'README.md'").groupBy("repo").agg(F.min_by("text", "ord").alias("text"))
    return repomap.build(heads, files, indexed, readmes).select("repo", F.md5(F.col("text").cast("binary")).alias("text_md5"))
