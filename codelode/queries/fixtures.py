"""The given tables as inputs of the library: DataFrames, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import git_blob_sha

#: The cap of ordinary files in these queries, so that some are too large.
SETTINGS = Settings(file_cap=20_000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Path by (doc_id div 20) mod 12, but for the first 20 documents, which are README files.
PATHS = [
    ("src/core/m", ".py"), ("src/util/m", ".js"), ("docs/guide/d", ".MD"), ("web/App", ".tsx"), ("nb/n", ".ipynb"), ("logo", ".png"),
    ("node_modules/p", "/index.js"), ("static/a", ".min.js"), ("types/t", ".d.ts"), ("top", ".ts"), ("docs/build/vendor/v", ".py"), ("pkg/__init__", ".py"),
]
PATH_SQL = "CASE WHEN doc_id < 20 THEN 'README.md' " + " ".join(f"WHEN floor(doc_id / 20) % 12 = {b} THEN concat('{a}', cast(doc_id AS string), '{z}')" for b, (a, z) in enumerate(PATHS)) + " END"
BLOB_SQL = "sha1(encode('blob ' || octet_length(encode({0}))) || '\\x00'::BLOB || encode({0}))"

#: v1: every document is a file; of the twelfth kind the size is 0.
LISTING_SQL = f"""listing AS (
  SELECT concat('acme__', source) AS repo, 'c1' AS commit_sha, doc_id AS ord, {PATH_SQL} AS path,
    CASE WHEN doc_id >= 20 AND floor(doc_id / 20) % 12 = 11 THEN 0 ELSE octet_length(encode(text)) END AS size,
    {BLOB_SQL.format('text')} AS blob_sha, text
  FROM documents)"""
#: v2: some files are gone, some changed, some have a copy.
LISTING2_SQL = f"""v2 AS (
  SELECT repo, 'c2' AS commit_sha, ord, path, CASE WHEN size = 0 THEN 0 ELSE octet_length(encode(t)) END AS size, {BLOB_SQL.format('t')} AS blob_sha, t AS text
  FROM (SELECT *, CASE WHEN ord % 7 = 3 THEN text || '!' ELSE text END AS t FROM listing WHERE ord % 13 <> 5)
  UNION ALL
  SELECT repo, 'c2', ord + 1000000000, concat('new/', path), size, blob_sha, text FROM listing WHERE ord % 11 = 2)"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, commit_sha, ord, path, size, blob_sha, text of the first commit."""
    docs = table(spark, sf_dir, "documents")
    content = F.encode("text", "UTF-8")
    size = F.when((F.col("doc_id") >= 20) & (F.floor(F.col("doc_id") / 20) % 12 == 11), 0).otherwise(F.octet_length("text")).cast("long")
    return docs.select(F.concat(F.lit("acme__"), "source").alias("repo"), F.lit("c1").alias("commit_sha"), F.col("doc_id").alias("ord"), F.expr(PATH_SQL).alias("path"), size.alias("size"), git_blob_sha(content).alias("blob_sha"), "text")


def listing2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the second commit."""
    v1 = listing(spark, sf_dir)
    text = F.when(F.col("ord") % 7 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    changed = v1.filter("ord % 13 <> 5").withColumn("text", text)
    changed = changed.withColumns({"size": F.when(F.col("size") == 0, 0).otherwise(F.octet_length("text")).cast("long"), "blob_sha": git_blob_sha(F.encode("text", "UTF-8"))})
    copies = v1.filter("ord % 11 = 2").withColumns({"ord": F.col("ord") + 1_000_000_000, "path": F.concat(F.lit("new/"), "path")})
    return changed.unionByName(copies).withColumn("commit_sha", F.lit("c2"))


#: First rule that holds; `skip` needs path and size.
SKIP_SQL = r"""CASE
    WHEN lower(regexp_extract(string_split(path, '/')[-1], '^.+(\.[^.]+)$', 1)) NOT IN ('.py', '.js', '.ts', '.tsx', '.md', '.ipynb') THEN 'extension'
    WHEN list_has_any(string_split(path, '/')[:-2], ['.git', '.github', '.next', '.nuxt', '.tox', '.venv', '__pycache__', 'bower_components', 'build', 'coverage', 'dist', 'env', 'node_modules', 'site-packages', 'third_party', 'vendor', 'venv']) THEN 'excluded_dir'
    WHEN regexp_matches(lower(string_split(path, '/')[-1]), '(\.min\.js|\.bundle\.js|\.chunk\.js|_pb2\.py|_pb2_grpc\.py|\.d\.ts)$') THEN 'generated'
    WHEN size > CASE WHEN lower(path) LIKE '%.ipynb' THEN 10485760 ELSE 20000 END THEN 'too_large'
    WHEN size = 0 THEN 'empty' END"""
SELECTED_SQL = f"selected AS (SELECT * FROM listing WHERE {SKIP_SQL} IS NULL)"
SELECTED2_SQL = f"selected2 AS (SELECT * FROM v2 WHERE {SKIP_SQL} IS NULL)"
