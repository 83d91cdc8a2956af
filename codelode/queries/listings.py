"""Repository names, trees, listings and their selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import select
from ..sources import repos
from .fixtures import LISTING_SQL, SETTINGS, SKIP_SQL, listing, table
from .registry import query

URLS_SQL = """urls AS (
  SELECT url, page_id AS n FROM pages
  UNION ALL
  SELECT CASE c_custkey % 5 WHEN 0 THEN 'https://github.com/' || o || '/' || r WHEN 1 THEN ' http://www.github.com/' || o || '/' || r || '.git'
    WHEN 2 THEN 'git@github.com:' || o || '/' || r || '.git' WHEN 3 THEN o || '/' || r ELSE 'https://github.com/' || o || '/' || r || '/tree/main/' END, -c_custkey - 1
  FROM (SELECT *, lower(c_mktsegment) AS o, 'r' || c_custkey AS r FROM customer))"""


@query(
    f"""WITH {URLS_SQL}, bare AS (SELECT n, url, rtrim(trim(url), '/') AS b FROM urls),
  m AS (SELECT n, url, CASE WHEN regexp_matches(b, '^https?://(?:www\\.)?github\\.com/[\\w.-]+/[\\w.-]+(?:/.*)?$') THEN regexp_extract(b, '^https?://(?:www\\.)?github\\.com/([\\w.-]+/[\\w.-]+)', 1)
    WHEN regexp_matches(b, '^git@github\\.com:[\\w.-]+/[\\w.-]+$') THEN regexp_extract(b, ':(.*)$', 1) WHEN regexp_matches(b, '^[\\w.-]+/[\\w.-]+$') THEN b END AS f FROM bare),
  s AS (SELECT n, url, split_part(f, '/', 1) AS owner, regexp_replace(split_part(f, '/', 2), '\\.git$', '') AS name FROM m WHERE f IS NOT NULL)
SELECT u.n, s.owner, s.name, s.owner || '/' || s.name AS full_name, lower(s.owner || '__' || s.name) AS slug, CASE WHEN s.n IS NULL THEN 'not a repository' END AS error FROM urls u LEFT JOIN s ON u.n = s.n"""
)
def src1_parse_repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses (none is a repository) and five ways to write one."""
    c = table(spark, sf_dir, "customer").withColumns({"o": F.lower("c_mktsegment"), "r": F.concat(F.lit("r"), F.col("c_custkey").cast("string"))})
    k, o, r = F.col("c_custkey") % 5, F.col("o"), F.col("r")
    at = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    forms = F.when(k == 0, at("https://github.com/", o, "/", r)).when(k == 1, at(" http://www.github.com/", o, "/", r, ".git")).when(k == 2, at("git@github.com:", o, "/", r, ".git"))
    made = c.select(forms.when(k == 3, at(o, "/", r)).otherwise(at("https://github.com/", o, "/", r, "/tree/main/")).alias("url"), (-F.col("c_custkey") - 1).cast("long").alias("n"))
    urls = table(spark, sf_dir, "pages").select("url", F.col("page_id").cast("long").alias("n")).unionByName(made)
    return repos.parse_repo_urls(urls).select("n", "owner", "name", "full_name", "slug", "error")


@query("SELECT concat('repo', s_nationkey) AS repo, 'c' AS commit_sha, (s_suppkey - 1)::INT AS n, concat('s', s_suppkey, '.py') AS path, CASE WHEN s_suppkey % 4 = 1 THEN 0 ELSE s_suppkey END AS size, concat('b', s_suppkey) AS blob_sha FROM supplier WHERE s_suppkey % 3 = 0")
def src2_explode_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of suppliers by nation: every third is a file, the others directories or modules; some sizes are missing."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    kind = F.when(k % 3 == 0, "blob").when(k % 3 == 1, "tree").otherwise("commit")
    text = lambda a, z="": F.concat(F.lit(a), k.cast("string"), F.lit(z))
    entry = F.struct(text("s", ".py").alias("path"), kind.alias("type"), text("b").alias("sha"), F.when(k % 4 != 1, k).cast("long").alias("size"))
    trees = s.groupBy(F.concat(F.lit("repo"), F.col("s_nationkey").cast("string")).alias("repo")).agg(F.array_sort(F.collect_list(entry)).alias("tree")).withColumn("commit_sha", F.lit("c"))
    found = repos.explode_tree(trees)
    return found.select("repo", "commit_sha", (F.regexp_extract("path", r"\d+", 0).cast("int") - 1).alias("n"), "path", "size", "blob_sha")


@query("SELECT 'world' AS repo, concat(trim(r_name), '/', trim(n_name), '/', s_name) AS path, s_suppkey AS size, concat('b', s_suppkey) AS blob_sha FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def src3_walk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, supplier as directories, directories and files, listed one directory at a time."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    sha = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    row = lambda parent, name, kind, own, size: [parent.alias("parent_sha"), name.alias("name"), F.lit(kind).alias("type"), own.alias("sha"), size.cast("long").alias("size")]
    entries = r.select(row(F.lit("root"), F.trim("r_name"), "tree", sha("r", "r_regionkey"), F.lit(None)))
    entries = entries.unionByName(n.select(row(sha("r", "n_regionkey"), F.trim("n_name"), "tree", sha("n", "n_nationkey"), F.lit(None))))
    entries = entries.unionByName(s.select(row(sha("n", "s_nationkey"), F.col("s_name"), "blob", sha("b", "s_suppkey"), F.col("s_suppkey"))))
    return repos.walk_trees(r.limit(1).select(F.lit("world").alias("repo"), F.lit("root").alias("tree_sha")), entries)


@query("""SELECT c_custkey AS repo, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'dev' END, c_mktsegment) AS ref, o_orderkey AS commit_sha FROM customer JOIN orders ON o_custkey = c_custkey
  WHERE CASE WHEN o_orderstatus = 'O' THEN 'dev' ELSE c_mktsegment END = coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'dev' END, c_mktsegment)""")
def src4_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as repositories whose default branch is their segment, orders as commits."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    requests = c.select(F.col("c_custkey").alias("repo"), F.when(F.col("c_custkey") % 2 == 0, "dev").alias("ref"))
    heads = c.select(F.col("c_custkey").alias("repo"), F.col("c_mktsegment").alias("default_branch"))
    refs = o.join(heads, o.o_custkey == heads.repo).select("repo", F.when(F.col("o_orderstatus") == "O", "dev").otherwise(F.col("default_branch")).alias("ref"), F.col("o_orderkey").alias("commit_sha"))
    return repos.snapshots(requests, heads, refs)[0]


@query(f"WITH {LISTING_SQL} SELECT repo, ord, path, {SKIP_SQL} AS skip_reason FROM listing")
def fil1_skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.with_reason(listing(spark, sf_dir), SETTINGS).select("repo", "ord", "path", "skip_reason")


@query(f"WITH {LISTING_SQL} SELECT path, ord, CASE WHEN lower(path) LIKE '%.ipynb' THEN 10485760 ELSE 512000 END::BIGINT AS max_bytes FROM listing")
def fil2_max_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("path", "ord", paths.max_bytes(F.col("path")).alias("max_bytes"))


@query(f"WITH {LISTING_SQL} SELECT repo, path, size, blob_sha FROM listing WHERE {SKIP_SQL} IS NULL")
def fil3_select_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_files(listing(spark, sf_dir), SETTINGS).select("repo", "path", "size", "blob_sha")


@query(f"WITH {LISTING_SQL} SELECT path, ord, list_has_any(string_split(path, '/')[:-2], ['build', 'vendor', 'node_modules', 'dist', 'env', 'venv']) AS vendored FROM listing")
def fil7_is_vendored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("path", "ord", paths.is_vendored(F.col("path")).alias("vendored"))


@query(f"WITH {LISTING_SQL} SELECT repo, skip_reason, count(*) AS files FROM (SELECT repo, {SKIP_SQL} AS skip_reason FROM listing) WHERE skip_reason IS NOT NULL GROUP BY ALL")
def ag1_skip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.skip_counts(listing(spark, sf_dir), SETTINGS)


@query(f"""WITH {LISTING_SQL}, g AS (SELECT repo, count(*) AS files, sum(size)::BIGINT AS bytes FROM listing WHERE {SKIP_SQL} IS NULL GROUP BY repo)
SELECT *, CASE WHEN files > 25 THEN files || ' files, the limit is 25' WHEN bytes > 60000 THEN bytes || ' bytes, the limit is 60000' END AS rejected FROM g""")
def ag2_size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    return select.size_guard(select.select_files(listing(spark, sf_dir), SETTINGS), replace(SETTINGS, repo_files=25, repo_bytes=60_000))


@query(f"""WITH {LISTING_SQL} SELECT path, ord, coalesce(map_extract(MAP {{'.py': 'python', '.js': 'javascript', '.ts': 'typescript', '.tsx': 'typescript', '.md': 'markdown', '.ipynb': 'notebook'}},
  lower(regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]+)$', 1)))[1], 'text') AS language FROM listing""")
def fn1_language_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("path", "ord", paths.language_of(F.col("path")).alias("language"))
