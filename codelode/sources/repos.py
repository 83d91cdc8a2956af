"""Repositories, their snapshots and their file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..jobs.shared import cut

NAME = "[A-Za-z0-9_.-]+"
# The ways to write a repository, tried in this order.
FORMS = (rf"^https?://(?:www\.)?github\.com/({NAME})/({NAME})(?:/.*)?$", rf"^git@github\.com:({NAME})/({NAME})$", rf"^({NAME})/({NAME})$")


def parse_repo_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    """Adds owner, name, full_name, slug, and error for what is no repository (the others are null then)."""
    bare = F.regexp_replace(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""), "/+$", "")
    form = F.lit(None)
    for i in reversed(range(len(FORMS))):
        owner, name = F.regexp_extract(bare, FORMS[i], 1), F.regexp_replace(F.regexp_extract(bare, FORMS[i], 2), r"\.git$", "")
        sound = bare.rlike(FORMS[i]) & (name != "") & ~owner.isin(".", "..") & ~name.isin(".", "..")
        form = F.when(sound, F.struct(owner.alias("owner"), name.alias("name"))).otherwise(form)
    parsed = urls.withColumn("_r", form)
    full = F.concat("_r.owner", F.lit("/"), "_r.name")
    added = {"owner": F.col("_r.owner"), "name": F.col("_r.name"), "full_name": full, "slug": F.lower(F.concat("_r.owner", F.lit("__"), "_r.name")), "error": F.when(F.col("_r").isNull(), "not a repository")}
    return parsed.withColumns(added).drop("_r")


def explode_tree(trees: DataFrame) -> DataFrame:
    """Files of landed listings (repo, commit_sha, tree: array of path, type, sha, size): repo, commit_sha, ord, path, size, blob_sha."""
    entries = trees.select("repo", "commit_sha", F.posexplode("tree").alias("ord", "e")).filter("e.type = 'blob'")
    return entries.select("repo", "commit_sha", "ord", F.col("e.path").alias("path"), F.coalesce("e.size", F.lit(0)).cast("long").alias("size"), F.col("e.sha").alias("blob_sha"))


def walk_trees(roots: DataFrame, entries: DataFrame) -> DataFrame:
    """Files under each root, with full paths, where a listing came one directory at a time.

    roots: repo, tree_sha. entries: parent_sha, name, type (tree, blob or else), sha, size. A join per level; each level is
    kept in the shared folder, so that a lost executor costs one level. A directory that lies in itself can't be walked: an error.
    """
    level = roots.select("repo", F.col("tree_sha").alias("sha"), F.lit("").alias("prefix"), F.array("tree_sha").alias("above"))
    files = None
    while True:
        found = cut(level.join(entries.withColumnRenamed("sha", "entry_sha"), F.col("sha") == F.col("parent_sha")).select("repo", "above", F.concat("prefix", "name").alias("path"), "type", F.col("entry_sha").alias("sha"), F.coalesce("size", F.lit(0)).cast("long").alias("size")))
        blobs = found.filter("type = 'blob'").select("repo", "path", "size", F.col("sha").alias("blob_sha"))
        files = blobs if files is None else files.unionByName(blobs)
        below = found.filter("type = 'tree'")
        if not below.filter(F.array_contains("above", F.col("sha"))).isEmpty():
            raise ValueError("a directory lies in itself")
        level = below.select("repo", "sha", F.concat("path", F.lit("/")).alias("prefix"), F.concat("above", F.array("sha")).alias("above"))
        if level.isEmpty():
            return files


def snapshots(requests: DataFrame, repos: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (repo, ref or null) with their commit, and those that have none.

    repos: repo, default_branch; refs: repo, ref, commit_sha.
    """
    asked = requests.join(repos, "repo", "left").select("repo", F.coalesce("ref", "default_branch").alias("ref"))
    return asked.join(refs, ["repo", "ref"]).select("repo", "ref", "commit_sha"), asked.join(refs, ["repo", "ref"], "left_anti").select("repo", "ref")
