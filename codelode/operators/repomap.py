"""A document per repository that says what is in it: an overview, its directories, the beginning of its README.

listing: repo, ord, path of all listed files; indexed: repo, ord, path of those that are indexed. At most `FULL_TREE` paths of a
repository are ever gathered; larger ones are counted by directory first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_vendored, language_of
from ..functions.text import SPACE, excerpt

MAP_PATH, FULL_TREE = "<repo-map>", 150


def languages(indexed: DataFrame) -> DataFrame:
    """repo, files, languages: counts of languages, the most frequent first, then in the order in which they first appear."""
    counts = indexed.groupBy("repo", language_of(F.col("path"), "other").alias("language")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "language")))  # a row per language
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["language"], F.lit(" "), (-p["m"]).cast("string"))), ", ")
    return counts.groupBy("repo").agg(F.sum("n").alias("files"), text.alias("languages"))


def find_readme(selected: DataFrame) -> DataFrame:
    """repo, path: the first listed file at the top that is named readme, whatever its suffix."""
    top = ~F.contains("path", F.lit("/")) & F.lower("path").rlike(r"^readme(\.[^.]*)?$")
    return selected.filter(top).groupBy("repo").agg(F.min_by("path", "ord").alias("path"))


def summary_tree(paths: DataFrame) -> DataFrame:
    """repo, ord, line: directories of up to two levels with their files, then the files at the top."""
    parts = F.split("path", "/")
    deep = F.least(F.lit(2), F.size(parts) - 1)
    directory = F.concat(F.array_join(F.slice(parts, F.lit(1), deep), "/"), F.lit("/"))
    counted = paths.filter(F.size(parts) > 1).groupBy("repo", directory.alias("key")).agg(F.count("*").alias("n"))
    lines = counted.select("repo", F.lit(0).alias("part"), "key", F.concat("key", F.lit(" ("), F.col("n").cast("string"), F.lit(" files)")).alias("line"))
    lines = lines.unionByName(paths.filter(F.size(parts) == 1).select("repo", F.lit(1).alias("part"), F.col("path").alias("key"), F.col("path").alias("line")))
    return lines.withColumn("ord", F.row_number().over(Window.partitionBy("repo").orderBy("part", "key"))).select("repo", "ord", "line")


def full_tree(paths: DataFrame) -> DataFrame:
    """repo, ord, line: every file under its directories, each of which is named where it first appears; two blanks a level."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("prefix"), F.element_at(parts, i).alias("name"), (i < F.size(parts)).alias("inner")))
    each = paths.select("repo", "path", F.explode(steps).alias("s")).select("repo", "path", "s.*")
    directories = each.filter("inner").groupBy("repo", "prefix", "name", "depth", "inner").agg(F.min("path").alias("path"))
    lines = directories.select("repo", "path", "depth", "name", "inner").unionByName(each.filter("not inner").select("repo", "path", "depth", "name", "inner"))
    indent = F.expr("repeat('  ', depth - 1)")
    line = F.concat(indent, "name", F.when(F.col("inner"), "/").otherwise(""))
    return lines.withColumn("ord", F.row_number().over(Window.partitionBy("repo").orderBy("path", F.desc("inner"), "depth"))).select("repo", "ord", line.alias("line"))


def tree(listing: DataFrame, indexed: DataFrame) -> DataFrame:
    """repo, n_paths, ord, line of the files that aren't vendored (the indexed ones, if all are)."""
    own = listing.filter(~is_vendored(F.col("path"))).select("repo", "path")
    paths = own.unionByName(indexed.select("repo", "path").join(own.select("repo").distinct(), "repo", "left_anti"))
    n = paths.groupBy("repo").agg(F.count("*").alias("n_paths"))
    small = paths.join(n.filter(F.col("n_paths") <= FULL_TREE), "repo", "left_semi")
    large = paths.join(n.filter(F.col("n_paths") > FULL_TREE), "repo", "left_semi")
    return full_tree(small).unionByName(summary_tree(large)).join(n, "repo")


def build(heads: DataFrame, listing: DataFrame, indexed: DataFrame, readmes: DataFrame) -> DataFrame:
    """repo, path, blob_sha, language, text, units of the maps.

    heads: repo, full_name, ref, commit_sha; readmes: repo, text. A map isn't in the ledger; it is redacted, chunked and embedded
    like any document.
    """
    lines = tree(listing, indexed).groupBy("repo", "n_paths").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"))
    lines = lines.select("repo", "n_paths", F.transform("l", lambda x: x["line"]).alias("tree"))
    first = F.concat(F.lit("Repository: "), "full_name", F.lit(" @ "), "ref", F.lit(" (commit "), F.substring("commit_sha", 1, 7), F.lit(")"))
    rows = heads.join(languages(indexed), "repo", "left").join(lines, "repo", "left").join(readmes.select("repo", excerpt(F.regexp_replace("text", rf"^{SPACE}+|{SPACE}+$", "")).alias("readme")), "repo", "left")
    second = F.concat(F.lit("Indexed files: "), F.coalesce("files", F.lit(0)).cast("string"), F.lit(" ("), F.coalesce("languages", F.lit("")), F.lit(")"))
    part = lambda title, body: F.struct(title.alias("title"), body.alias("body"))
    none = F.array().cast("array<string>")
    sections = F.array_compact(F.array(
        part(F.lit("Overview"), F.array(first, second)),
        part(F.concat(F.lit("Directory structure ("), F.coalesce("n_paths", F.lit(0)).cast("string"), F.lit(" files)")), F.coalesce("tree", none)),
        F.when(F.col("readme").isNotNull(), part(F.lit("README excerpt"), F.split("readme", "\n"))),
    ))
    rows = rows.withColumn("s", sections)
    end = lambda i: F.aggregate(F.slice("s", F.lit(1), i + 1), F.lit(0), lambda t, x: t + F.size(x["body"]) + 2) - 1
    units = F.transform("s", lambda x, i: F.struct((end(i) - F.size(x["body"])).cast("int").alias("start_line"), end(i).cast("int").alias("end_line"), F.concat(F.lit("Repo map > "), x["title"]).alias("name"), F.lit(0).alias("depth")))
    text = F.array_join(F.transform("s", lambda x: F.concat(F.array_join(F.concat(F.array(F.concat(F.lit("## "), x["title"])), x["body"]), "\n"), F.lit("\n"))), "\n")
    return rows.select("repo", F.lit(MAP_PATH).alias("path"), F.col("commit_sha").alias("blob_sha"), F.lit("text").alias("language"), text.alias("text"), units.alias("units"))
