"""Contents: hashes, texts, what is accepted, and what a fetch came to."""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.parts import as_column
from ..jobs.shared import cut, shared_dir
from ..operators import select
from ..sources import contents, landed
from .fixtures import BLOB_SQL, LISTING_SQL, SELECTED_SQL, SETTINGS, listing
from .registry import query

#: Some contents are longer than listed (another hash), some begin with a zero byte (and have the hash of these bytes).
FETCHED_SQL = f"""fetched AS (
  SELECT * REPLACE (CASE WHEN ord % 19 = 6 AND ord % 17 <> 4 THEN {BLOB_SQL.format("chr(0) || text")} ELSE blob_sha END AS blob_sha),
    octet_length(encode(text)) + CASE WHEN ord % 17 = 4 OR ord % 19 = 6 THEN 1 ELSE 0 END AS bytes
  FROM selected)"""
OUTCOME_SQL = """outcome AS (SELECT *, CASE WHEN bytes > CASE WHEN lower(path) LIKE '%.ipynb' THEN 10485760 ELSE 20000 END THEN 'too_large'
    WHEN ord % 17 = 4 THEN 'integrity_mismatch' WHEN ord % 19 = 6 THEN 'binary' END AS refused FROM fetched)"""
ALL_SQL = f"WITH {LISTING_SQL}, {SELECTED_SQL}, {FETCHED_SQL}, {OUTCOME_SQL}"


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = select.select_files(listing(spark, sf_dir), SETTINGS)
    raw, odd, zero = F.encode("text", "UTF-8"), F.col("ord") % 17 == 4, F.col("ord") % 19 == 6
    content = F.when(odd, F.concat(raw, F.lit(b"~"))).when(zero, F.concat(F.lit(b"\0"), raw)).otherwise(raw)
    return files.withColumn("content", content).withColumn("blob_sha", F.when(zero & ~odd, T.git_blob_sha(F.col("content"))).otherwise(F.col("blob_sha"))).drop("text")


def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contents.accept(fetched(spark, sf_dir), SETTINGS)
    return found.withColumns({"size": F.octet_length("content").cast("long"), "method": F.lit("raw")})


@query(f"WITH {LISTING_SQL} SELECT repo, path, ord, blob_sha FROM listing")
def fil5_git_blob_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("repo", "path", "ord", "blob_sha")


@query(f"{ALL_SQL} SELECT repo, path, ord, refused, CASE WHEN refused IS NULL THEN md5(text) END AS text_md5 FROM outcome")
def fil4_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome(spark, sf_dir).select("repo", "path", "ord", "refused", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN NULL WHEN doc_id % 3 = 2 THEN md5(chr(65533) || text) ELSE md5(text) END AS text_md5 FROM documents")
def fil6_decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes as they are, behind a zero byte, and behind a byte that no character begins with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k, raw = F.col("doc_id") % 3, F.encode("text", "UTF-8")
    content = F.when(k == 1, F.concat(F.lit(b"\0"), raw)).when(k == 2, F.concat(F.lit(b"\xff"), raw)).otherwise(raw)
    return docs.select("doc_id", F.md5(T.decode_text(content).cast("binary")).alias("text_md5"))


@query(f"{ALL_SQL} SELECT repo, sum(bytes)::BIGINT AS bytes, sum(bytes) > 40000 AS aborted FROM outcome WHERE refused IS NULL GROUP BY repo")
def ag3_byte_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents.byte_guard(outcome(spark, sf_dir).filter("refused is null"), replace(SETTINGS, repo_bytes=40_000))


FAILED_SQL = "string_agg(CASE WHEN refused IS NOT NULL THEN path || ': ' || refused END, ', ' ORDER BY path)"


@query(f"""{ALL_SQL} SELECT repo, 'raw' AS method, count(*) AS requested, count(*) FILTER (WHERE refused IS NULL) AS fetched, coalesce(sum(bytes) FILTER (WHERE refused IS NULL), 0)::BIGINT AS bytes, coalesce({FAILED_SQL}, '') AS failed FROM outcome GROUP BY repo""")
def ag4_fetch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = contents.fetch_report(select.select_files(listing(spark, sf_dir), SETTINGS), outcome(spark, sf_dir))
    failed = F.array_join(F.transform(F.array_sort(F.map_entries("failed")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    return report.select("repo", "method", "requested", "fetched", "bytes", failed.alias("failed"))


@query(f"""{ALL_SQL}, g AS (SELECT repo, count(*) AS requested, count(refused) AS bad, list(path || ': ' || refused ORDER BY path) FILTER (WHERE refused IS NOT NULL) AS l FROM outcome GROUP BY repo)
SELECT repo, requested, bad > requested * 0.1 AS aborted, CASE WHEN bad > requested * 0.1 THEN bad || ' of ' || requested || ' files failed: ' || array_to_string(l[1:5], ', ') END AS message FROM g""")
def ag5_failure_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = contents.fetch_report(select.select_files(listing(spark, sf_dir), SETTINGS), outcome(spark, sf_dir))
    return contents.failure_guard(report, replace(SETTINGS, failed_share=0.1)).select("repo", "requested", "aborted", "message")


@query(f"""{ALL_SQL} SELECT repo, path, CASE WHEN refused IS NOT NULL THEN refused ELSE 'missing_in_archive' END AS reason FROM outcome WHERE refused IS NOT NULL OR ord % 5 = 2""")
def jn3_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive that lacks every fifth file."""
    found = outcome(spark, sf_dir)
    failed = found.filter("refused is not null").select("repo", "path", F.col("refused").alias("reason"))
    return contents.missing(found, found.filter("ord % 5 <> 2").select("repo", "path"), failed)


@query(f"""{ALL_SQL}, k AS (SELECT repo, path || '#' || ord AS path, bytes, CASE WHEN ord % 23 = 9 THEN 'not_found' ELSE refused END AS reason FROM outcome),
  g AS (SELECT repo, count(*) AS requested, count(reason) AS failed, coalesce(sum(bytes) FILTER (WHERE reason IS NULL), 0) AS bytes, list(path || ': ' || reason ORDER BY path) FILTER (WHERE reason IS NOT NULL) AS l FROM k GROUP BY repo),
  a AS (SELECT repo, CASE WHEN bytes > 60000 THEN bytes || ' bytes, the limit is 60000' ELSE failed || ' of ' || requested || ' files failed: ' || array_to_string(l[1:5], ', ') END AS message FROM g WHERE bytes > 60000 OR failed > requested * 0.2)
SELECT 'accepted' AS kind, repo, path, NULL AS detail FROM k ANTI JOIN a USING (repo) WHERE reason IS NULL UNION ALL SELECT 'quarantined', repo, path, reason FROM k WHERE reason IS NOT NULL UNION ALL SELECT 'aborted', repo, NULL, message FROM a""")
def fil4_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents with wrong hashes, binaries and missing ones, in repositories of which some have too many of them and some too many bytes."""
    # a notebook's own cap goes by its suffix, so that its name ends in it again while it is judged
    suffix = F.when(F.lower("path").endswith(".ipynb"), ".ipynb").otherwise("")
    files = fetched(spark, sf_dir).withColumn("path", F.concat("path", F.lit("#"), F.col("ord").cast("string"), suffix))
    settings = replace(SETTINGS, repo_bytes=60_000)
    bare = lambda df, column: df.withColumn(column, F.regexp_replace(column, r"(#\d+)\.ipynb", "$1"))
    accepted, quarantined, aborted = (bare(df, column) for df, column in zip(contents.guarded(files, files.filter("ord % 23 <> 9"), settings), ("path", "path", "message")))
    row = lambda df, kind, path, detail: df.select(F.lit(kind).alias("kind"), "repo", path.alias("path"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    return row(accepted, "accepted", F.col("path"), none).unionByName(row(quarantined, "quarantined", F.col("path"), F.col("reason"))).unionByName(row(aborted, "aborted", none, F.col("message")))


def archives(files: DataFrame) -> DataFrame:
    """An archive per repository of files (repo, path, text): repo, content."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for batch in batches:
                for repo, path, text in zip(*(batch[c] for c in ("repo", "path", "text"))):
                    data = text.as_buffer()
                    info = tarfile.TarInfo(f"top/{path}")
                    info.size = data.size
                    tar.addfile(info, pa.BufferReader(data))
        yield pa.RecordBatch.from_arrays([as_column([repo.as_py()], pa.string()), as_column([out.getvalue()], pa.binary())], names=["repo", "content"])

    return files.filter("text is not null").select("repo", "path", "text").groupBy("repo").applyInArrow(pack, "repo string, content binary")


@query(f"WITH {LISTING_SQL} SELECT repo, path, ord, md5(text) AS content_md5 FROM listing WHERE octet_length(encode(text)) <= CASE WHEN lower(path) LIKE '%.ipynb' THEN 10485760 ELSE 20000 END")
def src6_untar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, a folder of a hundred documents an archive, unpacked."""
    files = listing(spark, sf_dir).select(F.concat_ws("-", F.col("repo"), F.floor(F.col("ord") / 2000).cast("string")).alias("repo"), F.concat(F.col("ord").cast("string"), F.lit("/"), "path").alias("path"), "text")
    found = landed.untar(archives(files), SETTINGS)
    return found.select(F.substring_index("repo", "-", 1).alias("repo"), F.expr("substr(path, instr(path, '/') + 1)").alias("path"), F.substring_index("path", "/", 1).cast("long").alias("ord"), F.md5("content").alias("content_md5"))


@query(f"""WITH {LISTING_SQL}, {SELECTED_SQL}, g AS (SELECT repo, count(*) > 25 AS large FROM selected GROUP BY repo)
SELECT repo, path, ord, CASE WHEN NOT large THEN 'raw' WHEN repo LIKE '%5' AND ord % 2 = 1 THEN 'raw' ELSE 'tarball' END AS via,
  CASE WHEN NOT large THEN 'raw' WHEN repo LIKE '%5' THEN 'tarball+raw' ELSE 'tarball' END AS method FROM selected JOIN g USING (repo)""")
def src7_merge_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of more than 25 files come as archives; those of repositories that end in 5 break off half way."""
    files = select.select_files(listing(spark, sf_dir), SETTINGS)
    landed = files.select("repo", F.concat("path", F.lit("#"), F.col("ord").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    odd, ends = F.regexp_extract("path", r"#(\d+)$", 1).cast("long") % 2 == 1, F.col("repo").endswith("5")
    unpacked = landed.filter(~(odd & ends)).withColumn("broken", F.lit(False)).unionByName(landed.filter(ends).select("repo", F.lit(None).cast("string").alias("path"), F.lit(None).cast("binary").alias("content"), F.lit(True).alias("broken")).distinct())
    merged = contents.merge_contents(landed.drop("content"), landed, unpacked, replace(SETTINGS, archive_from=25))
    return merged.select("repo", F.regexp_extract("path", r"^(.*)#\d+$", 1).alias("path"), F.regexp_extract("path", r"#(\d+)$", 1).cast("long").alias("ord"), "via", "method")


@query(f"""WITH {LISTING_SQL}, {SELECTED_SQL} SELECT repo, path, ord, octet_length(encode(text)) AS bytes, md5(text) AS content_md5 FROM selected WHERE ord % 7 <> 3""")
def src5_read_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document but one of seven lands as an object; those that are selected are opened, and what hasn't landed isn't found."""
    files = listing(spark, sf_dir)
    folder = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    numbered = files.withColumn("path", F.concat_ws("/", F.col("ord").cast("string"), "path"))
    landed.land(numbered.filter("ord % 7 <> 3").withColumn("content", F.encode("text", "UTF-8")), folder)
    wanted = select.select_files(files, SETTINGS).select("repo", "commit_sha", F.concat_ws("/", F.col("ord").cast("string"), "path").alias("path"), "size")
    found = landed.read_landed(spark, folder, wanted)
    return found.select("repo", F.expr("substr(path, instr(path, '/') + 1)").alias("path"), F.substring_index("path", "/", 1).cast("long").alias("ord"), F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("content_md5"))


@query(f"""WITH {LISTING_SQL}, {SELECTED_SQL}, s AS (SELECT *, repo || '-' || (ord // 600) AS part FROM selected), g AS (SELECT part, count(*) > 5 AS large FROM s GROUP BY part)
SELECT part AS repo, path, ord, md5(text) AS content_md5, CASE WHEN NOT large THEN 'raw' WHEN repo LIKE '%5' AND ord % 2 = 1 THEN 'raw' ELSE 'tarball' END AS via,
  CASE WHEN NOT large THEN 'raw' WHEN repo LIKE '%5' THEN 'tarball+raw' ELSE 'tarball' END AS method FROM s JOIN g USING (part)""")
def src7_fetch_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of repositories come as landed archives where more than five of their files are wanted. Of those of repositories that end in 5 the archive
    holds every other file and a second one has not landed; the rest come as single files, and others than those haven't landed at all."""
    files = listing(spark, sf_dir).withColumn("of", F.col("repo")).withColumn("repo", F.concat_ws("-", "repo", F.floor(F.col("ord") / 600).cast("string")))
    files = files.withColumn("path", F.concat_ws("/", F.col("ord").cast("string"), "path"))
    wanted = select.select_files(files, SETTINGS)
    settings = replace(SETTINGS, archive_from=5)
    large = cut(wanted.groupBy("repo").count().filter(F.col("count") > 5).select("repo"))
    halves = F.col("of").endswith("5")
    whole = files.filter(~halves | (F.col("ord") % 2 == 0)).join(large, "repo", "left_semi")
    single = files.join(large, "repo", "left_anti").unionByName(files.filter(halves & (F.col("ord") % 2 == 1)).join(large, "repo", "left_semi"))
    folder = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    row = lambda df, path, content: df.select("repo", F.lit("c1").alias("commit_sha"), path.alias("path"), content.alias("content"))
    landed.land(row(archives(whole), F.lit("1.tar.gz"), F.col("content")).unionByName(row(single, F.col("path"), F.encode("text", "UTF-8"))), folder)
    heads = wanted.select("repo", "commit_sha", "of").distinct()
    places = heads.select("repo", "commit_sha", F.lit("1.tar.gz").alias("path")).unionByName(heads.filter(halves).select("repo", "commit_sha", F.lit("2.tar.gz").alias("path")))
    found = landed.fetch_landed(spark, folder, wanted.select("repo", "commit_sha", "path", "size"), places, settings)
    return found.select("repo", F.expr("substr(path, instr(path, '/') + 1)").alias("path"), F.substring_index("path", "/", 1).cast("long").alias("ord"), F.md5("content").alias("content_md5"), "via", "method")
