"""Search by vector, by lines, and from a chunk to its context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jobs.shared import cut
from ..operators import search
from ..operators.chunk import chunk_documents
from ..operators.embed import hash_embed
from .chunks import BUCKET_SQL, CHUNKS_SQL, DIM, named_documents
from .fixtures import SETTINGS, table
from .registry import query


@query("""WITH v AS (SELECT 'r' || label AS repo, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.repo, list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e))) AS score FROM v q JOIN v c USING (repo) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, id, repo, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def tk1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against those of its label."""
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("r"), F.col("label").cast("string")).alias("repo"), F.col("vec_id").alias("id"), "embedding")
    queries = vectors.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "repo", F.col("embedding").alias("vector"))
    return search.top_k(queries, vectors, 5).withColumn("score", F.round("score", 6))


@query("""WITH c AS (SELECT 'r' || l_orderkey % 50 AS repo, l_orderkey AS path, l_linenumber AS chunk_index, min(l_partkey) % 500 + 1 AS start_line, min(l_partkey) % 500 + 1 + max(l_quantity)::BIGINT AS end_line FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS path, repo, chunk_index, start_line, end_line FROM orders JOIN c ON path = o_orderkey AND start_line <= o_custkey % 400 + 100 AND end_line >= o_custkey % 400 + 1""")
def jn4_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as chunks, a range of lines for each order."""
    return search.overlapping(ranges(spark, sf_dir), spans(spark, sf_dir)).select("path", "repo", "chunk_index", "start_line", "end_line")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("r"), (F.col("l_orderkey") % 50).cast("string")).alias("repo"), F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("chunk_index"))
    start = F.min("l_partkey") % 500 + 1
    return rows.agg(start.alias("start_line"), (start + F.max("l_quantity").cast("long")).alias("end_line"))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("o_custkey") % 400 + 1
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), (F.col("o_orderkey") % 50).cast("string")).alias("repo"), F.col("o_orderkey").alias("path"), first.alias("first_line"), (first + 99).alias("last_line"))


@query("""WITH c AS (SELECT l_orderkey AS path, l_linenumber AS chunk_index, min(l_partkey) % 500 + 1 AS s, min(l_partkey) % 500 + 1 + max(l_quantity)::BIGINT AS e FROM lineitem GROUP BY ALL),
  h AS (SELECT path AS query_id, s - 20 AS a, e + 20 AS b FROM c WHERE chunk_index = 1)
SELECT query_id, string_agg(chunk_index::VARCHAR, ',' ORDER BY s, chunk_index) AS context FROM h JOIN c ON path = query_id AND s <= b AND e >= a GROUP BY query_id""")
def jn5_expand_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each order as a hit whose parent reaches twenty lines further on both sides."""
    chunks = spans(spark, sf_dir).withColumns({"id": F.col("chunk_index"), "text": F.lit("")})
    hits = chunks.filter("chunk_index = 1").select(F.col("path").alias("query_id"), F.lit(1).alias("rank"), "repo", "path", (F.col("start_line") - 20).alias("parent_start_line"), (F.col("end_line") + 20).alias("parent_end_line"))
    found = search.expand_parents(hits, chunks)
    return found.select("query_id", F.array_join(F.transform("context", lambda c: c["chunk_index"].cast("string")), ",").alias("context"))


COUNTS_SQL = """{0} AS (SELECT k, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS w FROM (SELECT k, b AS bucket, count(*) AS n FROM (SELECT k, unnest(regexp_extract_all(lower(t), '[a-z0-9_]+')) AS w FROM {1}) JOIN words USING (w) GROUP BY ALL))"""


@query(f"""WITH RECURSIVE {CHUNKS_SQL}, sr AS (SELECT id AS k, repo, embed_text AS t FROM chunks), qs AS (SELECT item_id AS k, 'acme__src' || item_id % 20 AS repo, text AS t FROM benchmark),
  words AS (SELECT w, {BUCKET_SQL.format('w', DIM)}::INT AS b FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(t), '[a-z0-9_]+')) AS w FROM (SELECT t FROM sr UNION ALL SELECT t FROM qs))),
  {COUNTS_SQL.format('cv', 'sr')}, {COUNTS_SQL.format('qv', 'qs')},
  s AS (SELECT qs.k AS query_id, sr.k AS id, sr.repo, coalesce((SELECT sum(cv.w * qv.w) FROM cv JOIN qv USING (bucket) WHERE cv.k = sr.k AND qv.k = qs.k), 0) AS score FROM qs JOIN sr USING (repo))
SELECT query_id, rank::INT AS rank, id, repo, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 5""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents selected, chunked and embedded by hash, their vectors stored; the five best chunks of a repository for each benchmark text."""
    chunks = cut(chunk_documents(named_documents(spark, sf_dir), SETTINGS).dropDuplicates(["id"]).select("id", "repo", hash_embed(F.col("embed_text"), DIM).alias("embedding")))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("acme__src"), (F.col("item_id") % 20).cast("string")).alias("repo"), hash_embed(F.col("text"), DIM).alias("vector"))
    return search.top_k(asked, chunks, 5).withColumn("score", F.round("score", 6))
