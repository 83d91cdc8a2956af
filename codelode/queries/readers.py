"""Lines, outputs, sections, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import readers
from .fixtures import table
from .registry import query


@query("SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END)::INT AS n_lines FROM documents")
def fn5_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.line_count(F.col("text")).alias("n_lines"))


@query("SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS text_md5 FROM pages")
def fn6_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_html(F.col("html")).cast("binary")).alias("text_md5"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+'))::INT AS tokens FROM documents")
def fn4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


OUTPUT_SQL = """WITH l AS (SELECT page_id, list_filter(list_transform(string_split(replace(html, '>', '>' || chr(10)), chr(10)), lambda x: CASE WHEN length(rtrim(x, ' ' || chr(9))) > 300 THEN rtrim(x, ' ' || chr(9))[1:300] || ' ...' ELSE rtrim(x, ' ' || chr(9)) END), lambda x: x <> '') AS a FROM pages)
SELECT page_id, md5(array_to_string(CASE WHEN len(a) > 30 THEN a[1:15] || ['... [' || (len(a) - 30) || ' lines omitted]'] || a[len(a) - 14:] ELSE a END, chr(10))) AS text_md5 FROM l"""


@query(OUTPUT_SQL)
def fn7_clean_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as printed output, a line per tag, with terminal codes and progress lines that are to go."""
    noisy = F.regexp_replace("html", ">", ">\u001b[0m\n50%\r100%\r")
    noisy = F.regexp_replace(noisy, "50%\r100%\r", "old state\r")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.clean_output(noisy).cast("binary")).alias("text_md5"))


@query(OUTPUT_SQL.replace("SELECT page_id, md5(", "SELECT page_id, len(a) > 30 AS shortened, least(len(a), 31)::INT AS n, md5("))
def tk3_head_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.clean_output(F.regexp_replace("html", ">", ">\n"))
    n = F.size(F.split(text, "\n"))
    n = F.when(text == "", 0).otherwise(n).cast("int")
    return table(spark, sf_dir, "pages").select("page_id", (n == 31).alias("shortened"), n.alias("n"), F.md5(text.cast("binary")).alias("text_md5"))


@query("SELECT doc_id, round(entropy(c), 6) AS bits FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) GROUP BY doc_id")
def fn9_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.text_entropy(F.col("text")), 6).alias("bits"))


@query("""WITH w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id) AS i, w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w FROM documents)),
  e AS (SELECT w, entropy(c) AS bits FROM (SELECT w, unnest(string_split(w, '')) AS c FROM (SELECT DISTINCT w FROM w)) GROUP BY w)
SELECT doc_id, count(*) FILTER (WHERE length(w) >= 8 AND NOT regexp_matches(lower(w), 'xxx|your|example|changeme|placeholder|dummy') AND bits >= 3 - 1e-9) AS secrets FROM w JOIN e USING (w) GROUP BY doc_id""")
def fil8_is_real_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that look like a real secret, by document."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("w"))
    return words.groupBy("doc_id").agg(F.count_if(T.is_real_secret(F.col("w"))).alias("secrets"))


@query("SELECT doc_id, CASE WHEN length(trim(text, ' ' || chr(10))) > 1500 THEN md5(trim(text, ' ' || chr(10))[1:1500] || chr(10) || '...') ELSE md5(trim(text, ' ' || chr(10))) END AS excerpt_md5 FROM documents")
def fn18_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.excerpt(F.col("text")).cast("binary")).alias("excerpt_md5"))


#: Every fifth line is a heading, every seventeenth begins or ends a fence.
MARKDOWN_SQL = """l AS (SELECT doc_id, unnest(range(1, len(s) + 1))::INT AS line, unnest(s) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
  m AS (SELECT doc_id, line, t AS title, line % 17 = 3 AS fence, CASE WHEN line % 17 <> 3 AND line % 5 = 0 THEN 1 + (doc_id + line // 5) % 4 END AS level FROM l),
  o AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY line) % 2 AS open, max(line) OVER (PARTITION BY doc_id) AS n FROM m),
  h AS (SELECT *, trim(title) AS name0 FROM o WHERE level IS NOT NULL AND open = 0)"""


@query(f"""WITH {MARKDOWN_SQL}
SELECT a.doc_id, a.line AS start_line, coalesce((SELECT min(b.line) FROM h b WHERE b.doc_id = a.doc_id AND b.line > a.line AND b.level <= a.level) - 1, a.n)::INT AS end_line,
  concat(coalesce((SELECT string_agg('h' || p.line || ' > ', '' ORDER BY p.line) FROM h p WHERE p.doc_id = a.doc_id AND p.line < a.line AND p.level < a.level
    AND NOT EXISTS (SELECT 1 FROM h q WHERE q.doc_id = a.doc_id AND q.line > p.line AND q.line < a.line AND q.level <= p.level)), ''), 'h', a.line) AS name,
  (SELECT count(*) FROM h p WHERE p.doc_id = a.doc_id AND p.line < a.line AND p.level < a.level
    AND NOT EXISTS (SELECT 1 FROM h q WHERE q.doc_id = a.doc_id AND q.line > p.line AND q.line < a.line AND q.level <= p.level))::INT AS depth
FROM h a""")
def wn4_markdown_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose every fifth line is a heading of some level, and every seventeenth a fence."""
    lines = F.split("text", "\n")
    raw = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("i", "t")).withColumn("line", F.col("i") + 1)
    level = (1 + (F.col("doc_id") + F.floor(F.col("line") / 5)) % 4).cast("int")
    made = F.when(F.col("line") % 17 == 3, F.concat(F.lit("  ```"), "t")).when(F.col("line") % 5 == 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" h"), F.col("line").cast("string"), F.lit(" ##"))).otherwise(F.concat(F.lit("."), "t"))
    return readers.markdown_units(raw.select("doc_id", "line", made.alias("text")), ["doc_id"])


NOTEBOOK_SQL = """c AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'code' WHEN 'system' THEN 'raw' ELSE 'markdown' END AS kind, rtrim(text, ' ' || chr(10)) AS source FROM conversations),
  b AS (SELECT conv_id, turn, '# [cell ' || (turn + 1) || ' · ' || kind || ']' || chr(10) || source || CASE WHEN kind = 'code' THEN chr(10) || '# [output of cell ' || (turn + 1) || ']' || chr(10) || 'done ' || turn ELSE '' END AS block FROM c WHERE source <> '' OR kind = 'code'),
  z AS (SELECT *, len(string_split(block, chr(10))) AS n, sum(len(string_split(block, chr(10))) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS e FROM b)"""


@query(f"WITH {NOTEBOOK_SQL} SELECT conv_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY turn) || chr(10)) AS text_md5, string_agg((e - n + 1)::INT || '-' || e::INT || ' cell ' || (turn + 1), ', ' ORDER BY turn) AS units FROM z GROUP BY conv_id")
def fn8_notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as notebooks in JSON, read again: what assistants say is code that prints a line."""
    turn = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    kind = F.when(F.col("role") == "assistant", "code").when(F.col("role") == "system", "raw").otherwise("markdown")
    output = F.struct(F.lit("stream").alias("output_type"), F.lit("stdout").alias("name"), F.array(F.concat(F.lit("done "), F.col("turn").cast("string"), F.lit("\n"))).alias("text"))
    cell = F.struct(F.col("turn"), kind.alias("cell_type"), F.array("text").alias("source"), F.when(kind == "code", F.array(output)).alias("outputs"))
    cells = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.to_json(cell).alias("j")))).alias("a"))
    books = cells.select("conv_id", F.concat(F.lit('{"cells": ['), F.array_join(F.transform("a", lambda x: x["j"]), ", "), F.lit("]}")).alias("text"))
    read = readers.rendered_cells(readers.notebook_cells(books, ["conv_id"]), ["conv_id"])
    spans = F.array_join(F.transform("units", lambda u: F.concat(u["start_line"].cast("string"), F.lit("-"), u["end_line"].cast("string"), F.lit(" "), u["name"])), ", ")
    return read.select("conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), spans.alias("units"))


@query()
def fn8b_outputs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as results of cells."""
    output = F.struct(F.lit("execute_result").alias("output_type"), F.struct(F.col("html").alias("text/html"), F.lit("x").alias("image/png")).alias("data"))
    pages = table(spark, sf_dir, "pages").withColumn("outputs", F.array(F.try_parse_json(F.to_json(output))))
    return pages.select("page_id", readers.outputs_text(F.col("outputs")).alias("text"))


@query()
def ch6_python_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up module per document: a class with a method for every line of its text, named by the line's place."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    body = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("    @wrap\n    def m"), i.cast("string"), F.lit("(self):\n        return "), F.length(x).cast("string"))), "\n")
    source = F.concat(F.lit("class C"), F.col("doc_id").cast("string"), F.lit(":\n    pass\n"), body)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(readers.python_units(source)).alias("u"))
    return docs.select("doc_id", "u.start_line", "u.end_line", "u.name", "u.depth")
