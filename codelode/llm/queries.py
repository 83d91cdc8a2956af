"""The query of each operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .collocations import collocations
from .common import seeded, table
from .infilling import fill_in_middle, restored
from .langid import identify, learn
from .mixing import mix, repeating_weights
from .packing import pack
from .quality import classify
from .secretscan import base_only, find_secrets, number_of, written
from .simhash import exact_bands, near_duplicates
from .spans import without_repeats
from .suffixes import without_earlier_strings
from .tokencount import count_tokens
from .topk import scaled, top_products


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every twentieth vector."""
    return top_products(table(spark, sf_dir, "embeddings"), "vec_id", scaled(F.col("embedding")), F.col("vec_id") % 20 == 0, 20)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at 3 or fewer differing bits of 64."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, words=1, max_bits=3, bands=exact_bands(64, 3, 6))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that strings of 50 bytes cover which start in an earlier document too."""
    return without_earlier_strings(table(spark, sf_dir, "documents")).drop("kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a mix of 150 % of their words, with sources that weigh 3, 1, 2, repeating."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs, repeating_weights(docs)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def remainder(by: int) -> Column:
    """crc32 of doc_id as text, modulo `by`; 0 without doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % by, F.lit(0))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose remainder by 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(remainder(3) != 1))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels of those whose remainder by 5 is not 0."""
    labels = table(spark, sf_dir, "labels").filter(remainder(5) != 0).select("doc_id", F.col("quality").alias("label"))
    found = classify(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the sentences of runs that occurred before: two sentences or more, of 8 words or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_sentences", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), "text")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found for every fiftieth vector."""
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", F.col("embedding"), F.col("vec_id") % 50 == 0, 5)


def op10_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after four edits at places drawn by its id: a word put in, a stretch replaced, one taken out, a line added at the end."""
    n = F.coalesce(F.length("text"), F.lit(0))
    edits = [(F.lit("another "), F.lit(0)), (F.concat(F.coalesce("lang", F.lit("?")), F.lit(": ")), F.lit(24)), (F.lit(""), F.lit(60))]
    made = [F.struct(F.lit(i).alias("seq"), F.pmod(seeded(i, "doc_id"), n + 1).alias("position"), removed.alias("removed"), text.alias("inserted")) for i, (text, removed) in enumerate(edits)]
    made.append(F.struct(F.lit(3).alias("seq"), F.lit(2**31).alias("position"), F.lit(0).alias("removed"), F.concat(F.lit("\n"), F.coalesce("source", F.lit(""))).alias("inserted")))
    docs = table(spark, sf_dir, "documents").withColumn("edits", F.array(*[m.cast("struct<seq: long, position: long, removed: long, inserted: string>") for m in made]))
    return count_tokens(docs, tokenizer_file())


def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a task of filling in its middle, or plain, and the text rebuilt from it."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document that look like secrets: three patterns, and strings of sensitive places that can't be compressed."""
    spans = F.col("spans")
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [number_of(spans, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex", "novel")]
    return found.select("doc_id", *counts, F.sha2(written(base_only(spans)), 256).alias("base_sha256"), written(spans).alias("spans"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest collocations of each language: phrases of 2 to 5 words that occur 100 times or more."""
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_topk": op2_topk,
    "op3_simhash": op3_simhash,
    "op4_suffixes": op4_suffixes,
    "op5_mixing": op5_mixing,
    "op6_langid": op6_langid,
    "op7_quality": op7_quality,
    "op8_spans": op8_spans,
    "op9_ann": op9_ann,
    "op10_tokencount": op10_tokencount,
    "op11_infilling": op11_infilling,
    "op12_secrets": op12_secrets,
    "op13_collocations": op13_collocations,
}

#: The other queries need XXH64, seeded draws, Viterbi, trained weights or tokens, which SQL hasn't.
ORACLES: dict[str, str] = {
    "op8_spans": r"""
WITH l AS (SELECT doc_id, list_filter(regexp_extract_all(text, '(?s).*?(?:[.!?]\s+|\n\s*|$)'), lambda x: x <> '') AS l FROM documents),
  s AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS i FROM l),
  k AS (SELECT doc_id, i, lower(trim(s, ' ' || chr(10) || chr(9) || chr(13))) AS p, len(regexp_extract_all(s, '[^\s]+')) AS n FROM s),
  r AS (SELECT doc_id, i, p || chr(10) || lead(p) OVER w AS key, n + lead(n) OVER w AS n FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS nth FROM r WHERE n >= 8),
  g AS (SELECT DISTINCT doc_id, unnest([i, i + 1]) AS i FROM f WHERE nth > 1),
  c AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id),
  t AS (SELECT doc_id, string_agg(s, '' ORDER BY i) AS kept FROM s ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l.l), 0)::BIGINT AS n_sentences, coalesce(n_removed, 0) AS n_removed, sha256(CASE WHEN n_removed IS NULL THEN coalesce(d.text, '') ELSE coalesce(kept, '') END) AS kept_sha256,
  CASE WHEN n_removed IS NULL THEN d.text ELSE coalesce(kept, '') END AS text
FROM documents d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_infilling": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
  u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, [('0x' || h[8 * i + 1:8 * i + 8])::BIGINT for i in range(4)] AS h FROM d),
  k AS (SELECT doc_id, t, u, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
  c AS (SELECT doc_id, t, n, form, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM c""",
    "op13_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents WHERE text IS NOT NULL),
  w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
  g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
  f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
  n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
  c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
  inside AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN (SELECT lang, a, unnest(flatten([[array_to_string(w[i:i + j - 1], ' ') for i in range(1, k - j + 2)] for j in range(2, k)])) AS phrase FROM c) AS s ON c.lang = s.lang AND c.phrase = s.phrase AND 100 * s.a >= 100 * c.a),
  cut AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS cut FROM c ANTI JOIN inside USING (lang, phrase)),
  parts AS (SELECT lang, phrase, a, cut, array_to_string(w[:cut], ' ') AS p1, array_to_string(w[cut + 1:], ' ') AS p2 FROM cut),
  s AS (SELECT parts.lang, parts.phrase, a, cut, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n // (l.f::HUGEINT * r.f))::BIGINT AS score FROM parts JOIN n ON n.lang = parts.lang JOIN f AS l ON l.lang = parts.lang AND l.phrase = p1 JOIN f AS r ON r.lang = parts.lang AND r.phrase = p2),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM s) WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) WHERE rank <= 2000""",
}
