"""From raw documents to packed training sequences.

Each stage takes all that the one before kept. All but the last return the columns of documents (doc_id, text, lang, source,
n_chars) and no others; n_chars follows the text. Null texts and texts without a letter go in the first stage. Empty tables
stay empty. Documents without doc_id can't be told apart: near_dedup and substring_dedup keep them as they are. Of rows that repeat a
doc_id, near_dedup keeps one. Ties: the smallest doc_id stays, and the first occurrence of a passage. Very long texts are read
whole at each stage, by parts of a batch, and packed in several pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.common import stored
from codelode.llm.langid import identify, learn
from codelode.llm.mixing import mix, repeating_weights
from codelode.llm.packing import pack
from codelode.llm.queries import tokenizer_file
from codelode.llm.simhash import near_duplicates
from codelode.llm.spans import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a language can be told, with that language as their lang; what is `und` goes. Where no row has a lang, none can be
    learned, and all documents with a letter stay as they are."""
    docs = docs.select(COLUMNS)
    model = learn(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = identify(docs, model).filter("lang_pred <> 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies (five-word shingles, similarity 0.8 or more); one row of it."""
    docs = docs.select(COLUMNS)
    found = stored(near_duplicates(docs).select("doc_id", "component_id"))
    kept = docs.join(found.filter("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti")
    repeated = stored(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if not repeated.isEmpty():
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences (of more than 13 words: the pieces) of passages that occurred before; those of which nothing is left go.

    Two pieces of 13 words and parts of two more at its ends make up a passage of 50 words.
    """
    cut = without_repeats(docs.select(COLUMNS), longest=13)
    return cut.filter("n_removed = 0 or n_removed < n_sentences").withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as a mix of 150 % of all words takes."""
    docs = docs.select(COLUMNS)
    taken = mix(docs, repeating_weights(docs), keep=COLUMNS).filter("copies > 0")
    return taken.select("kept.*", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of at most 1024 tokens."""
    return pack(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Fingerprints, Viterbi, seeded draws and packing are beyond SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what one returns is written as Parquet before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
