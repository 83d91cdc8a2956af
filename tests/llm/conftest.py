"""Documents with everything that real tables hold: nulls anywhere, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

import pytest

#: Names that the operators use themselves, as further columns of the input.
CLASHING = ["row", "size", "key", "score", "lang_pred", "spans", "fp", "component_id", "copies", "n_removed", "n_sentences", "label", "at", "task", "length", "_id", "_gone"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
ENGLISH = "the and of house water tree with without under morning evening garden people river small great when where never always walking".split()
GERMAN = "der und von haus wasser baum mit ohne unter morgen abend garten leute fluss klein gross wann wo niemals immer gehend straße".split()


def sentence(words: list[str], rng: random.Random, n: int) -> str:
    return (" ".join(rng.choice(words) for _ in range(n)) + ". ").capitalize()


def prose(words: list[str], rng: random.Random, sentences: int) -> str:
    return "".join(sentence(words, rng, rng.randrange(4, 14)) for _ in range(sentences)).strip()


def made_documents() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars)."""
    rng = random.Random(3)
    passage = prose(ENGLISH, rng, 8)
    rows = []
    for i in range(60):
        words, lang = (ENGLISH, "en") if i % 3 else (GERMAN, "de")
        text = prose(words, rng, rng.randrange(1, 30))
        if i % 7 == 0:
            text = f"{text}\n{passage}\n{prose(words, rng, 2)}"
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    for i in range(60, 66):  # exact copies, and near ones
        rows.append((i, rows[5][1], "en", "s0", None))
        near = rows[8][1].split(" ")
        near[i - 60] = "changed"
        rows.append((i + 10, " ".join(near), "en", None, 1))
    long = prose(ENGLISH, rng, 4000)
    rows += [(200, long, "en", "s9", len(long)), (201, None, "en", "s1", None), (202, "", None, "s1", 0), (203, " \n\t ", "de", None, 4)]
    rows += [(204, "12 34 !? 5.6", "en", "s2", 12), (205, "Haus", None, "s2", 4), (None, rows[5][1], "en", "s3", None), (None, None, None, None, None)]
    rows += [rows[9], rows[9], (206, "𝄞 ünïcode  　字", None, "é", 1), (207, "\x00\x1c \x85 a\r\nb", "en", "Z", 9)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return made_documents()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
