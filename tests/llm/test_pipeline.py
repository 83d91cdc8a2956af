"""The stages of the corpus pipeline, one by one, against brute-force versions."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from codelode.llm import langid, mixing, spans  # noqa: E402
from codelode.llm.common import stored  # noqa: E402

from .test_duplicates import brute_spans  # noqa: E402


@pytest.fixture(scope="module")
def staged(spark, docs):
    out, now = {"documents": docs}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = out[name] = stored(stage(spark, now, ""))
    return out


def by_row(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect())


def test_columns(staged):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert staged[name].columns == corpus_pipeline.COLUMNS


def test_language_id_keeps_all_with_letters(staged):
    found = langid.identify(staged["documents"], langid.learn(staged["documents"])).select("doc_id", "text", "lang_pred", "source")
    before, after = Counter(tuple(r) for r in found.collect()), by_row(staged["language_id"])
    assert after == Counter({k: n for k, n in before.items() if any(c.isalpha() for w in langid.WORDS.findall(k[1] or "") for c in w)})


def test_language_id_without_languages(spark, docs):
    out = corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")
    letters = [r for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert out.columns == corpus_pipeline.COLUMNS and out.count() == len(letters)


def test_near_dedup_keeps_one_of_each_group(staged):
    before, after = staged["language_id"].collect(), staged["near_dedup"].collect()
    kept = Counter(r.doc_id for r in after)
    assert all(n == 1 for d, n in kept.items() if d is not None)
    shingles = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    held = [shingles(r.text) for r in after if r.doc_id is not None]
    for i, a in enumerate(held):  # copies have gone
        assert all(len(a & b) / len(a | b) < 0.9 for b in held[:i])
    for r in before:  # and what has gone has a copy that stays
        if r.doc_id not in kept:
            a = shingles(r.text)
            assert max(len(a & b) / len(a | b) for b in held) > 0.6
    assert 5 in kept and 61 not in kept and 8 in kept and 72 not in kept


def test_substring_dedup(staged):
    rows = [tuple(r) for r in staged["near_dedup"].select("doc_id", "text").collect()]
    expected = brute_spans(rows, 2, 8)
    got = {r.doc_id: r for r in staged["substring_dedup"].collect() if r.doc_id is not None}
    assert set(got) == {d for d, (_, n, gone) in expected.items() if gone == 0 or gone < n}
    assert any(gone for _, _, gone in expected.values())
    for d, r in got.items():
        assert r.text == expected[d][0] and r.n_chars == len(r.text)


def test_mixing_takes_what_its_operator_says(staged):
    docs = staged["substring_dedup"]
    copies = Counter()
    for r in mixing.mix(docs, mixing.repeating_weights(docs), keep=["text"]).collect():
        copies[r.doc_id, r.kept.text] += r.copies
    assert +copies == Counter((r.doc_id, r.text) for r in staged["mixing"].collect())


def test_mixing_of_rows_without_doc_id(spark):
    """Copies are those of each row: rows without doc_id don't take the copies of others."""
    rows = [(None, " ".join(["w"] * (i + 1)), "en", f"s{i % 3}", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    size = Counter()
    for _, text, _, source, _ in rows:
        size[source] += len(text.split())
    out = corpus_pipeline.mixing(spark, docs, "").collect()
    target = {r.source: r.target for r in mixing.mix(docs, mixing.repeating_weights(docs)).collect()}
    taken = Counter()
    for r in out:
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - target[s]) <= 60 for s in size) and max(Counter(r.text for r in out).values()) <= 2


def test_packing_packs_everything(staged):
    got = staged["packing"].collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r.doc_id for r in staged["mixing"].collect())


def test_empty(spark, no_docs):
    now = no_docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        assert now.count() == 0


def test_sentences_are_whole(staged):
    for r in staged["substring_dedup"].collect():
        assert "".join(spans.sentences(r.text)) == r.text
