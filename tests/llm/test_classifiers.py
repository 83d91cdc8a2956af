"""Language, quality, token counts."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest

from codelode.llm import langid, quality, tokencount
from codelode.llm.pretokens import chunk_ids

from .conftest import CLASHING, ENGLISH, GERMAN, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def slow_viterbi(scores, penalty):
    value, back = scores[0].astype(float), []
    for s in scores[1:]:
        top = int(value.argmax())
        switch = value[top] - penalty > value
        back.append(np.where(switch, top, np.arange(len(s))))
        value = np.where(switch, value[top] - penalty, value) + s
    label = [int(value.argmax())]
    for b in back[::-1]:
        label.append(int(b[label[-1]]))
    return np.array(label[::-1])


@pytest.mark.parametrize("lockstep", [langid.LOCKSTEP, 100])
def test_viterbi(monkeypatch, lockstep):
    monkeypatch.setattr(langid, "LOCKSTEP", lockstep)
    rng = np.random.default_rng(0)
    texts = [rng.normal(0, 3, (n, 4)).astype(np.float32) for n in (1, 2, 5, 50, 50, 300, 3)]
    for penalty in (1.0, 8.0, 30.0):
        for text, path in zip(texts, langid.viterbi(texts, penalty)):
            assert (path == slow_viterbi(text, penalty)).all()
            alone = langid.one_language(text, penalty)
            assert alone < 0 or (slow_viterbi(text, penalty) == alone).all()


def test_texts_of_one_language_are_told_exactly():
    """Short random texts, of two to five languages: where the shortcut names a language, the search finds it too."""
    rng, told = np.random.default_rng(1), 0
    for languages in (2, 3, 5):
        texts = [rng.normal(0, 3, (rng.integers(1, 12), languages)).astype(np.float32) for _ in range(35_000)]
        for text, path in zip(texts, langid.viterbi(texts, 8.0)):
            alone = langid.one_language(text, 8.0)
            told += alone >= 0
            assert alone < 0 or (path == alone).all()
    assert told > 10_000


def test_more_languages_than_a_byte_holds():
    rng = np.random.default_rng(2)
    texts = [rng.normal(0, 3, (40, 300)).astype(np.float32) for _ in range(5)]
    for text, path in zip(texts, langid.viterbi(texts, 5.0)):
        assert (path == slow_viterbi(text, 5.0)).all() and path.max() > 127


def grams_of(word):
    """Buckets of a word's n-grams, one by one."""
    marked = f"\x02{word}\x03"
    for n in langid.LENGTHS:
        for i in range(len(marked) - n + 1):
            h = n
            for c in marked[i : i + n]:
                h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
            yield (h >> 40) % langid.BUCKETS + (n - 1) * langid.BUCKETS


def test_counts_and_scores_of_languages(docs, rows):
    model = langid.learn(docs)
    counts = {lang: np.full(3 * langid.BUCKETS, langid.SMOOTHING) for lang in model.languages}
    for _, text, lang, *_ in rows:
        for w in langid.WORDS.findall(text or ""):
            if lang is not None and any(c.isalpha() for c in w):
                for g in grams_of(w.lower()):
                    counts[lang][g] += 1
    logs = {}
    for lang, n in counts.items():
        logs[lang] = np.concatenate([np.log(part / part.sum()) for part in n.reshape(3, -1)])
    for i, lang in enumerate(model.languages):
        assert np.allclose(model.scores[:, i], logs[lang], atol=1e-4)
    for r in langid.identify(docs, model).collect():
        if r.lang_pred != "und" and len(r.spans) == 1 and len(r.text) < 3000:
            total = {lang: sum(logs[lang][g] for w in langid.WORDS.findall(r.text) if any(c.isalpha() for c in w) for g in grams_of(w.lower())) for lang in logs}
            assert r.lang_pred == max(total, key=total.get)
            assert r.score == pytest.approx(1 / sum(np.exp(min(t - total[r.lang_pred], 700)) for t in total.values()), abs=1e-3)


def test_languages(docs, rows):
    model = langid.learn(docs)
    assert model.languages == ["de", "en"]
    found = langid.identify(docs, model)
    assert set(found.columns) == set(docs.columns)
    out = found.collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        if r.doc_id is not None and r.doc_id < 100:
            assert r.lang_pred == r.lang
        if r.spans:
            assert r.spans[0].start == 0 and r.spans[-1].end == len(r.text) and all(a.end == b.start and a.lang != b.lang for a, b in zip(r.spans, r.spans[1:]))


def test_mixed_text_gets_spans(docs):
    rng = random.Random(4)
    english, german = prose(ENGLISH, rng, 6), prose(GERMAN, rng, 12)
    known = langid.WordScores(langid.learn(docs))
    (lang, score, spans), *_ = langid.label_texts([f"{english} {german}"], known)
    assert lang == "de" and 0 < score < 1 and [s[2] for s in spans] == ["en", "de"] and abs(spans[0][1] - len(english)) < 12


def test_scripts_narrow(spark):
    rows = [("дом вода лес " * 20, "ru"), ("house water wood " * 20, "en")]
    known = langid.WordScores(langid.learn(spark.createDataFrame(rows, "text string, lang string")))
    assert [f[0] for f in langid.label_texts(["абвг", "zzz", "字"], known)][:2] == ["ru", "en"]


def test_nothing_learned(docs, no_docs):
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(no_docs)).collect()} == {"und"}
    assert langid.identify(no_docs, langid.learn(no_docs)).count() == 0


def test_quality_on_held_out(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        good = i % 3 > 0
        text = prose(ENGLISH, rng, 8) if good else " ".join(f"{rng.choice(ENGLISH)} {rng.choice(['$$$', '%%%', '|'])}" for _ in range(60))
        rows.append((i, text, int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = {r.doc_id: r.score for r in quality.classify(df, df.filter("doc_id % 5 <> 0")).collect()}
    held = [(got[i], good) for i, _, good in rows if i % 5 == 0]
    assert np.mean([(s >= 0.3) == bool(good) for s, good in held]) > 0.95
    assert np.mean([s for s, good in held if good]) > 0.8 and np.mean([s for s, good in held if not good]) < 0.2


def test_word_vectors_against_plain_loops(docs, rows):
    places, signs = quality.index_vectors()
    bucket = quality.Bucket()
    total, texts = np.zeros((quality.BUCKETS, quality.WIDTH)), []
    for doc_id, text, *_ in rows:
        raw = [bucket[w] for w in quality.TOKENS.findall(text or "")]
        t = [0 if i and raw[i - 1] == b else b for i, b in enumerate(raw)]
        texts.append((doc_id, t))
        for i, own in enumerate(t):
            for j in range(max(0, i - quality.WINDOW), min(len(t), i + quality.WINDOW + 1)):
                if j != i:
                    for place, sign in zip(places[t[j]], signs[t[j]]):
                        total[own, place] += sign
    unit = lambda v: v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)
    used = total.any(axis=1)
    expected = unit(unit(total) - unit(total)[used].mean(axis=0))
    vectors = quality.word_vectors(docs)
    assert np.allclose(vectors, expected, atol=1e-5)
    got = sorted((str(r.doc_id), np.round(r.x, 4).tolist()) for r in quality.pooled(docs, vectors).collect())
    means = sorted((str(d), np.round(np.mean([expected[b] for b in t], axis=0) if t else np.zeros(quality.WIDTH), 4).tolist()) for d, t in texts)
    assert [d for d, _ in got] == [d for d, _ in means] and np.allclose([x for _, x in got], [x for _, x in means], atol=3e-4)


def test_network_against_plain_loops():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(300, quality.WIDTH)), rng.integers(0, 2, 300)
    x[:, 0] += 2 * y
    net = quality.fit(x, y)
    for row, p in zip(x[:40], net.probability(x[:40])):
        z = float(net.b2)
        for j in range(quality.HIDDEN):
            inner = net.b1[j] + sum((row[i] - net.mean[i]) / net.scale[i] * net.w1[i, j] for i in range(quality.WIDTH))
            z += max(inner, 0) * net.w2[j]
        assert p == pytest.approx(1 / (1 + np.exp(-z / net.temperature)))
    assert quality.loss(net.probability(x), y) < quality.loss(np.full(300, 0.5), y)


def test_quality_of_odd_rows(spark, docs, no_docs, rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (4, 1), (4, 0)], "doc_id long, label int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert {round(r.score, 6) for r in quality.classify(docs, labels.filter("label = 1")).collect()} == {1.0}
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(no_docs, labels).count() == 0


def test_token_trees():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    known, rng = chunk_ids(PATH), random.Random(1)
    for text in ["", "a", " ", "x  y\n\n z" * 200, "a\x1c b " * 300, "　 a\xa0 b\n" * 200, prose(ENGLISH, rng, 300)]:
        tree = tokencount.TokenTree(text, known)
        for _ in range(25):
            p, n = rng.choice([0, len(text), rng.randrange(len(text) + 1)]), rng.choice([0, 1, 3, 50, 700])
            new = rng.choice(["", " ", "\n", "abc", "  ", "the of and ", "\x1c", "é\t", " x" * 400, "<|endof", "text|>", "<|endoftext|>"])
            text = text[:p] + new + text[p + n :]
            tree.edit(p, n, new)
            assert "".join(tree.texts) == text and tree.chars[1] == len(text) and tree.tokens[1] == len(t.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("letters", ["漢字仮名交文", "漢字。，仮名", "etaoin", "etaoin\t", "0123456789", "a", " ", "'s're'll", "!?'"])
def test_edits_of_texts_without_blanks(letters):
    """One changed character costs a few leaves, whatever parts the text; series of edits of all lengths count right."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    known, rng = chunk_ids(PATH), random.Random(letters)
    more = "".join(chr(c) for c in range(0x4E00, 0x5600)) if "漢" in letters else ""
    draw = lambda n: "".join(rng.choices(letters + more, k=n))
    text = draw(100_000)
    tree = tokencount.TokenTree(text, known)
    for k in range(40):
        p, n, new = (rng.randrange(len(text)), 1, draw(1)) if k < 10 else (rng.randrange(len(text)), rng.choice([0, 2, 900, 9000]), draw(rng.choice([0, 3, 900, 9000])))
        text, tree.encoded = text[:p] + new + text[p + n :], 0
        tree.edit(p, n, new)
        assert k >= 10 or tree.encoded < 4096
    assert "".join(tree.texts) == text and tree.tokens[1] == len(t.encode(text, add_special_tokens=False).ids)


def test_edits_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x y", "kept", [1])], "doc_id long, text string, _id string, edits array<int>")
    edits = spark.createDataFrame([(1, 0, 3, 0, " b"), (1, 0, 3, 0, " a")], "doc_id long, seq long, position long, removed long, inserted string")
    row = tokencount.with_edits(docs, edits).collect()[0]
    assert row._id == "kept" and [e.inserted for e in row.edits] == [" a", " b"]


def test_counts_after_edits(spark, docs, no_docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    count = lambda text: len(t.encode(text, add_special_tokens=False).ids)
    edits = [(1, 2, 5, 3, "xyz"), (1, 1, 0, 0, "first "), (200, 0, 1000, 10**6, " end"), (201, 0, 7, 7, "new"), (2, 0, None, 1, "no"), (9, 0, -4, -1, "a"), (None, 0, 0, 0, "no")]
    frame = spark.createDataFrame(edits, "doc_id long, seq long, position long, removed long, inserted string")
    got = tokencount.count_tokens(tokencount.with_edits(docs.drop("edits"), frame), PATH).collect()
    assert len(got) == len(rows)
    texts = {}
    for doc_id, text, *_ in rows:
        texts.setdefault(doc_id, []).append(text or "")
    for r in got:
        after = []
        for text in texts[r.doc_id]:
            before = text
            for _, _, p, n, new in sorted((e for e in edits if e[0] == r.doc_id and r.doc_id is not None and None not in e), key=lambda e: e[1]):
                p, n = min(max(p, 0), len(text)), max(n, 0)
                text = text[:p] + new + text[p + n :]
            after.append((count(before), count(text), len(text)))
        assert (r.tokens_before, r.tokens_after, r.chars_after) in after
        if not r.n_edits:
            assert r.chars_reencoded == 0
    assert next(r for r in got if r.doc_id == 200).chars_reencoded < 5000
    assert tokencount.count_tokens(tokencount.with_edits(no_docs, frame), PATH).count() == 0
    assert set(CLASHING)  # the fixture's further columns were there all along
