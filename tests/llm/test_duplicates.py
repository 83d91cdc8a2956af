"""Near-duplicates, repeated spans, repeated bytes."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from codelode.llm import graph, simhash, spans, suffixes


def brute_fingerprint(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), seed=42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(values, max_bits):
    label = {v: v for v in values}

    def find(v):
        while label[v] != v:
            v = label[v]
        return v

    values = list(values)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= max_bits:
                label[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_near_duplicates(docs, rows):
    got = simhash.near_duplicates(docs, 3, 1, 3, simhash.exact_bands(64, 3, 6)).collect()
    assert len(got) == len(rows)
    fp = {}
    for doc_id, text, *_ in rows:
        fp.setdefault(doc_id, []).append(brute_fingerprint(text, 3))
    root = brute_components({f for fs in fp.values() for f in fs}, 3)
    least = {}
    for doc_id, fs in fp.items():
        for f in fs:
            if doc_id is not None:
                least[root[f]] = min(least.get(root[f], doc_id), doc_id)
    for r in got:
        f = int.from_bytes(r.fp, "big")
        assert f in fp[r.doc_id] and r.component_id == least.get(root[f])


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 8])
def test_links_lose_nothing_in_crowded_bands(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:6]:  # chains of near ones
        for _ in range(30):
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                v ^= 1 << bit
            values.add(v)
    raw = np.array(sorted(values), dtype=">u8").view(np.uint8).reshape(-1, 8)
    df = spark.createDataFrame([(bytearray(f.tobytes()), bytearray(t.tobytes())) for f, t in zip(raw, simhash.pivot_table(raw))], "fp binary, table binary")
    edges = simhash.links(df, simhash.exact_bands(64, 3, 6), 3, 8)
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in graph.components(edges).collect()}
    for v, root in brute_components(values, 3).items():
        assert got.get(v, v) == root


def test_copies_at_similarity(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(300)] for _ in range(20)]
    near = [[w if i % 97 else "new" for i, w in enumerate(b)] for b in base]
    df = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(base + near)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert all(got[i + 20] == i and got[i] == i for i in range(20))


@pytest.mark.parametrize("common,more,linked", [(364, 60, False), (404, 50, True), (344, 30, True)], ids=["0.75", "0.8", "0.85"])
def test_similarity_is_exact(spark, common, more, linked):
    """Pairs of documents that share `common` words and have `more` of their own; a line that one of them repeats doesn't count."""
    rng = random.Random(common)
    word = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for i in range(40):
        shared = word(common)
        rows += [(2 * i, f"{shared} {word(more)}"), (2 * i + 1, f"{shared} {word(more)}")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 if linked else d for d, _ in rows}


def test_a_repeated_line_counts_once(spark):
    rng = random.Random(4)
    base, line = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (300, 6))
    df = spark.createDataFrame([(1, f"{base} {line}"), (2, f"{base} " + " ".join([line] * 200))], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(df).collect()} == {1}


@pytest.mark.parametrize("chunk", [simhash.VERIFIED, 8])
def test_similarity_in_large_groups(spark, monkeypatch, chunk):
    """Near copies of one document, some too far from all others: the same components as all pairs give."""
    monkeypatch.setattr(simhash, "VERIFIED", chunk)
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 7)):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a <= b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert 1 < len(set(root.values())) < 60
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == root


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_spans(rows, run, min_words):
    first, texts = {}, dict(sorted(((d, t) for d, t, *_ in rows if d is not None), key=lambda x: x[0]))
    cut = {d: spans.sentences(t) for d, t in texts.items()}
    key = lambda s, i: tuple(x.strip().lower() for x in s[i : i + run])
    long = lambda s, i: i + run <= len(s) and sum(len(x.split()) for x in s[i : i + run]) >= min_words
    for d in sorted(cut):
        for i in range(len(cut[d])):
            if long(cut[d], i):
                first.setdefault(key(cut[d], i), (d, i))
    out = {}
    for d, s in cut.items():
        gone = {i + j for i in range(len(s)) if long(s, i) and first[key(s, i)] != (d, i) for j in range(run)}
        out[d] = ("".join(x for i, x in enumerate(s) if i not in gone) if gone else texts[d], len(s), len(gone))
    return out


@pytest.mark.parametrize("run,min_words", [(2, 8), (3, 1)])
def test_spans(docs, rows, run, min_words):
    got = spans.without_repeats(docs, run, min_words)
    assert set(got.columns) == set(docs.columns)
    expected = brute_spans(rows, run, min_words)
    out = got.collect()
    assert len(out) == len(rows) and any(r.n_removed for r in out)
    for r in out:
        if r.doc_id is not None:
            assert (r.text, r.n_sentences, r.n_removed) == expected[r.doc_id]
        else:
            assert r.n_removed == 0


def test_sentences_make_up_the_text(rows):
    for _, text, *_ in rows:
        assert "".join(spans.sentences(text)) == (text or "")


def test_long_sentences_that_repeat(spark):
    """A passage of 60 words without an end, in sentences that differ round it; the same in a script without spaces."""
    rng = random.Random(8)
    word = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    rows, kept = [], {}
    for i in range(0, 40, 2):
        make, glue = (word, " ") if i % 4 else (han, "")
        passage = make(60)
        before, after = (make(rng.randrange(5, 40)), make(rng.randrange(5, 40))), (make(20), make(20))
        rows += [(i + k, glue.join([before[k], passage, after[k]])) for k in (0, 1)]
        kept[i + 1] = passage
    same = spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert not same.filter("n_removed > 0").count()
    got = {r.doc_id: r for r in spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), longest=13).collect()}
    for i, text in rows:
        assert "".join(spans.units(text, 13)[0]) == text and max(spans.units(text, 13)[1]) <= 13
        if i not in kept:
            assert got[i].text == text
            continue
        words = spans.UNIT_WORD.findall
        left = [w for w in words(got[i].text)]
        own = [w for w in words(text) if w not in words(kept[i])]
        assert [w for w in left if w in own] == own  # nothing else goes
        assert len(left) - len(own) <= 40


def test_marks_of_other_scripts():
    assert spans.units("今日は雨。明日は晴れ！ よい", 13)[0] == ["今日は雨。", "明日は晴れ！ ", "よい"]
    assert spans.units("यह है। वह है", 13)[0] == ["यह है। ", "वह है"]


@pytest.mark.parametrize("text", ["", " ", "one", "two words", "now three words", "a. b", "a\nb\nc", "日本", "日本語", "there are four words"])
def test_few_words_alone(spark, text):
    """Texts of fewer words than a piece's surroundings, with no other text beside them, and behind a text that fills a part."""
    long = "word " * (spans.TOGETHER // 5 + 1)
    behind = list(spans.units_of([long, text], 13))[1]
    assert spans.units(text, 13) == behind and "".join(behind[0]) == text
    docs = spark.createDataFrame([(1, long), (2, text)], "doc_id long, text string").coalesce(1)
    for some in (docs.filter("doc_id = 2"), docs):
        (kept,) = spans.without_repeats(some, longest=13).filter("doc_id = 2").collect()
        assert (kept.text, kept.n_sentences, kept.n_removed) == (text, len(behind[0]), 0)


def brute_bytes(rows, length):
    first = {}
    for d, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], d)
    out = {}
    for d, t, *_ in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        if d is not None:
            for i in range(len(raw) - length + 1):
                if first[raw[i : i + length]] < d:
                    gone[i : i + length] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[d, t] = (len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd,merged", [(suffixes.CROWD, suffixes.MERGED), (1, 8192), (suffixes.CROWD, 32), (2, 8)])
def test_suffixes(docs, rows, monkeypatch, crowd, merged):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "MERGED", merged)
    expected = brute_bytes(rows, 50)
    out = suffixes.without_earlier_strings(docs).collect()
    texts = {}
    for d, t, *_ in rows:
        texts.setdefault(d, []).append(t)
    assert len(out) == len(rows) and any(r.n_removed for r in out)
    for r in out:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in [expected[r.doc_id, t] for t in texts[r.doc_id]]


def test_runs_and_pieces_hold_every_string(rows):
    """Each string of each text is in one run, and in one piece of it; equal strings have equal anchors and cores, at equal distances."""
    length, texts = 50, [(t or "").encode() for _, t, *_ in rows] + [b"ab" * 300, b"a" * 200, b""]
    data, cuts = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    of_string, seen = {}, set()
    for anchor, doc, place in suffixes.runs_of(data, cuts, length):
        start = cuts[doc] + (place >> suffixes.START)
        run, start, place, n, core, piece = suffixes.pieces_of(suffixes.words_at(data), start, place, length)
        for r, s, p, k, c in zip(run.tolist(), start.tolist(), place.tolist(), n.tolist(), core.tolist()):
            for i in range(k):
                string = data[s + i : s + i + length].tobytes()
                seen.add(s + i)
                assert of_string.setdefault(string, (int(anchor[r]), c, (p >> suffixes.BEFORE & 63) - i)) == (int(anchor[r]), c, (p >> suffixes.BEFORE & 63) - i)
    assert seen == {int(a) + i for a, t in zip(cuts, texts) for i in range(len(t) - length + 1)}


def test_merged_transforms_find_repeated_intervals():
    rng = random.Random(2)
    depth, cores = 5, np.array([rng.randrange(6) for _ in range(80)])
    left = [bytes(rng.choice(b"\x00\xff") for _ in range(rng.randrange(depth))) for _ in cores]
    right = [bytes(rng.choice(b"\x00\xff") for _ in range(rng.randrange(depth - 1 - len(x), depth))) for x in left]
    whole = [(*x, 1000 + c, *y) for x, c, y in zip(left, cores.tolist(), right)]
    firsts = np.arange(80) // 2
    starts = suffixes.earlier_strings(cores, left, right, firsts, depth)
    first = {}
    for i, s in enumerate(whole):
        for o in range(len(s) - depth + 1):
            first.setdefault(s[o : o + depth], firsts[i])
    assert starts.any()
    for i, s in enumerate(whole):
        assert starts[i] == sum(1 << o for o in range(len(s) - depth + 1) if first[s[o : o + depth]] < firsts[i])


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert spans.without_repeats(no_docs).count() == 0
    assert suffixes.without_earlier_strings(no_docs).count() == 0
