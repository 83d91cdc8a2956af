"""Collocations against a plain version of their contract, with sketches of any size."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codelode.llm import collocations as c

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least, most_words=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in ((("und" if x is None else x), t) for x, t in rows):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, of in f.items():
        candidates = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        inside = {p[i : i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * candidates[p[i : i + k]]}
        found = []
        for p, a in candidates.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(found)[:top])]
    return out


def got(df):
    return [tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]


ODD = [("x", "A b. a B a b a b\tA  b"), ("x", "a b\x0bc a b \x0c\r\n a b"), (None, "é ü é ü é ü"), (None, "é ü é  ü"), ("und", "é ü"), ("", "q q q q q q"), ("x", None), ("x", ""), ("x", ".,;"), ("𝄞", "ünï 𝄞 ünï 𝄞 ünï 𝄞\x00 ")]


@pytest.fixture(scope="module")
def texts(rows):
    return [(r[2], r[1]) for r in rows] + ODD * 2


@pytest.fixture(scope="module")
def given(spark, docs, texts):
    odd = spark.createDataFrame(ODD * 2, "lang string, text string")
    return docs.unionByName(odd, allowMissingColumns=True).withColumns({x: F.lit(1) for x in ("f", "n", "k", "phrase", "rank")})


@pytest.mark.parametrize("cells, batch", [(1 << 16, 100_000), (1 << 4, 40)])
def test_against_plain_version(given, texts, monkeypatch, cells, batch):
    """A sketch that is too small lets everything through, and changes no row; nor do several batches."""
    monkeypatch.setattr(c, "FEWEST_CELLS", cells)
    monkeypatch.setattr(c, "MOST_CELLS", cells)
    monkeypatch.setattr(c, "BATCH", batch if cells > 1 << 10 else 4_000)
    for least in (4, 30):
        assert Counter(got(c.collocations(given, least=least))) == Counter(expected(texts, least))


def test_other_limits(given, texts):
    assert Counter(got(c.collocations(given, least=3, most_words=2, top=7))) == Counter(expected(texts, 3, 2, 7))
    assert Counter(got(c.collocations(given, least=300, most_words=3))) == Counter(expected(texts, 300, 3))


def test_sketch_bounds_from_above():
    words = c.Words(c.plain(["a b a b c. a b"] * 40), 7)
    sketch = c.Sketch(1 << 8, 100)
    for k in (1, 2, 3):
        sketch.add(words.phrases(k)[1])
    full = sketch.counters >= 100
    possible = c.Possible(1 << 8, {0: c.np.packbits(full), 1: c.np.packbits(full)})
    _, h = words.phrases(2)
    kinds, n = c.np.unique(h, return_counts=True)
    assert sketch.counters.max() == 100 and all(possible.of(0, kinds[n >= 100]))


def test_words_are_those_of_the_text():
    text = "  The END.\tOf it,, all \n\n x  \x0b?! y "
    data = c.plain([text, "", "Z"])
    words = c.Words(data, 0)
    assert [data[a:b].decode() for a, b, ok in zip(words.starts, words.ends, words.ok) if ok] == ["the", "end", "of", "it", "all", "x", "y", "z"]
    assert [list(words.starts[words.phrases(2)[0]]), len(words.phrases(3)[0])] == [[data.index(b"the"), data.index(b"of")], 0]


def test_exact_beyond_64_bits(spark):
    f = spark.createDataFrame([("x", "a b", 9 * 10**9, 2), ("x", "a", 9 * 10**9 + 1, 1), ("x", "b", 10**10 + 7, 1)], "lang string, phrase string, f long, k int")
    row = c.scored(f, spark.createDataFrame([("x", 3 * 10**13)], "lang string, n long")).first()
    assert row.score == 1000 * 9 * 10**9 * 3 * 10**13 // ((9 * 10**9 + 1) * (10**10 + 7))


def test_long_blanks_and_empty(spark, no_docs):
    assert got(c.collocations(no_docs)) == []
    long = " " * 300_000 + "a b" + "\n" * 300_000 + "a b" + "\t \t" * 100_000
    assert got(c.collocations(spark.createDataFrame([("x", long)], "lang string, text string"), least=2)) == [("x", 1, "a b", 2, 2, 2, 4, 2000)]
