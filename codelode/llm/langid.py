"""Language identification of whole texts, mixed ones included.

Learned: for each language, how often its words hold each character n-gram (1 to 3 characters, word borders included,
dealt into `BUCKETS` numbers per length) and which scripts they are written in. The counts cover all rows given, and their
number is bounded by the buckets, whatever the size of the corpus.

Predicted: the script of a word narrows the candidates, its n-grams give a score per candidate, and Viterbi over the words
with a penalty for each switch labels spans. A text keeps one language throughout if no stretch of it prefers another one
by the penalty (half of it at either end of the text, where a stretch has one switch only); that is tested first, with running sums, and only the other texts go through the word by word search. A text's
language is the one of most letters; its score is their share times the probability of that language among all for the
whole text.

Null texts and texts with no letter are `und` with score 0, and so is everything if nothing was learned. Ties go to the language
that is first in order. Repeated rows and null ids are rows like any other. Other columns are kept, but for
those named lang_pred, score and spans, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import kept, parts_of

WORDS = re.compile(r"[^\W\d_]+")
BUCKETS, LENGTHS = 1 << 15, (1, 2, 3)
#: Bytes of a worker's word cache, about (a word takes some 200 besides its scores), and scores of mixed texts that are searched in step.
CACHE_BYTES, LOCKSTEP = 40 << 20, 2_000_000
#: Cost of a switch, smoothing count, share of a language's words from which a script belongs to it, and the cost of a script that doesn't.
SWITCH, SMOOTHING, SCRIPT_SHARE, STRANGE = 8.0, 0.5, 0.01, 50.0
# First code points of scripts, and of what lies between them ("" is no script of its own).
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, ""), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, ""), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""),
    (0x2C60, "Latin"), (0x2C80, ""), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"),
    (0x3200, "Han"), (0xA000, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, ""), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, ""), (0x20000, "Han"), (0x32000, ""),
]
STARTS = np.array([s for s, _ in SCRIPTS])


class Model(NamedTuple):
    """languages; scores (a row per n-gram bucket), allowed (a row per script range), with a column per language."""

    languages: list[str]
    scores: np.ndarray
    allowed: np.ndarray


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of some words and the position of the word each is of; the script range of each word."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    owner, first = np.repeat(np.arange(len(words)), size), np.cumsum(size) - size + 1
    at, of = [], []
    with np.errstate(over="ignore"):
        for n in LENGTHS:
            h = np.full(max(len(points) - n + 1, 0), n, np.uint64)
            for i in range(n):
                h = (h ^ points[i : len(points) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            inside = owner[: len(h)] == owner[n - 1 :]
            at.append(((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)[inside] + (n - 1) * BUCKETS)
            of.append(owner[: len(h)][inside])
    return np.concatenate(at), np.concatenate(of), np.searchsorted(STARTS, points[first].astype(np.int64), side="right") - 1


def learn(rows: DataFrame) -> Model:
    """Counts over all rows (text, lang) whose lang and text are not null."""
    width = len(LENGTHS) * BUCKETS + len(SCRIPTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            words: dict[str, Counter] = {}
            for text, lang in zip(b["text"], b["lang"].to_pylist()):
                words.setdefault(lang, Counter()).update(WORDS.findall(text.as_py()))
            for lang, counter in words.items():
                lower = Counter()
                for w, n in counter.items():
                    lower[w.lower()] += n
                every = [w for w in lower if any(map(str.isalpha, w))]
                for known in (every[i : i + 20_000] for i in range(0, len(every), 20_000)):
                    at, of, script = grams(known)
                    often = np.array([lower[w] for w in known], dtype=np.int64)
                    sums = total.setdefault(lang, np.zeros(width, np.int64))
                    sums += np.bincount(at, often[of], width).astype(np.int64) + np.bincount(script + width - len(SCRIPTS), often, width).astype(np.int64)
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(sums[at])], names=["lang", "bucket", "n"])

    rows = rows.select("text", F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # buckets x languages at most
    languages = sorted(counted["lang"].unique())
    sums = np.zeros((width, len(languages)))
    sums[counted["bucket"].to_numpy(), np.searchsorted(languages, counted["lang"].to_numpy().astype(str)) if languages else []] = counted["n"]
    scores = []
    for i in range(len(LENGTHS)):
        part = sums[i * BUCKETS : (i + 1) * BUCKETS] + SMOOTHING
        scores.append(np.log(part / part.sum(axis=0)))
    scripts = sums[len(LENGTHS) * BUCKETS :]
    return Model(languages, np.concatenate(scores).astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1))


class WordScores(dict):
    """Word -> its row in `rows`, which has a score per language, and in `letters` (0: a run with no letter)."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.forget()

    def forget(self, least: int = 0) -> None:
        """Empties the cache and makes room for as many words as its bytes allow, for `least` at any rate."""
        self.clear()
        self.most = max(least, CACHE_BYTES // (200 + 4 * len(self.model.languages)))
        self.rows, self.letters = np.empty((self.most, len(self.model.languages)), np.float32), np.empty(self.most, np.int32)

    def learn(self, words: set[str]) -> None:
        """Scores new words together."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > self.most:
            self.forget(len(words))
            new = list(words)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            at, of, script = grams([w.lower() for w in part])
            scored = np.stack([np.bincount(of, c, len(part)) for c in self.model.scores[at].T], axis=1)
            allowed = self.model.allowed[script]
            scored -= STRANGE * (~allowed & allowed.any(axis=1, keepdims=True))
            letters = np.array([sum(map(str.isalpha, w)) for w in part])
            scored[letters == 0] = 0
            at = len(self)
            self.rows[at : at + len(part)], self.letters[at : at + len(part)] = scored, letters
            self.update(zip(part, range(at, at + len(part))))


def one_language(scores: np.ndarray, penalty: float) -> int:
    """The language of the best path if it is sure never to switch, else -1.

    Half a switch's penalty counts for the stretch on either side of it: a stretch in another language has two halves, but at an end of the text one.
    """
    total = np.cumsum(scores, axis=0, dtype=float)
    best = int(total[-1].argmax())
    lead = total - total[:, best : best + 1]
    lowest = np.minimum(np.minimum.accumulate(lead, axis=0), 0)
    inner, head, tail = (lead[1:] - lowest[:-1]).max(initial=0), lead.max(), (lead[-1] - lowest[:-1].min(axis=0, initial=0)).max()
    return best if max(inner, 2 * head, 2 * tail) < penalty - 1e-6 else -1


def viterbi(texts: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Labels of the best path through each text's scores, each switch costing `penalty`. The texts go in step, the longest first."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    while order:
        longest = len(texts[order[0]])
        many = max(1, LOCKSTEP // (longest * texts[order[0]].shape[1]))
        group, order = order[:many], order[many:]
        size = np.array([len(texts[i]) for i in group])
        going = np.searchsorted(-size, -np.arange(longest), side="left")  # texts of more than t words
        languages = texts[group[0]].shape[1]
        scores, back = np.zeros((longest, len(group), languages), np.float32), np.zeros((longest, len(group), languages), np.min_scalar_type(languages))
        for j, i in enumerate(group):
            scores[: size[j], j] = texts[i]
        value, own, rows = scores[0].astype(float), np.arange(languages), np.arange(len(group))
        for t in range(1, longest):
            n = going[t]
            v = value[:n]
            top = v.argmax(axis=1)
            most = v[rows[:n], top] - penalty
            switch = most[:, None] > v
            back[t, :n] = np.where(switch, top[:, None], own)
            value[:n] = np.where(switch, most[:, None], v) + scores[t, :n]
        label = np.zeros((longest, len(group)), np.int64)
        now = value.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            n = going[t]
            label[t, :n] = now[:n]
            now[:n] = back[t, rows[:n], now[:n]]
        for j, i in enumerate(group):
            out[i] = label[: size[j], j]
    return out


def label_texts(texts: list[str | None], known: WordScores, penalty: float = SWITCH) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, score, and spans (start, end, language; in characters) of each text."""
    languages = known.model.languages
    words = [WORDS.findall(t) if t and languages else [] for t in texts]
    known.learn(set().union(*words))
    scores, letters, labels = [], [], []
    for w in words:
        at = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
        scores.append(known.rows[at])
        letters.append(known.letters[at])
        labels.append(one_language(scores[-1], penalty) if letters[-1].any() else None)
    mixed = [i for i, label in enumerate(labels) if label == -1]
    paths = dict(zip(mixed, viterbi([scores[i] for i in mixed], penalty)))
    out = []
    for i, (text, label) in enumerate(zip(texts, labels)):
        if label is None:
            out.append(("und", 0.0, []))
            continue
        best, share, spans = label, 1.0, [(0, len(text), languages[label])]
        if i in paths:
            path = paths[i]
            share_of = np.bincount(path, letters[i], len(languages))
            best, share = int(share_of.argmax()), float(share_of.max() / share_of.sum())
            cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist()]
            if len(cuts) > 1:
                starts = [m.start() for m in WORDS.finditer(text)]
                borders = [0, *(starts[c] for c in cuts[1:]), len(text)]
                spans = [(a, b, languages[path[c]]) for a, b, c in zip(borders, borders[1:], cuts)]
            else:
                spans = [(0, len(text), languages[int(path[0])])]
        total = scores[i].sum(axis=0, dtype=float)
        out.append((languages[best], share / float(np.exp(np.minimum(total - total[best], 700)).sum()), spans))
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs (text, ...) and lang_pred, score, spans."""
    from pyspark.sql import types as T

    docs = docs.drop("lang_pred", "score", "spans")
    names = docs.columns
    spark_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_scores(spark_model)
        for b in batches:
            for part in parts_of(b, rows=512):
                texts = part["text"].to_pylist()
                found = label_texts(texts, known)
                spans = pa.array([[dict(zip(("start", "end", "lang"), s)) for s in f[2]] for f in found], SPANS)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f[0] for f in found]), pa.array([f[1] for f in found]), spans], names=[*names, "lang_pred", "score", "spans"])

    SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def word_scores(model) -> WordScores:
    """The cache of this worker for a broadcast model."""
    return kept(("words", model), lambda: WordScores(model.value))
