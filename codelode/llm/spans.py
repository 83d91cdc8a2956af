"""Substring deduplication by sliding sentence spans.

Every run of `run` consecutive sentences is hashed (128 bits; case and surrounding white space don't count). Runs that occur more
than once are joined over the whole corpus, and the sentences of every occurrence but the first, in the order of doc_id
and position, are removed. Runs of fewer than `min_words` words don't count: short sentences meet by chance.

A sentence ends after a full stop, question or exclamation mark with white space after it, or at a line end; the white space
after it belongs to it, so the sentences of a text make up the text. Counts are pre-aggregated and the join is by hash, so a
passage that a third of all documents share is a skewed join, which adaptive execution splits, and no group is gathered.

With `longest`, sentences also end at the marks of other scripts, and those of more words are cut where the words themselves say
so: before a pair of words whose hash is the least of its surroundings, else every `longest` words. Pieces of a passage are then the
same whatever stands round it. A run that holds such a piece takes as many units as make up twice min_words, as
fewer words meet by chance inside a sentence. In scripts without spaces, a character is a word.

Null text has no sentences, stays null, and loses nothing; nor does an empty text. A doc_id names a document: rows that repeat it count
as one document and keep its first occurrences. Rows without doc_id are kept as they are and aren't compared. Other columns are
kept, but for those named n_sentences and n_removed, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import parts_of
from .common import stored, unused

SENTENCE_END = re.compile(r"(?:[.!?]\s|\n)\s*")
#: Letters of scripts that are written without spaces: Thai to Lao, Myanmar, Khmer, kana, Han.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: Ends of sentences in other scripts too: full-width marks need no white space after them.
ANY_END = re.compile(r"(?:[.!?\u0589\u061f\u06d4\u0964\u0965\u104b\u1362\u17d4]\s|[\u3002\uff01\uff1f\uff61]|\n)\s*")
UNIT_WORD = re.compile(f"[{UNSPACED}]|[^\\s{UNSPACED}]+")
#: Where these scripts begin and end, in turn, and white space.
RANGES = np.array([ord(c) + i for a, b in re.findall("(.)-(.)", UNSPACED) for i, c in enumerate((a, b))])
UNSPACED_FROM, SPACE = int(RANGES[0]), np.array([chr(i).isspace() for i in range(0x3002)])
REACH = 4
#: Characters of texts that are cut together.
TOGETHER = 1 << 16
FOUND = "doc_id long, at int, hash binary"


def sentences(text: str | None) -> list[str]:
    """The sentences of a text, with the white space after them."""
    return split_at(text, SENTENCE_END)


def split_at(text: str | None, end: re.Pattern[str]) -> list[str]:
    if not text:
        return []
    cuts = [0, *(m.end() for m in end.finditer(text) if m.end() < len(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def word_places(text: str, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start, and a number for each (case doesn't count). Words end where sentences do."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    small = text.lower()
    if len(small) != len(text):
        small = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    space = SPACE[np.minimum(points, len(SPACE) - 1)]
    begins = ~space & np.r_[True, space[:-1]]
    if points.max() >= UNSPACED_FROM:
        alone = np.searchsorted(RANGES, points, side="right") % 2 == 1
        begins |= ~space & (alone | np.r_[False, alone[:-1]])
    begins[cuts] |= ~space[cuts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    own = np.frombuffer(small.encode("utf-32-le", "surrogatepass"), "<u4")[starts[0] :].astype(np.uint64)
    nth = (np.arange(starts[0], len(points)) - np.repeat(starts, np.diff(np.r_[starts, len(points)]))).astype(np.uint64)
    own = (own + nth * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    own ^= own >> np.uint64(31)
    own[space[starts[0] :]] = 0
    return starts, np.add.reduceat(own, starts - starts[0])


def piece_starts(numbers: np.ndarray, first: np.ndarray, longest: int) -> np.ndarray:
    """Numbers of the words that start a piece inside a sentence; `first`: the first word of each sentence."""
    size = np.diff(np.r_[first, len(numbers)])
    sentence = np.repeat(np.arange(len(first)), size)
    nth = np.arange(len(numbers)) - first[sentence]
    before = np.where(nth == 0, numbers, np.r_[numbers[:1], numbers[:-1]])
    pair = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (numbers * np.uint64(0xD6E8FEB86659FD93))
    pair = (pair ^ (pair >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(1)
    n = len(pair)
    least = (nth >= REACH) & (nth < size[sentence] - REACH) & (size[sentence] > longest)
    for step in range(1, min(REACH, n) + 1):  # there may be fewer words
        least[step:] &= pair[step:] < pair[: n - step]
        least[: n - step] &= pair[: n - step] <= pair[step:]
    starts = np.unique(np.r_[first[size > 0], np.flatnonzero(least)])
    pieces = -(-np.diff(np.r_[starts, n]) // longest)
    each = np.repeat(starts, pieces) + longest * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return np.setdiff1d(each, first, assume_unique=False)


def units(text: str | None, longest: int | None) -> tuple[list[str], list[int], list[bool]]:
    """Sentences, or their pieces; the words of each; and whether it is a piece."""
    return next(units_of([text], longest))


def units_of(texts: list[str | None], longest: int | None) -> Iterator[tuple[list[str], list[int], list[bool]]]:
    """The units of each text; short texts are looked at together."""
    if longest is None:
        for text in texts:
            parts = sentences(text)
            yield parts, [len(s.split()) for s in parts], [False] * len(parts)
        return
    together, size = [], 0
    for i, text in enumerate(texts):
        together.append(text or "")
        size += len(together[-1])
        if size >= TOGETHER or i == len(texts) - 1:
            yield from pieces_of(together, longest)
            together, size = [], 0


def pieces_of(texts: list[str], longest: int) -> Iterator[tuple[list[str], list[int], list[bool]]]:
    """The units of several texts, their sentences cut into pieces of `longest` words at most."""
    text, begin = "".join(texts), [0, *accumulate(map(len, texts))]
    ends = [[b, *(b + m.end() for m in ANY_END.finditer(t) if m.end() < len(t))] if t else [] for b, t in zip(begin, texts)]
    cuts = np.array(list(chain.from_iterable(ends)), np.int64)
    starts, numbers = word_places(text, cuts) if text else (cuts, cuts)
    first = np.searchsorted(starts, cuts)
    inner = piece_starts(numbers, first, longest) if len(starts) else starts
    sentence = np.r_[np.arange(len(cuts)), np.searchsorted(cuts, starts[inner], side="right") - 1]
    at, words = np.r_[cuts, starts[inner]], np.r_[first, inner]
    order = np.argsort(at, kind="stable")
    at, piece = at[order], (np.bincount(sentence, minlength=len(cuts))[sentence[order]] > 1).tolist()
    n, borders = np.diff(np.r_[words[order], len(starts)]).tolist(), np.searchsorted(at, begin).tolist()
    at = [*at.tolist(), len(text)]
    parts = [text[a:b] for a, b in zip(at, at[1:])]
    for a, b in zip(borders, borders[1:]):
        yield parts[a:b], n[a:b], piece[a:b]


def runs_of(n: list[int], piece: list[bool], run: int, min_words: int) -> list[tuple[int, int]]:
    """First unit and number of units of every run."""
    out, upto, pieces = [], [0, *accumulate(n)], [0, *accumulate(piece)]
    for i in range(len(n) - run + 1):
        j = i + run
        while j <= len(n) and pieces[j] > pieces[i] and upto[j] - upto[i] < 2 * min_words:
            j += 1
        if j <= len(n) and upto[j] - upto[i] >= min_words:
            out.append((i, j - i))
    return out


def hashed_runs(parts: list[str], n: list[int], piece: list[bool], run: int, min_words: int) -> list[tuple[int, bytes]]:
    """Position and hash of every run of units with enough words."""
    from xxhash import xxh128_digest

    plain = [s.strip().lower() for s in parts]
    return [(i, xxh128_digest("\n".join(plain[i : i + k]).encode("utf-8", "surrogatepass"))) for i, k in runs_of(n, piece, run, min_words)]


def without_repeats(docs: DataFrame, run: int = 2, min_words: int = 8, longest: int | None = None) -> DataFrame:
    """All columns of docs (doc_id, text, ...), text without its repeated sentences, and n_sentences and n_removed (long).

    With `longest`, units of at most so many words take the place of sentences, in these numbers too.
    """
    docs = docs.drop("n_sentences", "n_removed")
    names, key, starts_of = docs.columns, unused(docs, "_id"), unused(docs, "_gone")

    def hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in parts_of(whole)):
            runs = [hashed_runs(*found, run, min_words) for found in units_of(b["text"].to_pylist(), longest)]
            ids = np.repeat(b["doc_id"].to_numpy(), [len(r) for r in runs])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([i for r in runs for i, _ in r], pa.int32()), pa.array([h for r in runs for _, h in r], pa.binary())], names=["doc_id", "at", "hash"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    found = stored(named.mapInArrow(hash_runs, FOUND))
    repeated = found.groupBy("hash").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = found.join(repeated, "hash").filter(F.struct("doc_id", "at") > F.col("first"))
    gone = later.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("at").alias(starts_of))  # a number per sentence of a document at most

    def drop_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in parts_of(whole)):
            texts, n, removed = [], [], []
            whole = b["text"].to_pylist()
            for text, starts, (parts, words, piece) in zip(whole, b[starts_of].to_pylist(), units_of(whole, longest)):
                size = dict(runs_of(words, piece, run, min_words)) if starts else {}
                out = {i + j for i in starts or () for j in range(size.get(i, 0))}
                texts.append("".join(s for i, s in enumerate(parts) if i not in out) if out else text)
                n.append(len(parts))
                removed.append(len(out))
            columns = [pa.array(texts, pa.string()) if c == "text" else b[c] for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_sentences", "n_removed"])

    out = T.StructType([*docs.schema.fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])
    return docs.withColumn(key, F.col("doc_id").cast("long")).join(gone, key, "left").drop(key).mapInArrow(drop_runs, out)
