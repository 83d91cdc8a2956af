"""Collocations: phrases whose words meet more often than their parts would by chance, mined per language.

1. Sketch. Every task hashes the phrases of its texts into two rows of counters that stop at the least frequency; blocks of counters are
   summed where they meet. A counter that stays below bounds all phrases that fall on it. Single words and pairs come first; longer
   phrases are hashed only where all their pairs are still possible.
2. Candidates. The longest phrases that no counter rules out are gathered without repeats, and all their parts with them. None that
   reaches the least frequency can be missing.
3. Automata. Candidates, dealt by a hash into batches of bounded size, are compiled into Aho-Corasick automata, one per language
   and batch. Words are guarded by blanks, and pieces of a text kept apart by a line feed, so matches are whole words
   of one piece; all matches, overlapping ones too, are counted in every shard of the texts, and summed.
4. Thresholds, cuts and containment are joins on exact counts.

The sketch has a counter per `BYTES_A_CELL` bytes of text, `MOST_CELLS` at most, so that its filter is a bounded broadcast; above that it
lets more candidates through and the counts of the third step stay exact. A batch of candidates is bounded by `BATCH` phrases on average.

Null and empty texts hold no words, a null lang counts as `und`. Repeated rows count repeatedly; ties are ordered by phrase. A long
text is one part of a batch, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import kept, parts_of
from .common import stored

LEAST, MOST_WORDS, TOP = 100, 5, 2_000
BYTES_A_CELL, FEWEST_CELLS, MOST_CELLS = 64, 1 << 16, 1 << 26
#: Counters of a block; insertions between two looks at counters that are full; phrases that a task remembers.
BLOCK, STEP, REMEMBERED = 4_096, 50_000, 100_000
#: Candidates of a batch, on average.
BATCH = 150_000
#: Bytes of text of a task, where there are tasks enough: what it hands on (counters, candidates, counts) hardly grows with what it reads.
TASK_BYTES = 1 << 30
#: Upper-case letters to lower-case ones, marks that end a piece to line feeds, tabs to blanks.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
BLANKS, PIECE = re.compile(rb"  +"), re.compile(rb" ?\n[ \n]*")
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def plain(texts: list[str]) -> bytes:
    """Texts as words between single blanks; pieces are kept apart by a line feed in the place of a word."""
    data = BLANKS.sub(b" ", "\n".join(texts).encode("utf-8", "surrogatepass").translate(PLAIN))
    return b" " + PIECE.sub(b" \n ", data).strip(b" ") + b" "


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD[1]
    x = (x ^ (x >> np.uint64(27))) * ODD[2]
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of plain text: where they start and end, and a number for each; 0 is the end of a piece."""

    def __init__(self, data: bytes, seed: int):
        self.data, points = data, np.frombuffer(data, np.uint8)
        blanks = np.flatnonzero(points == 32)
        full = np.flatnonzero(np.diff(blanks) > 1)
        self.starts, self.ends = blanks[full] + 1, blanks[full + 1]
        if not len(full):
            self.numbers, self.ok = np.zeros(0, np.uint64), np.zeros(0, bool)
            return
        within = points[self.starts[0] : self.ends[-1]].astype(np.uint64)
        nth = np.arange(len(within), dtype=np.uint64) - np.repeat((self.starts - self.starts[0]).astype(np.uint64), np.diff(np.r_[self.starts, self.ends[-1]]))
        own = (within + nth * ODD[0]) * ODD[3]
        own ^= own >> np.uint64(29)
        own *= ODD[1]
        own[within == 32] = 0
        self.numbers = mixed(np.add.reduceat(own, self.starts - self.starts[0]) + np.uint64(seed))
        self.ok = points[self.starts] != 10

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the first words of all phrases of k words, and a hash of each."""
        n = len(self.numbers) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ok, h = self.ok[:n].copy(), self.numbers[:n] + np.uint64(k)
        for i in range(1, k):
            ok &= self.ok[i : i + n]
            h = mixed(h * ODD[0] + self.numbers[i : i + n])
        at = np.flatnonzero(ok)
        return at, h[at]


def seed_of(lang: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Plain text of each language, in bounded parts."""
    for b in (part for whole in batches for part in parts_of(whole)):
        texts: dict[str, list[str]] = {}
        for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
            if text:
                texts.setdefault(lang, []).append(text)
        for lang, of in texts.items():
            yield lang, plain(of)


class Sketch:
    """Two rows of counters that stop at `least` (255 at most); an upper bound of a phrase's frequency is the smaller of its two."""

    def __init__(self, cells: int, least: int):
        self.cells, self.least = cells, least
        self.counters = np.zeros(2 * cells, np.uint16)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return places(hashes, self.cells)

    def add(self, hashes: np.ndarray) -> None:
        for at in self.places(hashes):
            for a in range(0, len(at), STEP):
                step = at[a : a + STEP]
                np.add.at(self.counters, step, np.uint16(1))
                self.counters[step[self.counters[step] > self.least]] = self.least

    def blocks(self, table: int) -> Iterator[pa.RecordBatch]:
        """Blocks that hold anything: table, block, counters."""
        rows = self.counters.reshape(-1, min(BLOCK, 2 * self.cells))
        used = np.flatnonzero(rows.any(axis=1))
        for a in range(0, len(used), 256):
            some = used[a : a + 256]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), table), pa.int32()), pa.array(some, pa.int32()), pa.array([r.tobytes() for r in rows[some].astype(np.uint8)], pa.binary())], names=["table", "block", "counters"])


def places(hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each hash in either row."""
    mask = np.uint64(cells - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64) + cells


class Possible:
    """For each table of counters, which of them have reached the least frequency."""

    def __init__(self, cells: int, tables: dict[int, np.ndarray]):
        self.cells, self.tables = cells, {t: np.unpackbits(bits).view(bool) for t, bits in tables.items()}

    def of(self, table: int, hashes: np.ndarray) -> np.ndarray:
        first, second = places(hashes, self.cells)
        return self.tables[table][first] & self.tables[table][second]

    def phrases(self, words: Words, upto: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By number of words: first words and hashes of phrases that are still possible by the tables there are. Those of three or more
        are held against single words and pairs, then against their own table."""
        out = {}
        good: np.ndarray | None = None
        for k in range(1, upto + 1):
            at, h = words.phrases(k)
            if k > 1:
                shorter = good[at] & good[at + 1]  # both phrases of k - 1 words
                at, h = at[shorter], h[shorter]
            table = min(k, 3) - 1
            if table in self.tables:
                fine = self.of(table, h)
                at, h = at[fine], h[fine]
            out[k] = at, h
            good = np.zeros(len(words.numbers) + 1, bool)
            good[at] = True
        return out


def sketched(texts: DataFrame, cells: int, least: int, most_words: int, known: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Packed bits of counters that reach `least`: of words and pairs (tables 0 and 1), or, where those are known, of longer phrases (table 2)."""
    told = texts.sparkSession.sparkContext.broadcast(known)
    tables = (2,) if known else (0, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = {t: Sketch(cells, least) for t in tables}
        possible = Possible(cells, told.value)
        for lang, data in by_language(batches):
            words = Words(data, seed_of(lang))
            if known:
                for k, (_, h) in possible.phrases(words, most_words).items():
                    if k > 2:
                        sketches[2].add(h)
            else:
                for t in tables:
                    sketches[t].add(words.phrases(t + 1)[1])
        for t, sketch in sketches.items():
            yield from sketch.blocks(t)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for t, block, counters in zip(b["table"].to_pylist(), b["block"].to_pylist(), b["counters"]):
                more = np.frombuffer(counters.as_buffer(), np.uint8).astype(np.uint16)
                sums[t, block] = np.minimum(sums[t, block] + more, least).astype(np.uint16) if (t, block) in sums else more
        for (t, block), counters in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([block], pa.int32()), pa.array([np.packbits(counters >= least).tobytes()], pa.binary())], names=["table", "block", "bits"])

    parts = texts.mapInArrow(run, "table int, block int, counters binary").repartition("table", "block")
    full = stored(parts.mapInArrow(total, "table int, block int, bits binary")).filter(F.col("bits").cast("binary") != F.lit(bytes(min(BLOCK, 2 * cells) // 8)))
    out = {t: np.zeros(2 * cells // 8, np.uint8) for t in tables}
    size = min(BLOCK, 2 * cells) // 8
    for r in full.collect():  # a bit per counter at most
        out[r["table"]][r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return known | out


def possible_phrases(texts: DataFrame, cells: int, most_words: int, known: dict[int, np.ndarray]) -> DataFrame:
    """lang, phrase: of what no counter rules out, the longest phrase of two words or more at each place, once per task and sometimes more;
    and rows without phrase that count the words (n)."""
    told = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        possible, counts, found = Possible(cells, told.value), Counter(), set()
        seen = np.zeros(1 << 20, np.uint64)

        def rows(langs: list[str], phrases: list[bytes | None], n: list[int | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])

        for lang, data in by_language(batches):
            words = Words(data, seed_of(lang))
            counts[lang] += int(words.ok.sum())
            part_of_longer = np.zeros(len(words.numbers), bool)
            for k, (at, h) in reversed(possible.phrases(words, most_words).items()):
                longest = ~part_of_longer[at]
                part_of_longer[at] = True
                if k > 1:
                    at, h = at[longest], h[longest]
                    slot = (h & np.uint64(len(seen) - 1)).astype(np.int64)
                    new = seen[slot] != h  # a phrase that was seen last in its place is left out
                    seen[slot[new]] = h[new]
                    at = at[new]
                    found.update((lang, data[a:b]) for a, b in zip(words.starts[at].tolist(), words.ends[at + k - 1].tolist()))
            if len(found) >= REMEMBERED:
                yield rows([x for x, _ in found], [x for _, x in found], [None] * len(found))
                found.clear()
        yield rows([*(x for x, _ in found), *counts], [*(x for _, x in found), *[None] * len(counts)], [*[None] * len(found), *counts.values()])

    return stored(texts.mapInArrow(run, "lang string, phrase string, n long"))


def with_parts(phrases: DataFrame) -> DataFrame:
    """lang, phrase of all phrases and of the shorter ones and single words inside them, without repeats."""
    words = F.split("phrase", " ")
    inside = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.size(words) - i + 1), lambda k: F.array_join(F.slice(words, i, k), " ")))
    return phrases.select("lang", "phrase").distinct().select("lang", F.explode(F.flatten(inside)).alias("phrase")).distinct()


def counted(texts: DataFrame, candidates: DataFrame, least: int) -> DataFrame:
    """lang, phrase, f: the exact number of occurrences of the candidates (lang, phrase) with `least` or more."""
    spark = texts.sparkSession
    batches = max(1, -(-candidates.count() // BATCH))
    dealt = candidates.withColumn("batch", F.pmod(F.xxhash64("lang", "phrase"), F.lit(batches)).cast("int"))
    numbered = stored(dealt.withColumn("id", F.row_number().over(Window.partitionBy("batch").orderBy("lang", "phrase")) - 1))
    out = []
    for batch in range(batches):
        mine = numbered.filter(F.col("batch") == batch)
        patterns: dict[str, list[tuple[str, int]]] = {}
        for r in mine.select("lang", "phrase", "id").orderBy("id").toLocalIterator():  # a batch is bounded
            patterns.setdefault(r.lang, []).append((r.phrase, r.id))
        told = spark.sparkContext.broadcast(patterns)

        def run(rows: Iterator[pa.RecordBatch], told=told, batch=batch) -> Iterator[pa.RecordBatch]:
            automata = kept(("automata", told), lambda: {lang: automaton(of) for lang, of in told.value.items()})
            total: Counter[int] = Counter()
            for lang, data in by_language(rows):
                if lang in automata:
                    total.update(map(itemgetter(1), automata[lang].iter(data.decode("utf-8", "surrogatepass"))))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), batch), pa.int32()), pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["batch", "id", "f"])

        out.append(stored(texts.mapInArrow(run, "batch int, id int, f long").groupBy("batch", "id").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)))
        told.unpersist()
    return reduce(DataFrame.unionByName, out).join(numbered, ["batch", "id"]).select("lang", "phrase", "f")


def automaton(phrases: list[tuple[str, int]]):
    """An automaton that finds phrases between blanks, with their numbers."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for phrase, i in phrases:
        found.add_word(f" {phrase} ", i)
    found.make_automaton()
    return found


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a (its frequency), l and r (those of its parts), n (words of the language), score of the first `top` phrases of each language.

    Phrases have 2 to `most_words` words and occur `least` times or more within pieces. The score of a cut is floor(1000 a n / (l r)), that of
    a phrase the lowest of its cuts; phrases inside a longer one that is as frequent go.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text <> ''")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = texts.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES))
    cells = min(MOST_CELLS, max(FEWEST_CELLS, 1 << (size // BYTES_A_CELL).bit_length()))
    full = min(least, 255)  # a counter is a byte
    known = sketched(texts, cells, full, most_words, {})
    if most_words > 2:
        known = sketched(texts, cells, full, most_words, known)
    found = possible_phrases(texts, cells, most_words, known)
    n = found.filter("phrase is null").groupBy("lang").agg(F.sum("n").alias("n"))
    f = stored(counted(texts, stored(with_parts(found.filter("phrase is not null"))), least).withColumn("k", F.size(F.split("phrase", " "))))
    return ranked(scored(f, n), top)


def scored(f: DataFrame, n: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of phrases that aren't inside a longer one as frequent. f: lang, phrase, f, k (words); n: lang, n."""
    words = F.split("phrase", " ")
    phrases = f.filter("k > 1")
    longer = f.filter("k > 2").withColumn("phrase", F.explode(F.array(F.array_join(F.slice(words, 1, F.col("k") - 1), " "), F.array_join(F.slice(words, 2, F.col("k") - 1), " "))))
    covered = longer.groupBy("lang", "phrase").agg(F.max("f").alias("covered"))  # one more word suffices: frequencies fall with each word
    alone = phrases.join(covered, ["lang", "phrase"], "left").filter("covered is null or covered < f").drop("covered")
    cuts = alone.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "cut", F.array_join(F.slice(words, 1, F.col("cut")), " ").alias("_first"), F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("_rest"))
    of = lambda name, count: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(of("_first", "l"), ["lang", "_first"]).join(of("_rest", "r"), ["lang", "_rest"]).join(n, "lang")
    whole = "cast({} as decimal(17, 0))"
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {whole.format('a')} * {whole.format('n')}) div ({whole.format('l')} * {whole.format('r')})")
    least = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return least.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def ranked(phrases: DataFrame, top: int) -> DataFrame:
    """The first phrases of each language; Spark keeps no more than `top` of a task before they meet."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = phrases.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
