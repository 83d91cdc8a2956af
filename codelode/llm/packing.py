"""Best-fit packing of documents into sequences of at most `capacity` tokens, by linear grouping.

Plan: pieces shorter than the capacity are counted by length, which is all that a plan needs (at most `capacity` numbers
reach the driver). Lengths above `small` go, in groups of equal cardinality, up to the longest length of their group; the
few rounded sizes give a configuration program, solved by column generation. Real lengths then take the places of the
rounded ones, and the small lengths go where they fit best. A plan is a list of runs: "the pieces of length L with ranks
a to b go to the sequences from s on, at offset o"; its size depends on the capacity alone, not on the corpus.

Run: a piece gets its rank among those of its length from a count per task (no global sort), and its place by binary search.

Empty and null texts are documents of the end token alone. Repeated rows, also of one doc_id, are packed one by one; a null
doc_id stays null. Documents of a length are interchangeable, so ties need no rule. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import parts_of
from .common import stored
from .pretokens import chunk_ids, encode

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """A row per piece, with its place (task, nth) among those of its length. All pieces but the first have `capacity` ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, task, seen = chunk_ids(tokenizer_path), TaskContext.get().partitionId(), defaultdict(int)
        for batch in (part for whole in batches for part in parts_of(whole)):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = encode(text.as_py(), known) + end
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b]), task, seen[b - a]))
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), OUT.types)] if rows else [pa.array([], t) for t in OUT.types], schema=OUT)

    OUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Configurations of a few sizes and how often to use each, rounded down: column generation on the linear program that covers `demand`."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(sizes.min()), capacity + 1):
            fits = sizes <= room
            values = np.where(fits, best[np.maximum(room - sizes, 0)] + price, -1.0)
            j = int(values.argmax())
            if values[j] > best[room - 1]:
                best[room], last[room] = values[j], j
            else:
                best[room], last[room] = best[room - 1], -1
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        while room > 0:
            if last[room] < 0:
                room -= 1
            else:
                column[last[room]] += 1
                room -= sizes[last[room]]
        amount, step = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    amount = np.linalg.solve(basis, demand.astype(float))
    return [(basis[:, j].astype(int), int(np.floor(amount[j] + 1e-6))) for j in range(k) if amount[j] + 1e-6 >= 1]


class Bins:
    """Kinds of bins that hold the same lengths, with how many there are of each; kinds that have the same room are kept together."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room = capacity, defaultdict(list)

    def add(self, lengths: tuple[int, ...], count: int) -> None:
        if count:
            self.by_room[self.capacity - sum(lengths)].append((lengths, count))

    def best_fit(self, length: int, count: int) -> None:
        """Puts `count` pieces of a length into the fullest bins that take them; as many into each as it takes, as one by one would."""
        while count:
            room = min((r for r, kinds in self.by_room.items() if kinds and r >= length), default=None)
            lengths, there = self.by_room[room].pop() if room is not None else ((), count)
            each = (self.capacity - sum(lengths)) // length
            filled = min(there, count // each)
            self.add(lengths + (length,) * each, filled)
            count -= filled * each
            if filled < there and count:
                self.add(lengths + (length,) * count, 1)
                filled, count = filled + 1, 0
            if lengths:
                self.add(lengths, there - filled)


def plan(histogram: dict[int, int], capacity: int, groups: int, small: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset) that place every piece of the histogram."""
    bins = Bins(capacity)
    bins.add((capacity,), histogram.get(capacity, 0))
    large = sorted((n for n in histogram if small < n < capacity), reverse=True)
    left = {n: histogram[n] for n in large}
    if large:
        # Equal cardinality: a length belongs to the group in which the middle of its run of pieces falls.
        counts = np.array([histogram[n] for n in large])
        middle = (np.cumsum(counts) - counts / 2) / counts.sum()
        group = np.unique(np.minimum((middle * groups).astype(int), groups - 1), return_inverse=True)[1]
        members = [[n for n, g in zip(large, group) if g == j] for j in range(group.max() + 1)]
        sizes, demand = np.array([m[0] for m in members]), np.array([sum(histogram[n] for n in m) for m in members])

        def take(g: int, most: int) -> tuple[int, int]:
            """The longest length left in a group, and how many of up to `most`."""
            n = next((n for n in members[g] if left[n]), 0)
            return n, min(most, left.get(n, 0))

        for column, uses in configurations(sizes, demand, capacity):
            places = [g for g in range(len(sizes)) for _ in range(column[g])]
            kinds: list[tuple[tuple[int, ...], int]] = [((), uses)]
            for g in places[: max(1, len(places) - 1)]:  # real pieces of the groups, longest first; the last place is left to best fit, which knows the real room
                new = []
                for lengths, number in kinds:
                    while number:
                        n, some = take(g, number)
                        if not some:
                            new.append((lengths, number))
                            break
                        left[n] -= some
                        number -= some
                        new.append(((*lengths, n), some))
                kinds = sorted(new, key=lambda x: sum(x[0]))  # long pieces meet the bins that hold least
            for lengths, number in kinds:
                if lengths:
                    bins.add(lengths, number)
    for n in large:
        bins.best_fit(n, left[n])
    for n in sorted((n for n in histogram if 0 < n <= small), reverse=True):
        bins.best_fit(n, histogram[n])
    runs, used, sequence = [], defaultdict(int), 0
    for kinds in bins.by_room.values():
        for lengths, number in kinds:
            offset = 0
            for n in lengths:
                runs.append((n, used[n], number, sequence, offset))
                used[n] += number
                offset += n
            sequence += number
    return runs


def place(pieces: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a length and a rank among those of their length."""
    by_length = defaultdict(list)
    for n, *run in sorted(runs):
        by_length[n].append(run)
    tables = {n: np.array(r, dtype=np.int64) for n, r in by_length.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at, table = np.flatnonzero(length == n), tables[int(n)]
                k = np.searchsorted(table[:, 0], rank[at], side="right") - 1
                sequence[at], offset[at] = table[k, 2] + rank[at] - table[k, 0], table[k, 3]
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    kept = [f"{x.name} {x.dataType.simpleString()}" for x in pieces.schema if x.name != "rank"]
    return pieces.mapInArrow(run, ", ".join([*kept, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, groups: int = 64, small: int = 448) -> DataFrame:
    """Packs documents (doc_id, text) into few sequences of at most `capacity` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece.
    """
    pieces = stored(cut_documents(docs, tokenizer_path, capacity, end_id))
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return place(ranked, plan(histogram, capacity, groups, small))
