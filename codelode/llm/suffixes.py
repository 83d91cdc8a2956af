"""Suffix-array deduplication: bytes covered by a string of `length` bytes that starts in an earlier document too.

What could repeat. Every string of `length` bytes holds an anchor: the first place of the least hash among its runs of `ANCHOR`
bytes. Neighbouring strings of one anchor make up a run. Equal strings have equal anchors, so only strings whose anchors occur in
two documents or more can repeat; nothing is lost. A run is cut into two pieces, by how far its strings start before the
anchor: then the strings of a piece have a core of more than half their bytes in common, which says what a piece may share
strings with. Equal pieces are one, with its first document: any later document loses all strings of it.

What does repeat. Different pieces of one core meet in one task, in bundles of bounded size, each dealt into shards; the core
is one symbol there. A shard's suffixes are sorted once, which gives its Burrows-Wheeler transform. The shards'
transforms are merged without sorting again: the interleave of the shards starts in any order and is refined by one stable
pass per round over the symbols before each suffix, after which suffixes stand in the order of one symbol more.
Neighbours that part in round k have less than k symbols in common. Intervals of one first document have converged and are kept
out of later rounds; those left after a string's symbols are the repeated intervals, whose first document decides. A core
with more than `CROWD` different pieces doesn't meet in one task: its strings are looked up one by one, by hash, with counts
pre-aggregated.

Texts are judged as UTF-8 bytes; null text is empty. A doc_id names one text: rows that repeat it don't remove each other's
bytes. Rows without doc_id are kept whole and not compared. Texts shorter than `length` lose nothing. Pieces are told apart by
128 bits of hashes, cores by 64. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import parts_of, raw
from .common import stored

ANCHOR = 16
#: Bytes of text worked on together; pieces merged together, and the shards they are dealt into; pieces of a core from which its strings are looked up one by one.
BLOCK, MERGED, SHARDS, CROWD = 1 << 18, 8_192, 2, 4_096
#: A place: start in the text, bytes from there to the anchor, and number of strings less one.
START, BEFORE = 12, 6


def mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash and eight more bytes."""
    h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; a view."""
    return np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,))


def hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place on."""
    w = words_at(data).copy()
    return mixed(w[:-8] * np.uint64(0xD6E8FEB86659FD93), w[8:])


def hashed(words: np.ndarray, start: np.ndarray, size: np.ndarray | int, seed: np.ndarray | int) -> np.ndarray:
    """Hashes of the `size` (eight at least) bytes from each start on."""
    size = np.broadcast_to(np.asarray(size, np.int64), start.shape)
    h = mixed(size.astype(np.uint64), np.broadcast_to(np.asarray(seed, np.uint64), start.shape))
    for at in range(0, int(size.max(initial=8)) - 7, 8):
        some = size >= at + 8
        if some.all():
            h = mixed(h, words[start + at])
        else:
            h[some] = mixed(h[some], words[start[some] + at])
    return mixed(h, words[start + size - 8])


def sliding(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    have = 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def halves(length: int) -> tuple[int, int, int]:
    """Strings start at that many distances before their anchor; of these, the strings of a piece; and the bytes of its core."""
    width = length - ANCHOR + 1
    return width, -(-width // 2), length - -(-width // 2) + 1


def runs_of(data: np.ndarray, cuts: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hash of the anchor, number of the document, and place of all runs in documents put together, block by block."""
    width, last = halves(length)[0], len(data) - length + 1
    low = np.uint64((1 << 20) - 1)
    for a in range(0, last, BLOCK):
        b = min(a + BLOCK, last)
        h = hashes(data[a : b + length - 1])
        # A hash's last bits give way to its place, so that the least one names the first place of the least hash.
        anchor = (sliding((h & ~low) | np.arange(len(h), dtype=np.uint64), width) & low).astype(np.int64)
        ends = cuts[np.searchsorted(cuts, a, side="right") : np.searchsorted(cuts, b + length, side="left")] - a  # strings mustn't cross these
        step = np.zeros(b - a + 1, np.int32)
        np.add.at(step, np.clip(ends - length + 1, 0, b - a), 1)
        np.add.at(step, np.clip(ends, 0, b - a), -1)
        inside = np.cumsum(step[:-1]) == 0
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])])
        n = np.diff(np.r_[first, b - a])[inside[first]]
        first = first[inside[first]]
        doc = np.searchsorted(cuts, first + a, side="right") - 1
        yield h[anchor[first]].view(np.int64), doc, first + a - cuts[doc] << START | anchor[first] - first << BEFORE | n - 1


def pieces_of(words: np.ndarray, start: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of runs: number of the run, start, place, strings, hash of the core and hash of each of their pieces."""
    width, part, core = halves(length)
    before, n = place >> BEFORE & (1 << BEFORE) - 1, (place & (1 << BEFORE) - 1) + 1
    far = np.clip(before - part + 1, 0, n)  # strings that start `part` or more bytes before the anchor come first
    run = np.r_[np.flatnonzero(far), np.flatnonzero(n > far)]
    half = np.repeat([1, 0], [np.count_nonzero(far), np.count_nonzero(n > far)])
    skipped = np.where(half == 1, 0, far[run])
    n = np.where(half == 1, far[run], n[run] - far[run])
    start, before = start[run] + skipped, before[run] - skipped
    place = (place[run] >> START) + skipped << START | before << BEFORE | n - 1
    return run, start, place, n, hashed(words, start + before - half * (width - part), core, half), hashed(words, start, n + length - 1, 7)


def listed(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row numbers and values of the lists of a column."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), size), pc.list_flatten(column)


def located(b: pa.RecordBatch, column: str, length: int, field: str | None = None):
    """Of the places (or structs with a place) listed in a column: words of the text, row, start among all bytes, place and struct, of those that lie in the row's text."""
    data, cuts = raw(b["text"])
    row, values = listed(b[column])
    place = (values if field is None else pc.struct_field(values, field)).to_numpy(zero_copy_only=False)
    start = cuts[row] + (place >> START)
    fit = start + (place & (1 << BEFORE) - 1) + length <= cuts[row + 1]
    return data, cuts, row[fit], start[fit], place[fit], values.filter(pa.array(fit))


def anchors_of(docs: DataFrame, length: int) -> DataFrame:
    """anchor (hash), doc_id, place of all runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["doc_id"].to_numpy()
            for anchor, doc, place in runs_of(*raw(b["text"]), length):
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids[doc]), pa.array(place)], names=["anchor", "doc_id", "place"])

    return docs.mapInArrow(run, "anchor long, doc_id long, place long")


def met_anchors(docs: DataFrame, length: int) -> DataFrame:
    """anchor, a, b (least and greatest doc_id): a row per anchor and batch, so that frequent ones are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["doc_id"].to_numpy()
            for anchor, doc, _ in runs_of(*raw(b["text"]), length):
                order = np.argsort(anchor)
                anchor, doc = anchor[order], ids[doc[order]]
                first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]][: len(anchor)])
                if len(first):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[first]), pa.array(np.minimum.reduceat(doc, first)), pa.array(np.maximum.reduceat(doc, first))], names=["anchor", "a", "b"])

    return docs.mapInArrow(run, "anchor long, a long, b long")


def pieces(placed: DataFrame, length: int) -> DataFrame:
    """core, piece (hashes), doc_id, place of the pieces of documents (doc_id, text, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in parts_of(batch, BLOCK):
                data, _, row, start, place, _ = located(b, "places", length)
                if len(row):
                    of, _, place, _, core, piece = pieces_of(words_at(data), start, place, length)
                    yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(piece.view(np.int64)), b["doc_id"].take(pa.array(row[of])), pa.array(place)], names=["core", "piece", "doc_id", "place"])

    return placed.mapInArrow(run, "core long, piece long, doc_id long, place long")


def edges_of(placed: DataFrame, length: int) -> DataFrame:
    """core, piece, n, doc_id, and the bytes before and after the core, of documents (doc_id, text, wanted: core, piece, n, place)."""
    width, part, core = halves(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in parts_of(batch, BLOCK):
                data, _, row, start, place, wanted = located(b, "wanted", length, "place")
                n, before = (place & (1 << BEFORE) - 1) + 1, place >> BEFORE & (1 << BEFORE) - 1
                same = hashed(words_at(data), start, n + length - 1, 7).view(np.int64) == pc.struct_field(wanted, "piece").to_numpy(zero_copy_only=False) if len(row) else np.zeros(0, bool)  # not of another text of this doc_id
                row, start, n, before, wanted = row[same], start[same], n[same], before[same], wanted.filter(pa.array(same))
                at, end = start + before - (before >= part) * (width - part), start + n + length - 1
                text = data.tobytes()
                left, right = ([text[x:y] for x, y in zip(a.tolist(), z.tolist())] for a, z in ((start, at), (at + core, end)))
                yield pa.RecordBatch.from_arrays([*(pc.struct_field(wanted, c) for c in ("core", "piece", "n")), b["doc_id"].take(pa.array(row)), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["core", "piece", "n", "doc_id", "left", "right"])

    return placed.mapInArrow(run, "core long, piece long, n long, doc_id long, left binary, right binary")


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of strings put together (each ends in 0) by their first `depth` symbols: prefix doubling from four."""
    base, have = int(symbols.max(initial=0)) + 1, 4
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(3, np.int64)])
    key = np.zeros(len(symbols), np.int64)
    for i in range(have):
        key = key * base + padded[i : i + len(symbols)]
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order
        sorted_ = key[order]
        rank = np.empty_like(key)
        rank[order] = np.cumsum(np.r_[0, sorted_[1:] != sorted_[:-1]])
        key = rank * (rank.max() + 1)
        key[:-have] += rank[have:]
        have *= 2


def repeated_intervals(shards: list[np.ndarray], ends: list[np.ndarray], firsts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges the shards' transforms. `ends`: the places `depth` symbols after the start of each string; `firsts`: the document of each.

    Returns, of strings in intervals of several documents: their number among all ends, their interval, and the interval's first document.
    """
    transforms, back, row, at = [], [], [], 0
    for symbols, end in zip(shards, ends):
        order = suffix_array(symbols, depth + 1)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        transforms.append(symbols[order - 1])
        back.append(rank[order - 1] + at)  # where the suffix one symbol longer stands in this shard
        row.append(rank[end] + at)
        at += len(symbols)
    transform, back, row = np.concatenate(transforms), np.concatenate(back), np.concatenate(row)
    number, first = np.arange(len(row)), np.concatenate(firsts)
    part = np.zeros(len(row), np.int32)  # number of the interval of suffixes that have not parted so far
    for round_ in range(depth):
        symbol = transform[row]
        order = np.argsort(symbol, kind="stable")  # one pass: symbols are small numbers
        symbol, old = symbol[order], part[order]
        new = np.r_[True, (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])][: len(order)]
        row, number, first = back[row[order]], number[order], first[order]
        part = np.cumsum(new, dtype=np.int32) - 1
        if round_ % 3 == 2 or round_ == depth - 1:
            begins = np.flatnonzero(new)
            several = (np.minimum.reduceat(first, begins) < np.maximum.reduceat(first, begins))[part] if len(begins) else np.zeros(0, bool)
            row, number, first, part = row[several], number[several], first[several], part[several]
    begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
    size = np.diff(np.r_[begins, len(part)])
    return number, np.repeat(np.arange(len(begins)), size), np.repeat(np.minimum.reduceat(first, begins) if len(begins) else first, size)


def earlier_strings(core: np.ndarray, left: list[bytes], right: list[bytes], first: np.ndarray, depth: int) -> np.ndarray:
    """For each piece, the bit set of its strings (`depth` symbols: bytes before the core, the core, bytes after it) that a piece of a smaller first document holds too."""
    text = b"".join(chain.from_iterable(zip(left, right)))
    size = np.array([list(map(len, left)), list(map(len, right))]).T
    # Symbols: 0 ends a piece, then bytes, then cores. A piece takes two places more than its bytes.
    begin = np.r_[0, np.cumsum(size.sum(axis=1) + 2)]
    at = np.repeat(np.arange(len(left)) * 2, size.sum(axis=1)) + np.arange(len(text)) + np.repeat(np.tile([0, 1], len(left)), size.ravel())
    symbols = np.zeros(begin[-1], np.uint16)
    symbols[at] = np.frombuffer(text, np.uint8).astype(np.uint16) + 1
    symbols[begin[:-1] + size[:, 0]] = np.unique(core, return_inverse=True)[1] + 257
    strings = size.sum(axis=1) + 2 - depth
    piece = np.repeat(np.arange(len(left)), strings)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(strings) - strings, strings)
    shard = np.minimum(np.arange(len(left)) * SHARDS // len(left), SHARDS - 1)
    shards, ends, firsts = [], [], []
    for k in range(int(shard[-1]) + 1):
        own, where = np.flatnonzero(shard == k), shard[piece] == k
        if len(own):
            shards.append(symbols[begin[own[0]] : begin[own[-1] + 1]])
            ends.append((begin[piece] + offset)[where] + depth - begin[own[0]])
            firsts.append(first[piece[where]])
    number, _, least = repeated_intervals(shards, ends, firsts, depth)
    hit = number[least < first[piece[number]]]
    bits = np.zeros(len(left), np.int64)
    np.bitwise_or.at(bits, piece[hit], np.int64(1) << offset[hit])
    return bits


def merged(edges: DataFrame, depth: int) -> DataFrame:
    """doc_id, piece, starts (bit set) of pieces (core, piece, doc_id, left, right), those of one core together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in chain(batches, (None,)):
            if b is not None:
                held = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            while held is not None and held.num_rows and (b is None or held.num_rows >= MERGED):
                h = held["core"].to_numpy()
                borders = np.r_[np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)] if b is None else []].astype(int)
                upto = borders[borders <= MERGED]
                n = int(upto[-1] if len(upto) else borders[0] if len(borders) else 0)
                if not n:
                    break
                now, held = held.slice(0, n), held.slice(n)
                starts = earlier_strings(h[:n], now["left"].to_pylist(), now["right"].to_pylist(), now["doc_id"].to_numpy(), depth)
                some = pa.array(np.flatnonzero(starts))
                yield pa.RecordBatch.from_arrays([now["doc_id"].take(some), now["piece"].take(some), pa.array(starts).take(some)], names=["doc_id", "piece", "starts"])

    return edges.repartition("core").sortWithinPartitions("core").mapInArrow(run, "doc_id long, piece long, starts long")


def looked_up(edges: DataFrame, depth: int) -> DataFrame:
    """The same for cores with very many pieces: each string by its hash."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh128_digest

        for b in batches:
            rows = []
            for core, piece, doc_id, left, right in zip(*(b[c].to_pylist() for c in ("core", "piece", "doc_id", "left", "right"))):
                for o in range(len(left) + len(right) + 2 - depth):
                    rows.append((doc_id, piece, o, xxh128_digest(b"%d %d %b%b" % (core, len(left) - o, left[o:], right[: depth - 1 - (len(left) - o)]))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["doc_id", "piece", "offset", "string"])

    each = edges.mapInArrow(strings, "doc_id long, piece long, offset int, string binary")
    least = each.groupBy("string").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("string", "least")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("offset"))
    return each.join(least, "string").filter("least < doc_id").groupBy("doc_id", "piece").agg(F.bit_or(bit).alias("starts"))


def without_earlier_strings(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) of documents (doc_id, text).

    `length` is from 17 to 79, so that a string holds an anchor and the starts of a piece fit a long.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.filter("doc_id is not null and text is not null")
    repeated = stored(met_anchors(named, length).repartition("anchor").groupBy("anchor").agg(F.min("a").alias("a"), F.max("b").alias("b")).filter("a < b").select("anchor"))
    found = anchors_of(named, length).join(repeated.hint("shuffle_hash"), "anchor")  # a row per anchor on the small side, whatever the other holds
    places = stored(found.groupBy("doc_id").agg(F.collect_list("place").alias("places")))  # a number per sixteen bytes of a text, about
    # Equal pieces are one: its first document, and a place there (which one doesn't matter).
    distinct = stored(pieces(named.join(places, "doc_id"), length).groupBy("core", "piece").agg(F.min_by("place", "doc_id").alias("place"), F.min("doc_id").alias("doc_id")))
    several = stored(distinct.groupBy("core").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("core", "n"))
    wanted = distinct.join(several.hint("shuffle_hash"), "core").groupBy("doc_id").agg(F.collect_list(F.struct("core", "piece", "n", "place")).alias("wanted"))
    edges, depth = stored(edges_of(named.join(wanted, "doc_id"), length)), halves(length)[1]
    starts = merged(edges.filter(F.col("n") <= CROWD), depth).unionByName(looked_up(edges.filter(F.col("n") > CROWD), depth))
    # Of the pieces that a document is the first to hold, what earlier documents hold of them; it loses all strings of its other ones.
    own = distinct.select("doc_id", "piece", F.lit(0).cast("long").alias("starts")).unionByName(starts)
    firsts = stored(own.groupBy("doc_id").agg(F.collect_list(F.struct("piece", "starts")).alias("firsts")))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in parts_of(batch, BLOCK):
                yield cut_texts(b, length)

    marked = docs.join(places, "doc_id", "left").join(firsts, "doc_id", "left")
    return marked.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def cut_texts(b: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """What is left of texts (text, places, firsts)."""
    data, cuts, row, start, place, _ = located(b, "places", length)
    cover = np.zeros(len(data) + 1, np.int64)
    if len(row):
        run, start, _, n, _, piece = pieces_of(words_at(data), start, place, length)
        of, firsts = listed(b["firsts"])
        known = mixed(pc.struct_field(firsts, "piece").to_numpy(zero_copy_only=False).view(np.uint64), of.astype(np.uint64))
        order = np.argsort(known)
        first = np.flatnonzero(np.r_[True, known[order][1:] != known[order][:-1]][: len(order)])
        # A piece that isn't among the first ones is an earlier document's: all of its strings go.
        starts = np.r_[np.bitwise_or.reduceat(pc.struct_field(firsts, "starts").to_numpy(zero_copy_only=False)[order], first) if len(first) else np.zeros(0, np.int64), 0]
        known, key = known[order][first], mixed(piece, row[run].astype(np.uint64))
        at = np.searchsorted(known, key)
        own = np.r_[known, np.uint64(0)][at] == key
        own[at == len(known)] = False
        np.add.at(cover, start[~own], 1)
        np.add.at(cover, (start + n + length - 1)[~own], -1)
        some = np.flatnonzero(own & (starts[at] != 0))
        which, offset = np.nonzero(starts[at[some]][:, None] >> np.arange(64) & 1)
        np.add.at(cover, start[some[which]] + offset, 1)
        np.add.at(cover, start[some[which]] + offset + length, -1)
    gone = np.cumsum(cover)[:-1] > 0
    begins = gone & ~np.r_[False, gone[:-1]][: len(gone)]
    heads = cuts[:-1][cuts[:-1] < cuts[1:]]
    begins[heads] = gone[heads]
    removed, spans = np.r_[0, np.cumsum(gone)][cuts], np.r_[0, np.cumsum(begins)][cuts]
    kept, ends = data[~gone].tobytes(), cuts - removed
    sha = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(ends.tolist(), ends[1:].tolist())]
    binary = pa.Array.from_buffers(pa.binary(), len(sha), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(kept)])
    return pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(np.diff(x)) for x in (cuts, removed, spans)), pa.array(sha, pa.string()), binary], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
