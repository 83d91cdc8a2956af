"""SimHash near-duplicates with pivot distance tables.

Fingerprint: a bit is 1 if it is set in over half the hashes of a document's word shingles. Fingerprints of several
words take their further words from the same hashes, remixed.

Pivot table: each distinct fingerprint gets its Hamming distances to `PIVOTS` reference fingerprints, once. By the triangle
inequality two fingerprints within `max_bits` differ by at most that in every coordinate; pairs that differ by more are
discarded, and what is left is verified on the fingerprints.

Pairs are looked for among fingerprints that agree on a band of bits, so that they meet by a shuffle. With `exact_bands`
every pair within max_bits agrees on some band: no link is lost. A band value that many fingerprints share is
dealt into chunks that meet two by two. Inside a group only pairs not yet connected are compared, and a group hands on a
star per component, round its least fingerprint, so that many groups hand on the same links: never all pairs. Where bands come
in rounds, the later ones start from what the first connected. Copies of a fingerprint are one node.

A similarity that is to hold exactly is verified on the shingles: candidates are what looser bands and bits connect, and
only documents of one candidate group meet, with the hashes of their distinct shingles.

Null and empty texts have no words and fingerprint zero, which links like any other. A null doc_id stays null and names
a component only if no member has an id. Repeated rows get the same result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import parts_of
from .common import stored
from .graph import components

PIVOTS, CHUNK, VERIFIED, ROUND, SEED = 16, 1024, 1024, 16, 42


def remixed(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64-bit hash from a hash; the hash itself for word 0."""
    if word:
        h = h + np.uint64(word * 0x9E3779B97F4A7C15 % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of the word shingles of a whole text, repeats included, A-Z lower-cased."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, n = np.r_[0, ends[:-1]], max(1, len(words) - shingle + 1)
    stops = ends[len(words) - n :] - 1
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist())), np.uint64, n)


def fingerprint(hashes: np.ndarray, words: int) -> bytes:
    """The majority of each bit, the highest first."""
    out = b""
    for word in range(words):
        count = np.zeros(64, np.int64)
        for a in range(0, len(hashes), 65_536):
            bits = np.unpackbits(remixed(hashes[a : a + 65_536], word).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            count += bits.sum(axis=0, dtype=np.int64)
        out += np.packbits(count * 2 > len(hashes)).tobytes()
    return out


def fingerprints(docs: DataFrame, shingle: int, words: int = 1, distinct: bool = False) -> DataFrame:
    """doc_id, fp (8 * words bytes) of documents (doc_id, text).

    With `distinct`, fp is of each shingle once, and digest (of these shingles) and key (of the text) are added.
    """
    from xxhash import xxh128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, digest = [], []
            for t in b["text"]:
                hashes = shingle_hashes(t.as_py(), shingle)
                if distinct:
                    hashes = np.unique(hashes)
                    digest.append(xxh128_digest(hashes.tobytes()))
                fp.append(fingerprint(hashes, words))
            more = [b["key"], pa.array(digest, pa.binary())] if distinct else []
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp, pa.binary()), *more], names=["doc_id", "fp", "key", "digest"][: 2 + len(more)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.xxhash64("text").alias("key")] if distinct else []))
    return rows.mapInArrow(run, "doc_id long, fp binary" + (", key long, digest binary" if distinct else ""))


def exact_bands(bits: int, max_bits: int, blocks: int) -> list[np.ndarray]:
    """Masks over `blocks` blocks of which max_bits are left out: two fingerprints within max_bits agree on one of them at least."""
    block = np.arange(bits) * blocks // bits
    return [np.packbits(np.isin(block, kept)) for kept in combinations(range(blocks), blocks - max_bits)]


def sampled_bands(bits: int, width: int) -> list[np.ndarray]:
    """Masks of `width` neighbouring bits each, over all bits."""
    return [np.packbits((np.arange(bits) // width) == i) for i in range(bits // width)]


def shuffled_bands(bits: int, width: int, orders: int) -> list[list[np.ndarray]]:
    """Masks of `width` bits each, over all bits in several orders, the given one first."""
    taken = [np.arange(bits), *(np.random.default_rng(SEED + i).permutation(bits) for i in range(1, orders))]
    return [[np.packbits(np.isin(np.arange(bits), order[i : i + width])) for i in range(0, bits - width + 1, width)] for order in taken]


def binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, w = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * w).astype("<i4")), pa.py_buffer(np.ascontiguousarray(rows))])


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances to the reference fingerprints, clipped to a byte."""
    pivots = np.random.default_rng(SEED).integers(0, 256, (PIVOTS, fp.shape[1]), dtype=np.uint8)
    return np.stack([np.minimum(np.bitwise_count(fp ^ p).sum(axis=1, dtype=np.int64), 255) for p in pivots], axis=1).astype(np.uint8)


def connect(run: np.ndarray, fp: np.ndarray, table: np.ndarray, max_bits: int, label: np.ndarray | None = None) -> np.ndarray:
    """For each row, the first row it is connected to by links within its run (rows of a run stand together), and by `label` before."""
    label, n = np.arange(len(run)) if label is None else label.copy(), len(run)
    at, step = np.arange(n), 1
    while True:
        at = at[at + step < n]
        at = at[run[at] == run[at + step]]
        if not len(at):
            return label
        a = at[label[at] != label[at + step]]
        a = a[np.abs(table[a].astype(np.int16) - table[a + step]).max(axis=1) <= max_bits] if len(a) else a
        a = a[np.bitwise_count(fp[a] ^ fp[a + step]).sum(axis=1, dtype=np.int64) <= max_bits] if len(a) else a
        while len(a):
            x, y = label[a], label[a + step]
            apart = x != y
            a, x, y = a[apart], x[apart], y[apart]
            label[np.maximum(x, y)] = np.minimum(x, y)
            while (label[label] != label).any():
                label = label[label]
        step += 1


def met_by_chunks(rows: DataFrame, by: str) -> DataFrame:
    """Adds chunk, i and j to rows with `chunks` (null: one): a crowded key's chunks meet two by two; the pairs inside a chunk meet on the
    way, and the links among them are handed on where the chunk is at `home`, in one of its meetings."""
    chunks, chunk = F.coalesce("chunks", F.lit(1)), F.pmod(F.xxhash64(by), F.coalesce("chunks", F.lit(1))).cast("int")
    others = F.when(chunks == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), chunks - 1), chunk))
    met = rows.withColumn("chunk", chunk).withColumn("other", F.explode(others))
    return met.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other"), "home": F.col("other") == F.pmod(F.col("chunk") + 1, chunks)})


def first_of(run: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each row, the first row of its run with its code."""
    _, first, at = np.unique(run * (np.int64(code.max(initial=0)) + 1) + code, return_index=True, return_inverse=True)
    return first[at]


def merged(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each row, the first row to which both labellings together connect it."""
    while True:
        before = one
        for by in (other, one):
            least = np.full(len(one), len(one))
            np.minimum.at(least, by, one)
            one = least[by]
        if (one == before).all():
            return one


def tied(part: pa.RecordBatch, run: np.ndarray, connected: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and what to hang them on: those of a chunk on its first ones, where it is at home, and these on the first ones of both chunks.
    Rows of one `top` count as connected."""
    chunk, top = part["chunk"].to_numpy(), part["top"].dictionary_encode().indices.to_numpy()
    inner = np.cumsum(np.r_[True, (run[1:] != run[:-1]) | (chunk[1:] != chunk[:-1])])
    within = connected(inner, first_of(inner, top))
    across, own = connected(run, merged(within, first_of(run, top))), np.arange(len(run))
    home = np.flatnonzero((within != own) & part["home"].to_numpy(zero_copy_only=False))
    first = np.flatnonzero((within == own) & (across != own))
    return np.r_[home, first], np.r_[within[home], across[first]]


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Run numbers and rows of all runs of several rows that agree on the integer columns `keys`, each run whole."""
    held = None
    for b in chain((b.slice(a, 1024) for b in batches for a in range(0, b.num_rows, 1024)), (None,)):
        if b is not None:
            held = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks().to_batches()[0]
        if held is None or not held.num_rows:
            continue
        values = np.stack([held[x].to_numpy().astype(np.int64) for x in keys])
        new = np.r_[True, (values[:, 1:] != values[:, :-1]).any(axis=0)]
        last = int(np.flatnonzero(new)[-1]) if b is not None else held.num_rows  # the last run may go on in the next batch
        run = np.cumsum(new)[:last]
        several = np.flatnonzero(np.r_[False, run[1:] == run[:-1]] | np.r_[run[1:] == run[:-1], False]) if last else np.zeros(0, int)
        if len(several):
            yield run[several], held.take(pa.array(several))
        held = held.slice(last)


def links(distinct: DataFrame, bands: list[np.ndarray], max_bits: int, width: int) -> DataFrame:
    """Edges (a, b) that connect the tops of what links within max_bits connect; distinct: fp, table, top.

    top: a name of what a fingerprint is known to be connected to; without such a column, the fingerprint itself.
    """
    distinct = distinct if "top" in distinct.columns else distinct.withColumn("top", F.col("fp"))
    named = distinct.schema["top"].dataType.simpleString()

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                fp = as_matrix(b["fp"], width)
                for i, mask in enumerate(bands):
                    key = np.full(len(fp), i + 1, np.uint64)
                    for part in (fp & mask).view(">u8").T:  # values that meet by chance are told apart when pairs are verified
                        key = remixed(key ^ part.astype(np.uint64), i + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b["fp"], b["table"], b["top"]], names=["key", "fp", "table", "top"])

    banded = distinct.select("fp", "table", "top").mapInArrow(band, f"key long, fp binary, table binary, top {named}")
    shared = banded.select("key").groupBy("key").count().filter("count > 1").select("key", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    met = met_by_chunks(banded.join(shared, "key"), "fp").select("key", "i", "j", "chunk", "home", "fp", "table", "top")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, part in runs(batches, ("key", "i", "j")):
            fp, table = as_matrix(part["fp"], width), as_matrix(part["table"], PIVOTS)
            a, b = tied(part, run, lambda of, label, fp=fp, table=table: connect(of, fp, table, max_bits, label))
            if len(a):
                yield pa.RecordBatch.from_arrays([part["top"].take(pa.array(a)), part["top"].take(pa.array(b))], names=["a", "b"])

    return met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "chunk", "fp").mapInArrow(compare, f"a {named}, b {named}")


def alike(run: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], max_bits: int, least: float, label: np.ndarray | None = None) -> np.ndarray:
    """For each row, the first row of its run to which links of a Jaccard similarity of `least` or more connect it, and `label` before."""
    label, n = np.arange(len(run)) if label is None else label.copy(), len(run)
    size = np.fromiter(map(len, sets), np.int64, n)
    at, step = np.arange(n), 1
    while True:
        at = at[at + step < n]
        at = at[run[at] == run[at + step]]
        if not len(at):
            return label
        a = at[label[at] != label[at + step]]
        a = a[np.minimum(size[a], size[a + step]) >= least * np.maximum(size[a], size[a + step]) * (1 - 1e-9)]
        a = a[np.bitwise_count(fp[a] ^ fp[a + step]).sum(axis=1, dtype=np.int64) <= max_bits] if len(a) else a
        for x in a.tolist():
            y = x + step
            if label[x] != label[y]:
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if both and both / (size[x] + size[y] - both) >= least:
                    low, high = sorted((label[x], label[y]))
                    label[label == high] = low
        step += 1


def similar_sets(docs: DataFrame, sets: DataFrame, groups: DataFrame, shingle: int, words: int, max_bits: int, least: float) -> DataFrame:
    """Edges (a, b) of digests that connect what a Jaccard similarity of `least` or more connects inside a group.

    docs: text; sets: digest, fp, key (hash of a text with these shingles); groups: fp, top (the group).
    """
    named = sets.join(groups, "fp").select("digest", "key", F.col("top").alias("group"))
    sizes = named.groupBy("group").count().filter("count > 1").select("group", F.ceil(F.col("count") / VERIFIED).cast("int").alias("chunks"))
    members = stored(named.join(sizes, "group"))
    texts = docs.select(F.xxhash64("text").alias("key"), "text").join(members.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts_of(b):
                found = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in part["text"]]
                columns = [part["group"], part["chunks"], part["digest"], pa.array([fingerprint(h, words) for h in found], pa.binary()), pa.array([h.tobytes() for h in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["group", "chunks", "top", "fp", "hashes"])

    held = members.join(texts, "key").select("group", "chunks", "digest", "text").mapInArrow(gather, "group long, chunks int, top binary, fp binary, hashes binary")
    met = met_by_chunks(held, "top").select("group", "i", "j", "chunk", "home", "top", "fp", "hashes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, part in runs(batches, ("group", "i", "j")):
            fp, sets = as_matrix(part["fp"], 8 * words), [np.frombuffer(h.as_buffer(), np.uint64) for h in part["hashes"]]
            a, b = tied(part, run, lambda of, label, fp=fp, sets=sets: alike(of, fp, sets, max_bits, least, label))
            if len(a):
                yield pa.RecordBatch.from_arrays([part["top"].take(pa.array(a)), part["top"].take(pa.array(b))], names=["a", "b"])

    return met.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "chunk", "top").mapInArrow(compare, "a binary, b binary")


def similar_documents(docs: DataFrame, shingle: int = 5, words: int = 8, max_bits: int = 120, orders: int = 3, least: float = 0.8) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links reach): documents (doc_id, text) link whose distinct word shingles
    have a Jaccard similarity of `least` or more, and no others.

    Fingerprints are of distinct shingles. 0.8 is a cosine of 0.89, an angle of 15 % of the bits (77 of 512): the limit of
    bits is 5 standard deviations above, and one of 96 bands of 16 bits agrees with a probability of 0.998 (0.97 for four shingles
    of five). What these connect is a candidate; it links if its shingles say so.
    """
    marked = stored(fingerprints(docs, shingle, words, distinct=True))
    sets = stored(marked.groupBy("digest", "fp").agg(F.min("doc_id").alias("first"), F.min("key").alias("key")))
    prints = stored(sets.select("fp").distinct().mapInArrow(tabled(8 * words), "fp binary, table binary"))
    rounds = [bands[i : i + ROUND] for bands in shuffled_bands(64 * words, 16, orders) for i in range(0, len(bands), ROUND)]  # so few at once, for the sake of disk
    groups = prints.withColumn("top", F.xxhash64("fp"))  # a chance collision makes two groups one candidate, which its shingles settle
    for part in (rounds[:1], rounds[1:]):  # the first bands connect most of a group, so that the others hand on new links alone
        found = [stored(links(groups, bands, max_bits, 8 * words)) for bands in part]
        if found:
            groups = stored(groups.join(components(reduce(DataFrame.unionByName, found)).withColumnRenamed("node", "top"), "top", "left").select("fp", "table", F.coalesce("root", "top").alias("top")))
    roots = components(stored(similar_sets(docs, sets, groups.select("fp", "top"), shingle, words, max_bits, least)))
    linked = stored(roots.join(sets.select(F.col("digest").alias("node"), "first"), "node"))
    leasts = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(leasts, "root").select(F.col("node").alias("digest"), "least")
    class_of = sets.select("digest", "first").join(named, "digest", "left").select("digest", F.coalesce("least", "first").alias("component_id"))
    return marked.join(class_of, "digest").select("doc_id", "fp", "component_id")


def tabled(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the pivot table to batches of fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, binary(pivot_table(as_matrix(b["fp"], width)))], names=[*b.schema.names, "table"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, words: int = 8, max_bits: int = 120, bands: list[np.ndarray] | None = None) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links reach) of documents (doc_id, text).

    With bands, fingerprints within max_bits that agree on a band link. Without, see similar_documents: similarity of 0.8 or more.
    """
    if bands is None:
        return similar_documents(docs, shingle, words, max_bits)
    marked = stored(fingerprints(docs, shingle, words))
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")).mapInArrow(tabled(8 * words), "fp binary, first long, table binary"))
    roots = components(stored(links(distinct, bands, max_bits, 8 * words)))
    linked = stored(roots.join(distinct.select(F.col("fp").alias("node"), "first"), "node"))
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(least, "root").select(F.col("node").alias("fp"), "least")
    class_of = distinct.select("fp", "first").join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return marked.join(class_of, "fp").select("doc_id", "fp", "component_id")
