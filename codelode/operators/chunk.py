"""Documents to chunks with exact line ranges, scopes and parent spans.

documents: repo, path, blob_sha, language, text, units (array of start_line, end_line, name, depth). Small documents take a path
of column expressions alone; only larger ones meet the splitter, which runs in Arrow batches, a document at a time.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..functions.parts import parts

UNITS = "array<struct<start_line: int, end_line: int, name: string, depth: int>>"
PIECES = pa.list_(pa.struct([("text", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]))
# Where to cut, the best place first. A separator stays with what follows it.
LADDERS = {
    "python": ["\nclass ", "\ndef ", "\n\tdef ", "\n    def ", "\n\n", "\n", " ", ""],
    "javascript": ["\nfunction ", "\nconst ", "\nlet ", "\nclass ", "\nif ", "\nfor ", "\n\n", "\n", " ", ""],
    "typescript": ["\ninterface ", "\nfunction ", "\nconst ", "\nlet ", "\nclass ", "\nif ", "\nfor ", "\n\n", "\n", " ", ""],
    "markdown": ["\n# ", "\n## ", "\n### ", "\n#### ", "\n```\n", "\n\n", "\n", " ", ""],
    "notebook": ["\n# [cell ", "\nclass ", "\ndef ", "\n\n", "\n", " ", ""],
    "text": ["\n\n", "\n", " ", ""],
}


def words(text: str) -> int:
    return len(text.split())


def cut_up(text: str, ladder: list[str], limit: int, count: Callable[[str], int]) -> Iterator[tuple[int, str, int]]:
    """Parts (place, text, tokens) of at most `limit` tokens, cut at the first separator of the ladder that occurs, and further down where needed."""
    if (size := count(text)) <= limit:
        yield 0, text, size
        return
    at = next((i for i, s in enumerate(ladder) if not s or text.find(s, 1) >= 0), len(ladder) - 1)
    separator = ladder[at]
    if separator:
        cuts = [0, *(m.start() for m in re.finditer(re.escape(separator), text) if m.start()), len(text)]
    else:  # single characters, taken together as far as they fit
        cuts, step = [0], len(text)
        while cuts[-1] < len(text):
            step = min(step * 2, len(text) - cuts[-1])
            while step > 1 and count(text[cuts[-1] : cuts[-1] + step]) > limit:
                step //= 2
            cuts.append(cuts[-1] + max(1, step))
    below = ladder[at + 1 :]
    for a, b in zip(cuts, cuts[1:]):
        part = text[a:b]
        if not separator or (size := count(part)) <= limit:
            yield a, part, size if separator else count(part)
        else:
            for place, inner, size in cut_up(part, below, limit, count):
                yield a + place, inner, size


def pieces(text: str, language: str, settings: Settings, count: Callable[[str], int] = words) -> list[tuple[str, int, int]]:
    """(text, start line, end line) of the chunks of a larger document: neighbouring parts, with an overlap of whole parts."""
    out, held, total, line, seen = [], deque(), 0, 1, 0

    def give() -> None:
        nonlocal line, seen
        start, joined = held[0][0], "".join(p for _, p, _ in held)
        bare = joined.strip()
        if bare:
            start += len(joined) - len(joined.lstrip())
            line, seen = line + text.count("\n", seen, start) if start >= seen else text.count("\n", 0, start) + 1, start
            out.append((bare, line, line + bare.count("\n")))

    for part in cut_up(text, LADDERS.get(language, LADDERS["text"]), settings.piece_tokens, count):
        size = part[2]
        if held and total + size > settings.piece_tokens:
            give()
            while held and (total > settings.overlap_tokens or total + size > settings.piece_tokens):
                total -= held.popleft()[2]
        held.append(part)
        total += size
    if held:
        give()
    return out


def split_documents(documents: DataFrame, settings: Settings = Settings(), counter: Callable[[], Callable[[str], int]] | None = None) -> Column:
    """A column of pieces for documents that are too long for one chunk; `counter` makes the token counter, once per stream of batches.

    Pieces leave a worker in small batches, so that it holds those of one part of a batch at a time.
    """

    @F.arrow_udf("array<struct<text: string, start_line: int, end_line: int>>")
    def split(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        count = counter() if counter else words
        for batch in batches:
            for texts, languages in parts(*batch):
                rows = zip(texts.to_pylist(), languages.to_pylist())
                yield pa.array([[dict(zip(("text", "start_line", "end_line"), p)) for p in pieces(t, lang, settings, count)] if t is not None else None for t, lang in rows], PIECES)

    return split(F.col("text"), F.col("language"))


def chunk_small(text: Column) -> Column:
    """The one piece of a document that fits: the text without the line feeds round it."""
    bare = F.regexp_replace(text, r"^\n+|\n+$", "")
    start = (F.length(F.regexp_extract(text, r"^\n*", 0)) + 1).cast("int")
    return F.array(F.struct(bare.alias("text"), start.alias("start_line"), (start + T.line_feeds(bare)).cast("int").alias("end_line")))


def scope_of(units: Column, line: Column) -> Column:
    """Name of the deepest unit round a line, the first one of that depth; null if there is none."""
    round_ = F.filter(units, lambda u: (u["start_line"] <= line) & (u["end_line"] >= line))
    deepest = F.aggregate(round_, F.struct(F.lit(-1).alias("depth"), F.lit(None).cast("string").alias("name")), lambda a, u: F.when(u["depth"] > a["depth"], F.struct(u["depth"].alias("depth"), u["name"].alias("name"))).otherwise(a))
    return deepest["name"]


def tokens_between(lines: Column, first: Column, last: Column) -> Column:
    """Tokens of lines first to last, by running sums per line."""
    return F.element_at(lines, last) - F.when(first > 1, F.element_at(lines, F.greatest(first - 1, F.lit(1)))).otherwise(0)


def running_tokens(text: Column) -> Column:
    """Tokens of the first line, the first two lines, and so on (white space counts alike whether lines are joined or not)."""

    @F.arrow_udf("array<int>")
    def sums(counts: pa.Array) -> pa.Array:
        lines, total = counts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.cumsum(np.r_[0, counts.flatten().to_numpy(zero_copy_only=False)])
        ends = np.cumsum(np.r_[0, lines])
        rows = pa.array((total[1:] - np.repeat(total[ends[:-1]], lines)).astype(np.int32))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows, mask=counts.is_null())

    return sums(F.transform(F.split(text, "\n"), lambda x: T.token_count(x).cast("int")))


def top_span(units: Column, start: Column, end: Column) -> Column:
    """The lines of the top-level units that a chunk touches, and its own; null if it touches none."""
    touched = F.filter(units, lambda u: (u["depth"] == 0) & (u["start_line"] <= end) & (u["end_line"] >= start))
    low = F.least(start, F.array_min(F.transform(touched, lambda u: u["start_line"])))
    high = F.greatest(end, F.array_max(F.transform(touched, lambda u: u["end_line"])))
    return F.when(F.size(touched) > 0, F.struct(low.alias("a"), high.alias("b")))


def with_neighbours(chunks: DataFrame) -> DataFrame:
    """Adds _from and _to, the lines from the chunk before to the chunk after, to chunks (repo, path, chunk_index, start_line, end_line): they are sorted with the columns they have."""
    order = Window.partitionBy("repo", "path").orderBy("chunk_index")
    return chunks.withColumns({"_from": F.coalesce(F.lag("start_line").over(order), "start_line"), "_to": F.coalesce(F.lead("end_line").over(order), "end_line")})


def neighbours_of(pieces: Column) -> Column:
    """Pieces of one document with _from and _to: no rows meet for that."""
    place = lambda p, i: F.struct(p["text"].alias("text"), p["start_line"].alias("start_line"), p["end_line"].alias("end_line"), F.coalesce(F.get(pieces, i - 1)["start_line"], p["start_line"]).alias("_from"), F.coalesce(F.get(pieces, i + 1)["end_line"], p["end_line"]).alias("_to"))
    return F.transform(pieces, place)


def parents(chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds parent_start_line and parent_end_line to chunks (start_line, end_line, units, lines, fits, n_lines, _from, _to), and drops the last two.

    The whole file if it fits, else its top-level units, else the neighbours, else the chunk alone.
    """
    start, end = F.col("start_line"), F.col("end_line")
    within = lambda a, b: tokens_between(F.col("lines"), a, b) <= settings.context_tokens
    near = chunks.withColumn("_top", top_span(F.col("units"), start, end))
    whole = F.struct(F.lit(1).alias("a"), F.col("n_lines").alias("b"))
    neighbours = F.struct(F.col("_from").alias("a"), F.col("_to").alias("b"))
    parent = F.when(F.col("fits"), whole).when(F.col("_top").isNotNull() & within(F.col("_top.a"), F.col("_top.b")), F.col("_top"))
    parent = parent.when(within(F.col("_from"), F.col("_to")), neighbours).otherwise(F.struct(start.alias("a"), end.alias("b")))
    return near.withColumn("_p", parent).withColumns({"parent_start_line": F.col("_p.a").cast("int"), "parent_end_line": F.col("_p.b").cast("int")}).drop("_p", "_from", "_to", "_top")


def with_parents(chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The same for chunks (repo, path, chunk_index, start_line, end_line, units, lines, fits, n_lines) of which the neighbours are other rows."""
    return parents(with_neighbours(chunks), settings)


def chunk_documents(documents: DataFrame, settings: Settings = Settings(), counter: Callable[[], Callable[[str], int]] | None = None) -> DataFrame:
    """Chunks with id, repo, path, blob_sha, language, chunk_index, lines, parent lines, scope, text, embed_text, token_count.

    Blank documents give none; null units are none.
    """
    tokens = T.token_count(F.col("text"))
    live = documents.filter(F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))).withColumns({"_tokens": tokens, "units": F.coalesce("units", F.array().cast(UNITS))})
    n_lines = (F.size(F.split("text", "\n")) - F.when(F.col("text").endswith("\n"), 1).otherwise(0)).cast("int")
    live = live.withColumns({"fits": F.col("_tokens") <= settings.context_tokens, "n_lines": n_lines})
    empty = F.array().cast("array<int>")
    small = live.filter(F.col("_tokens") <= settings.piece_tokens).withColumns({"_pieces": chunk_small(F.col("text")), "lines": empty})
    large = live.filter(F.col("_tokens") > settings.piece_tokens).withColumns({"_pieces": split_documents(live, settings, counter), "lines": F.coalesce(running_tokens(F.when(~F.col("fits"), F.col("text"))), empty)})
    keys = ["repo", "path", "blob_sha", "language", "units", "lines", "fits", "n_lines"]
    one = small.select(*keys, F.posexplode("_pieces").alias("chunk_index", "p")).select(*keys, "chunk_index", "p.*")
    one = one.withColumns({"parent_start_line": F.lit(1), "parent_end_line": F.col("n_lines")})
    many = parents(large.select(*keys, F.posexplode(neighbours_of(F.col("_pieces"))).alias("chunk_index", "p")).select(*keys, "chunk_index", "p.*"), settings)
    return finished(one.unionByName(many), settings)


def finished(chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds scope, embed_text, id and token_count, and keeps the columns of a chunk."""
    scoped = chunks.withColumn("scope", scope_of(F.col("units"), F.col("start_line")))
    plain = F.when(F.col("language") == "markdown", F.concat(F.lit("\n"), F.col("text"))).otherwise(F.concat(F.lit("# File: "), "path", F.lit("\n"), "text"))
    full = T.embed_text(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("language"), F.col("scope"), F.col("text"))
    done = scoped.withColumns({"embed_text": full if settings.header == "context" else plain, "id": T.chunk_id(F.col("repo"), F.col("path"), F.col("blob_sha"), F.col("chunk_index"))})
    return done.withColumn("token_count", T.token_count(F.col("embed_text"))).select(CHUNK_COLUMNS)


CHUNK_COLUMNS = ["id", "repo", "path", "blob_sha", "language", "chunk_index", "start_line", "end_line", "parent_start_line", "parent_end_line", "scope", "text", "embed_text", "token_count"]
