"""Secret scans by dictionary-primed zstandard novelty.

Base spans are found by three patterns. Beyond them, a string of at least `LEAST` characters that stands near a word such as
password or credential, and has letters and digits, is a candidate. Its novelty is what it adds to the compressed size of the text
around it: the window of `AROUND` characters on each side is compressed with and without the candidate, both times primed with a
dictionary of the corpus' most frequent identifiers. Identifiers, paths and what the surroundings repeat add little; a random key can't be
compressed. Candidates whose added bytes come to `NOVEL` or more of their length are reported as `novel`.

The identifiers are counted over all documents (letters and underscores only, so that no key gets into the dictionary); the `WORDS`
most frequent ones make it up. Candidates that overlap a base span are left out, and base spans always stay. Windows are bounded, so a
long text costs in proportion to its length; texts are worked on by parts of a batch. No row depends on others but by the dictionary.

Null and empty texts have no spans. Repeated rows get the same spans, a null doc_id is kept, an empty table stays empty. Other
columns are kept, but for one named `spans`, which is replaced. Spans of one start are ordered as kinds are listed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import kept, parts_of

KINDS = ("assign", "access", "hex", "novel")
#: Shortest group or match that counts, by base kind.
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
NAMED = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that make what follows them sensitive.
SENSITIVE = (*NAMED, "pwd", "passphrase", "credential", "bearer", "authorization", "private_key", "private key", "api key", "access_key", "access key", "accesskey", "signing_key", "client_id")
NEAR = re.compile("|".join(SENSITIVE), re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~.-]+")
LEAST, REACH, AROUND, NOVEL = 16, 64, 512, 0.8
#: Identifiers of the dictionary.
WORDS, IDENTIFIER = 4_096, r"\b[A-Za-z_]{4,32}\b"
LEVEL = 3
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("novelty", T.DoubleType())])
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the patterns find."""
    out = []
    lower = text.lower()
    if any(name in lower for name in NAMED):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def sensitive_strings(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Where candidates start and end: long strings of letters and digits on the line of a sensitive word, within reach behind it, apart from what is taken."""
    lower = text.lower()
    if not any(word in lower for word in SENSITIVE):
        return []
    found, done = [], 0
    for near in NEAR.finditer(text):
        begin = max(near.end(), done)
        reach = near.end() + REACH
        line = text.find("\n", near.end(), reach)
        for m in CANDIDATE.finditer(text, begin):
            if m.start() >= (reach if line < 0 else line):
                break
            done = m.end()
            s = m[0].strip(".=-")
            start = m.start() + m[0].index(s) if s else m.start()
            if len(s) >= LEAST and any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
                found.append((start, start + len(s)))
    return [(a, b) for a, b in found if not any(a < end and start < b for start, _, end in taken)]


class Novelty:
    """Sizes of texts compressed behind a dictionary."""

    def __init__(self, words: list[str]):
        primed = zstandard.ZstdCompressionDict("\n".join(reversed(words)).encode() or b"\n" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "surrogatepass")))

    def of(self, text: str, start: int, end: int) -> float:
        """Bytes that a string adds to its surroundings, by its length."""
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        return (self.size(before + text[start:end] + after) - self.size(before + after)) / (end - start)


def spans_of(text: str | None, novelty: Novelty) -> list[tuple[str, int, int, float | None]]:
    """Kind, start, end (code points) and novelty of all spans of a text, by start, then kind."""
    if not text:
        return []
    spans: list[tuple[int, int, int, float | None]] = [(*s, None) for s in base_spans(text)]
    for start, end in sensitive_strings(text, [s[:3] for s in spans]):
        share = novelty.of(text, start, end)
        if share >= NOVEL:
            spans.append((start, 3, end, share))
    return [(KINDS[kind], start, end, share) for start, kind, end, share in sorted(spans, key=lambda s: s[:3])]


def identifiers(docs: DataFrame, most: int = WORDS) -> list[str]:
    """The most frequent identifiers of all texts; ties by the identifier. At most `most` reach the driver."""
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("word"))
    return [r.word for r in words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(most).collect()]


def find_secrets(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """All columns of docs (text, ...) and spans: kind, start, end (code points, end exclusive) and novelty (of `novel` ones, else null)."""
    docs = docs.drop("spans")
    names = docs.columns
    known = docs.sparkSession.sparkContext.broadcast(identifiers(docs) if words is None else words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = kept(("novelty", known), lambda: Novelty(known.value))
        for b in (part for whole in batches for part in parts_of(whole)):
            found = [[dict(zip(("kind", "start", "end", "novelty"), s)) for s in spans_of(t, novelty)] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, ARROW_SPANS)], names=[*names, "spans"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("spans", T.ArrayType(SPAN))]))


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] != KINDS[-1])


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
