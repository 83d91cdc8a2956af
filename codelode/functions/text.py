"""Column expressions on contents and texts. Lines end at line feeds only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .parts import parts

# Limits of what is kept of a cell's output.
HEAD_LINES, TAIL_LINES, LINE_CHARS = 15, 15, 300
#: Characters of a README that go into the repo map.
EXCERPT_CHARS = 1_500
# Words and signs of made-up secrets.
PLACEHOLDERS = ("xxx", "your", "example", "changeme", "placeholder", "dummy", "<", "${", "{{")
MIN_SECRET_CHARS, MIN_ENTROPY = 8, 3.0
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def git_blob_sha(content: Column) -> Column:
    """The hash under which git stores these bytes."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.lit(b"\0"), content))


def decode_text(content: Column) -> Column:
    """Text of UTF-8 bytes, bad ones replaced; null for binary contents (a zero byte among the first 8192)."""
    return F.when(F.position(F.lit(b"\0"), F.substring(content, 1, 8192)) == 0, F.make_valid_utf8(content.cast("string")))


def line_count(text: Column) -> Column:
    return (F.regexp_count(text, F.lit("\n")) + F.when(text.endswith("\n"), 0).otherwise(1)).cast("int")


def line_feeds(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\n")).cast("int")


def token_count(text: Column) -> Column:
    """Words between white space: the counter that needs no model."""
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("int")


def strip_html(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def clean_output(text: Column) -> Column:
    """What is kept of printed output: no terminal codes, the last state of each line, no blank lines, head and tail of long ones."""
    lines = F.split(F.regexp_replace(text, r"\x1b\[[0-9;?]*[A-Za-z]", ""), "\n")
    last = F.transform(lines, lambda x: F.regexp_replace(F.element_at(F.split(x, "\r"), -1), rf"{SPACE}+$", ""))
    short = F.transform(last, lambda x: F.when(F.length(x) > LINE_CHARS, F.concat(F.substring(x, 1, LINE_CHARS), F.lit(" ..."))).otherwise(x))
    kept = F.filter(short, lambda x: x != "")

    def head_and_tail(a: Column) -> Column:
        omitted = F.concat(F.lit("... ["), (F.size(a) - HEAD_LINES - TAIL_LINES).cast("string"), F.lit(" lines omitted]"))
        cut = F.concat(F.slice(a, 1, HEAD_LINES), F.array(omitted), F.slice(a, -TAIL_LINES, TAIL_LINES))
        return F.array_join(F.when(F.size(a) > HEAD_LINES + TAIL_LINES, cut).otherwise(a), "\n")

    return F.element_at(F.transform(F.array(kept), head_and_tail), 1)


def text_entropy(text: Column) -> Column:
    """Bits per character of long texts, counted in one pass."""

    @F.arrow_udf("double")
    def bits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for (texts,) in parts(batch):
                yield pa.array([None if t is None else bits_of(t) for t in texts.to_pylist()], pa.float64())

    return bits(text)


def bits_of(text: str) -> float:
    """The sum over its different characters, an empty text's being 0."""
    if text.isascii():
        n = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=1)
    else:
        n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1]
    share = n[n > 0] / max(1, len(text))
    return float(-(share * np.log2(share)).sum()) + 0.0


def entropy(value: Column) -> Column:
    """Bits per character of short values: each different character is a pass over them."""
    chars = F.array_distinct(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)))

    def term(c: Column) -> Column:
        p = (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / F.length(value)
        return -p * F.log2(p)

    return F.aggregate(F.transform(chars, term), F.lit(0.0), lambda a, x: a + x)


def is_real_secret(value: Column) -> Column:
    """Whether a value looks like a secret rather than a placeholder; eight different characters are enough."""
    lower = F.lower(value)
    hinted = F.lit(False)
    for hint in PLACEHOLDERS:
        hinted = hinted | F.contains(lower, F.lit(hint))
    plain = ~F.contains(value, F.lit("[REDACTED:")) & (F.length(value) >= MIN_SECRET_CHARS) & ~value.rlike("^[{%$]") & ~hinted
    return plain & (entropy(value) >= MIN_ENTROPY - 1e-9)


def excerpt(text: Column) -> Column:
    """The beginning of a README; null if it is blank."""
    bare = F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")
    return F.when(bare != "", F.when(F.length(bare) > EXCERPT_CHARS, F.concat(F.substring(bare, 1, EXCERPT_CHARS), F.lit("\n..."))).otherwise(bare))


def embed_text(path: Column, start: Column, end: Column, language: Column, scope: Column, text: Column) -> Column:
    """A chunk's text behind a header that says where it is from."""
    header = F.concat(F.lit("File: "), path, F.lit(" (lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")\nLanguage: "), language)
    return F.concat(header, F.when(F.coalesce(scope, F.lit("")) != "", F.concat(F.lit("\nScope: "), scope)).otherwise(""), F.lit("\n\n"), text)


def chunk_id(repo: Column, path: Column, blob_sha: Column, index: Column) -> Column:
    """Stays the same as long as the file does."""
    return F.sha1(F.concat_ws("|", repo, path, blob_sha, index.cast("string")).cast("binary"))
