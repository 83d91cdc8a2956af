"""Steps that work on a batch in bounded parts, and steps that need no rows to meet."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codelode.config import Settings
from codelode.functions import parts, redaction, text
from codelode.operators import chunk, embed, readers
from codelode.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_parts_are_bounded_and_whole():
    texts = pa.array(["a" * n for n in (0, 5, 3 << 20, 7)] + [None] + ["b" * 300_000] * 9 + ["c"] * 700)
    got = list(parts.parts(texts, pa.array(range(len(texts)))))
    assert [t for p, _ in got for t in p.to_pylist()] == texts.to_pylist() and [i for _, n in got for i in n.to_pylist()] == list(range(len(texts)))
    assert all(len(p) <= parts.PART_ROWS and (len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= parts.PART_BYTES) for p, _ in got)
    assert not list(parts.parts(texts.slice(0, 0)))


def test_redaction_of_more_than_a_part(spark):
    rows = [(i, None if i % 50 == 7 else f"mail a{i}@corp.org now\n" * (1 + i % 3)) for i in range(1_000)]
    done = redaction.redact_documents(spark.createDataFrame(rows, "i long, text string").coalesce(1)).collect()
    for r in done:
        if r.i % 50 == 7:
            assert r.text is None and r.findings == {}
        else:
            assert r.text == "mail [REDACTED:email] now\n" * (1 + r.i % 3) and r.findings == {"email": 1 + r.i % 3}


@pytest.mark.parametrize("t", ["", "aabb", "x" * 1_000, "".join(chr(0x4E00 + i % 5_000) for i in range(12_000)), "a\U0001f600b" * 9])
def test_entropy_of_texts(spark, t):
    n = Counter(t)
    bits = sum(c / len(t) * math.log2(len(t) / c) for c in n.values())
    df = spark.createDataFrame([(t,), (None,)], "t string").coalesce(1)
    assert [r.b for r in df.select(text.text_entropy(F.col("t")).alias("b")).collect()] == [pytest.approx(bits), None]


def test_words_are_counted_where_texts_are_read(spark):
    rows = [(1, "A b b"), (1, "b é_9"), (2, ""), (3, None)]
    df = embed.hash_embed_rows(spark.createDataFrame(rows, "k long, t string"), ["k"], "t", 1 << 20)
    assert plan(df)[1].count("Exchange hashpartitioning") == 1
    n = Counter(embed.Buckets(1 << 20)[w] for w in ("a", "b", "b", "b", "_9"))
    norm = math.sqrt(sum(c * c for c in n.values()))
    assert {(r.k, r.bucket): r.weight for r in df.collect()} == {(1, b): pytest.approx(c / norm) for b, c in n.items()}


def test_neighbours_need_no_rows_to_meet(spark):
    words = "\n".join(" ".join(f"w{i}" for i in range(n, n + 20)) for n in range(0, 2_000, 20))
    docs = spark.createDataFrame([("r", "a.md", "s1", "markdown", words), ("r", "a.md", "s2", "markdown", "other\n" + words)], "repo string, path string, blob_sha string, language string, text string")
    docs = docs.withColumn("units", F.lit(None).cast(chunk.UNITS))
    df = chunk.chunk_documents(docs, Settings(piece_tokens=100, overlap_tokens=0, context_tokens=350))
    assert "Window" not in plan(df)[0] and "Exchange" not in plan(df)[1]
    for sha in ("s1", "s2"):  # two files under one path aren't each other's neighbours
        c = sorted((r for r in df.collect() if r.blob_sha == sha), key=lambda r: r.chunk_index)
        assert len(c) > 15
        for i, r in enumerate(c):
            assert (r.parent_start_line, r.parent_end_line) == (c[max(i - 1, 0)].start_line, c[min(i + 1, len(c) - 1)].end_line)


def test_neighbours_are_sorted_without_lines(spark):
    from tests.test_queries import SF

    tree = plan(QUERIES["wn3_neighbours"](spark, SF))[1]
    assert "sequence(" not in tree[tree.index("Window ") :] and "lines" not in tree[tree.index("Window ") :]


def test_units_of_more_than_a_part(spark):
    texts = [None if i % 50 == 7 else f"x = {i}\nclass C{i}:\n    def f(self):\n        pass\n" if i % 3 else "def broken(" for i in range(1_000)]
    units = [[] if i % 50 == 7 or i % 3 == 0 else [(2, 4, f"class C{i}", 0), (3, 4, f"class C{i} > def f", 1)] for i in range(1_000)]
    got = list(readers.units_in_parts(iter([pa.array(texts)])))
    assert len(got) > 1 and max(map(len, got)) <= parts.PART_ROWS
    assert [[tuple(u.values()) for u in row] for part in got for row in part.to_pylist()] == units
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    assert {r.i: [tuple(u) for u in r.u] for r in df.select("i", readers.python_units(F.col("text")).alias("u")).collect()} == dict(enumerate(units))
