"""Fill-in-the-middle against a plain version of its contract."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codelode.llm import infilling, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [
    (900, "a\x1eb \x1b\x1e \x1bd\x1be\x1b \x1e"), (901, " lead and trail \n"), (902, "<P>"), (903, "almost <P <S marker> M>"), (904, "\x1e"), (905, "\x1b"), (906, "<S> in text"),
    (907, " no ASCII\u0085white"), (908, "𝄞 𝄞𝄞\t\t字"), (909, "x" * 5000), (910, "$0 \\1 $1"), (911, "ends in <"), (912, "<"), *[(1000 + i, f"{' ' * (i % 3)}w{i} <\x1e " * (i % 7)) for i in range(300)],
]


def expected(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def made(spark, docs):
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    rows = docs.select("doc_id", "text", "size", "row").unionByName(odd, allowMissingColumns=True)
    clashing = rows.withColumns({c: F.lit("mine") for c in ("n", "form", "output", "_body", "_marked", "_drawn", "_first")})
    out = infilling.fill_in_middle(clashing)
    return out.withColumn("again", infilling.restored(F.col("output"), F.col("form"))).collect()


def test_against_plain_version(made, rows):
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made)
    assert got == Counter(expected(i, t) for i, t in [*[r[:2] for r in rows], *ODD])
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_round_trip_and_columns(made, rows):
    text = dict(ODD) | {r[0]: r[1] for r in rows if r[0] is not None}
    assert all(r.again == (text[r.doc_id] or "") for r in made if r.doc_id is not None)
    assert {r._body for r in made} == {"mine"} and made[0].__fields__.count("n") == 1


def test_rates(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    assert {r.form for r in infilling.fill_in_middle(rows, rate=0).collect()} == {"plain"}
    assert {r.form for r in infilling.fill_in_middle(rows, rate=100, spm=0).collect()} == {"psm"}
    assert infilling.fill_in_middle(rows, seed=1).exceptAll(infilling.fill_in_middle(rows)).count()


def test_empty(no_docs):
    assert infilling.fill_in_middle(no_docs).collect() == []


def test_plan_has_no_shuffle_and_no_python(spark):
    plan = queries.op11_infilling(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "MapInArrow" not in plan
