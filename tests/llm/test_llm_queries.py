"""The registered queries over the smallest tables: contract columns, whole tables, held-out rows, query selection."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from codelode.llm import queries
from codelode.llm.common import seeded

SF = "/root/testdata/sf0.001"
TYPES = {
    "op1_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op3_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_suffixes": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op5_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op6_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_spans": "doc_id bigint, n_sentences bigint, n_removed bigint, kept_sha256 string, text string",
    "op9_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op10_tokencount": "doc_id bigint, n_edits bigint, tokens_before bigint, tokens_after bigint, chars_after bigint",
    "op11_infilling": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
    "op12_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op13_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
}


@pytest.fixture(scope="module")
def found(spark):
    return {name: query(spark, SF) for name, query in queries.QUERIES.items()}


@pytest.mark.parametrize("name", TYPES)
def test_columns(spark, found, name):
    types = dict(found[name].dtypes)
    for column, kind in (x.split() for x in TYPES[name].split(", ")):
        assert types[column] == kind
    if "doc_id" in types and name != "op1_packing":
        ids = Counter(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
        assert Counter(r.doc_id for r in found[name].select("doc_id").collect()) == ids


def test_held_out(found):
    for r in found["op6_langid"].collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    for r in found["op7_quality"].collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)


def vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    return {r.vec_id: np.array(r.embedding, dtype=float) for r in rows if r.embedding is not None and np.isfinite(np.array(r.embedding, dtype=float)).all()}


def test_top_products(spark, found):
    scaled = {i: np.floor(64 * v).astype(np.int64) for i, v in vectors(spark).items()}
    got = defaultdict(list)
    for r in sorted(found["op2_topk"].collect(), key=lambda r: r.rank):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in scaled if i % 20 == 0}
    for q, rows in got.items():
        best = sorted((-int(scaled[q] @ v), i) for i, v in scaled.items() if i != q)[:20]
        assert rows == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_neighbours(spark, found):
    unit = {i: v / np.linalg.norm(v) for i, v in vectors(spark).items() if v.any()}
    got = defaultdict(list)
    for r in sorted(found["op9_ann"].collect(), key=lambda r: r.rank):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {i for i in unit if i % 50 == 0}
    hits = 0
    for q, rows in got.items():
        best = [i for _, i in sorted((-float(unit[q] @ v), i) for i, v in unit.items() if i != q)[:5]]
        hits += len(set(best) & {i for i, _ in rows})
        assert len(rows) == 5 and all(s == pytest.approx(float(unit[q] @ unit[i]), abs=1e-9) for i, s in rows)
    assert hits >= 0.9 * 5 * len(got)


def test_token_counts_of_edits(spark, found):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_file())
    count = lambda text: len(t.encode(text, add_special_tokens=False).ids)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    drawn = docs.select("doc_id", *[F.pmod(seeded(i, "doc_id"), F.coalesce(F.length("text"), F.lit(0)) + 1).alias(f"p{i}") for i in range(3)])
    rows = {r.doc_id: r for r in docs.select("doc_id", "text", "lang", "source").join(drawn, "doc_id").collect()}
    got = found["op10_tokencount"].collect()
    assert len(got) == len(rows)
    for r in got:
        doc = rows[r.doc_id]
        text = doc.text or ""
        assert r.tokens_before == count(text) and r.n_edits == 4
        for p, n, new in [(doc.p0, 0, "another "), (doc.p1, 24, f"{doc.lang or '?'}: "), (doc.p2, 60, ""), (1 << 40, 0, "\n" + (doc.source or ""))]:
            p = min(p, len(text))
            text = text[:p] + new + text[p + n :]
        assert (r.tokens_after, r.chars_after) == (count(text), len(text)) and r.chars_reencoded < 4 * 4096


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, found, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    sql = con.sql(queries.ORACLES[name])
    assert sorted(found[name].columns) == sorted(sql.columns)
    assert Counter(map(tuple, found[name].select(sql.columns).collect())) == Counter(sql.fetchall())
