"""Exact and approximate search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, v string, row string"


def made(n: int, d: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((5, d))
    x = (centre[rng.integers(0, 5, n)] + rng.standard_normal((n, d))).astype(np.float32)
    x[::9] = x[0]  # copies
    rows = [(i, v.tolist(), 0, "", "", "", "") for i, v in enumerate(x)]
    odd = [None, [], [0.0] * d, [None] + [1.0] * (d - 1), [float("nan")] + [1.0] * (d - 1), [float("inf")] * d, [1.0]]
    rows += [(n + i, v, None, None, None, None, None) for i, v in enumerate(odd)]
    return rows + [rows[21], (None, rows[3][1], 0, "", "", "", "")]


def usable(rows, zero_too):
    return [(i, np.array(v, dtype=np.float64)) for i, v, *_ in rows if v and len(v) == 8 and None not in v and np.isfinite(v).all() and (zero_too or any(v))]


@pytest.mark.parametrize("blocks", [(topk.CANDIDATES, topk.QUERIES), (64, 7)])
def test_top_products_are_exact(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATES", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", blocks[1])
    monkeypatch.setattr(topk, "STEP", 16)
    monkeypatch.setattr(topk, "HEAD", 40)
    rows = made(300, 8, 1)
    got = topk.top_products(spark.createDataFrame(rows, SCHEMA), "vec_id", topk.scaled(F.col("embedding")), F.col("vec_id") % 20 == 0, 6).collect()
    vectors = [(i, np.floor(64 * v).astype(int)) for i, v in usable(rows, True)]
    expected = []
    for a, (q, x) in enumerate(vectors):
        if q is not None and q % 20 == 0:
            order = sorted(((-int(x @ y), -1 if j is None else j, j) for b, (j, y) in enumerate(vectors) if b != a), key=lambda t: t[:2])[:6]
            expected += [(q, n + 1, j, -s) for n, (s, _, j) in enumerate(order)]
    assert sorted(map(str, expected)) == sorted(str((r.query_id, r["rank"], r.vec_id, r.score)) for r in got)


def test_few_and_no_candidates(spark):
    for rows in ([], [(0, [1.0, 2.0], 0, "", "", "", "")], [(0, [1.0, 2.0], 0, "", "", "", ""), (1, [1e30, -1e30], 0, "", "", "", "")]):
        df = spark.createDataFrame(rows, SCHEMA)
        for found in (topk.top_products(df, "vec_id", topk.scaled(F.col("embedding")), F.col("vec_id") % 20 == 0, 5), ann.nearest(df, "vec_id", F.col("embedding"), F.col("vec_id") % 20 == 0, 5)):
            assert found.count() == max(0, len(rows) - 1)


@pytest.mark.parametrize("slice_rows", [ann.SLICE, 64])
def test_neighbours_recall_and_scores(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(ann, "SLICE", slice_rows)
    monkeypatch.setattr(ann, "LEAF", 16)
    rows = made(800, 8, 2)
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), "vec_id", F.col("embedding"), F.col("vec_id") % 20 == 0, 5).collect()
    vectors = usable(rows, False)
    by_id = dict(vectors)
    hits, wanted, seen = 0, 0, {}
    for r in got:
        x, y = by_id[r.query_id], by_id[r.vec_id]
        assert r.score == pytest.approx(float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), abs=1e-12)
        seen.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    for a, (q, x) in enumerate(vectors):
        if q is not None and q % 20 == 0:
            best = sorted((-(x @ y) / (np.linalg.norm(x) * np.linalg.norm(y)) for b, (j, y) in enumerate(vectors) if b != a))[:5]
            found = sorted(seen[q])
            assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(u[1] >= v[1] for u, v in zip(found, found[1:]))
            hits += sum(f[1] >= -best[-1] - 1e-9 for f in found)
            wanted += 5
    assert hits >= 0.9 * wanted


def test_chi_square():
    assert ann.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def test_neighbours_of_extreme_lengths(spark):
    """Vectors whose squares overflow or vanish take part with their exact cosine."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 6))
    scale = [1.0, 1e200, 1e-200, 1e300, 1e-300, 3.0]
    made = [(i, [float(x * scale[i % 6]) for x in v]) for i, v in enumerate(base)]
    found = ann.nearest(spark.createDataFrame(made, "id long, v array<double>"), "id", F.col("v"), F.col("id") % 5 == 0, 4).collect()
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    for q in range(0, 60, 5):
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        best = sorted((-float(unit[q] @ unit[i]), i) for i in range(60) if i != q)[:4]
        assert [i for _, i, _ in mine] == [i for _, i in best]
        assert all(s == pytest.approx(-b, abs=1e-12) for (_, _, s), (b, _) in zip(mine, best))
