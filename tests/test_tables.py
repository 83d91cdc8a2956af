"""Sources, stores, runs and streams on small tables."""

from __future__ import annotations

import hashlib
import io
import tarfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codelode.config import Settings
from codelode.operators import embed, index, repomap, search, store
from codelode.sources import contents, landed, repos
from codelode.streaming import index_stream


def sha(raw: bytes) -> str:
    return hashlib.sha1(b"blob %d\0" % len(raw) + raw).hexdigest()


def archive(members: dict[str, bytes], link: bool = False) -> bytearray:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, raw in members.items():
            info = tarfile.TarInfo(f"top/{name}")
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
        if link:
            info = tarfile.TarInfo("top/link.py")
            info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
            tar.addfile(info)
    return bytearray(out.getvalue())


def test_untar(spark):
    whole = archive({"a.py": b"x", "big.py": b"y" * 600_000, "d/b.py": b"z"}, link=True)
    df = spark.createDataFrame([("r1", whole), ("r2", bytearray(b"no archive")), ("r3", whole[: len(whole) // 2])], "repo string, content binary")
    got = landed.untar(df).collect()
    assert {(r.path, bytes(r.content)) for r in got if r.repo == "r1"} == {("a.py", b"x"), ("d/b.py", b"z")}
    assert [r.broken for r in got if r.repo == "r2"] == [True] and any(r.broken for r in got if r.repo == "r3")


def test_read_landed(spark, tmp_path):
    files = {("r", "c", "a b%.py"): b"1", ("r", "c", "d/e.py"): b"2", ("s", "c", "x.py"): b"3"}
    for parts, raw in files.items():
        place = tmp_path.joinpath(*parts)
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(raw)
    wanted = spark.createDataFrame([k for k in files if k[0] == "r"], "repo string, commit_sha string, path string")
    assert {(r.path, bytes(r.content)) for r in landed.read_landed(spark, str(tmp_path), wanted).collect()} == {("a b%.py", b"1"), ("d/e.py", b"2")}


def test_accept_and_guards(spark):
    rows = [("r", "ok.py", sha(b"x"), b"x"), ("r", "big.py", sha(b"y" * 11), b"y" * 11), ("r", "other.py", "00", b"z"), ("r", "bin.py", sha(b"\0"), b"\0")]
    df = spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in rows], "repo string, path string, blob_sha string, content binary")
    got = contents.accept(df, Settings(file_cap=10)).withColumns({"size": F.octet_length("content").cast("long"), "method": F.lit("raw")})
    assert {r.path: r.refused for r in got.collect()} == {"ok.py": None, "big.py": "too_large", "other.py": "integrity_mismatch", "bin.py": "binary"}
    wanted = df.unionByName(df.limit(1).withColumn("path", F.lit("gone.py")))
    report = contents.failure_guard(contents.fetch_report(wanted, got)).first()
    assert (report.requested, report.fetched, report.bytes) == (5, 1, 1) and report.failed["gone.py"] == "not_found" and report.aborted and report.message.startswith("4 of 5")


def test_walk_and_snapshots(spark):
    entries = [("t0", "a", "tree", "t1", None), ("t0", "x.py", "blob", "b1", 3), ("t1", "y.py", "blob", "b2", None), ("t1", "sub", "commit", "m", None)]
    got = repos.walk_trees(spark.createDataFrame([("r", "t0"), ("s", "t1")], "repo string, tree_sha string"), spark.createDataFrame(entries, "parent_sha string, name string, type string, sha string, size long"))
    assert {tuple(r) for r in got.collect()} == {("r", "x.py", 3, "b1"), ("r", "a/y.py", 0, "b2"), ("s", "y.py", 0, "b2")}
    asked = spark.createDataFrame([("r", None), ("r", "dev"), ("q", None)], "repo string, ref string")
    good, bad = repos.snapshots(asked, spark.createDataFrame([("r", "main")], "repo string, default_branch string"), spark.createDataFrame([("r", "main", "c1")], "repo string, ref string, commit_sha string"))
    assert [tuple(r) for r in good.collect()] == [("r", "main", "c1")] and bad.count() == 2


def test_top_k(spark):
    chunks = spark.createDataFrame([("a", "r", [1.0, 0.0]), ("b", "r", [0.0, 1.0]), ("c", "r", [0.0, 0.0]), ("d", "s", [1.0, 0.0]), ("e", "r", [2.0, 0.0])], "id string, repo string, embedding array<float>")
    asked = spark.createDataFrame([("q", "r", [0.9, 0.1]), ("z", "t", [1.0, 0.0])], "query_id string, repo string, vector array<float>")
    for found in (search.top_k(asked, chunks, 10), search.top_k_sql(asked, chunks, 10)):
        assert [(r["rank"], r.id) for r in found.orderBy("rank").collect()] == [(1, "a"), (2, "e"), (3, "b"), (4, "c")]


def test_overlaps(spark):
    chunks = spark.createDataFrame([("r", "p", i, i * 8 + 1, i * 8 + 10, str(i), "") for i in range(5)], "repo string, path string, chunk_index int, start_line int, end_line int, id string, text string")
    hits = spark.createDataFrame([("q", 1, "r", "p", 10, 17), ("q", 2, "r", "p", 100, 120)], "query_id string, rank int, repo string, path string, parent_start_line int, parent_end_line int")
    got = search.expand_parents(hits, chunks).collect()
    assert [[c.id for c in r.context] for r in got] == [["0", "1", "2"]]


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("r", "a", 1), ("r", "b", 1), ("s", "a", 1)], "repo string, path string, v int")
    new = spark.createDataFrame([("r", "a", 2, 1), ("r", "a", 3, 2), ("t", "x", 9, 1)], "repo string, path string, v int, seq int")
    now = store.upsert(old, new, ["repo", "path"], "seq")
    assert {tuple(r) for r in now.collect()} == {("r", "a", 3), ("r", "b", 1), ("s", "a", 1), ("t", "x", 9)}
    kept, deleted = store.delete_files(now, spark.createDataFrame([("r", "a"), ("r", "zz")], "repo string, path string"))
    assert kept.count() == 3 and [tuple(r) for r in deleted.collect()] == [("r", 1)]
    assert store.delete_repos(now, spark.createDataFrame([("r",)], "repo string")).count() == 2
    path = str(tmp_path / "t")
    store.write(now, path)
    store.write(now.filter("repo = 'r'").withColumn("v", F.lit(7)), path, spark.createDataFrame([("r",)], "repo string"))
    got = {(r.repo, r.path): r.v for r in spark.read.parquet(path).collect()}
    assert got["r", "a"] == 7 and got["r", "b"] == 7
    events = spark.createDataFrame([("j", "queued", 1, 1), ("j", "running", 2, 2), ("k", "failed", 1, 3)], "id string, status string, updated_at int, seq int")
    assert {r.id: r.status for r in store.current_jobs(events).collect()} == {"j": "running", "k": "failed"}


def test_incremental_run(spark):
    file = "repo string, path string, blob_sha string"
    ledger = spark.createDataFrame([("r", "same", "1"), ("r", "old", "1"), ("r", "gone", "1"), ("r", "bad", "1")], file)
    selected = spark.createDataFrame([("r", "same", "1"), ("r", "old", "2"), ("r", "new", "1"), ("r", "bad", "2")], file)
    changes = index.diff(selected, ledger)
    assert {r.path: r.status for r in changes.collect()} == {"same": "unchanged", "old": "changed", "new": "added", "gone": "removed", "bad": "changed"}
    done = selected.filter("path in ('old', 'new')")
    chunks, after = index.apply(ledger, ledger, changes, selected, done)
    assert {(r.path, r.blob_sha) for r in after.collect()} == {("same", "1"), ("old", "2"), ("new", "1"), ("bad", "1")} == {(r.path, r.blob_sha) for r in chunks.collect()}
    again = {r.path: r.status for r in index.diff(selected, after).collect()}
    assert again == {"same": "unchanged", "old": "unchanged", "new": "unchanged", "bad": "changed"}
    record = index.repo_records(spark.createDataFrame([("r", "c2")], "repo string, commit_sha string"), selected, selected.filter("path = 'bad'")).first()
    assert (record.file_count, record.indexed_sha) == (3, None)


def test_repo_map(spark):
    listing = spark.createDataFrame([("r", i, p) for i, p in enumerate(["src/a.py", "src/x/b.py", "README.md", "node_modules/m.js", "c.css"])], "repo string, ord long, path string")
    heads = spark.createDataFrame([("r", "o/r", "main", "0123456789")], "repo string, full_name string, ref string, commit_sha string")
    row = repomap.build(heads, listing, listing.filter("path like '%.py' or path like '%.md'"), spark.createDataFrame([("r", " hello\nyou ")], "repo string, text string")).first()
    assert row.text.split("\n") == ["## Overview", "Repository: o/r @ main (commit 0123456)", "Indexed files: 3 (python 2, markdown 1)", "", "## Directory structure (4 files)", "README.md", "c.css", "src/", "  a.py", "  x/", "    b.py", "", "## README excerpt", "hello", "you", ""]
    assert [tuple(u)[:3] for u in row.units] == [(1, 3, "Repo map > Overview"), (5, 11, "Repo map > Directory structure (4 files)"), (13, 15, "Repo map > README excerpt")]
    many = spark.createDataFrame([("r", i, f"d{i % 3}/e/f{i}.py") for i in range(200)] + [("r", 999, "top.py")], "repo string, ord long, path string")
    lines = [r.line for r in repomap.tree(many, many).orderBy("ord").collect()]
    assert lines == ["d0/e/ (67 files)", "d1/e/ (67 files)", "d2/e/ (66 files)", "top.py"]


def test_embedder_and_dim(spark):
    df = spark.createDataFrame([("a b a",), (None,), ("",)], "embed_text string")
    got = embed.with_embedder(df, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()
    assert [r.embedding for r in got] == [[5.0, 1.0], [0.0, 1.0], [0.0, 1.0]]
    good, bad = embed.check_dim(spark.createDataFrame([([1.0],), ([1.0, 2.0],), (None,)], "embedding array<float>"), 2)
    assert good.count() == 1 and bad.count() == 2
    unit = spark.createDataFrame([("water river water",)], "t string").select(embed.hash_embed(F.col("t"), 32).alias("v")).first().v
    assert sum(x * x for x in unit) == pytest.approx(1.0)


def test_stream_resumes(spark, tmp_path, monkeypatch):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "index")
    rows = [("r", f"f{i}.py", f"s{i}", f"def f{i}():\n    return {i}\n") for i in range(12)]
    spark.createDataFrame(rows, index_stream.FILES).repartition(6).write.parquet(landed)
    whole = index_stream.process

    def breaks_off(root, settings):
        run = whole(root, settings)

        def once(batch, number):
            if number == 1:
                raise RuntimeError("crash")
            run(batch, number)

        return once

    monkeypatch.setattr(index_stream, "process", breaks_off)
    with pytest.raises(Exception, match="crash"):
        index_stream.index_stream(spark, landed, root, files_per_batch=2).awaitTermination()
    part = index_stream.ledger(spark, root).count()
    assert 0 < part < 12
    monkeypatch.setattr(index_stream, "process", whole)
    index_stream.index_stream(spark, landed, root, files_per_batch=2).awaitTermination()
    assert index_stream.ledger(spark, root).count() == 12 and index_stream.stored_chunks(spark, root).count() == 12
    spark.createDataFrame([("r", "f0.py", "new", "x = 1\n")], index_stream.FILES).write.mode("append").parquet(landed)
    index_stream.index_stream(spark, landed, root).awaitTermination()
    chunks = index_stream.stored_chunks(spark, root)
    assert chunks.count() == 12 and chunks.filter("path = 'f0.py'").first().text == "x = 1"


def test_stream_forgets_gone_files_and_keeps_vectors(spark, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "index")

    def land(*rows):
        spark.createDataFrame(rows, index_stream.FILES).coalesce(1).write.mode("append").parquet(landed)
        index_stream.index_stream(spark, landed, root).awaitTermination()
        return sorted((r.path, r.text, len(r.embedding)) for r in index_stream.stored_chunks(spark, root).collect())

    assert land(("r", "a.py", "a1", "a = 1"), ("r", "b.py", "b1", "b = 1"), ("r", "b.py", "b1", "b = 1"), ("r", "never.py", None, None)) == [("a.py", "a = 1", 384), ("b.py", "b = 1", 384)]
    assert land(("r", "a.py", None, None), ("r", "b.py", "b2", "b = 2")) == [("b.py", "b = 2", 384)]
    assert land(("r", "a.py", "a1", "a = 1"), ("r", "b.py", "b2", "b = 2")) == [("a.py", "a = 1", 384), ("b.py", "b = 2", 384)]  # back again; b.py as it was
    named = spark.read.schema(index_stream.LEDGER).parquet(f"{root}/ledger")
    assert named.filter("path = 'b.py'").count() == 2 and not named.filter("path = 'never.py'").count()


def test_a_bucket_that_lost_all_rows_is_emptied(spark, tmp_path):
    from codelode.operators import store

    rows = [(f"r{i}", "p", i) for i in range(40)]
    table = spark.createDataFrame(rows, "repo string, path string, n int")
    store.write(table, f"{tmp_path}/t")
    gone = spark.createDataFrame([(f"r{i}",) for i in range(0, 40, 3)], "repo string")
    after = spark.createDataFrame([r for r in rows if int(r[0][1:]) % 3], "repo string, path string, n int")
    store.write(after, f"{tmp_path}/t", touched=gone)
    assert sorted(r.repo for r in spark.read.parquet(f"{tmp_path}/t").collect()) == sorted(r.repo for r in after.collect())


def test_deep_trees_and_missing_contents(spark):
    from codelode.sources import contents, repos

    entries = spark.createDataFrame([(f"t{i}", "d", "tree", f"t{i + 1}", None) for i in range(5)] + [("t5", "f.py", "blob", "b", 3)], "parent_sha string, name string, type string, sha string, size long")
    roots = spark.createDataFrame([("r", "t0")], "repo string, tree_sha string")
    assert [r.path for r in repos.walk_trees(roots, entries).collect()] == ["d/d/d/d/d/f.py"]
    loop = spark.createDataFrame([("t0", "d", "tree", "t0", None)], "parent_sha string, name string, type string, sha string, size long")
    with pytest.raises(ValueError):
        repos.walk_trees(roots, loop)
    assert [r.broken for r in landed.untar(spark.createDataFrame([("r", None)], "repo string, content binary")).collect()] == [True]


def test_odd_vectors_take_no_part(spark):
    from codelode.operators.search import top_k

    chunks = spark.createDataFrame([("a", "r", [1.0, 0.0]), ("b", "r", None), ("c", "r", [1.0]), ("d", "r", [None, 1.0]), ("e", "r", [0.0, 1.0])], "id string, repo string, embedding array<double>")
    asked = spark.createDataFrame([("q", "r", [1.0, 0.1]), ("n", "r", None)], "query_id string, repo string, vector array<double>")
    assert [(r.query_id, r.id) for r in sorted(top_k(asked, chunks, 5).collect(), key=lambda r: r.rank)] == [("q", "a"), ("q", "e")]


def test_hash_embed_and_running_tokens_by_plain_loops(spark):
    import hashlib
    import math
    import re

    from codelode.operators.chunk import running_tokens

    texts = ["water river water", "", None, "a\n\nb c\n", "ÄÖ Kelvin x_1 x_1 " + "w " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1)
    for r in rows.select("t", embed.hash_embed(F.col("t"), 384).alias("v"), running_tokens(F.col("t")).alias("n")).collect():
        if r.t is None:
            assert r.v is None and r.n is None
            continue
        counts = [0] * 384
        for w in re.findall("[a-z0-9_]+", r.t.lower()):
            counts[int(hashlib.md5(w.encode()).hexdigest(), 16) % 384] += 1
        norm = math.sqrt(sum(c * c for c in counts)) or 1
        assert r.v == pytest.approx([c / norm for c in counts])
        lines = r.t.split("\n")
        assert r.n == [sum(len(x.split()) for x in lines[: i + 1]) for i in range(len(lines))]


def test_the_version_that_landed_last_holds(spark, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "index")
    rows = [("r", "a.py", "old", "x = 1\n"), ("r", "a.py", "new", "x = 2\n"), ("r", "b.py", "only", "y = 1\n")]
    spark.createDataFrame(rows, index_stream.FILES).coalesce(1).write.parquet(landed)
    index_stream.index_stream(spark, landed, root).awaitTermination()
    assert {(r.path, r.blob_sha) for r in index_stream.ledger(spark, root).collect()} == {("a.py", "new"), ("b.py", "only")}
    assert {(r.path, r.text) for r in index_stream.stored_chunks(spark, root).collect()} == {("a.py", "x = 2"), ("b.py", "y = 1")}


class KnownFiles(dict):
    """A map in a state, and the handle that gives it."""

    def getMapState(self, *_):
        return self

    getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.__delitem__


def test_stream_meets_the_state_by_slots_not_by_files():
    known = KnownFiles({("r", "same.py"): ("s",), ("r", "gone.py"): ("g",), ("r", "back.py"): ("b",)})
    step = index_stream.LastVersions()
    step.init(known)
    rows = [("r", f"f{i}.py", f"v{v}", f"text {v}", v, "a.parquet", i) for i in range(50) for v in (2, 3, 1)]
    rows += [("r", "same.py", "s", "t", 1, "a.parquet", 60), ("r", "gone.py", None, None, 1, "a.parquet", 61), ("r", "never.py", None, None, 1, "a.parquet", 62), ("r", None, "n", "t", 1, "a.parquet", 63)]
    rows += [("r", "back.py", None, None, 1, "a.parquet", 64), ("r", "back.py", "b", "t", 1, "a.parquet", 65)]
    columns = ["repo", "path", "blob_sha", "text", "landed_at", "landed_in", "landed_row"]
    parts = [pd.DataFrame(rows[i : i + 40], columns=columns) for i in range(0, len(rows), 40)]
    frames = list(step.handleInputRows((7,), iter(parts), None))
    assert len(frames) == 1  # a frame for a slot: one for each file was a third of the stream's time
    found = {r.path: (r.blob_sha, r.text) for r in frames[0].itertuples()}
    assert found == {f"f{i}.py": ("v3", "text 3") for i in range(50)} | {"gone.py": (None, None), None: ("n", "t")}
    assert known == {("r", p): (sha,) for p, (sha, _) in found.items() if sha} | {("r", "same.py"): ("s",), ("r", "back.py"): ("b",)}
    assert not list(step.handleInputRows((7,), iter(parts), None))
