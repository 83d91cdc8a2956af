"""Landed files and archives: what is opened, what is found, how much memory it takes."""

from __future__ import annotations

import gzip
import hashlib
import io
import resource
import subprocess
import sys
import tarfile
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codelode.config import Settings
from codelode.functions.parts import as_column
from codelode.queries.contents import archives
from codelode.sources import landed

FILES = {("a__x", "c1", "src/m.py"): b"one", ("a__x", "c1", "doc/r 1%.md"): b"two", ("a__x", "c2", "src/m.py"): b"three", ("b__y", "c1", "src/m.py"): b"\0\xff", ("b__y", "c1", "e.py"): b""}


def rows_of(spark, files):
    return spark.createDataFrame([(*k, bytearray(v)) for k, v in files.items()], "repo string, commit_sha string, path string, content binary")


def got(df):
    return {(r.repo, r.commit_sha, r.path): bytes(r.content) for r in df.collect()}


@pytest.fixture
def folder(spark, tmp_path):
    landed.land(rows_of(spark, FILES), str(tmp_path))
    return str(tmp_path)


@pytest.fixture
def pushdown(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_lands_and_reads_back(spark, folder, tmp_path):
    assert got(landed.landed(spark, folder)) == FILES
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a__x", "b__y"]  # nothing unfinished is left
    landed.land(rows_of(spark, {("a__x", "c1", "src/m.py"): b"again"}), folder)
    assert got(landed.landed(spark, f"file://{folder}"))[("a__x", "c1", "src/m.py")] == b"again"
    assert not landed.landed(spark, f"{folder}/none").count()


def test_columns_decide_what_is_opened(spark, folder, tmp_path):
    place = tmp_path / "b__y" / "c1" / "e.py"
    place.chmod(0)
    names = landed.landed(spark, folder, "path string, size long").collect()
    assert sorted((r.path, r["size"]) for r in names) == sorted((k[2], len(v)) for k, v in FILES.items())


@pytest.mark.parametrize("condition", ["repo = 'a__x'", "repo in ('a__x', 'none') and commit_sha = 'c1'", "path = 'src/m.py'", "path like 'src/%'", "repo = 'b__y' and path like 'e%'", "repo = '..'", "repo = 'a__x' and repo = 'b__y'", "path in ('../c2/src/m.py', 'e.py')", "length(path) > 5", "repo is null"])
def test_filters(spark, folder, pushdown, condition):
    df = landed.landed(spark, folder).filter(condition)
    expected = rows_of(spark, FILES).filter(condition)
    assert got(df) == got(expected)


def test_other_repositories_are_not_listed():
    asked = []

    class System:
        def get_file_info(self, what):
            asked.append(what.base_dir if hasattr(what, "base_dir") else what)
            return []

    reader = landed.PruningReader("/top", landed.StructType())
    assert list(reader.pushFilters([landed.EqualTo(("repo",), "a__x"), landed.EqualTo(("commit_sha",), "c1"), landed.StringStartsWith(("path",), "src/m")])) == []
    original = landed.opened
    landed.opened = lambda _: (System(), "/top")
    try:
        assert list(reader.files()) == []
    finally:
        landed.opened = original
    assert asked == ["/top/a__x/c1/src"]


def test_partitions_by_bytes(spark, folder, monkeypatch):
    reader = landed.LandedReader(folder, landed.StructType())
    assert [len(p.files) for p in reader.partitions()] == [5]
    monkeypatch.setattr(landed, "TASK_BYTES", 5)
    assert sorted(k for p in reader.partitions() for k in p.files) == sorted((*k, len(v)) for k, v in FILES.items()) and all(sum(f[3] for f in p.files) <= 5 for p in reader.partitions())


def test_read_landed_opens_what_is_listed(spark, folder, tmp_path):
    (tmp_path / "b__y").chmod(0)  # of another repository nothing is touched
    wanted = spark.createDataFrame([("a__x", "c1", "src/m.py", 3, "kept"), ("a__x", "c1", "src/m.py", 3, "twice"), ("a__x", "c1", "gone.py", 1, "x"), ("a__x", "c1", "../c2/src/m.py", 5, "x"), ("a__x", "c1", "src", 0, "folder"), ("a__x", None, "src/m.py", None, "x"), ("..", "a__x", "c1/src/m.py", 1, "x")], "repo string, commit_sha string, path string, size long, content string")
    found = landed.read_landed(spark, folder, wanted)
    assert [bytes(r.content) for r in found.collect()] == [b"one", b"one"] and found.columns == ["repo", "commit_sha", "path", "size", "content"]
    assert not landed.read_landed(spark, folder, wanted.limit(0)).count()
    assert wanted.columns[-1] == "content" and wanted.drop("content").schema.names == ["repo", "commit_sha", "path", "size"]


def test_too_large_objects_are_cut_for_refusal(spark, folder):
    landed.land(rows_of(spark, {("a__x", "c1", "big.py"): b"x" * 1000}), folder)
    wanted = spark.createDataFrame([("a__x", "c1", "big.py")], "repo string, commit_sha string, path string")
    assert len(landed.read_landed(spark, folder, wanted, Settings(file_cap=10, notebook_cap=20)).first().content) == 21


def test_no_place_is_an_error(spark, tmp_path):
    for bad in [("r", "c", "../x"), ("r/s", "c", "x"), ("r", None, "x")]:
        with pytest.raises(Exception, match="no place"):
            landed.land(spark.createDataFrame([(*bad, bytearray(b"x"))], "repo string, commit_sha string, path string, content binary"), str(tmp_path))


def tar(members, n=1):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz", compresslevel=n, encoding="latin-1", format=tarfile.GNU_FORMAT) as t:
        for name, raw in members:
            info = tarfile.TarInfo(f"top/{name}")
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
    return out.getvalue()


def test_odd_archives(spark):
    odd = {"latin": tar([("\xe9.py", b"x")]), "none": None, "empty": tar([]), "gz": gzip.compress(b"no tar"), "zero": b"", "flipped": bytearray(tar([("a.py", b"abc" * 50)]))}
    odd["flipped"][30] ^= 255
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in odd.items()], "repo string, content binary")
    found = {}
    for r in landed.untar(df).collect():
        found.setdefault(r.repo, []).append((r.path, r.broken))
    assert found.pop("latin") == [("�.py", False)] and "empty" not in found
    assert {k: v[-1] for k, v in found.items()} == {k: (None, True) for k in ("none", "gz", "zero", "flipped")}
    assert not landed.untar(df.limit(0)).count()


def test_batches_are_bounded():
    rows = [("r", "p", bytes(3 << 20), False)] * 7 + [("r", "p", bytes(20 << 20), False)] + [("r", "p", b"", False)] * 3000 + [("r", None, None, True)]
    sizes = [(b.num_rows, sum(len(x or b"") for x in b.column(2).to_pylist())) for b in landed.in_batches(iter(rows), landed.MEMBERS)]
    assert sum(n for n, _ in sizes) == len(rows) and max(n for n, _ in sizes) <= landed.BATCH_ROWS
    assert all(size <= landed.BATCH_BYTES for n, size in sizes if n > 1)


def test_columns_are_made_without_pandas():
    for kind, values in [(pa.string(), ["a", None, "", "\xe9" * 3]), (pa.binary(), [b"", None, b"\0\xff"]), (pa.string(), [None] * 9), (pa.binary(), []), (pa.bool_(), [True, False, True] * 5), (pa.int64(), [1, -(1 << 40)])]:
        made = as_column(values, kind)
        made.validate(full=True)
        assert made.type == kind and made.to_pylist() == values
    code = "import sys; from codelode.sources import landed as l; n = [b.num_rows for b in l.in_batches(iter([('r', 'p', b'x', False), ('r', None, None, True)]), l.MEMBERS)]; assert n == [2] and 'pandas' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


def test_memory_of_an_archive_that_compresses_well():
    """200 MB of zeros in 200 KB: a block of the archive is inflated in small parts."""
    packed = tar(((f"f{i}.py", bytes(500_000)) for i in range(400)), 9)
    assert len(packed) < 1 << 20
    tracemalloc.start()
    try:
        assert sum(len(raw) for _, raw, _ in landed.members(io.BytesIO(packed), Settings())) == 200_000_000
        assert tracemalloc.get_traced_memory()[1] < 80 << 20
    finally:
        tracemalloc.stop()


def test_archives_are_packed_by_arrow_batches(spark):
    rows = [("r", f"{i}.py", "\xe9" * i) for i in range(9)] + [("r", "none.py", None), ("s", "none.py", None), ("t", "e.py", "")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        packed = archives(spark.createDataFrame(rows, "repo string, path string, text string"))
        assert "InPandas" not in packed._jdf.queryExecution().optimizedPlan().toString()
        got = landed.untar(packed).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.repo, r.path, bytes(r.content).decode(), r.broken) for r in got) == [(*r, False) for r in sorted(r for r in rows if r[2] is not None)]


def test_memory_of_a_large_archive(spark, tmp_path):
    """50,000 members of 4 KB that don't compress (200 MB): the most that a worker holds, whole archive as a stream."""
    raw = b"".join(hashlib.sha512(i.to_bytes(8, "big")).digest() for i in range(64)) * 50
    data = tar(((f"d/f{i}.py", raw[i % 4096 : i % 4096 + 4096]) for i in range(50_000)), 0)
    assert len(data) > 200 << 20
    place = tmp_path / "r" / "c" / "1.tar.gz"
    place.parent.mkdir(parents=True)
    place.write_bytes(data)
    del data
    archives = spark.createDataFrame([("r", "c", "1.tar.gz")], "repo string, commit_sha string, path string")

    def peak(batches):
        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_pydict({"n": [n], "kb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss]})

    found = landed.untar_landed(spark, str(tmp_path), archives, Settings(archive_cap=300 << 20))
    per_task = found.mapInArrow(peak, "n long, kb long").collect()
    assert sum(r.n for r in per_task) == 50_000 and max(r.kb for r in per_task) < 500_000


@pytest.mark.parametrize("known", [True, False])
def test_fetch(spark, tmp_path, known):
    """large: archive; torn: half an archive, the rest as single files; absent: no archive landed; unlisted: none named; small: no archive asked."""
    wanted, single, whole = [], {}, {}
    for repo, n in {"large": 9, "torn": 400, "absent": 9, "unlisted": 9, "small": 3}.items():
        members = [(f"f{i}.py", hashlib.sha512(f"{repo}{i}".encode()).digest() * 20) for i in range(n)]
        wanted += [(repo, "c", p, len(raw)) for p, raw in members] * 2
        packed = tar([*members, ("unasked.py", b"x")], 6)
        whole[(repo, "c", "a.tar.gz")] = {"torn": packed[: len(packed) // 2], "small": b"never opened"}.get(repo, packed)
        if repo != "large":
            single |= {(repo, "c", p): raw for p, raw in members}
    del whole[("absent", "c", "a.tar.gz")], whole[("unlisted", "c", "a.tar.gz")]
    folder = str(tmp_path)
    landed.land(rows_of(spark, single | whole), folder)
    df = spark.createDataFrame(wanted, "repo string, commit_sha string, path string, size long")
    places = spark.createDataFrame([*whole, ("absent", "c", "a.tar.gz")], "repo string, commit_sha string, path string")
    got = landed.fetch_landed(spark, folder, df if known else df.drop("size"), places, Settings(archive_from=5)).select("repo", "path", F.octet_length("content").alias("n"), F.sha1("content").alias("h"), "via", "method").collect()
    assert {(r.repo, r.path) for r in got} == {(w[0], w[2]) for w in wanted} and len(got) == len(wanted) // 2
    assert all(r.h == hashlib.sha1(hashlib.sha512(f"{r.repo}{r.path[1:-3]}".encode()).digest() * 20).hexdigest() for r in got)
    kinds = {}
    for r in got:
        kinds.setdefault((r.repo, r.method), set()).add(r.via)
    assert kinds == {("large", "tarball"): {"tarball"}, ("torn", "tarball+raw"): {"tarball", "raw"}, ("absent", "tarball+raw"): {"raw"}, ("unlisted", "tarball+raw"): {"raw"}, ("small", "raw"): {"raw"}}
