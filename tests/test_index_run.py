"""Runs of the index job: first, incremental, with a failure, up to date, forced, guarded, broken off; searched by its stored vectors."""

from __future__ import annotations

import hashlib
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from codelode.config import Settings
from codelode.jobs import search
from codelode.jobs.index_run import jobs, open_index, run, stored_table
from codelode.operators.tablelog import TableLog
from codelode.sources import landed

HEADS = "repo string, full_name string, ref string, commit_sha string, forced boolean"
LISTING = "repo string, ord long, path string, blob_sha string, size long"
CONTENTS = "repo string, path string, content binary"


def sha(data: bytes) -> str:
    return hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()


def go(spark, root: str, files: dict[str, dict[str, str | None]], commit: str, forced: bool = False, model: str = "hash", settings: Settings = Settings(failed_share=0.5), landed: dict | None = None):
    """landed: contents by (repo, path) that are others than listed."""
    heads = spark.createDataFrame([(r, f"acme/{r}", "main", commit, forced) for r in files], HEADS)
    rows = [(r, i, p, sha((t or p).encode()), 10) for r, of in files.items() for i, (p, t) in enumerate(of.items())]
    contents = {(r, p): t.encode() for r, of in files.items() for p, t in of.items() if t is not None} | (landed or {})
    found = run(heads, spark.createDataFrame(rows, LISTING), spark.createDataFrame([(*k, bytearray(c)) for k, c in contents.items()], CONTENTS), root, settings, model)
    return {x.repo: x for x in found.collect()}


def texts(spark, root: str) -> dict[tuple[str, str], str]:
    return {(r.repo, r.path): r.text for r in stored_table(spark, root, "chunks").filter("path <> '<repo-map>'").collect()}


def test_runs(spark, tmp_path):
    root = str(tmp_path / "index")
    first = go(spark, root, {"a": {"README.md": "# A\nriver boats\n", "x.py": "x = 1\n", "y.py": "y = 1\n"}, "b": {"z.py": "z = 1\n"}}, "c1")
    assert (first["a"].files_fetched, first["a"].files_removed, first["b"].files_selected) == (3, 0, 1)
    assert texts(spark, root)[("a", "x.py")] == "x = 1" and len(texts(spark, root)) == 4
    maps = stored_table(spark, root, "chunks").filter("path = '<repo-map>'")
    assert maps.select("repo").distinct().count() == 2 and maps.filter(F.size("embedding") != 384).isEmpty()

    # one file is gone, one changed, one is new but its content isn't there; the other repository isn't touched
    second = go(spark, root, {"a": {"README.md": "# A\nriver boats\n", "x.py": "x = 2\n", "w.py": None}}, "c2")
    assert (second["a"].files_fetched, second["a"].files_removed, second["a"].files_unchanged, list(second["a"].failed)) == (1, 1, 1, ["w.py"])
    assert texts(spark, root) == {("a", "README.md"): "# A\nriver boats", ("a", "x.py"): "x = 2", ("b", "z.py"): "z = 1"}
    assert {(r.repo, r.path) for r in stored_table(spark, root, "ledger").collect()} == {("a", "README.md"), ("a", "x.py"), ("b", "z.py")}
    records = {r.repo: (r.indexed_sha, r.file_count) for r in stored_table(spark, root, "repos").collect()}
    assert records == {"a": (None, 2), "b": ("c1", 1)}

    # the failure is taken again at the same commit, and then all is up to date
    third = go(spark, root, {"a": {"README.md": "# A\nriver boats\n", "x.py": "x = 2\n", "w.py": "w = 1\n"}}, "c2")
    assert third["a"].files_fetched == 1 and texts(spark, root)[("a", "w.py")] == "w = 1"
    again = go(spark, root, {"a": {"x.py": "x = 3\n"}}, "c2")
    assert again["a"].up_to_date and ("a", "w.py") in texts(spark, root)
    # forced, or vectors of another model: everything anew
    assert go(spark, root, {"a": {"x.py": "x = 2\n"}}, "c2", forced=True)["a"].files_fetched == 1
    assert texts(spark, root) == {("a", "x.py"): "x = 2", ("b", "z.py"): "z = 1"}
    assert go(spark, root, {"b": {"z.py": "z = 1\n"}}, "c1", model="other")["b"].files_fetched == 1

    spark.createDataFrame([("q", "a", "x")], "query_id string, repo string, text string").write.parquet(str(tmp_path / "asked"))
    search.main(str(tmp_path / "asked"), root, str(tmp_path / "hits"))
    assert {r.repo for r in spark.read.parquet(str(tmp_path / "hits")).collect()} == {"a"}
    assert stored_table(spark, root, "chunks").schema["embedding"].dataType.simpleString() == "array<float>"
    states = [r.status for r in jobs(spark, root).collect()]
    assert states.count("succeeded") == len(states) == 6


def index_of(spark, root: str) -> dict[str, set]:
    """What readers see, without vectors."""
    return {t: {tuple(r) for r in stored_table(spark, root, t).drop("embedding").collect()} for t in ("chunks", "ledger", "repos")}


def test_guarded_batch(spark, tmp_path):
    """A wrong hash, a binary, a missing content; a repository of which too many fail, and one above the byte limit."""
    root = str(tmp_path / "index")
    good = {f"f{i}.py": f"x = {i}\n" for i in range(12)}
    files = {"ok": good | {"wrong.py": "right\n", "bin.py": "b\n", "none.py": None}, "bad": {f"g{i}.py": None if i < 3 else "y = 1\n" for i in range(9)}, "big": {"h.py": "z" * 400, "i.py": "z" * 401}}
    zero = b"a\0b"
    landed = {("ok", "wrong.py"): b"other\n", ("ok", "bin.py"): zero}
    settings = Settings(repo_bytes=800)
    got = go(spark, root, files, "c1", settings=settings, landed=landed)
    assert {p: got["ok"].failed[p] for p in got["ok"].failed} == {"wrong.py": "integrity_mismatch", "bin.py": "integrity_mismatch", "none.py": "not_found"}
    assert got["ok"].refused is None and got["ok"].files_fetched == 12
    assert got["bad"].refused == "3 of 9 files failed: g0.py: not_found, g1.py: not_found, g2.py: not_found" and got["bad"].chunk_count == 0
    assert got["big"].refused == "801 bytes, the limit is 800"
    seen = index_of(spark, root)
    assert {r[1] for r in seen["chunks"]} == {"ok"} and {r[0] for r in seen["repos"]} == {"ok"} and {r[0] for r in seen["ledger"]} == {"ok"}
    held = {(r.repo, r.path): r.reason for r in stored_table(spark, root, "quarantine").collect()}
    assert held == {("ok", "wrong.py"): "integrity_mismatch", ("ok", "bin.py"): "integrity_mismatch", ("ok", "none.py"): "not_found", **{("bad", f"g{i}.py"): "not_found" for i in range(3)}}
    ends = {r.repo: (r.status, r.error, r.files_done) for r in jobs(spark, root).collect()}
    assert ends == {"ok": ("succeeded", None, 12), "bad": ("failed", f"Refused: {got['bad'].refused}", 0), "big": ("failed", f"Refused: {got['big'].refused}", 0)}
    info = open_index(spark, root).latest().info  # gathered while chunks are written
    assert info["chunks"] == sum(r.chunks_written for r in got.values()) == stored_table(spark, root, "chunks").count() and info["tokens"] > 0
    order = [r.status for r in stored_table(spark, root, "jobs").filter("repo = 'ok'").orderBy("seq").collect()]
    assert order == ["queued", "running", "succeeded"]


V1 = {"a": {f"f{i}.py": f"x = {i}\n" for i in range(6)}, "b": {"README.md": "# B\nboats\n"}}
V2 = {"a": {**{f"f{i}.py": f"x = {i}\n" for i in range(1, 6)}, "f1.py": "changed = 1\n", "new.py": "n = 1\n"}, "b": {"README.md": "# B\nships\n"}}


@pytest.fixture(scope="module")
def undisturbed(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("undisturbed"))
    go(spark, root, V1, "c1")
    first = index_of(spark, root)
    go(spark, root, V2, "c2")
    return [first, index_of(spark, root)]


POINTS = ["gone", "chunks", "ledger", "repos", "jobs", "publish"]


def breaking(point):
    """The log's writes, of which the one that is named fails once it has been done (a commit: before it has its name)."""
    stage, stage_gone, publish = TableLog.stage, TableLog.stage_gone, TableLog.publish

    def staged(self, table, rows, *a, **b):
        out = stage(self, table, rows, *a, **b)
        if table == point and (table != "jobs" or not rows.filter("status = 'succeeded'").isEmpty()):
            raise OSError("lost")
        return out

    def staged_gone(self, keys):
        out = stage_gone(self, keys)
        if point == "gone":
            raise OSError("lost")
        return out

    def published(self, version):
        if point == "publish" and version.info.get("status") == "succeeded":
            raise OSError("lost")
        return publish(self, version)

    return {"stage": staged, "stage_gone": staged_gone, "publish": published}


def test_broken_off_runs(spark, tmp_path, undisturbed):
    """A failure after any write leaves the index as it was; the next run gives the tables of an undisturbed one."""
    root = str(tmp_path / "index")
    go(spark, root, V1, "c1")
    before = index_of(spark, root)
    for n, point in enumerate(POINTS):
        with pytest.MonkeyPatch.context() as patch:
            for name, f in breaking(point).items():
                patch.setattr(TableLog, name, f)
            with pytest.raises(OSError, match="lost"):
                go(spark, root, V2, "c2")
        assert index_of(spark, root) == before == undisturbed[0]
        ends = jobs(spark, root).filter("status = 'failed'").collect()
        assert len(ends) == 2 * (n + 1) and {(r.repo, r.error) for r in ends} == {("a", "OSError: lost"), ("b", "OSError: lost")}
    go(spark, root, V2, "c2")
    assert index_of(spark, root) == undisturbed[1]
    log = open_index(spark, root)
    log.compact(whole=True, least=2)
    assert index_of(spark, root) == undisturbed[1] and len(log.latest().segments["chunks"]) == 1


def test_landed_contents(spark, tmp_path):
    """A run opens what is new or changed, and READMEs: from the archive where many files are wanted, as single files else."""
    root, folder = str(tmp_path / "index"), str(tmp_path / "landed")
    v1 = {"README.md": "# A\nriver boats\n", **{f"f{i}.py": f"x = {i}\n" for i in range(8)}}
    v2 = v1 | {"f1.py": "x = 'two'\n", "new.py": "y = 1\n"}
    del v2["f7.py"]
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for path, text in v1.items():
            info = tarfile.TarInfo(f"a-c1/{path}")
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    # of the second commit only what has to be opened has landed
    single = {("b", "c1", "z.py"): b"z = 1\n", ("a", "c1", ".tar.gz"): out.getvalue()} | {("a", "c2", p): v2[p].encode() for p in ("README.md", "f1.py", "new.py")}
    landed.land(spark.createDataFrame([(*k, bytearray(v)) for k, v in single.items()], "repo string, commit_sha string, path string, content binary"), folder)
    archives = spark.createDataFrame([("a", "c1", ".tar.gz")], "repo string, commit_sha string, path string")
    settings = Settings(archive_from=5)

    def step(commit, files):
        heads = spark.createDataFrame([(r, f"acme/{r}", "main", commit, False) for r in files], HEADS)
        listing = spark.createDataFrame([(r, i, p, sha(t.encode()), len(t)) for r, of in files.items() for i, (p, t) in enumerate(of.items())], LISTING)
        return {x.repo: x for x in run(heads, listing, landed.contents_in(spark, folder, archives, settings), root, settings).collect()}

    first = step("c1", {"a": v1, "b": {"z.py": "z = 1\n"}})
    assert (first["a"].files_fetched, first["b"].files_fetched, first["a"].refused) == (9, 1, None)
    second = step("c2", {"a": v2})
    assert (second["a"].files_fetched, second["a"].files_removed, second["a"].files_unchanged, second["a"].refused) == (2, 1, 7, None)
    assert texts(spark, root) == {("a", p): t.strip() for p, t in v2.items()} | {("b", "z.py"): "z = 1"}
    assert {r.text.count("river boats") for r in stored_table(spark, root, "chunks").filter("path = '<repo-map>' and repo = 'a'").collect()} == {1}
