"""Tables kept as deltas against a dictionary, and what they read and write."""

from __future__ import annotations

import random

import pytest

from codelode.operators import tablelog
from codelode.operators.tablelog import Conflict, Table, TableLog

TABLES = {"t": Table("repo string, path string, v int", ("repo", "path")), "r": Table("repo string, v int", ("repo",)), "e": Table("repo string, v int")}
FILE, REPO, GONE = "repo string, path string, v int", "repo string, v int", "repo string, path string"


@pytest.fixture
def log(spark, tmp_path):
    return TableLog(spark, str(tmp_path / "index"), TABLES)


def rows(log, table, version=None):
    return sorted(map(tuple, log.read(version or log.latest(), table).collect()))


def put(log, base, table, made, schema):
    return log.commit(base, {table: [log.stage(table, log.spark.createDataFrame(made, schema), len(made))[0]]})


def test_against_a_dictionary(spark, log):
    """Upserts, deletes of files and of repositories, and compactions, in any order."""
    rng, held, seen = random.Random(2), {}, []
    for step in range(9):
        keys = {(f"r{rng.randrange(4)}", f"p{rng.randrange(5)}") for _ in range(6)}
        gone = {(f"r{rng.randrange(4)}", f"p{rng.randrange(5)}") for _ in range(3)} - keys
        repo = {f"r{rng.randrange(4)}"} if step % 3 == 2 else set()
        new = [(*k, 10 * step + j) for k in keys for j in range(1 + step % 2)]
        held = {k: v for k, v in held.items() if k not in gone and k not in keys and k[0] not in repo} | {k: [x[2] for x in new if x[:2] == k] for k in keys}
        dead = log.stage_gone(spark.createDataFrame([*gone, *((r, None) for r in repo)], GONE))
        written, _ = log.stage("t", spark.createDataFrame(new, FILE), len(new))
        log.commit(log.latest(), {"t": [dead, written]})
        if step in (3, 4, 8):
            log.compact(2)
        expected = sorted((*k, v) for k, of in held.items() for v in of)
        assert rows(log, "t") == expected
        seen.append((log.latest(), expected))
    assert all(rows(log, "t", version) == expected for version, expected in seen)  # older versions stay as they were
    assert len(log.latest().segments["t"]) == 1 and not log.latest().segments["t"][0].gone


def test_keys_of_other_tables(log):
    put(log, log.latest(), "r", [("a", 1), ("b", 1)], REPO)
    put(log, log.latest(), "r", [("a", 2), ("c", 2)], REPO)
    put(log, log.latest(), "e", [("a", 1)], REPO)
    put(log, log.latest(), "e", [("a", 1)], REPO)
    for _ in range(2):
        assert rows(log, "r") == [("a", 2), ("b", 1), ("c", 2)] and rows(log, "e") == [("a", 1), ("a", 1)] and rows(log, "t") == []
        log.compact(2)


def test_conflicts(spark, log):
    of = lambda *repos: spark.createDataFrame([(r,) for r in repos], "repo string")
    base = log.latest()
    stage = lambda repo, v: {"r": [log.stage("r", spark.createDataFrame([(repo, v)], REPO), 1)[0]]}
    one, two, three = stage("a", 1), stage("b", 2), stage("a", 3)
    log.commit(base, one, touched=of("a"))
    log.commit(base, two, touched=of("b"))  # another repository: goes on, on top
    with pytest.raises(Conflict):
        log.commit(base, three, touched=of("a"))
    assert rows(log, "r") == [("a", 1), ("b", 2)]
    assert not log.publish(log.latest()) and log.versions() == [1, 2]


def size(path) -> int:
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_a_change_writes_what_it_changes(spark, log, tmp_path):
    many = spark.range(20_000).selectExpr("concat('r', id % 500) AS repo", "concat('p', id) AS path", "cast(id AS int) AS v")
    log.commit(log.latest(), {"t": [log.stage("t", many, 20_000)[0]]})
    before = size(tmp_path)
    put(log, log.latest(), "t", [("r1", "p1", -1)], FILE)
    assert size(tmp_path) - before < before / 50
    assert log.read(log.latest(), "t").filter("v = -1").count() == 1 and log.read(log.latest(), "t").count() == 20_000


def files_read(df) -> int:
    """Files that the scans of a finished plan have opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves, n = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        n += metrics.apply("numFiles").value() if metrics.contains("numFiles") else 0
    return n


def test_few_repositories_are_found_in_few_folders(spark, log, monkeypatch):
    monkeypatch.setattr(tablelog, "FOLDER_ROWS", 100)
    many = spark.range(6_400).selectExpr("concat('r', id % 500) AS repo", "concat('p', id) AS path", "cast(id AS int) AS v")
    segment, said = log.stage("t", many, 6_400)
    log.commit(log.latest(), {"t": [segment]})
    asked = spark.createDataFrame([("r3",), ("r4",)], "repo string")
    found = log.read(log.latest(), "t", asked)
    assert segment.bits == 6 and said["rows"] == 6_400
    assert files_read(log.read(log.latest(), "t")) >= 60 and files_read(found) <= 4
    assert found.filter("repo in ('r3', 'r4')").count() == 26  # ids with remainder 3 and 4 by 500, below 6,400


def test_folders_grow_with_the_rows(spark, log, monkeypatch):
    monkeypatch.setattr(tablelog, "FOLDER_ROWS", 50)
    for step in range(4):
        put(log, log.latest(), "t", [(f"r{i % 40}", f"p{step}-{i}", i) for i in range(50)], FILE)
    assert [s.bits for s in log.latest().segments["t"]] == [0, 0, 0, 0]
    log.compact(4)
    assert [(s.bits, s.rows) for s in log.latest().segments["t"]] == [(2, 200)]
    assert log.read(log.latest(), "t").count() == 200


def test_vacuum(spark, log, tmp_path):
    put(log, log.latest(), "r", [("a", 1)], REPO)
    first = log.latest()
    put(log, log.latest(), "r", [("a", 2)], REPO)
    log.stage("r", spark.createDataFrame([("x", 9)], REPO), 1)  # of a run that broke off
    assert log.vacuum(older_than=3600) == 0 and log.vacuum(older_than=-1) == 1 and rows(log, "r", first) == [("a", 1)]
    log.compact(2)
    assert log.vacuum(keep=1, older_than=-1) == 2 and log.versions() == [3] and rows(log, "r") == [("a", 2)]
    assert not list(tmp_path.rglob(".[0-9a-f]*.json"))
