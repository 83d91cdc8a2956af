"""The tables of an index as deltas: what a run changes is written once, beside what is there, and one manifest makes all of it visible.

A commit adds segments to tables: Parquet folders of new rows, and lists of keys that are gone. No file is ever changed. Of rows with
a table's key (the files of a repository, or a repository) those of the newest segment that names the key hold, so a changed file costs
what its own rows cost. Readers merge: the keys of all but the oldest segment are few, and are joined with the rows.

A commit is a file `log/<version>.json` that lists the live segments of all tables and is moved to its name in one step, which fails
where the name is taken. So a reader sees whole runs only, a run that breaks off leaves nothing but files that no manifest names, and of two
runs that change repositories of the same slots the later one fails (`Conflict`) and can be run again. Runs on other slots go on.

Segments are dealt into folders by a hash of the repository, so that a few repositories are found without reading the others. Each segment
has as many folders as its rows ask for; compaction, which merges the newest segments while the next older one isn't twice their size,
sets them anew. A row is thus rewritten a logarithmic number of times, and tables keep a logarithmic number of segments.

Files are moved and listed by Hadoop's file systems through the session's JVM.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a folder, about; what runs in parallel is told apart by so many slots of repositories.
FOLDER_ROWS, SLOTS = 200_000, 1_024
#: Segments from which a table is compacted.
SEGMENTS = 4


class Conflict(RuntimeError):
    """Another run has changed the same repositories meanwhile."""


@dataclass(frozen=True)
class Table:
    """Columns as DDL; the key whose rows a newer segment replaces, or none for a table that only grows."""

    schema: str
    key: tuple[str, ...] = ()


@dataclass(frozen=True)
class Segment:
    """rows: how many, in `path`, in 2 ** bits folders; gone: folders of keys (repo, path; a null path is the whole repository). seq: the commit."""

    path: str | None = None
    rows: int = 0
    bits: int = 0
    gone: tuple[str, ...] = ()
    seq: int = 0


@dataclass(frozen=True)
class Version:
    number: int = 0
    segments: dict[str, list[Segment]] = field(default_factory=dict)
    info: dict[str, object] = field(default_factory=dict)


def slot_of(repo: Column | str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(repo), F.lit(slots)).cast("int")


class TableLog:
    """Tables under a folder, by name."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.tables = spark, tables
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        path = self.hadoop.Path(root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(path).toString()

    # manifests

    def path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        folder = self.path("log")
        if not self.fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int) -> Version:
        stream = self.fs.open(self.path(f"log/{number:020d}.json"))
        try:
            said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        segments = {t: [Segment(**s | {"gone": tuple(s["gone"])}) for s in of] for t, of in said["segments"].items()}
        return Version(said["number"], segments, said["info"])

    def latest(self) -> Version:
        numbers = self.versions()
        return self.version(numbers[-1]) if numbers else Version()

    def publish(self, version: Version) -> bool:
        """Whether the version has got its name; the name may be taken."""
        said = {"number": version.number, "segments": {t: [asdict(s) for s in of] for t, of in version.segments.items()}, "info": version.info}
        made = self.path(f"log/.{uuid.uuid4().hex}")
        out = self.fs.create(made, False)
        try:
            out.write(bytearray(json.dumps(said).encode()))
        finally:
            out.close()
        context = self.hadoop.FileContext.getFileContext(self.path("").toUri(), self.spark._jsc.hadoopConfiguration())
        gateway = self.spark.sparkContext._gateway
        how = gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        try:
            context.rename(made, self.path(f"log/{version.number:020d}.json"), how)
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            self.fs.delete(made, False)
            return False
        return True

    # writing

    def stage(self, table: str, rows: DataFrame, about: int, **metrics: Column) -> tuple[Segment, dict[str, int]]:
        """Writes rows that no reader sees yet; `about`: their number, roughly. Gives the segment, and metrics gathered while it was written."""
        bits = max(0, math.ceil(math.log2(max(about, 1) / FOLDER_ROWS))) if about > FOLDER_ROWS else 0
        path, seen = f"data/{table}-{uuid.uuid4().hex}", Observation()
        ordered = rows.select([f.name for f in self.empty(table).schema])
        dealt = ordered.withColumn("bucket", slot_of("repo", 1 << bits)).hint("rebalance", F.col("bucket"))
        dealt.observe(seen, F.count("*").alias("rows"), *[m.alias(name) for name, m in metrics.items()]).write.partitionBy("bucket").parquet(f"{self.root}/{path}")
        try:
            found = dict(seen.get)
        except Exception:  # a plan that turns out to be empty while it runs takes its metrics with it
            written = self.spark.read.schema(ordered.schema).parquet(f"{self.root}/{path}")
            found = written.agg(F.count("*").alias("rows"), *[m.alias(name) for name, m in metrics.items()]).first().asDict()
        return Segment(path, found["rows"], bits), found

    def stage_gone(self, keys: DataFrame) -> Segment:
        """The same for keys (repo, path) whose rows are gone."""
        path = f"data/gone-{uuid.uuid4().hex}"
        keys.select(F.col("repo").cast("string").alias("repo"), F.col("path").cast("string").alias("path")).write.parquet(f"{self.root}/{path}")
        return Segment(gone=(path,))

    def commit(self, base: Version, added: dict[str, list[Segment]], touched: DataFrame | None = None, info: dict[str, object] | None = None) -> Version:
        """Makes segments visible, all at once. touched: repo of what was read from `base` to make them."""
        slots = sorted(r.s for r in touched.select(slot_of("repo").alias("s")).distinct().collect()) if touched is not None else []
        while True:
            now = self.latest()
            for number in range(base.number + 1, now.number + 1):
                if set(slots) & set(self.version(number).info.get("slots", ())):
                    raise Conflict(f"version {number} has changed some of these repositories")
            seq = now.number + 1
            segments = {t: [*now.segments.get(t, []), *(replace(s, seq=seq) for s in added.get(t, ()) if s.rows or s.gone)] for t in self.tables}
            if self.publish(made := Version(seq, segments, {**(info or {}), "slots": slots, "at": time.time()})):
                return made

    # reading

    def empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], self.tables[table].schema)

    def rows_of(self, table: str, segment: Segment, repos: DataFrame | None) -> DataFrame:
        rows = self.spark.read.schema(f"{self.tables[table].schema}, bucket int").parquet(f"{self.root}/{segment.path}")
        if repos is not None and segment.bits:
            buckets = repos.select(slot_of("repo", 1 << segment.bits).alias("b")).distinct().collect()  # a number per folder at most
            rows = rows.filter(F.col("bucket").isin([r.b for r in buckets]))
        return rows.drop("bucket").withColumn("_seq", F.lit(segment.seq))

    def merged(self, table: str, segments: list[Segment], repos: DataFrame | None = None) -> DataFrame:
        """The rows that hold, of some segments that follow each other, with _seq."""
        key = list(self.tables[table].key)
        parts = [self.rows_of(table, s, repos) for s in segments if s.rows]
        rows = reduce(DataFrame.unionByName, parts) if parts else self.empty(table).withColumn("_seq", F.lit(0))
        if not key or len(segments) < 2:
            return rows
        newer = [self.rows_of(table, s, repos).select(*key, "_seq") for s in segments[1:] if s.rows]
        gone = [self.spark.read.schema("repo string, path string").parquet(*[f"{self.root}/{g}" for g in s.gone]).withColumn("_seq", F.lit(s.seq)) for s in segments[1:] if s.gone]
        whole = [g.filter("path is null").select("repo", "_seq") for g in gone]
        named = newer + [g.filter("path is not null").select(*key, "_seq") if "path" in key else g.select("repo", "_seq") for g in gone]
        for on, keys in ((key, named), (["repo"], whole if "path" in key else [])):
            if keys:
                last = reduce(DataFrame.unionByName, keys).groupBy(*on).agg(F.max("_seq").alias("_last"))
                rows = rows.join(last, on, "left").filter("_last is null or _seq >= _last").drop("_last")
        return rows

    def read(self, version: Version, table: str, repos: DataFrame | None = None) -> DataFrame:
        """A table as of a version. With `repos` (repo), the other repositories' rows may be missing: their folders aren't read."""
        return self.merged(table, version.segments.get(table, []), repos).select([f.name for f in self.empty(table).schema])

    # upkeep

    @staticmethod
    def due(segments: list[Segment]) -> list[Segment]:
        """The newest segments, as far back as the next older one isn't twice as large as all newer ones."""
        size, first = 0, len(segments)
        while first and (first == len(segments) or segments[first - 1].rows <= 2 * size):
            first -= 1
            size += segments[first].rows
        return segments[first:] if len(segments) - first > 1 else []

    def compact(self, least: int = SEGMENTS, whole: bool = False) -> Version:
        """Merges segments of tables that have `least` or more: the newest ones that are due, or all. Rows stay as they are; lists of keys that
        no older segment needs go."""
        version = self.latest()
        for table in self.tables:
            while len(version.segments.get(table, [])) >= max(least, 2) and (run := version.segments[table] if whole else self.due(version.segments[table])):
                oldest = run[0] is version.segments[table][0]
                rows = self.merged(table, run).drop("_seq")
                made, _ = self.stage(table, rows, sum(s.rows for s in run))
                made = replace(made, seq=run[-1].seq, gone=() if oldest else tuple(g for s in run for g in s.gone))
                version = self.exchange(table, run, made)
        return version

    def exchange(self, table: str, old: list[Segment], new: Segment) -> Version:
        while True:
            now = self.latest()
            live = now.segments[table]
            if not set(old) <= set(live):
                raise Conflict(f"{table} has been compacted meanwhile")
            at = live.index(old[0])
            segments = now.segments | {table: [*live[:at], *([new] if new.rows or new.gone else []), *live[at + len(old) :]]}
            if self.publish(made := Version(now.number + 1, segments, {"compacted": table, "slots": [], "at": time.time()})):
                return made

    def vacuum(self, keep: int = 10, older_than: float = 86_400.0) -> int:
        """Deletes data that none of the last `keep` versions names and that is older than so many seconds (a run may still be at it), and older manifests."""
        numbers = self.versions()
        named = {p for n in numbers[-keep:] for of in self.version(n).segments.values() for s in of for p in (s.path, *s.gone) if p}
        gone, folder = 0, self.path("data")
        for f in self.fs.listStatus(folder) if self.fs.exists(folder) else ():
            if f"data/{f.getPath().getName()}" not in named and time.time() - f.getModificationTime() / 1000 >= older_than:
                gone += bool(self.fs.delete(f.getPath(), True))
        for n in numbers[:-keep]:
            self.fs.delete(self.path(f"log/{n:020d}.json"), False)
        return gone
