"""Files that have landed as objects under <folder>/<repo>/<commit_sha>/<path>, and archives among them.

Two ways in. `read_landed` takes a listing: its rows are dealt over tasks by their bytes, and each task opens the objects of its rows
and no others, so that nothing is listed and the driver holds no names. The data source `landed` (registered by `register`) is for what has
no listing: `spark.read.format("landed").load(folder)` lists the snapshots that its filters leave (equality and IN on repo, commit_sha and
path, and beginnings of path are pushed down) and plans partitions of about as many bytes each. The driver holds their names, as it does for any files that Spark
lists. It writes a row as an object, too. Contents come in Arrow batches bounded in bytes; folders are anything that `pyarrow.fs` opens.

Null names, and names that would lead out of the folder ("..", empty parts), are never found. Empty listings give empty results.
"""

from __future__ import annotations

import re
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import IO

import pyarrow as pa
from pyarrow import fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from ..config import Settings
from ..functions.parts import as_column
from ..jobs.shared import cut

PLACE = ["repo", "commit_sha", "path"]
SCHEMA = "repo string, commit_sha string, path string, size long, content binary"
MEMBERS = pa.schema([("repo", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("broken", pa.bool_())])
#: Bytes and rows of a batch that leaves a task, bytes that a task reads, and the most tasks.
BATCH_BYTES, BATCH_ROWS, TASK_BYTES, TASKS = 1 << 20, 1_024, 128 << 20, 200_000
#: Bytes that are read from an archive at a time, and that are inflated at a time (to 17 MB at most, as deflate goes).
BLOCK, INFLATED = 1 << 18, 1 << 14
UNFINISHED = "_unfinished-"


def opened(folder: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a folder, and the folder's place in it."""
    local = re.sub(r"^file:/+", "/", folder.rstrip("/"))
    return (pfs.LocalFileSystem(), local) if local.startswith("/") else pfs.FileSystem.from_uri(local)


def place_of(*names: str | None) -> str | None:
    """repo/commit_sha/path, if no part of it is missing or leads elsewhere, and the first two are single names."""
    if any(n is None for n in names) or any("/" in n for n in names[:2]):
        return None
    place = "/".join(names)
    return None if any(part in ("", ".", "..") for part in place.split("/")) else place


def in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded rows and bytes (a row larger than the bound is a batch of its own)."""
    held, size = [], 0
    binary = [i for i, f in enumerate(schema) if pa.types.is_binary(f.type)]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([as_column(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        more = sum(len(row[i] or b"") for i in binary)
        if held and (size + more > BATCH_BYTES or len(held) == BATCH_ROWS):
            yield batch()
            held, size = [], 0
        held.append(row)
        size += more
    if held:
        yield batch()


def found(system: pfs.FileSystem, top: str, places: list[str | None]) -> Iterator[tuple[int, str, int]]:
    """Number, place and size of those places that are objects."""
    known = [(i, f"{top}/{p}") for i, p in enumerate(places) if p is not None]
    for (i, at), info in zip(known, system.get_file_info([at for _, at in known])):
        if info.type == pfs.FileType.File:
            yield i, at, info.size


def content_of(system: pfs.FileSystem, at: str, cap: int | None) -> bytes:
    """An object's bytes; of one larger than `cap`, which no file may be, one byte more than that, so that it's refused as too large."""
    with system.open_input_stream(at, compression=None) as source:
        return source.read() if cap is None else source.read(cap + 1)


def by_bytes(df: DataFrame, least: int = 1) -> DataFrame:
    """Rows dealt over tasks by their place, about as many bytes each; without a column size they stay as they are."""
    if "size" not in df.columns:
        return df
    total = df.agg(F.sum("size")).first()[0] or 0
    return df.repartition(min(max(-(-int(total) // TASK_BYTES), least), TASKS), *PLACE)


def read_landed(spark: SparkSession, folder: str, wanted: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """wanted (repo, commit_sha, path, and more) with content, of those that have landed. With a column size, rows are dealt by it. A column
    content of wanted gives way. Repeated rows are read and given as often."""
    wanted = wanted.drop("content")
    columns, cap = wanted.columns, max(settings.file_cap, settings.notebook_cap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(folder)
        for batch in batches:
            names = [batch.column(columns.index(c)).to_pylist() for c in PLACE]
            schema = pa.schema([("_row", pa.int64()), ("content", pa.binary())])
            rows = ((i, content_of(system, at, cap)) for i, at, _ in found(system, top, [place_of(*n) for n in zip(*names)]))
            for part in in_batches(rows, schema):
                yield pa.RecordBatch.from_arrays([*batch.take(part.column(0)).columns, part.column(1)], names=[*columns, "content"])

    dealt = by_bytes(wanted, spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, StructType([*wanted.schema.fields]).add("content", "binary"))


def members(source: IO[bytes], settings: Settings) -> Iterator[tuple[str | None, bytes | None, bool]]:
    """path, content, False of the plain files of a .tar.gz, up to the cap of a file, without the first part of their path; last None, None, True if it's corrupt.

    The archive is read as a stream: what is held is one member and one inflated block, whatever the archive's size. Names that aren't UTF-8 get replacement characters.
    """
    try:
        with tarfile.open(fileobj=source, mode="r|gz", bufsize=INFLATED) as tar:
            while (member := tar.next()) is not None:
                tar.members.clear()  # or it would keep every header
                path = member.name.partition("/")[2].encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                cap = settings.notebook_cap if path.lower().endswith(".ipynb") else settings.file_cap
                if member.isfile() and path and member.size <= cap:
                    yield path, tar.extractfile(member).read(), False
    except (tarfile.TarError, EOFError, zlib.error, ValueError):
        yield None, None, True


def untar(archives: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """repo, path, content, and broken (true in a row without path for an archive that is missing, too large or corrupt) of archives (repo, content: .tar.gz)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for repo, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if not content.is_valid or content.as_buffer().size > settings.archive_cap:
                        yield repo, None, None, True
                    else:
                        yield from ((repo, *m) for m in members(pa.BufferReader(content.as_buffer()), settings))

        yield from in_batches(rows(), MEMBERS)

    return archives.select("repo", F.col("content").cast("binary")).mapInArrow(run, "repo string, path string, content binary, broken boolean")


def untar_landed(spark: SparkSession, folder: str, archives: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The same of archives that have landed (repo, commit_sha, path). They are opened as streams, so that none is ever whole in memory, and dealt
    over tasks by their place, so that one repository's archives are unpacked side by side. An archive that is not there is broken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            system, top = opened(folder)
            for batch in batches:
                names = list(zip(*(c.to_pylist() for c in batch.columns)))
                there = {i: (at, size) for i, at, size in found(system, top, [place_of(*n) for n in names])}
                for i, (repo, *_) in enumerate(names):
                    at, size = there.get(i, (None, 0))
                    if at is None or size > settings.archive_cap:
                        yield repo, None, None, True
                        continue
                    with system.open_input_stream(at, compression=None, buffer_size=BLOCK) as source:
                        yield from ((repo, *m) for m in members(source, settings))

        yield from in_batches(rows(), MEMBERS)

    n = max(archives.count() // 64, spark.sparkContext.defaultParallelism)  # tasks of about 64 archives
    return archives.select(PLACE).repartition(min(n, TASKS), *PLACE).mapInArrow(run, "repo string, path string, content binary, broken boolean")


def fetch_landed(spark: SparkSession, folder: str, wanted: DataFrame, archives: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """repo, path, content, via, method of wanted files (repo, commit_sha, path, and size if it is known; one commit a repository): from the archives
    (repo, commit_sha, path) of repositories of more than a threshold of wanted files, as single files for the others.

    Single files are opened only where no archive has given them: in small repositories, and in those of which an archive is missing, too large or
    corrupt. Repeated wanted rows count once. A path that an archive holds twice is given twice (`contents.guarded` counts it once).
    """
    # names are stored before they meet contents, so that their size is known: where they are small, Spark needn't shuffle the contents
    wanted = cut(wanted.dropDuplicates(PLACE))
    large = cut(wanted.groupBy("repo").agg(F.count("*").alias("n")).filter(F.col("n") > settings.archive_from).select("repo"))
    asked = wanted.join(large, "repo", "left_semi")
    taken = cut(archives.select(PLACE).distinct().join(asked.select("repo", "commit_sha").distinct(), ["repo", "commit_sha"], "left_semi"))
    listed = wanted.select("repo", "path", F.lit(True).alias("_asked"))
    # used three times, and unpacking is dear
    unpacked = cut(untar_landed(spark, folder, taken, settings).join(listed, ["repo", "path"], "left").filter("_asked or broken").drop("_asked"))
    given = unpacked.filter("not broken").select("repo", "path", "content", F.lit("tarball").alias("via"))
    fallen = unpacked.filter("broken").select("repo").unionByName(large.join(taken, "repo", "left_anti")).distinct().withColumn("_fallen", F.lit(True))
    method = cut(large.join(fallen, "repo", "left").select("repo", F.when(F.col("_fallen"), "tarball+raw").otherwise("tarball").alias("method")))
    small = wanted.join(large, "repo", "left_anti").withColumn("method", F.lit("raw"))
    left = wanted.join(method.filter("method = 'tarball+raw'"), "repo").join(given.select("repo", "path"), ["repo", "path"], "left_anti")
    single = read_landed(spark, folder, cut(small.unionByName(left)), settings).withColumn("via", F.lit("raw"))
    columns = ["repo", "path", "content", "via", "method"]
    return given.join(method, "repo").select(columns).unionByName(single.select(columns))


def contents_in(spark: SparkSession, folder: str, archives: DataFrame | None = None, settings: Settings = Settings()) -> Callable[[DataFrame], DataFrame]:
    """What gives the contents of wanted files out of a folder, and out of archives (repo, commit_sha, path) in it where there are any: only what is wanted is opened."""

    def fetch(wanted: DataFrame) -> DataFrame:
        return read_landed(spark, folder, wanted, settings) if archives is None else fetch_landed(spark, folder, wanted, archives, settings)

    return fetch


class Part(InputPartition):
    """Objects that a task of the data source reads: repo, commit_sha, path, size."""

    def __init__(self, files: list[tuple[str, str, str, int]]):
        self.files = files


class LandedReader(DataSourceReader):
    """Plans partitions by bytes over the snapshots that are asked for; content is opened only if the schema names it."""

    def __init__(self, folder: str, schema: StructType):
        self.folder, self.names = folder, schema.names
        self.asked: dict[str, set[str]] = {}
        self.beginning = ""

    def folders(self, system: pfs.FileSystem, at: str, column: str) -> list[str]:
        if column in self.asked:
            return sorted(n for n in self.asked[column] if "/" not in n and n not in ("", ".", ".."))
        listed = system.get_file_info(pfs.FileSelector(at, allow_not_found=True))
        return sorted(i.base_name for i in listed if i.type == pfs.FileType.Directory and not i.base_name.startswith(UNFINISHED))

    def files(self) -> Iterator[tuple[str, str, str, int]]:
        system, top = opened(self.folder)
        for repo in self.folders(system, top, "repo"):
            for commit in self.folders(system, f"{top}/{repo}", "commit_sha"):
                at = f"{top}/{repo}/{commit}"
                if "path" in self.asked:
                    names = sorted(self.asked["path"])
                    yield from ((repo, commit, names[i], size) for i, _, size in found(system, top, [place_of(repo, commit, n) for n in names]) if names[i].startswith(self.beginning))
                    continue
                # a beginning that names folders is listed from there
                inner = self.beginning.rpartition("/")[0]
                if inner and place_of(repo, commit, inner) is None:
                    continue
                for info in system.get_file_info(pfs.FileSelector(f"{at}/{inner}".rstrip("/"), allow_not_found=True, recursive=True)):
                    path = info.path[len(at) + 1 :]
                    if info.type == pfs.FileType.File and path.startswith(self.beginning):
                        yield repo, commit, path, info.size

    def partitions(self) -> list[Part]:
        parts, held, size = [], [], 0
        for file in self.files():
            if held and (size + file[3] > TASK_BYTES or len(held) == 50_000):
                parts.append(Part(held))
                held, size = [], 0
            held.append(file)
            size += file[3]
        return [*parts, Part(held)] if held or not parts else parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, top = opened(self.folder)
        kinds = {"size": pa.int64(), "content": pa.binary()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in self.names])

        def rows() -> Iterator[tuple]:
            for repo, commit, path, size in partition.files:
                row = {"repo": repo, "commit_sha": commit, "path": path, "size": size}
                if "content" in self.names:
                    row["content"] = content_of(system, f"{top}/{repo}/{commit}/{path}", None)
                yield tuple(row[n] for n in self.names)

        yield from in_batches(rows(), schema)


class PruningReader(LandedReader):
    """The same with filters pushed down: Spark asks for the setting spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, (EqualTo, In)) and column in PLACE:
                values = {v for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v is not None}
                self.asked[column] = self.asked.get(column, values) & values
            elif isinstance(f, StringStartsWith) and column == "path" and not self.beginning:
                self.beginning = f.value
            else:
                yield f


class LandedWriter(DataSourceArrowWriter):
    """Writes each row as an object: beside its place first, then moved there, so that a task that runs again does no harm. An object that is there is replaced."""

    def __init__(self, folder: str):
        self.folder, self.aside = folder, f"{UNFINISHED}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, top = opened(self.folder)
        aside, made = f"{top}/{self.aside}/{uuid.uuid4().hex}", ""
        system.create_dir(f"{top}/{self.aside}", recursive=True)
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in (*PLACE, "content")]
            for repo, commit, path, content in zip(*columns):
                place = place_of(repo.as_py(), commit.as_py(), path.as_py())
                if place is None or not content.is_valid:
                    raise ValueError(f"no place or no content: {repo}/{commit}/{path}")
                with system.open_output_stream(aside, compression=None) as out:
                    out.write(content.as_buffer())
                at = f"{top}/{place}"
                if (parent := at.rpartition("/")[0]) != made:
                    system.create_dir(parent, recursive=True)
                    made = parent
                system.move(aside, at)
        return WriterCommitMessage()

    def tidy(self) -> None:
        system, top = opened(self.folder)
        if system.get_file_info(f"{top}/{self.aside}").type == pfs.FileType.Directory:
            system.delete_dir(f"{top}/{self.aside}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.tidy()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.tidy()


class Landed(DataSource):
    """Format `landed`: option path, the folder; option prune, true where filters can be pushed down."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        reader = PruningReader if self.options.get("prune", "false").lower() == "true" else LandedReader
        return reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> LandedWriter:
        if overwrite:
            raise ValueError("landed files are added, or replaced one by one: use mode append")
        return LandedWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Landed)


def landed(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """The files of a folder. Filters are pushed down where the session lets Python sources have them; `schema` may leave columns out, and without content nothing is opened."""
    register(spark)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("landed").schema(schema).option("prune", prune).load(folder)


def land(files: DataFrame, folder: str) -> None:
    """Writes files (repo, commit_sha, path, content) under a folder, an object each. Null contents and names that have no place raise an error."""
    register(files.sparkSession)
    content = F.col("content").cast("binary")
    files.select(*PLACE, F.octet_length(content).cast("long").alias("size"), content.alias("content")).write.format("landed").mode("append").save(folder)
