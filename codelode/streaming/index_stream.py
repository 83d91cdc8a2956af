"""Resumable indexing of landed files as a stream.

Landed files are repo, path, blob_sha, text; a row without blob_sha says that the file is gone. What each file was last is kept in the
query's state store (RocksDB, a map by repo and path), so a micro-batch costs what has landed, not what is stored. Files are dealt into
slots by a hash of repo and path, and a slot's files meet the state together: the state is asked file by file, but no data frame is made for each. Files that differ from it
are read, redacted, chunked and embedded, their chunks appended, and only then does the ledger name them; gone files are named
without blob_sha. A batch that is run again after a crash starts from the state before it and writes the same chunks under
the same ids. Of several versions of a path in one batch the one that landed last holds (by time and name of the file,
then its place there). Files without a path are files like others; repeated rows change nothing; a gone file that was never there is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import Settings
from ..functions.redaction import redact_documents
from ..operators.chunk import chunk_documents
from ..operators.embed import hash_embed
from ..operators.readers import read_documents

FILES = "repo string, path string, blob_sha string, text string"
LEDGER = "repo string, path string, blob_sha string, batch long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Slots that files are dealt into; a worker holds the files of one that have landed in a batch. Fixed, as the state is kept by slot.
SLOTS = 1_024


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """repo, path, blob_sha: what each file that is there was when its chunks were last stored."""
    rows = spark.read.schema(LEDGER).parquet(f"{root}/ledger")
    return rows.groupBy("repo", "path").agg(F.max_by("blob_sha", "batch").alias("blob_sha")).filter("blob_sha is not null")


def stored_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of files as the ledger has them, with their vectors."""
    return spark.read.option("mergeSchema", "false").parquet(f"{root}/chunks").join(ledger(spark, root), ["repo", "path", "blob_sha"], "left_semi").dropDuplicates(["id"])


class LastVersions(StatefulProcessor):
    """Of the files of a slot that have landed, the last version of each that isn't what the state has; the state then has it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("files", "repo string, path string", "blob_sha string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        last: dict[tuple, tuple] = {}
        for part in rows:
            for file in part.itertuples(index=False):
                order = (file.landed_at, file.landed_in, file.landed_row)
                if (at := (file.repo, file.path)) not in last or order > last[at][0]:
                    last[at] = order, file.blob_sha, file.text
        new = []
        for at, (_, blob_sha, text) in last.items():
            known = self.known.getValue(at)
            if blob_sha == (known[0] if known else None):
                continue
            if blob_sha is None:
                self.known.removeKey(at)
            else:
                self.known.updateValue(at, (blob_sha,))
            new.append((*at, blob_sha, text))
        if new:
            yield pd.DataFrame(new, columns=["repo", "path", "blob_sha", "text"])

    def close(self) -> None:
        pass


def process(root: str, settings: Settings):
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{root}/incoming")  # the state is stepped once a batch, however often its rows are read
        rows = spark.read.schema(FILES).parquet(f"{root}/incoming")
        redact_documents(read_documents(rows.filter("blob_sha is not null"))).write.mode("overwrite").parquet(f"{root}/read")  # small and large documents are chunked apart
        chunks = chunk_documents(spark.read.parquet(f"{root}/read"), settings)
        chunks.withColumn("embedding", hash_embed(F.col("embed_text"), settings.vector_size).cast("array<float>")).write.mode("append").parquet(f"{root}/chunks")
        rows.select("repo", "path", "blob_sha", F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(f"{root}/ledger")

    return run


def index_stream(spark: SparkSession, landed: str, root: str, settings: Settings = Settings(), files_per_batch: int = 8) -> StreamingQuery:
    """Indexes Parquet files of FILES that are in `landed`, from where the last run stopped, and ends when there are none left."""
    own = spark.newSession()  # the state store is this query's alone
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(f"{root}/ledger")
    source = own.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_batch).parquet(landed)
    landing = [F.col(f"_metadata.{n}").alias(a) for n, a in (("file_modification_time", "landed_at"), ("file_path", "landed_in"), ("row_index", "landed_row"))]
    files = source.select("repo", "path", "blob_sha", "text", *landing).withColumn("slot", F.pmod(F.xxhash64("repo", "path"), F.lit(SLOTS)).cast("int")).groupBy("slot")
    changes = files.transformWithStateInPandas(LastVersions(), FILES, "update", "none")
    writer = changes.writeStream.outputMode("update").foreachBatch(process(root, settings)).option("checkpointLocation", f"{root}/progress")
    return writer.trigger(availableNow=True).start()
