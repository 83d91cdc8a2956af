"""Indexes snapshots: spark-submit codelode/jobs/index.py HEADS LISTING CONTENTS ROOT [ARCHIVES].

HEADS and LISTING are Parquet, columns as in index_run.run; ROOT is the index's folder. CONTENTS is Parquet, or `landed:` and a folder whose files
lie under <repo>/<commit_sha>/<path>; ARCHIVES (Parquet: repo, commit_sha, path) names the archives among them.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from codelode.jobs.index_run import run
from codelode.sources.landed import contents_in


def main(heads: str, listing: str, contents: str, root: str, archives: str | None = None) -> None:
    spark = SparkSession.builder.appName("index").getOrCreate()
    kind, _, folder = contents.partition("landed:")
    given = contents_in(spark, folder, archives and spark.read.parquet(archives)) if folder and not kind else spark.read.parquet(contents)
    run(spark.read.parquet(heads), spark.read.parquet(listing), given, root).write.mode("append").parquet(f"{root}/runs")


if __name__ == "__main__":
    main(*sys.argv[1:6])
