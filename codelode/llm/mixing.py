"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets: a source gets `weight` parts of the mix, but never more than `max_epochs` times its size; what is cut off is shared
out again by weight until no source is above. The sources that are clamped only grow in number while the level of the
others rises, so each round is one aggregate over the table of sources.

Repetitions: with rate = target / size, each document is taken floor(rate) times, and some are taken once more, so that the
words of these extra copies come to the rate's fraction of the source. How many of each size is planned over the sizes of
a source from long to short, each size making up for the rounding of those before, so that the error left is that of the
shortest documents. Which ones is drawn by a seeded hash of doc_id and text, so that reruns agree however the rows lie in files:
documents of a size are dealt into slices (`SLICES` of them, or a slice for each `DEALT` documents of the corpus), each slice
gives its share, and ranks are taken inside a slice. A source that holds a third of all rows is never in one task.

Size is the number of words (null text: 0). A null source is a source of its own, last in order. Documents of size 0 are
taken as often as others of their source's whole part, and count 0 words. Repeated rows are separate documents, also with
a null or repeated doc_id; of equal rows it doesn't matter which one is drawn. Empty tables give empty results. Clashing names of other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import seeded, stored, word_count

SLICES, DEALT = 64, 1 << 17


def key_of(source: str = "source"):
    """A key that joins and sorts as the source does by code point, null last."""
    return F.when(F.col(source).isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col(source).cast("string")))


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """Adds `position` (from 0) in the total order of the columns, without bringing the rows into one task."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = stored(sorted_.withColumns({"_task": F.spark_partition_id(), "_nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = local.groupBy("_task").agg(F.count("*").alias("_n"))
    before = counts.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before"))  # a row per task
    return local.join(before, "_task").withColumn("position", F.col("_before") + F.col("_nth")).drop("_task", "_nth", "_before")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Adds `target` to sources (source_size, weight > 0): min(weight * level, max_epochs * source_size), adding up to `total` where that is feasible."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    while True:
        full = cap < F.col("weight") * F.lit(level)
        now = sources.agg(F.count_if(full).alias("n"), F.sum(F.when(full, cap).otherwise(0.0)).alias("capped"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if now.n == clamped or not now.weight:
            return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap) if now.weight else cap)
        level, clamped = (total - now.capped) / now.weight, now.n


def extra_by_size(rows: pd.DataFrame) -> pd.DataFrame:
    """How many documents of each size of one source are taken once more. A row per size, however many documents it has."""
    rows = rows.sort_values("size", ascending=False)
    size, n, fraction = rows["size"].to_numpy(), rows["n"].to_numpy(), rows["fraction"].to_numpy()
    want, taken, extra = np.cumsum(fraction * size * n), 0.0, np.zeros(len(rows), np.int64)
    for i in range(len(rows)):
        extra[i] = min(n[i], max(0, round((want[i] - taken) / size[i])))
        taken += extra[i] * size[i]
    return pd.DataFrame({"key": rows["key"], "size": size, "extra": extra, "n": n})


def mix(docs: DataFrame, weights: DataFrame, share: float = 1.5, max_epochs: float = 2.0, seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """Copies of each document in a mix of `share` times all words.

    docs: doc_id, source, text; weights: key (see key_of), weight. Returns doc_id, source, size, source_size, target,
    copies, taken; the row order of `docs` isn't kept, and `row` (a number per input row) tells repeated rows apart. With `keep`, a struct
    `kept` of these columns is added.
    """
    kept = [F.struct(*keep).alias("kept")] if keep else []
    own = [F.col("doc_id").cast("long").alias("doc_id"), "source", key_of().alias("key"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("content")]
    held = stored(docs.select(F.monotonically_increasing_id().alias("row"), *own, *kept))
    sized = held.drop("kept")
    sources = stored(sized.groupBy("key").agg(F.sum("size").alias("source_size")).join(weights.select("key", F.col("weight").cast("double").alias("weight")), "key"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    slices_of = max(SLICES, -(-sized.count() // DEALT))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = water_fill(sources, share * total, max_epochs).withColumns({"whole": F.floor(rate).cast("long"), "fraction": rate - F.floor(rate)})
    dealt = sized.withColumns({"draw": seeded(seed, "key", "doc_id", "content"), "slice": F.pmod(seeded(seed + 1, "doc_id", "content"), F.lit(slices_of)).cast("int")})
    slices = dealt.filter("size > 0").groupBy("key", "size", "slice").agg(F.count("*").alias("m"))
    sizes = slices.groupBy("key", "size").agg(F.sum("m").alias("n")).join(sources.filter("fraction > 0").select("key", "fraction"), "key")
    extra = sizes.groupBy("key").applyInPandas(extra_by_size, "key string, size long, extra long, n long").filter("extra > 0")
    upto = F.sum("m").over(Window.partitionBy("key", "size").orderBy("slice"))
    share_of = lambda m: F.floor(F.col("extra") * m / F.col("n") + F.lit(0.5))
    quota = slices.join(extra, ["key", "size"]).withColumn("upto", upto).select("key", "size", "slice", (share_of(F.col("upto")) - share_of(F.col("upto") - F.col("m"))).alias("quota")).filter("quota > 0")
    nth = F.row_number().over(Window.partitionBy("key", "size", "slice").orderBy("draw", "doc_id", "content", "row"))
    chosen = dealt.join(quota, ["key", "size", "slice"], "left").withColumn("more", F.when(F.col("quota").isNotNull() & (nth <= F.col("quota")), 1).otherwise(0))
    copies = (F.col("whole") + F.col("more")).cast("long")
    mixed = chosen.join(sources.select("key", "source_size", "target", "whole"), "key").select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    return mixed.join(held.select("row", "kept"), "row") if keep else mixed


def repeating_weights(docs: DataFrame, cycle: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """A weight per source: the cycle, over the sources by code point, null last."""
    keys = ranked(docs.select(key_of().alias("key")).distinct(), "key")
    return keys.select("key", F.element_at(F.array(*map(F.lit, cycle)), (F.col("position") % len(cycle) + 1).cast("int")).alias("weight"))
