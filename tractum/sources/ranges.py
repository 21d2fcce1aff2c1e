"""Digests of very large files: byte ranges hashed in tasks of their own and
combined into one digest per file as a tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractum.session import stage
from tractum.sources.feather import located

RANGE = 64 << 20
FANOUT = 1024
READ = 8 << 20


def file_ranges(spark: SparkSession, path: str, pattern: str = "*", width: int = RANGE) -> DataFrame:
    """``path``, ``n_bytes``, ``part``, ``first`` and ``length`` of the byte
    ranges of every file.  Contents are not read.  Spark's file source lists no
    empty files, so they have no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("n_bytes"))
    parts = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_bytes") / width) - 1)
    each = files.select("path", "n_bytes", F.explode(parts).alias("part"))
    return each.select("*", (F.col("part") * width).alias("first"), F.least(F.lit(width).cast("long"), F.col("n_bytes") - F.col("part") * width).alias("length"))


def range_digests(ranges: DataFrame) -> DataFrame:
    """Adds ``digest``, the SHA-256 (lowercase hex) of each range.  Ranges are
    dealt over the tasks; a file that became shorter fails the job."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            digests = []
            for path, first, length in zip(frame["path"], frame["first"], frame["length"]):
                store, inner = located(path)
                seen, left = hashlib.sha256(), int(length)
                with store.open_input_file(inner) as source:
                    source.seek(int(first))
                    while left:
                        data = source.read(min(READ, left))
                        if not data:
                            raise OSError(f"{path} ends before byte {first + length}")
                        seen.update(data)
                        left -= len(data)
                digests.append(seen.hexdigest())
            yield frame.assign(digest=digests)

    dealt = ranges.repartition("path", "part")
    return dealt.mapInPandas(run, ranges.schema.add("digest", "string"))


def tree_digest(ranges: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``path``, ``n_bytes``, ``n_ranges`` and ``tree``: as long as a file has
    several digests, each ``fanout`` consecutive ones become the SHA-256 of
    their hex text.  A file of one range has that range's digest.  A level is one
    aggregation, so no task holds more than ``fanout`` digests of a file."""
    level = stage(ranges.select("path", "n_bytes", F.col("part").alias("at"), "digest"))
    sizes = level.groupBy("path").agg(F.max("at").alias("last"))
    whole = level.groupBy("path", "n_bytes").agg(F.count("*").alias("n_ranges"))
    most = (sizes.agg(F.max("last")).first()[0] or 0) + 1
    level = level.join(sizes, "path")
    while most > 1:
        above = F.floor(F.col("at") / fanout)
        items = F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
        joined = level.groupBy("path", "last", above.alias("above")).agg(items.alias("items"))
        digest = F.when(F.col("last") > 0, F.sha2(F.array_join("items", ""), 256)).otherwise(F.element_at("items", 1))
        level = stage(joined.select("path", F.floor(F.col("last") / fanout).alias("last"), F.col("above").alias("at"), digest.alias("digest")))
        most = -(-most // fanout)
    return whole.join(level.select("path", F.col("digest").alias("tree")), "path")


def changed_ranges(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """The ranges that differ between two lists of range digests: ``path``, ``part`` and ``status`` (changed, missing or unexpected)."""
    old = expected.select("path", "part", F.col("digest").alias("_old"))
    status = F.when(F.col("digest").isNull(), "missing").when(F.col("_old").isNull(), "unexpected").when(F.col("digest") != F.col("_old"), "changed")
    return actual.join(old, ["path", "part"], "full").select("path", "part", status.alias("status")).where("status is not null")
