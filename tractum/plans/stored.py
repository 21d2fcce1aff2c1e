"""A keyed registry stored as ranges of keys, changed by copy-on-write.

``<path>/data/<version>/range=<n>/`` holds rows, ``<path>/versions/<version>`` a
manifest that names, for each range, the folder its rows are in.  An upsert
writes the ranges it touches under the new version, and the new manifest last:
the version with the greatest number is the registry.  An interrupted run
leaves folders that no manifest names.  One writer at a time.
"""

from __future__ import annotations

import uuid
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractum.session import stage

MANIFEST = "version long, range int, folder string, n_rows long"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete manifests: a manifest is one file, which the committer renames into its folder."""
    try:
        found = spark.read.format("binaryFile").load(f"{path}/versions/*/*.parquet").select("path").collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return [int(r.path.split("/")[-2]) for r in found]


class Registry:
    """``key`` (long) and other columns; ``width`` consecutive keys are a range."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, width: int):
        self.spark, self.path, self.schema, self.key, self.width = spark, path.rstrip("/"), schema, key, width

    def version(self) -> int:
        return max(_versions(self.spark, self.path), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/versions/{version:012d}")

    def read(self, version: int | None = None) -> DataFrame:
        """The registry; ``version``: as it was then."""
        return self._rows(self.manifest(version))

    def _rows(self, manifest: DataFrame) -> DataFrame:
        folders = [r.folder for r in manifest.select("folder").distinct().collect()]  # one for each range of keys
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def upsert(self, entries: DataFrame, load_order: str) -> int:
        """Replaces or adds rows by key, the entry of greatest ``load_order`` per
        key; returns the new version.  Only ranges that entries fall into are
        read and written.  An entry with a null key is refused."""
        old = self.manifest()
        new = self.version() + 1
        rest = [f.name for f in self.schema.fields if f.name != self.key]
        if not entries.where(F.col(self.key).isNull()).isEmpty():
            raise ValueError("an entry has no key")
        place = F.floor(F.col(self.key) / self.width).cast("int").alias("_range")
        last = entries.groupBy(self.key).agg(F.max_by(F.struct(*rest), load_order).alias("_e")).select(self.key, "_e.*")
        last = stage(last.select(*[f.name for f in self.schema.fields], place))
        touched = last.select(F.col("_range").alias("range")).distinct()
        kept = self._rows(old.join(touched, "range", "left_semi")).join(last.select(self.key), self.key, "left_anti")
        rows = kept.select(*[f.name for f in self.schema.fields], place).unionByName(last)
        folder = f"{self.path}/data/{new:012d}-{uuid.uuid4().hex}"
        rows.repartition("_range").write.partitionBy("_range").parquet(folder)
        counts = rows.groupBy("_range").agg(F.count("*").alias("n_rows"))
        written = counts.select(F.lit(new).cast("long").alias("version"), F.col("_range").alias("range"),
                                F.concat(F.lit(f"{folder}/_range="), F.col("_range").cast("string")).alias("folder"), "n_rows")
        self._publish(written.unionByName(old.join(touched, "range", "left_anti").select(*written.columns)), new)
        return new

    def _publish(self, manifest: DataFrame, version: int) -> None:
        """One file, renamed into place when it is complete: from then on this is the registry."""
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/{version:012d}")
