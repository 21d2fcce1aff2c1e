"""Typed readers, sinks, named stages, schema dispatch and file manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractum.session import shared_folder


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """Header text with explicit types; a row that does not fit fails the job.

    The codec follows the suffix (``.gz``); a BOM before the header is ignored.
    """
    return (
        spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "FAILFAST")
        .option("enforceSchema", False).csv(path)
    )


def spread(df: DataFrame) -> DataFrame:
    """Shares a scan with fewer partitions than the cluster has cores over all
    of them, for work that is heavy per row.  Larger scans are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_delimited(df: DataFrame, path: str, order: Sequence[str], id_columns: Sequence[str] = (),
                    sep: str = ",") -> None:
    """Fixed field order; ids as decimal text, so no reader can round them."""
    out = [F.col(c).cast("string").alias(c) if c in id_columns else F.col(c) for c in order]
    df.select(*out).write.mode("errorifexists").option("header", True).option("sep", sep).option(
        "compression", "gzip"
    ).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_entries(df: DataFrame, column: str, value_type: str = "string") -> DataFrame:
    """One row per entry of a JSON dictionary column: ``key``, ``entry``."""
    parsed = F.from_json(column, f"map<string,{value_type}>")
    return df.select("*", F.explode(parsed).alias("key", "entry")).drop(column)


def dispatch(df: DataFrame, layouts: Mapping[str, Sequence[str]]) -> str:
    """Name of the first layout whose columns are all present, or an error."""
    for name, columns in layouts.items():
        if set(columns) <= set(df.columns):
            return name
    raise ValueError(f"no known layout has the columns {df.columns}")


def schema_inventory(df: DataFrame, table: str) -> DataFrame:
    """(table, column, type, n_rows, n_nulls) from one pass over the table."""
    rows = [
        F.struct(
            F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("type"), F.count("*").alias("n_rows"),
            F.count_if(F.col(f.name).isNull()).alias("n_nulls"),
        )
        for f in df.schema.fields
    ]
    return df.agg(F.array(*rows).alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")


def input_fingerprint(spark: SparkSession, inputs: Sequence[str]) -> str:
    """Hash of the names, sizes and times of all files under ``inputs``."""
    entry = F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(inputs))
    # Sum and xor do not depend on the order in which files are listed.
    total = files.agg(F.count("*"), F.sum(F.crc32(entry)), F.bit_xor(F.xxhash64(entry))).first()
    return "-".join(f"{(v or 0) & 0xFFFFFFFFFFFFFFFF:x}" for v in total)


def _there(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.schema("id long").parquet(path).isEmpty()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def named_stage(df: DataFrame, name: str, inputs: Sequence[str]) -> DataFrame:
    """Parquet stage in the shared folder, reused while the query and the files
    it is made from stay the same.  Its mark is one file, renamed into place
    once the stage is complete; a stage without one is written again."""
    spark = df.sparkSession
    query = hashlib.sha256(f"{df.semanticHash()} {df.schema.json()}".encode()).hexdigest()[:16]
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{query}-{input_fingerprint(spark, inputs)}"
    if not _there(spark, f"{path}.done"):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}.done")
    return spark.read.schema(df.schema).parquet(path)


def audit_json(metrics: DataFrame) -> DataFrame:
    """A one-row metric frame as JSON text with keys in name order."""
    return metrics.select(F.to_json(F.struct(*sorted(metrics.columns))).alias("audit"))


def scan_totals(df: DataFrame, weight: Column, fraction: float | None = None, seed: int = 0) -> DataFrame:
    """Row count and weight of a full or sampled scan, with an honest flag;
    a partial scan states no totals."""
    scanned = df if fraction is None else df.sample(fraction, seed)
    complete = F.lit(fraction is None)
    totals = scanned.agg(F.count("*").alias("n_rows"), F.sum(weight).alias("weight"))
    return totals.select(
        complete.alias("complete"), F.when(complete, F.col("n_rows")).alias("n_rows"),
        F.when(complete, F.col("weight")).alias("weight"),
    )


def _hash_file(path: str, block: int = 8 << 20) -> tuple[int, str, str]:
    from pyarrow import fs

    filesystem, inner = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not
                                               path.startswith("file://") else path)
    md5, sha, size = hashlib.md5(), hashlib.sha256(), 0
    with filesystem.open_input_stream(inner) as stream:
        while data := stream.read(block):
            md5.update(data)
            sha.update(data)
            size += len(data)
    return size, md5.hexdigest(), sha.hexdigest()


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, n_bytes, md5, sha256 of every file.  Spark spreads the files over
    tasks; each is hashed in 8 MiB blocks, so size does not matter."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")

    def hash_paths(frames):
        for frame in frames:
            rows = [(p, *_hash_file(p)) for p in frame["path"]]
            yield pd.DataFrame(rows, columns=["path", "n_bytes", "md5", "sha256"])

    files = listed.repartition("path")
    return files.mapInPandas(hash_paths, "path string, n_bytes long, md5 string, sha256 string")


def verify_manifest(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Status per path: ok, missing, unexpected or changed."""
    e = expected.select("path", F.col("sha256").alias("_want"), F.col("n_bytes").alias("_bytes"))
    status = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("_want").isNull(), "unexpected")
        .when((F.col("sha256") == F.col("_want")) & (F.col("n_bytes") == F.col("_bytes")), "ok")
        .otherwise("changed")
    )
    return actual.join(e, "path", "full").select("path", status.alias("status"))
