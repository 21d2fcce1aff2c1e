"""Arrow IPC (Feather v2) files as a Spark source and sink.

Reading: files are dealt by size over Spark partitions and handed over as Arrow
batches; filters reach the source, which skips batches.  Writing: one file per Spark partition, streamed batch by batch.
Paths are plain paths of a mount that every executor has, or URIs of a
filesystem that pyarrow opens (``hdfs:``, ``s3:``, ``gs:``, ``file:`` ...).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.pandas.types import from_arrow_schema


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The filesystem of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:(//)?(?=/)", "", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def arrow_files(store: fs.FileSystem, inner: str) -> list[str]:
    """The complete Feather files of a folder, or the file itself."""
    if store.get_file_info(inner).type != fs.FileType.Directory:
        return [inner]
    found = store.get_file_info(fs.FileSelector(inner))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".arrow"))


def _files(path: str) -> list[str]:
    return arrow_files(*located(path))


def _open(path: str, inner: str) -> pa.NativeFile:
    return located(path)[0].open_input_file(inner)


class BatchRange(InputPartition):
    """Share ``share`` of ``of`` of a file's record batches, or batches ``share`` to ``of``."""

    def __init__(self, path: str, share: int, of: int, batches: bool = False):
        self.path, self.share, self.of, self.batches = path, share, of, batches

    def of_file(self, n: int) -> range:
        return range(self.share, min(self.of, n)) if self.batches else range(n * self.share // self.of, n * (self.share + 1) // self.of)


def _may_hold(f: Filter, low, high) -> bool:
    """Whether a batch with values from ``low`` to ``high`` can have a row that passes."""
    if isinstance(f, EqualTo):
        return low <= f.value <= high
    if isinstance(f, In):
        return any(low <= v <= high for v in f.value if v is not None)
    if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
        return high > f.value or (high == f.value and isinstance(f, GreaterThanOrEqual))
    return low < f.value or (low == f.value and isinstance(f, LessThanOrEqual))


def _passes(f: Filter, column: pa.Array) -> pa.Array:
    if isinstance(f, In):
        return pc.is_in(column, pa.array(f.value, column.type), skip_nulls=True)
    compare = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
    return pc.fill_null(compare[type(f)](column, pa.scalar(f.value, column.type)), False)


class FeatherReader(DataSourceReader):
    """Takes comparisons with constants and lists of them from the filter of the
    query.  A batch whose stored minimum and maximum rule it out is not read; of
    any other only the compared columns are read before a row has passed.
    Spark applies the filter again, so a reader that skips less is right as well.
    """

    def __init__(self, path: str, columns: list[str], batches: int | None, size: int):
        self.path, self.columns, self.batches, self.size = path, columns, batches, size
        self.filters: list[Filter] = []
        self.batches_skipped = self.batches_read = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            known = isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1
            values = f.value if isinstance(f, In) else (getattr(f, "value", None),)
            if known and all(isinstance(v, (int, str)) and not isinstance(v, bool) for v in values):
                self.filters.append(f)
            yield f

    def partitions(self) -> list[BatchRange]:
        """Shares of files by size, from the listing alone; with ``batches``, ranges of that many, for which every footer is read."""
        store, inner = located(self.path)
        ranges = []
        for file in arrow_files(store, inner):
            if self.batches is None:
                shares = max(1, -(-store.get_file_info(file).size // self.size))
                ranges += [BatchRange(file, i, shares) for i in range(shares)]
            else:
                with _open(self.path, file) as source:
                    n = pa.ipc.open_file(source).num_record_batches
                ranges += [BatchRange(file, i, i + self.batches, True) for i in range(0, n, self.batches)]
        return ranges

    def read(self, part: BatchRange) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.path)
        with store.open_input_file(part.path) as source:
            reader = pa.ipc.open_file(source)
            names = reader.schema.names
            filters = [f for f in self.filters if f.attribute[0] in names]
            limits = _stored_limits(store, part.path) if filters else {}
            compared = sorted({names.index(f.attribute[0]) for f in filters})
            probe = pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=compared)) if compared else None
            wanted = pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in self.columns])) if self.columns else reader
            for i in part.of_file(reader.num_record_batches):
                if not all(self._possible(f, limits, i) for f in filters):
                    self.batches_skipped += 1
                    continue
                keep = None
                if probe is not None:
                    found = probe.get_batch(i)
                    for f in filters:
                        ok = _passes(f, found.column(found.schema.get_field_index(f.attribute[0])))
                        keep = ok if keep is None else pc.and_(keep, ok)
                    if not pc.any(keep).as_py():
                        self.batches_skipped += 1
                        continue
                self.batches_read += 1
                batch = wanted.get_batch(i).select(self.columns)
                yield batch if keep is None else batch.filter(keep)

    @staticmethod
    def _possible(f: Filter, limits: dict, i: int) -> bool:
        known = limits.get(f.attribute[0])
        if known is None or i >= len(known):
            return True
        return known[i] is not None and _may_hold(f, *known[i])


def _limits(batch: pa.RecordBatch) -> dict[str, list | None]:
    """[least, largest] of each whole-number and text column; None if all values are null."""
    out = {}
    for field, column in zip(batch.schema, batch.columns):
        if pa.types.is_integer(field.type) or pa.types.is_string(field.type) or pa.types.is_large_string(field.type):
            found = pc.min_max(column).as_py()
            out[field.name] = None if found["min"] is None else [found["min"], found["max"]]
    return out


def _stored_limits(store: fs.FileSystem, file: str) -> dict[str, list]:
    """Column -> limits of each batch, from the file beside ``file``; nothing if there is none."""
    if store.get_file_info(f"{file}.limits").type != fs.FileType.File:
        return {}
    with store.open_input_stream(f"{file}.limits") as source:
        rows = json.loads(source.read())
    return {c: [r[c] for r in rows] for c in (rows[0] if rows else {})}


class FeatherSource(DataSource):
    """Options: ``path``, ``columns`` (comma list, read nothing else),
    ``bytesPerPartition`` (128 MiB) or ``batchesPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "feather"

    def _arrow_schema(self) -> pa.Schema:
        path = self.options["path"]
        with _open(path, _files(path)[0]) as source:
            schema = pa.ipc.open_file(source).schema
        wanted = self.options.get("columns")
        return pa.schema([schema.field(c) for c in wanted.split(",")]) if wanted else schema

    def schema(self):
        return from_arrow_schema(self._arrow_schema())

    def reader(self, schema) -> FeatherReader:
        batches = self.options.get("batchesPerPartition")
        return FeatherReader(self.options["path"], [f.name for f in schema.fields], int(batches) if batches else None,
                             int(self.options.get("bytesPerPartition", str(128 << 20))))


def read_feather(spark: SparkSession, path: str, columns: list[str] | None = None, batches: int | None = None) -> DataFrame:
    """Files are dealt by size, or ``batches`` record batches to a partition.
    Turns the pushdown of filters into Python sources on for the session."""
    spark.dataSource.register(FeatherSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("feather").option("path", path)
    reader = reader.option("batchesPerPartition", str(batches)) if batches else reader
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()


def write_complete(store: fs.FileSystem, final: str, batches) -> int:
    """Writes the batches under a name of its own and moves the file to
    ``final`` once it is complete, after the limits of its batches
    (``<final>.limits``); no rows leave no file.  Returns the rows."""
    partial, sink, writer, rows, limits = f"{final}.{uuid.uuid4().hex}.tmp", None, None, 0, []
    for batch in batches:
        if batch.num_rows:
            if writer is None:
                sink = store.open_output_stream(partial)
                writer = pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
            limits.append(_limits(batch))
    if writer is not None:
        writer.close()
        sink.close()
        with store.open_output_stream(f"{final}.limits") as out:
            out.write(json.dumps(limits).encode())
        store.move(partial, final)
    return rows


def write_feather(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` under ``path`` and returns (file, n_rows).  A file gets its
    final name only when complete, so a retried task leaves no half file."""
    def write(batches):
        from pyspark import TaskContext

        store, inner = located(path)
        store.create_dir(inner, recursive=True)
        # Named by partition: a retried or speculative copy replaces its twin.
        final = f"{inner}/part-{TaskContext.get().partitionId():06d}.arrow"
        rows = write_complete(store, final, batches)
        if rows:
            yield pa.RecordBatch.from_pydict({"file": [final], "n_rows": [rows]})

    return df.mapInArrow(write, "file string, n_rows long")
