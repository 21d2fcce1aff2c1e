"""Sources, sinks and stages."""

import hashlib
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tractum.session import shared_folder, stage
from tractum.sources import tables
from tractum.sources.feather import read_feather, write_feather


def test_feather_by_uri(spark, tmp_path):
    df = spark.range(50).repartition(2)
    assert sum(r.n_rows for r in write_feather(df, f"file://{tmp_path}/u").collect()) == 50
    assert sorted(r.id for r in read_feather(spark, f"file:{tmp_path}/u").collect()) == list(range(50))


def test_feather_on_another_filesystem(tmp_path):
    """Paths belong to the filesystem object, not to the machine; an unfinished file is not seen."""
    import pyarrow as pa
    from pyarrow import fs

    from tractum.sources import feather

    store = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    store.create_dir("d")
    batch = pa.RecordBatch.from_pydict({"x": [1, 2, 3]})
    assert feather.write_complete(store, "d/a.arrow", [batch, batch.slice(0, 0)]) == 3
    assert feather.write_complete(store, "d/b.arrow", []) == 0
    with store.open_output_stream("d/c.arrow.1.tmp") as out:
        out.write(b"half")
    assert feather.arrow_files(store, "d") == ["d/a.arrow"]
    with store.open_input_file("d/a.arrow") as source:
        assert pa.ipc.open_file(source).read_all().column("x").to_pylist() == [1, 2, 3]


def test_feather_round_trip_in_ranges(spark, tmp_path):
    df = spark.range(0, 50_000, numPartitions=3).select((F.col("id") + 720575940000000000).alias("id"), (F.col("id") % 7).alias("n"))
    files = write_feather(df, str(tmp_path / "f")).collect()
    assert sum(r["n_rows"] for r in files) == 50_000
    back = read_feather(spark, str(tmp_path / "f"), ["id"], batches=1)
    assert back.columns == ["id"] and back.rdd.getNumPartitions() > 3
    assert back.agg(F.sum(F.col("id") - 720575940000000000), F.count_distinct("id")).first() == (sum(range(50_000)), 50_000)


def test_delimited_is_strict_and_ignores_a_bom(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("﻿id\tn\n720575940628857210\t3\n", encoding="utf-8")
    schema = "id LONG, n INT"
    assert tables.read_delimited(spark, str(path), schema, "\t").collect()[0]["id"] == 720575940628857210
    path.write_text("id\tn\nx\t3\n")
    with pytest.raises(Exception):
        tables.read_delimited(spark, str(path), schema, "\t").collect()


def test_ids_are_text_in_csv(spark, tmp_path):
    df = spark.createDataFrame([(720575940628857211, 2)], "id long, n int")
    tables.write_delimited(df, str(tmp_path / "c"), ["n", "id"], ["id"])
    text = spark.read.text(str(tmp_path / "c")).collect()
    # Every part file, an empty one too, has the header.
    assert {r[0] for r in text} == {"n,id", "2,720575940628857211"}


def test_manifest_and_verification(spark, tmp_path):
    for name, data in (("a", b"one"), ("b", b"two" * 1000)):
        (tmp_path / name).write_bytes(data)
    m = tables.file_manifest(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r for r in m.collect()}
    assert got["b"]["n_bytes"] == 3000 and got["b"]["sha256"] == hashlib.sha256(b"two" * 1000).hexdigest()
    assert got["a"]["md5"] == hashlib.md5(b"one").hexdigest()
    kept = stage(m)
    (tmp_path / "a").write_bytes(b"ONE")
    (tmp_path / "c").write_bytes(b"new")
    status = {r["path"].rsplit("/", 1)[1]: r["status"] for r in tables.verify_manifest(tables.file_manifest(spark, str(tmp_path)), kept).collect()}
    assert status == {"a": "changed", "b": "ok", "c": "unexpected"}


def test_named_stage_is_reused_until_its_input_changes(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(5).write.parquet(path)
    first = tables.named_stage(spark.read.parquet(path), "demo", [path]).inputFiles()
    assert tables.named_stage(spark.read.parquet(path), "demo", [path]).inputFiles() == first
    spark.range(6).write.mode("overwrite").parquet(path)
    assert tables.named_stage(spark.read.parquet(path), "demo", [path]).count() == 6


class FakeContext:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def fake_session(master, conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=FakeContext(master))


def test_shared_folder_follows_the_session():
    named = fake_session("yarn", {"spark.checkpoint.dir": "hdfs:///shared"})
    assert shared_folder(named) == "hdfs:///shared" and named.sparkContext.folder is None
    with pytest.raises(RuntimeError):
        shared_folder(fake_session("yarn", {}))
    assert shared_folder(fake_session("local[2]", {})).startswith("/tmp/spark-")


def test_layout_dispatch(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert tables.dispatch(df, {"x": ["c"], "y": ["a", "b"]}) == "y"
    with pytest.raises(ValueError):
        tables.dispatch(df, {"x": ["c"]})


def test_partial_scan_states_no_totals(spark):
    part = tables.scan_totals(spark.range(100), F.col("id"), fraction=0.5).collect()[0]
    assert (part["complete"], part["n_rows"], part["weight"]) == (False, None, None)
