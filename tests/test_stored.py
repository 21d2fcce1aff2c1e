"""Range digests, the stored registry and filters in the Feather source."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from tractum.plans.stored import Registry
from tractum.session import stage
from tractum.sources import ranges
from tractum.sources.feather import FeatherReader, read_feather, write_feather


def plain_tree(data, width, fanout):
    level = [hashlib.sha256(data[i:i + width]).hexdigest() for i in range(0, len(data), width)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i:i + fanout]).encode()).hexdigest() for i in range(0, len(level), fanout)]
    return level[0]


def test_one_file_is_hashed_by_ranges(spark, tmp_path):
    rng = random.Random(1)
    files = {"empty": b"", "small": b"abc", "exact": rng.randbytes(4000), "large": rng.randbytes(123_457), "runs": rng.randbytes(27_001)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    parts = ranges.file_ranges(spark, str(tmp_path), width=1000)
    assert parts.where("path like '%large'").count() == 124
    hashed = stage(ranges.range_digests(parts))
    got = {r.path.rsplit("/", 1)[1]: (r.n_bytes, r.n_ranges, r.tree) for r in ranges.tree_digest(hashed, fanout=3).collect()}
    assert got == {n: (len(d), max(1, -(-len(d) // 1000)), plain_tree(d, 1000, 3)) for n, d in files.items() if d}
    changed = bytearray(files["large"])
    changed[77_123] ^= 1
    (tmp_path / "large").write_bytes(bytes(changed) + b"more" * 300)
    again = ranges.range_digests(ranges.file_ranges(spark, str(tmp_path), width=1000))
    assert sorted((r.part, r.status) for r in ranges.changed_ranges(again, hashed).collect()) == [(77, "changed"), (123, "changed"), (124, "unexpected")]


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def entries(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, seq long")


def test_only_touched_ranges_are_written(spark, tmp_path, monkeypatch):
    reg = Registry(spark, str(tmp_path / "r"), SCHEMA, "id", width=100)
    assert (reg.version(), reg.read().count()) == (0, 0)
    assert reg.upsert(entries(spark, [(i, f"a{i}", i) for i in range(0, 1000, 10)] + [(-5, "below", 1)]), "seq") == 1
    before = {r.range: r.folder for r in reg.manifest().collect()}
    assert len(before) == 11
    reg.upsert(entries(spark, [(120, "old", 1), (120, "new", 2), (125, None, 1), (2000, "far", 1)]), "seq")
    after = {r.range: (r.folder, r.n_rows) for r in reg.manifest().collect()}
    assert {k for k in after if after[k][0] != before.get(k)} == {1, 20} and after[1][1] == 11
    rows = {r.id: r.name for r in reg.read().collect()}
    want = {i: f"a{i}" for i in range(0, 1000, 10)} | {-5: "below", 120: "new", 125: None, 2000: "far"}
    assert rows == want
    assert {r.id: r.name for r in reg.read(1).collect()}[120] == "a120" and reg.read(1).count() == 101

    def interrupted(manifest, version):
        raise OSError("lost")

    monkeypatch.setattr(reg, "_publish", interrupted)
    with pytest.raises(OSError):
        reg.upsert(entries(spark, [(120, "never", 3)]), "seq")
    monkeypatch.undo()
    assert reg.version() == 2 and {r.id: r.name for r in reg.read().collect()} == want
    assert reg.upsert(entries(spark, [(120, "third", 3)]), "seq") == 3
    assert {r.id: r.name for r in reg.read().collect()} == want | {120: "third"}
    with pytest.raises(ValueError):
        reg.upsert(entries(spark, [(None, "x", 1)]), "seq")


def test_filters_skip_batches(spark, tmp_path):
    df = spark.range(0, 60_000, numPartitions=2).select((F.col("id") + 720575940000000000).alias("id"), (F.col("id") % 7).alias("n"), F.concat(F.lit("k"), F.col("id") % 3).alias("name"),
                                                        F.when(F.col("id") < 10_000, F.col("id")).alias("early"))
    path = str(tmp_path / "f")
    write_feather(df, path).collect()

    def read(filters, columns=("id", "name")):
        reader = FeatherReader(path, list(columns), None, 50_000)
        assert list(reader.pushFilters(filters)) == filters
        parts = reader.partitions()
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        return rows, reader.batches_read, reader.batches_skipped, len(parts)

    rows, used, skipped, parts = read([])
    assert (len(rows), skipped) == (60_000, 0) and parts > 2
    base, total = 720575940000000000, used
    rows, used, skipped, _ = read([In(("id",), (base + 5, base + 7, base + 59_999))])
    assert (sorted(r["id"] - base for r in rows), used, used + skipped) == ([5, 7, 59_999], 2, total)
    assert read([EqualTo(("n",), 9)])[:2] == ([], 0)
    rows, used, *_ = read([GreaterThan(("id",), base + 50_000), LessThanOrEqual(("id",), base + 50_010), EqualTo(("name",), "k1")], ("name",))
    assert len(rows) == 3 and used == 1 and rows[0] == {"name": "k1"}
    assert read([EqualTo(("early",), 3)])[:2] == ([{"id": base + 3, "name": "k0"}], 1)
    for file in (tmp_path / "f").glob("*.limits"):  # files of other writers: only the compared column is read first
        file.unlink()
    assert read([In(("id",), (base + 5,))])[1:3] == (1, total - 1)
    back = read_feather(spark, path)
    assert back.where(F.col("id").isin(base + 5, base + 31_000)).count() == 2
    assert back.where("name = 'k2' and n > 5 and early is not null").count() == df.where("name = 'k2' and n > 5 and early is not null").count()
    assert back.where("early is null").count() == 50_000
