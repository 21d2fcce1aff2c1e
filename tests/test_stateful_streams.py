"""Stateful streams: samples in any order and batch, late rows, expiry and violations."""

import random

import pytest
from pyspark.sql import functions as F

from check import compare, connect
from tractum.catalog import load, streams
from tractum.streaming import stateful as X
from tractum.streaming.runner import output, run_available

SCHEMA = "id long, t_ms long, event_id long, kind string, value double"


@pytest.fixture
def write_files(tmp_path):
    def write(batches):
        """One file per batch, read in this order."""
        import os

        import pyarrow as pa
        import pyarrow.parquet as pq

        folder = tmp_path / f"files{random.random()}"
        folder.mkdir()
        for n, rows in enumerate(batches):
            cols = list(zip(*rows))
            table = pa.table({"id": pa.array(cols[0], pa.int64()), "t_ms": pa.array(cols[1], pa.int64()), "event_id": pa.array(cols[2], pa.int64()),
                              "kind": pa.array(cols[3], pa.string()), "value": pa.array(cols[4], pa.float64())})
            path = folder / f"{n}.parquet"
            pq.write_table(table, path)
            os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
        return str(folder)

    return write


def stream(spark, folder):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return s.withColumn("at", F.timestamp_millis("t_ms"))


def plain_ewma(rows, s=0.2):
    out = {}
    for i, _, _, _, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if v is not None:
            n, a = out.get(i, (0, 0.0))
            out[i] = (n + 1, a + s * (v - a))
    return out


def test_shuffled_files_give_the_one_batch_result(spark, write_files):
    """Samples up to 40 s late in four files, and in one: buffers are released in between and the result is the same."""
    rng = random.Random(2)
    rows = [(i, 1000 * t + rng.randrange(1000), 10 * t + i, "k", None if rng.random() < 0.05 else rng.random()) for t in range(240) for i in (0, 1, 2)]
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(40_000))
    want = {i: (n, pytest.approx(a)) for i, (n, a) in plain_ewma(rows).items()}
    for batches in ([late], [late[k:k + 180] for k in range(0, 720, 180)]):
        out = X.ewma_in_order(stream(spark, write_files(batches)), 0.2, "41 seconds")
        base, _ = run_available(out, "update")
        last = {}
        for r in output(spark, base, out.schema).orderBy("batch").collect():
            last[r.id] = r
        assert {i: (r.n_samples, r.ewma) for i, r in last.items()} == want
        assert all(r.n_late == 0 and 0 < r.n_waiting < 60 for r in last.values())


def test_late_samples_are_counted(spark, write_files):
    rows = [(1, 1000 * t, t, "k", float(t)) for t in range(100)]
    batches = [rows[50:], rows[:30] + [(1, 99_500, 200, "k", 7.0)], [(1, 99_700, 201, "k", 8.0), (2, 99_000, 202, "k", 1.0)]]
    out = X.ewma_in_order(stream(spark, write_files(batches)), 0.2, "10 seconds")
    base, _ = run_available(out, "update")
    rows_out = {r.id: r for r in output(spark, base, out.schema).orderBy("batch").collect()}
    assert {i: r.n_late for i, r in rows_out.items()} == {1: 30, 2: 0}
    want = plain_ewma(rows[50:] + batches[1][30:] + batches[2])
    assert {i: (r.n_samples, r.ewma) for i, r in rows_out.items()} == {i: (n, pytest.approx(a)) for i, (n, a) in want.items()}


def test_frames_expire_and_violations_are_told(spark, write_files):
    first = [(1, 1000, 1, "a", 1.0), (1, 900, 2, "b", 2.0), (2, 5000, 3, "c", None), (3, 800, 4, "d", 4.0)]
    second = [(2, 5200, 5, "e", 5.0), (4, 5300, 6, "f", 6.0), (3, 5100, 7, "g", 7.0), (3, 5050, 8, "h", 8.0), (5, 700, 9, "late", 9.0)]
    out = X.watch_frames(stream(spark, write_files([first, second])), "350 milliseconds")
    base, _ = run_available(out, "update")
    rows = output(spark, base, out.schema).orderBy("batch").collect()
    assert [(r.id, r.kind) for r in rows if r.event == "late"] == [(5, "late")]
    assert sorted((r.id, r.event_id, r.t_ms, r.before) for r in rows if r.event == "violation") == [(1, 2, 900, 1000), (3, 8, 5050, 5100)]
    last = {r.id: (r.event, r.kind) for r in rows if r.event in ("frame", "stale")}
    assert last == {1: ("stale", "a"), 2: ("frame", "e"), 3: ("frame", "g"), 4: ("frame", "f")}
    assert ("stale", 3, "d") in {(r.event, r.id, r.kind) for r in rows}


@pytest.mark.parametrize("key", ["stream_ewma_ordered", "stream_frame_expiry", "stream_order_violations"])
def test_queries_in_several_batches(spark, tmp_path, monkeypatch, key):
    """The events in three files, dealt by event_id: the same rows as the SQL twin on the whole table."""
    source = "/root/testdata/sf0.001"
    (tmp_path / "events.parquet").mkdir()
    con = connect(source)
    for k in range(3):
        path = tmp_path / "events.parquet" / f"{k}.parquet"
        con.execute(f"COPY (SELECT * FROM events WHERE event_id * 3 // (SELECT max(event_id) + 1 FROM events) = {k} ORDER BY event_id) TO '{path}' (FORMAT parquet)")
        import os
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    monkeypatch.setattr(streams, "FILES", 1)
    queries, oracles = load()
    problem, n = compare(spark, con, key, queries[key], oracles[key], str(tmp_path))
    assert not problem and n


class Store:
    """A key's state and timers without a store; it cannot list timers, and counts what is asked of it."""

    def __init__(self):
        self.timers, self.values, self.calls, self.watermark = set(), {}, 0, 0

    def getValueState(self, name, schema):
        return Cell(self, name)

    getListState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


class Cell:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def get(self):
        self.store.calls += 1
        return self.store.values.get(self.name)

    def update(self, value):
        self.store.calls += 1
        self.store.values[self.name] = value

    put = update

    def clear(self):
        self.update(None)


@pytest.mark.parametrize("make", [X._Frames, lambda: X._Recurrence(0.2)])
def test_a_key_asks_the_store_a_few_times(make):
    """New keys: one read, one write of each state and one timer; timers are moved without listing them."""
    store, op = Store(), make()
    op.init(store)
    row = (lambda t: (1, t, t, "k", 1.0)) if isinstance(op, X._Frames) else (lambda t: (1, t, t, 1.0))
    list(op.handleInputRows((1,), iter([row(100), row(200)]), store))
    assert store.calls <= 4 and len(store.timers) == 1
    store.watermark = 150
    list(op.handleInputRows((1,), iter([row(300)]), store))
    assert len(store.timers) == 1
    store.watermark = 1000
    store.timers.clear()
    last = list(op.handleExpiredTimer((1,), store, None))[-1]
    assert (last.event, last.t_ms, last.n_rows) == ("stale", 300, 3) if isinstance(op, X._Frames) else (last.n_samples, last.n_waiting, last.n_late) == (3, 0, 0)
