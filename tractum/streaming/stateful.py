"""Stateful operators with event-time timers: recurrences over samples that
come in any order, and expiry and order checks of frames inside the stream.

Both keep their state in the RocksDB store, which ``needs_state_store`` sets.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def needs_state_store(spark: SparkSession) -> None:
    """Sets the state store that timers and list states require, where the session has the default one."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, "") or ""):
        spark.conf.set(name, STORE)


def _moved(handle, timer: int | None, to: int) -> int:
    """The key's one timer, set to ``to``.  Its time is kept in the state: asking
    the store for a key's timers costs more than all else a key does."""
    if timer != to:
        if timer is not None:
            handle.deleteTimer(timer)
        handle.registerTimer(to)
    return to


AVERAGE = Row("id", "n_samples", "n_waiting", "n_late", "ewma")


class _Recurrence(StatefulProcessor):
    """``a += s * (x - a)`` in order of (t_ms, event_id): samples wait in a
    buffer until the watermark has passed them, then they are taken in order."""

    def __init__(self, smoothing: float):
        self.smoothing = smoothing

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t_ms long, event_id long, value double")
        self.taken = handle.getValueState("taken", "n long, late long, a double, n_waiting long, timer long")

    def _fold(self, a: float, samples) -> float:
        for _, _, x in samples:
            a += self.smoothing * (x - a)
        return a

    def _step(self, key, new, watermark: int, fired: bool = False) -> Iterator[Row]:
        n, late, a, n_waiting, timer = self.taken.get() or (0, 0, 0.0, 0, None)
        timer = None if fired else timer
        in_time = [s for s in new if s[0] > watermark]
        late += len(new) - len(in_time)
        samples = sorted([tuple(r) for r in (self.waiting.get() if n_waiting else ())] + in_time)
        ready = bisect_right(samples, watermark, key=lambda s: s[0])
        rest = samples[ready:]
        n, a = n + ready, self._fold(a, samples[:ready])
        if rest:
            self.waiting.put(rest)
            # One timer per release: at the first sample that still waits.
            timer = _moved(self.handle, timer, max(rest[0][0], watermark + 1))
        elif n_waiting:
            self.waiting.clear()
        self.taken.update((n, late, a, len(rest), timer))
        yield AVERAGE(key[0], n + len(rest), len(rest), late, self._fold(a, rest))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._step(key, [(t, e, v) for _, t, e, v in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._step(key, [], timerValues.getCurrentWatermarkInMs(), fired=True)

    def close(self) -> None:
        pass


def ewma_in_order(samples: DataFrame, smoothing: float, delay: str) -> DataFrame:
    """The recurrence over samples that come up to ``delay`` late, in any order.

    ``samples``: id, t_ms, event_id, value and the instant ``at``.  Gives, in
    update mode, each id's samples so far and its average as if those that still
    wait were the last ones; how they fall into batches has no influence.
    A sample that comes after the watermark has passed it is left out and
    counted in ``n_late``.  A NULL value leaves its sample out.
    """
    needs_state_store(samples.sparkSession)
    # Without the event-time column in its input the operator sees late samples, and counts them.
    kept = samples.where("value is not null").withWatermark("at", delay).select("id", "t_ms", "event_id", "value")
    return kept.groupBy("id").transformWithState(_Recurrence(smoothing), "id long, n_samples long, n_waiting long, n_late long, ewma double", "Update", "EventTime")


FRAME = Row("id", "event", "t_ms", "event_id", "kind", "value", "before", "n_rows", "n_violations")


class _Frames(StatefulProcessor):
    """Holds the newest frame of a key until the watermark has passed it."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last long, n long, back long, timer long, t_ms long, event_id long, kind string, value double")

    def _load(self):
        last, n, back, timer, *held = self.state.get() or (None, 0, 0, None, None, None, None, None)
        return last, n, back, timer, None if held[0] is None else tuple(held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, n, back, timer, held = self._load()
        watermark, out = timerValues.getCurrentWatermarkInMs(), []
        if held is not None and held[0] < watermark:  # its timer would fire in this batch
            out.append(("stale", *held, None))
            held = None
        for _, t, e, kind, value in sorted(rows, key=lambda r: r[2]):
            n += 1
            if last is not None and t < last:
                back += 1
                out.append(("violation", t, e, kind, value, last))
            last = t
            if t < watermark:
                out.append(("late", t, e, kind, value, None))
            elif held is None or (t, e) > (held[0], held[1]):
                held = (t, e, kind, value)
        if held is not None:
            timer = _moved(self.handle, timer, held[0] + 1)
            out.append(("frame", *held, None))
        self.state.update((last, n, back, timer, *(held or (None, None, None, None))))
        for row in out:
            yield FRAME(key[0], *row, n, back)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, n, back, _, held = self._load()
        self.state.update((last, n, back, None, None, None, None, None))
        if held is not None:
            yield FRAME(key[0], "stale", *held, None, n, back)

    def close(self) -> None:
        pass


FRAME_EVENTS = "id long, event string, t_ms long, event_id long, kind string, value double, before long, n_rows long, n_violations long"


def watch_frames(frames: DataFrame, limit: str) -> DataFrame:
    """What happens to the frames of each id, in update mode:

    ``violation``  a frame earlier than the one that came before it
    ``late``       a frame that arrives stale; it is not held
    ``frame``      the newest frame held after a batch
    ``stale``      the held frame is more than ``limit`` older than the newest
                   event of the stream; the id holds none any more

    ``frames``: id, t_ms, event_id, kind, value and the instant ``at``; frames of a
    batch come in order of event_id.  ``before``: the time a violation goes back from; ``n_rows``
    and ``n_violations`` count up to the end of the batch.
    """
    needs_state_store(frames.sparkSession)
    kept = frames.select("id", "t_ms", "event_id", "kind", F.coalesce("value", F.lit(float("nan"))).alias("value"), "at").withWatermark("at", limit).drop("at")
    return kept.groupBy("id").transformWithState(_Frames(), FRAME_EVENTS, "Update", "EventTime")
