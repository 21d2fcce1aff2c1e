"""Streaming twins of the ordered and stateful measures."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tractum.functions.columns import is_finite


def with_event_time(events: DataFrame, millis: Column) -> DataFrame:
    """Adds ``t_ms`` and the instant ``at`` (needed for watermarks); neither
    depends on the session time zone."""
    return events.withColumn("t_ms", millis).withColumn("at", F.timestamp_millis("t_ms"))


def edge_counts(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts with all keys in the state; where keys have no end, land partial
    counts instead (``partial_counts``, ``runner.merged``)."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


def deduplicate(events: DataFrame, id_column: str, delay: str) -> DataFrame:
    """Drops repeats that come within the watermark; rows later than ``delay``
    are dropped as well.  Where none may be lost, use ``runner.first_of``."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark([id_column])


def windowed(events: DataFrame, keys: Sequence[str], width: str, slide: str | None, amount: Column | None) -> DataFrame:
    window = F.window("at", width, slide) if slide else F.window("at", width)
    amount = F.lit(1) if amount is None else amount
    grouped = events.groupBy(window.alias("_w"), *keys).agg(F.sum(amount).cast("long").alias("n"))
    return grouped.select(F.unix_millis("_w.start").alias("start_ms"), *keys, "n")


def windowed_counts(events: DataFrame, keys: Sequence[str], delay: str, width: str, slide: str | None = None,
                    amount: Column | None = None) -> DataFrame:
    """Counts (or sums of ``amount``) per window with bounded state: windows
    older than the watermark are closed, and rows later than ``delay`` are not
    counted.  ``partial_counts`` counts them all."""
    return windowed(events.withWatermark("at", delay), keys, width, slide, amount)


def partial_counts(keys: Sequence[str], width: str | None = None, slide: str | None = None,
                   amount: Column | None = None) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """Counts of one micro-batch, to be landed and added up: the sum does not
    depend on how rows fall into batches, no row is too late, and no state is
    kept between batches."""
    def route(batch: DataFrame) -> dict[str, DataFrame]:
        if width is None:
            return {"out": batch.groupBy(*keys).agg((F.count("*") if amount is None else F.sum(amount).cast("long")).alias("n"))}
        return {"out": windowed(batch, keys, width, slide, amount)}

    return route


def latest_frames(events: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The last frame of each key by (time, event id)."""
    order = F.struct("t_ms", "event_id")
    return events.groupBy(key).agg(F.max("t_ms").alias("t_ms"), *[F.max_by(f, order).alias(f) for f in fields])


def fresh_only(frames: DataFrame, limit_ms: int) -> DataFrame:
    """Frames at most ``limit_ms`` older than the newest event seen.  Wall-clock
    time would make a rerun differ, so event time is the clock."""
    newest = frames.agg(F.max("t_ms")).scalar()
    return frames.where(newest - F.col("t_ms") <= limit_ms)


EWMA_OUT = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_samples", T.LongType()), T.StructField("ewma", T.DoubleType())])
EWMA_STATE = T.StructType([T.StructField("n", T.LongType()), T.StructField("a", T.DoubleType()), T.StructField("last", T.LongType())])


def ewma(samples: DataFrame, smoothing: float) -> DataFrame:
    """``a += s * (x - a)`` per id, carried from batch to batch.

    ``samples``: id, t_ms, event_id, value.  Rows are ordered inside a
    micro-batch, whose size the trigger bounds.  Batches must follow in time:
    a sample that comes before one already taken fails the query, since the
    recurrence can't be mended.  Samples in any order can be landed and passed
    to ``operators.ordered.weighted_decay``.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, a, last = state.get if state.exists else (0, 0.0, None)
        batch = pd.concat(list(frames)).sort_values(["t_ms", "event_id"])
        if last is not None and int(batch["t_ms"].iloc[0]) < last:
            raise ValueError(f"samples of id {key[0]} go back in time: {int(batch['t_ms'].iloc[0])} after {last}")
        x = batch["value"].to_numpy()
        decay = (1.0 - smoothing) ** np.arange(len(x), -1, -1)
        a = a * decay[0] + smoothing * float(np.dot(x, decay[1:]))
        n += len(x)
        state.update((n, a, int(batch["t_ms"].iloc[-1])))
        yield pd.DataFrame({"id": [key[0]], "n_samples": [n], "ewma": [a]})

    return samples.groupBy("id").applyInPandasWithState(step, EWMA_OUT, EWMA_STATE, "update", GroupStateTimeout.NoTimeout)


def split_valid(frames: DataFrame, kinds: Sequence[str], lo: float, hi: float) -> dict[str, DataFrame]:
    """Valid frames with the value clamped, and invalid ones with the reason."""
    reason = F.when(~F.col("event_type").isin(*kinds), "unknown_kind").when(
        F.col("value").isNull() | ~is_finite("value"), "value_not_finite")
    checked = frames.withColumn("reason", reason)
    clamped = F.least(F.greatest("value", F.lit(lo)), F.lit(hi))
    return {
        "valid": checked.where("reason IS NULL").withColumn("value", clamped).drop("reason"),
        "invalid": checked.where("reason IS NOT NULL"),
    }
