"""ST: streaming operators on the events table, checked against batch SQL."""

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractum.catalog.base import query
from tractum.catalog.views import epoch_ms
from tractum.operators.ordered import lag_within, weighted_decay
from tractum.streaming import operators as S
from tractum.streaming import stateful as X
from tractum.streaming.runner import appended, first_of, latest, merged, output, read_events, run_available

DAY, HOUR = 86_400_000, 3_600_000


def _columns(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


LONG, TEXT = T.LongType(), T.StringType()
WINDOWS = _columns(start_ms=LONG, event_type=TEXT, n=LONG)


FILES = 1000  # of a micro-batch; the results don't depend on it


def _events(t):
    return read_events(t.spark, t.folder, FILES)


def _stream(t):
    return S.with_event_time(_events(t), epoch_ms("ts"))


@query("stream_edge_counts", "", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_edge_counts(t):
    keys = ["user_id", "event_type"]
    return merged(_events(t), S.partial_counts(keys), keys, _columns(user_id=LONG, event_type=TEXT, n=LONG))


@query("stream_dedup", "", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(t):
    """The stream arrives twice; each event stays once."""
    twice = _stream(t).union(_stream(t))
    return first_of(twice.select("event_id", "user_id", "event_type"), "event_id")


@query("stream_sliding_rate", "smp", f"""
    SELECT start_ms, event_type, CAST(sum(spike) AS BIGINT) AS n FROM (SELECT scenario AS event_type, spike, unnest([t_ms // {HOUR} * {HOUR} - k * {HOUR} FOR k IN range(0, 6)]) AS start_ms FROM smp) s GROUP BY 1, 2""")
def stream_sliding_rate(t):
    spikes = S.partial_counts(["event_type"], "6 hours", "1 hour", F.when(F.col("event_type") == "error", 1).otherwise(0))
    return merged(_stream(t), spikes, ["start_ms", "event_type"], WINDOWS)


@query("stream_latest_fresh", "smp", f"""
    SELECT id AS user_id, max(t_ms) AS t_ms, arg_max(scenario, (t_ms, event_id)) AS event_type, arg_max(value, (t_ms, event_id)) AS value FROM smp GROUP BY 1
    HAVING (SELECT max(t_ms) FROM smp) - max(t_ms) <= {DAY // 4}""")
def stream_latest_fresh(t):
    frames = latest(S.latest_frames(_stream(t), "user_id", ["event_type", "value"]), ["user_id"])
    return S.fresh_only(frames, DAY // 4)


@query("stream_ewma", "smp", """
    SELECT id, count(*) AS n_samples, round(sum(0.2 * power(0.8, age - 1) * value), 6) AS ewma FROM
      (SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY t_ms DESC, event_id DESC) AS age FROM smp) s GROUP BY 1""")
def stream_ewma(t):
    """Samples land as they come; the decay is a ranked sum over all of them."""
    samples = _stream(t).select(F.col("user_id").alias("id"), "t_ms", "event_id", "value")
    return weighted_decay(appended(samples), ["id"], ["t_ms", "event_id"], "value", 0.2, "ewma").withColumn("ewma", F.round("ewma", 6))


@query("stream_ewma_ordered", "smp", """
    SELECT id, count(*) AS n_samples, round(sum(0.2 * power(0.8, age - 1) * value), 6) AS ewma FROM
      (SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY t_ms DESC, event_id DESC) AS age FROM smp WHERE value IS NOT NULL) s GROUP BY 1""")
def stream_ewma_ordered(t):
    """The recurrence itself, with samples held back until the watermark has passed them."""
    samples = _stream(t).withColumnRenamed("user_id", "id")
    out = latest(X.ewma_in_order(samples, 0.2, "60 days"), ["id"])
    return out.select("id", "n_samples", F.round("ewma", 6).alias("ewma"))


def _watched(t, limit: str, shift=None):
    """(held frames, violations): the last word of the stream on each id, and its side output."""
    millis = epoch_ms("ts") if shift is None else epoch_ms("ts") - shift
    frames = S.with_event_time(_events(t), millis).withColumnsRenamed({"user_id": "id", "event_type": "kind"})
    stream = X.watch_frames(frames, limit)
    base, _ = run_available(stream, "update", lambda batch: {"held": batch.where("event in ('frame', 'stale')"), "violations": batch.where("event = 'violation'")}, "frames")
    rest = [c for c in stream.columns if c != "id"]
    held = output(t.spark, base, stream.schema, "held").groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("batch", F.col("event") == "frame")).alias("r")).select("id", "r.*")
    return held, output(t.spark, base, stream.schema, "violations")


@query("stream_frame_expiry", "smp", f"""
    SELECT id AS user_id, max(t_ms) AS t_ms, arg_max(scenario, (t_ms, event_id)) AS event_type, arg_max(value, (t_ms, event_id)) AS value FROM smp GROUP BY 1
    HAVING (SELECT max(t_ms) FROM smp) - max(t_ms) <= {DAY // 4}""")
def stream_frame_expiry(t):
    """Frames that no timer has expired when the stream ends."""
    held, _ = _watched(t, "6 hours")
    return held.where("event = 'frame'").select(F.col("id").alias("user_id"), "t_ms", F.col("kind").alias("event_type"), "value")


@query("stream_order_violations", "smp", f"""
    SELECT id AS user_id, event_id, t, p AS before FROM (SELECT id, event_id, t, lag(t) OVER (PARTITION BY id ORDER BY event_id) AS p
      FROM (SELECT id, event_id, t_ms - CASE WHEN event_id % 17 = 0 THEN {3 * DAY} ELSE 0 END AS t FROM smp) a) b WHERE t < p""")
def stream_order_violations(t):
    """Frames that go back in time, from the stream's side output; every 17th frame carries a clock that is three days late."""
    _, violations = _watched(t, "60 days", F.when(F.col("event_id") % 17 == 0, 3 * DAY).otherwise(0))
    return violations.select(F.col("id").alias("user_id"), "event_id", F.col("t_ms").alias("t"), "before")


KINDS = ["click", "purchase", "signup", "view"]


@query("stream_validate", "", """
    SELECT event_type, event_type <> 'error' AS valid, count(*) AS n, min(v) AS lowest, max(v) AS highest FROM
      (SELECT event_type, CASE WHEN event_type <> 'error' THEN least(greatest(value, 1.0), 20.0) ELSE value END AS v FROM events) s GROUP BY 1, 2""")
def stream_validate(t):
    stream = _events(t).select("event_id", "event_type", "value")
    base, _ = run_available(stream, "append", lambda batch: S.split_valid(batch, KINDS, 1.0, 20.0))
    def side(name):
        return output(t.spark, base, stream.schema, name).select("event_type", "value", F.lit(name == "valid").alias("valid"))
    return side("valid").union(side("invalid")).groupBy("event_type", "valid").agg(
        F.count("*").alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


@query("order_violations", "smp", """
    SELECT id, count(*) AS n_rows, count(*) FILTER (WHERE t_ms < p) AS n_violations FROM
      (SELECT id, t_ms, lag(t_ms) OVER (PARTITION BY id ORDER BY value, event_id) AS p FROM smp) s GROUP BY 1""")
def order_violations(t):
    """Steps back in time when samples are taken in order of their value."""
    df = lag_within(t.smp().select("id", "t_ms", "value", "event_id"), ["id"], ["value", "event_id"], ["t_ms"])
    return df.groupBy("id").agg(F.count("*").alias("n_rows"), F.count_if(F.expr("t_ms < prev_t_ms")).alias("n_violations"))


@query("stream_tumbling", "smp", f"SELECT t_ms // {HOUR} * {HOUR} AS start_ms, scenario AS event_type, count(*) AS n FROM smp GROUP BY 1, 2")
def stream_tumbling(t):
    return merged(_stream(t), S.partial_counts(["event_type"], "1 hour"), ["start_ms", "event_type"], WINDOWS)


def _closed(width: int, slide: int, amount: str) -> str:
    """Windows that end at or before the last watermark, six hours behind the newest event."""
    starts = f"unnest([t_ms // {slide} * {slide} - k * {slide} FOR k IN range(0, {width // slide})])"
    return f"""SELECT start_ms, event_type, CAST(sum(v) AS BIGINT) AS n FROM (SELECT scenario AS event_type, {amount} AS v, {starts} AS start_ms FROM smp) s
      WHERE start_ms + {width} <= (SELECT max(t_ms) FROM smp) - {6 * HOUR} GROUP BY 1, 2"""


@query("stream_windows_closed", "smp", _closed(HOUR, HOUR, "1"))
def stream_windows_closed(t):
    """Windows told once, when the watermark has passed them; the state holds open ones only."""
    return appended(S.windowed_counts(_stream(t), ["event_type"], "6 hours", "1 hour"))


@query("stream_sliding_closed", "smp", _closed(6 * HOUR, HOUR, "spike"))
def stream_sliding_closed(t):
    spike = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return appended(S.windowed_counts(_stream(t), ["event_type"], "6 hours", "6 hours", "1 hour", spike))


@query("stream_dedup_bounded", "", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup_bounded(t):
    """Repeats dropped in the stream, with ids held for the watermark's delay."""
    stream = _stream(t)
    twice = S.deduplicate(stream.unionByName(_stream(t)), "event_id", "60 days")
    return appended(twice.select("event_id", "user_id", "event_type"))


@query("observe_metrics", "", """
    SELECT 'batch' AS source, count(*) AS n_rows, count(*) FILTER (WHERE event_type = 'error') AS n_errors FROM events
    UNION ALL SELECT 'stream', count(*), count(*) FILTER (WHERE event_type = 'error') FROM events""")
def observe_metrics(t):
    """Row metrics collected while the rows pass, in a batch and in a stream."""
    metrics = [F.count("*").alias("n_rows"), F.count_if(F.col("event_type") == "error").alias("n_errors")]
    seen = Observation("progress")
    watched = t.read("events").observe(seen, *metrics)
    watched.write.format("noop").mode("overwrite").save()
    # One row of metrics per micro-batch, landed with it: exact for any number of batches.
    base, _ = run_available(_events(t), "append", lambda batch: {"out": batch.agg(*metrics)})
    landed = output(t.spark, base, _columns(n_rows=LONG, n_errors=LONG))
    totals = landed.agg(F.lit("stream").alias("source"), F.sum("n_rows").alias("n_rows"), F.sum("n_errors").alias("n_errors"))
    own = t.spark.createDataFrame([("batch", seen.get["n_rows"], seen.get["n_errors"])], "source string, n_rows long, n_errors long")
    return own.union(totals)
