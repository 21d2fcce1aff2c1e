"""Peaks by prominence and lagged autocorrelation of long series.

A series is laid out by range of (key, order), so it may cover many partitions.
Peaks are searched by a monotone stack in each partition; a peak that finds no
higher value there passes the partitions next to it by their largest and least
values (a few per partition, for the series that go on) and asks only the one
partition that holds a higher value.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tractum.operators.keys import join_null_safe
from tractum.operators.ordered import Ordered, rank_within
from tractum.session import stage


def _segments(table: pa.Table) -> list[tuple[int, int]]:
    """(begin, end) of the runs of one key; NULL is a key."""
    if not table.num_rows:
        return []
    codes = table.column("key").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(codes[1:] != codes[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(codes)]))


def _one_side(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the least value from it leftwards up to, not including,
    the nearest higher one, and whether there is a higher one."""
    low, closed = v.copy(), np.zeros(len(v), bool)
    stack: list[tuple[float, float]] = []  # values still without a higher one to their right, and their least values
    for i, x in enumerate(v.tolist()):
        least = x
        while stack and stack[-1][0] <= x:
            least = min(least, stack.pop()[1])
        low[i], closed[i] = least, bool(stack)
        stack.append((x, least))
    return low, closed


def _until_higher(v: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """Least value before the first one above each height, reading from the
    start; there is one above every height.  No value before it: +inf."""
    top, low = np.maximum.accumulate(v), np.minimum.accumulate(v)
    at = np.searchsorted(top, heights, "right")
    return np.where(at > 0, low[np.maximum(at - 1, 0)], np.inf)


def _beyond(chain: dict | None, at: int, step: int) -> tuple[np.ndarray, ...]:
    """(partitions, largest and least values so far) of a series outwards from its ``at``-th partition."""
    if chain is None:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    part, high, low = ((chain[k][:at][::-1] if step < 0 else chain[k][at + 1:]) for k in ("part", "high", "low"))
    return part, np.maximum.accumulate(high), np.minimum.accumulate(low)


def _block_peaks(chains: list[dict], places: dict):
    """The peaks of one partition, with what each side has found so far and the partition to ask for the rest."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_pos")
        head, tail = places.get(rows.column("_part")[0].as_py(), (None, None))
        values = rows.column("v").to_numpy()
        spans = _segments(rows)
        found = []
        for s, (begin, end) in enumerate(spans):
            v = values[begin:end]
            left, right = (head if s == 0 else None), (tail if s == len(spans) - 1 else None)
            before = chains[left[0]]["last"][left[1] - 1] if left and left[1] > 0 else np.inf
            after = chains[right[0]]["first"][right[1] + 1] if right and right[1] + 1 < len(chains[right[0]]["first"]) else np.inf
            at = np.flatnonzero((v > np.append(before, v[:-1])) & (v > np.append(v[1:], after)))
            if not len(at):
                continue
            cols = [begin + at]
            for end_of, step, (low, closed) in ((left, -1, _one_side(v)), (right, 1, [x[::-1] for x in _one_side(v[::-1])])):
                parts, high, least = _beyond(chains[end_of[0]] if end_of else None, end_of[1] if end_of else 0, step)
                hit = np.searchsorted(high, v[at], "right")  # the first partition outwards with a higher value
                passed = np.where(hit > 0, np.append(least, np.inf)[np.maximum(hit - 1, 0)], np.inf)
                ask = np.append(parts, -1)[hit]
                open_ = ~closed[at]
                cols += [np.where(open_, np.minimum(low[at], passed), low[at]), np.where(open_, ask, -1)]
            found.append(cols)
        row, low_left, ask_left, low_right, ask_right = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        taken = rows.take(pa.array(row.astype(np.int64)))
        return pa.table([taken.column("key"), taken.column("i"), taken.column("v"), pa.array(low_left), pa.array(low_right), pa.array(ask_left.astype(np.int64)), pa.array(ask_right.astype(np.int64))],
                        names=["key", "i", "v", "low_left", "low_right", "ask_left", "ask_right"])

    return run


def _answers(rows: pa.Table, asked: pa.Table) -> pa.Table:
    """Completes the sides of peaks that reach into this partition: from its end for a left side, from its start for a right one."""
    if not asked.num_rows:
        return asked.select(["key", "i", "side", "low"])
    rows = rows.sort_by("_pos")
    v, spans = rows.column("v").to_numpy(), _segments(rows)
    side, height, low = asked.column("side").to_pylist(), asked.column("v").to_numpy(), asked.column("low").to_numpy()
    left = np.array([s == "left" for s in side])
    found = np.empty(len(height))
    begin, end = spans[-1]  # the series that goes on in the next partition
    found[left] = _until_higher(v[begin:end][::-1], height[left])
    begin, end = spans[0]
    found[~left] = _until_higher(v[begin:end], height[~left])
    return pa.table([asked.column("key"), asked.column("i"), asked.column("side"), pa.array(np.minimum(low, found))], names=["key", "i", "side", "low"])


def _borders(rows: DataFrame) -> tuple[list[dict], dict]:
    """(chains, places): for each series that covers several partitions the
    first, last, least and largest values there, and for each partition where
    its first and its last series stand in which chain.  Brings at most two
    rows per partition together."""
    parts = rows.groupBy("_part").agg(F.min("_pos").alias("p_lo"), F.max("_pos").alias("p_hi"))
    own = rows.groupBy("_part", "key").agg(F.min("_pos").alias("lo"), F.max("_pos").alias("hi"), F.min_by("v", "_pos").alias("first"), F.max_by("v", "_pos").alias("last"),
                                          F.min("v").alias("low"), F.max("v").alias("high"))
    edge = own.join(F.broadcast(parts), "_part").where((F.col("lo") == F.col("p_lo")) | (F.col("hi") == F.col("p_hi")))
    runs: list[list] = []
    for r in sorted(edge.collect(), key=lambda r: r["lo"]):
        if runs and runs[-1][-1]["key"] == r["key"] and runs[-1][-1]["_part"] != r["_part"]:
            runs[-1].append(r)
        else:
            runs.append([r])
    chains, places = [], {}
    for run in runs:
        if len(run) == 1:
            continue
        for at, r in enumerate(run):
            head, tail = places.get(r["_part"], (None, None))
            here = (len(chains), at)
            places[r["_part"]] = (here if r["lo"] == r["p_lo"] else head, here if r["hi"] == r["p_hi"] else tail)
        chains.append({"part": np.array([r["_part"] for r in run]), **{k: np.array([r[k] for r in run]) for k in ("first", "last", "low", "high")}})
    return chains, places


def peaks(df: DataFrame, key: str, order: Sequence[Column | str], value: str, carry: Sequence[str] = ()) -> DataFrame:
    """``key``, ``i`` (place in the series, from 0), ``value``, ``prominence`` and
    the columns ``carry`` (of the sample) of every peak, over ordered samples of
    each key.

    A peak is a value above its neighbours; of a run of equal values the middle
    one counts (the left of two).  The first and last value of a series are no
    peaks.  The prominence is the height above the higher of the two least
    values found to the left and to the right before a higher value or the end.
    NULL and NaN values are left out; a NULL key is a key.  Building the result
    runs jobs and stages tables in the shared folder.
    """
    v = F.col(value).cast("double")
    kept = df.where(v.isNotNull() & ~F.isnan(v))
    numbered = rank_within(kept.select(F.col(key).alias("key"), v.alias("v"), *[(F.col(c) if isinstance(c, str) else c).alias(f"_o{n}") for n, c in enumerate(order)],
                                      *[F.col(c).alias(f"_c{n}") for n, c in enumerate(carry)]),
                           ["key"], [f"_o{n}" for n in range(len(order))], "i")
    numbered = stage(numbered.select("key", "v", (F.col("i") - 1).alias("i"), *[f"_c{n}" for n in range(len(carry))]))
    changes = Ordered(numbered.select("key", "i", "v"), ["key"], ["i"]).lag(["v"]).where("prev_v is null or v <> prev_v").select("key", "i", "v")
    laid = Ordered(changes, ["key"], ["i"])
    rows = laid.rows.select("key", "i", "v", "_pos", "_part")
    kind = rows.schema["key"].dataType.simpleString()
    found = stage(rows.groupBy("_part").applyInArrow(_block_peaks(*_borders(rows)), f"key {kind}, i long, v double, low_left double, low_right double, ask_left long, ask_right long"))
    sides = found.select("key", "i", "v", F.explode(F.array(
        F.struct(F.lit("left").alias("side"), F.col("low_left").alias("low"), F.col("ask_left").alias("ask")),
        F.struct(F.lit("right").alias("side"), F.col("low_right").alias("low"), F.col("ask_right").alias("ask")))).alias("s")).select("key", "i", "v", "s.*")
    asked = stage(sides.where("ask >= 0"))
    wanted = rows.join(F.broadcast(asked.select(F.col("ask").alias("_part")).distinct()), "_part", "left_semi")
    answered = wanted.groupBy("_part").cogroup(asked.withColumnRenamed("ask", "_part").groupBy("_part")).applyInArrow(_answers, f"key {kind}, i long, side string, low double")
    lows = sides.where("ask < 0").select("key", "i", "side", "low").unionByName(answered).groupBy("key", "i").agg(F.max("low").alias("base"))
    # The run of a peak ends where the next value begins.
    runs = Ordered(changes, ["key"], [F.col("i").desc()]).lag(["i"], "next_").select("key", "i", F.col("next_i").alias("next"))
    out = join_null_safe(join_null_safe(found.select("key", "i", "v"), lows, ["key", "i"]), runs, ["key", "i"])
    out = out.select("key", F.floor((F.col("i") + F.col("next") - 1) / 2).alias("i"), "v", (F.col("v") - F.col("base")).alias("prominence"))
    if carry:
        out = join_null_safe(out, numbered.drop("v"), ["key", "i"])
    return out.select(F.col("key").alias(key), "i", F.col("v").alias(value), "prominence", *[F.col(f"_c{n}").alias(c) for n, c in enumerate(carry)])


def autocorrelation(df: DataFrame, key: str, order: Sequence[Column | str], value: str, lags: Sequence[int], block: int = 4096) -> DataFrame:
    """``key``, ``n``, ``lag`` and ``r`` for each lag below the length of the
    series: sum of (x_i - m)(x_(i+lag) - m) over the sum of (x_i - m)^2; 0 for
    a constant series.

    A block of ``block`` samples also holds the first samples of the next one,
    as many as the longest lag, so no task holds a whole series.  NULL and NaN
    values are left out; a NULL key is a key.
    """
    longest = max(lags)
    block = max(block, longest)
    v = F.col(value).cast("double")
    kept = df.where(v.isNotNull() & ~F.isnan(v))
    mean = kept.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.avg(v).alias("m"))
    ranked = rank_within(kept.select(F.col(key).alias("key"), v.alias("v"), *[(F.col(c) if isinstance(c, str) else c).alias(f"_o{n}") for n, c in enumerate(order)]),
                         ["key"], [f"_o{n}" for n in range(len(order))], "i").select("key", (F.col("i") - 1).alias("i"), "v")
    centred = join_null_safe(ranked, mean, ["key"]).select("key", "n", "i", (F.col("v") - F.col("m")).alias("x"))
    own = F.floor(F.col("i") / block)
    halo = (F.col("i") % block < longest) & (own > 0)
    dealt = centred.select("key", "n", "i", "x", own.alias("own"), F.explode(F.when(halo, F.array(own - 1, own)).otherwise(F.array(own))).alias("block"))
    w = Window.partitionBy("key", "block").orderBy("i")
    here = F.col("own") == F.col("block")
    products = dealt.select("key", "n", "x", here.alias("here"), *[F.lead("x", lag).over(w).alias(f"x{lag}") for lag in lags]).where("here")
    sums = products.groupBy("key", "n").agg(F.sum(F.col("x") * F.col("x")).alias("total"), *[F.sum(F.col("x") * F.col(f"x{lag}")).alias(f"s{lag}") for lag in lags])
    each = sums.select("key", "n", "total", F.explode(F.array(*[F.struct(F.lit(lag).alias("lag"), F.col(f"s{lag}").alias("s")) for lag in lags])).alias("e")).where("e.lag < n")
    return each.select(F.col("key").alias(key), "n", "e.lag", F.when(F.col("total") > 0, F.col("e.s") / F.col("total")).otherwise(F.lit(0.0)).alias("r"))


def rhythm(correlations: DataFrame, key: str, step: float) -> DataFrame:
    """``key``, ``score`` (the largest correlation), ``lag`` (the least one that
    has it) and ``frequency`` (1 / (lag * step)), from ``autocorrelation``."""
    best = correlations.groupBy(key).agg(F.max(F.struct("r", (-F.col("lag")).alias("minus"))).alias("b"))
    return best.select(key, F.col("b.r").alias("score"), (-F.col("b.minus")).alias("lag"), (1.0 / (-F.col("b.minus") * step)).alias("frequency"))
