"""Variable-capacity best-fit packing of documents into training sequences.

Pieces are placed longest first into the fullest open bin that holds them.  If
none does, a bin is opened with the permitted length of least cost per token
it can expect to hold, given all pieces still to come.  At the end each bin is
cut down to the least permitted length that holds its contents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractum.session import stage

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 64  # cost of a sequence besides its length, in tokens
GROUP = 50_000  # expected pieces packed together; groups are dealt by hash and packed side by side


def best_fit(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece and the final capacity of each bin.

    ``lengths`` are at most the largest capacity.  Ties keep the given order.
    """
    sizes = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: dict[int, list[int]] = {}  # open bins by free space
    room = 0  # bit r is set if a bin with r free tokens is open
    opened: list[int] = []
    left = int(lengths.sum())
    for at, n in zip(order.tolist(), lengths[order].tolist()):
        left -= n
        fitting = room >> n
        if n and fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            number = free[space].pop()
            if not free[space]:
                room &= ~(1 << space)
        elif n or not opened:
            space = min((c for c in sizes if c >= n), key=lambda c: ((overhead + c) / (n + min(c - n, left)) if n else c, c))
            number = len(opened)
            opened.append(space)
        else:
            number, space = len(opened) - 1, None  # nothing to place
        bins[at] = number
        if space is None:
            continue
        offsets[at] = opened[number] - space
        rest = space - n
        free.setdefault(rest, []).append(number)
        room |= 1 << rest
    filled = np.bincount(bins, weights=lengths, minlength=len(opened)).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    return bins, offsets, np.asarray(sizes)[np.searchsorted(sizes, filled)] if len(opened) else filled


def pack(df: DataFrame, id_column: str, length: Column, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """One row per piece: ``id_column``, ``piece`` (from 0), ``start`` and
    ``length`` in the document, ``bin_id``, ``offset`` in the bin, ``capacity``
    and ``filled`` of the bin.

    A document longer than the largest capacity is cut into pieces of that
    length and a rest; nothing is dropped.  Length 0 or null gives one piece
    of length 0.  Rows with the same or a null id are packed each.  Rows are
    dealt to groups by their place in a staged table, so repeated rows are
    spread as well.  Building the result runs jobs.
    """
    top = max(capacities)
    n = F.coalesce(length, F.lit(0)).cast("long")
    rows = df.select(F.col(id_column).alias("_id"), n.alias("_n"))
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_n") / top) - 1, F.lit(0).cast("long")))
    pieces = rows.select("_id", "_n", F.explode(steps).alias("piece")).select(
        "_id", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("_n") - F.col("piece") * top).alias("length"))
    held = stage(pieces)
    groups = max(1, math.ceil(held.count() / GROUP))
    dealt = held.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = pieces.schema.add("bin_id", "long").add("offset", "long").add("capacity", "long").add("filled", "long")

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [f for f in frames if f.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        group = table.column("_group").to_numpy()
        for g in np.unique(group):
            part = table.filter(pa.array(group == g)).drop_columns("_group").sort_by([("length", "descending"), ("_id", "ascending"), ("piece", "ascending")])
            lengths = part.column("length").to_numpy()
            bins, offsets, caps = best_fit(lengths, capacities, overhead)
            filled = np.bincount(bins, weights=lengths, minlength=len(caps)).astype(np.int64)
            for name, values in (("bin_id", (int(g) << 32) + bins), ("offset", offsets), ("capacity", caps[bins].astype(np.int64)), ("filled", filled[bins])):
                part = part.append_column(name, pa.array(values))
            yield from part.to_batches()

    return dealt.repartition("_group").mapInArrow(place, schema).withColumnRenamed("_id", id_column)
