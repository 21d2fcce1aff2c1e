"""The strongest paths of three edges between many sources and targets, without listing all paths."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractum.operators.joins import in_set
from tractum.operators.ordered import top_k
from tractum.operators.reach import NO_BLOBS, _chunks, _packed
from tractum.session import stage

FIRST, MIDDLE, LAST = range(3)  # kinds of rows that a group receives
PATH_BLOCK = 16_000_000  # middle edges that one task holds
SOURCE_BLOCKS = 32  # at least; sources are dealt to these
TWO_PATHS = 4_000_000  # paths of two edges that a task holds at once
CANDIDATES = 1_000_000  # entries, about, that are compared at once
NONE = -(1 << 62)  # least count where there is no path yet


class _Lists(NamedTuple):
    """Sorted ids, where their lists lie, and the lists one after another."""

    ids: np.ndarray
    start: np.ndarray
    size: np.ndarray
    post: np.ndarray
    n: np.ndarray


def _lists(table: pa.Table, kind: int) -> _Lists:
    parts = [(ids, np.diff(ends), posts, n) for ids, ends, posts, n in _chunks(table, kind)]
    ids, size, post, n = (np.concatenate([np.zeros(0, "i8"), *x]) for x in zip(*parts)) if parts else [np.zeros(0, "i8")] * 4
    order = np.argsort(ids)
    return _Lists(ids[order], (np.cumsum(size) - size)[order], size[order], post, n)


def _spans(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of several lists, and which list each is of."""
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + (start - (np.cumsum(size) - size))[of], of


def _two_paths(at: np.ndarray, n_1: np.ndarray, middle: _Lists) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Mid (its place in ``at``), middle edge and least count of the paths of two edges:
    the strongest first, then by mid and mid2.  Of very many, one count after the other."""
    start, size = middle.start[at], middle.size[at]
    pieces = np.concatenate(([0], np.cumsum(size)))

    def piece(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = np.searchsorted(pieces, [lo, hi], "right")
        a, b = a - 1, min(b, len(at))
        own = np.maximum(pieces[a:b], lo), np.minimum(pieces[a + 1:b + 1], hi)
        edge, of = _spans(start[a:b] + own[0] - pieces[a:b], np.maximum(own[1] - own[0], 0))
        return of + a, edge, np.minimum(n_1[of + a], middle.n[edge])

    cuts = [*range(0, int(pieces[-1]), TWO_PATHS), int(pieces[-1])]
    if len(cuts) <= 2:
        mid, edge, least = piece(0, cuts[-1])
        order = np.argsort(-least, kind="stable")
        yield mid[order], edge[order], least[order]
        return
    counts = sorted({int(x) for lo, hi in zip(cuts, cuts[1:]) for x in np.unique(piece(lo, hi)[2])}, reverse=True)
    for count in counts:
        for lo, hi in zip(cuts, cuts[1:]):
            mid, edge, least = piece(lo, hi)
            own = np.flatnonzero(least == count)
            yield mid[own], edge[own], least[own]


def _strongest(k: int):
    """Per source of a block and target the ``k`` best paths through the mid2 of one part.

    Paths of two edges are taken from the strongest on.  A target is settled once its k-th
    path comes before whatever is left, which is no stronger than the last one taken and
    has a later mid; a source ends when all its targets are settled."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        first, middle, last = (_lists(table, kind) for kind in (FIRST, MIDDLE, LAST))
        del table
        if not len(last.ids) or not len(middle.ids):
            return
        targets, target = np.unique(last.post, return_inverse=True)
        list_of = np.empty(len(target), np.int64)
        places, of = _spans(last.start, last.size)
        list_of[places] = of
        ends = np.searchsorted(last.ids, middle.post)  # of each middle edge, which list of last edges goes on
        for s, lo, size in zip(first.ids.tolist(), first.start.tolist(), first.size.tolist()):
            mids, n_1 = first.post[lo:lo + size], first.n[lo:lo + size]
            at = np.minimum(np.searchsorted(middle.ids, mids), len(middle.ids) - 1)
            own = middle.ids[at] == mids
            at, mids, n_1 = at[own], mids[own], n_1[own]
            best = np.full((len(targets), k, 6), NONE)  # least count, mid, mid2 and the three counts
            settled = targets == s
            budget = 2 * k * len(targets)
            for mid, edge, least in _two_paths(at, n_1, middle):
                keep = middle.post[edge] != s
                mid, edge, least, a = mid[keep], edge[keep], least[keep], 0
                while a < len(edge) and not settled.all():
                    sizes = np.cumsum(last.size[ends[edge[a:a + CANDIDATES]]])
                    b = a + max(1, int(np.searchsorted(sizes, budget, "right")))
                    budget = min(budget * 2, CANDIDATES)
                    two = np.arange(a, b)
                    if budget == CANDIDATES:  # much is left: only what leads to targets that are not settled
                        wanted = np.zeros(len(last.ids), bool)
                        wanted[list_of[~settled[target]]] = True
                        two = two[wanted[ends[edge[two]]]]
                    out, of = _spans(last.start[ends[edge[two]]], last.size[ends[edge[two]]])
                    of = two[of]
                    t, value = target[out], np.minimum(least[of], last.n[out])
                    own = np.flatnonzero(~settled[t] & (value >= best[t, k - 1, 0]) & (targets[t] != mids[mid[of]]))
                    out, of, t, value = out[own], of[own], t[own], value[own]
                    if len(t):
                        rows = np.stack((value, mids[mid[of]], middle.post[edge[of]], n_1[mid[of]], middle.n[edge[of]], last.n[out]), axis=1)
                        some = np.unique(t)
                        rows, t = np.concatenate((best[some].reshape(-1, 6), rows)), np.concatenate((np.repeat(some, k), t))
                        real = rows[:, 0] > NONE
                        rows, t = rows[real], t[real]
                        order = np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0], t))
                        rows, t = rows[order], t[order]
                        place = np.arange(len(t)) - np.searchsorted(t, t)
                        on = place < k
                        best[some] = NONE
                        best[t[on], place[on]] = rows[on]
                    left, now, now_2 = least[b - 1], mids[mid[b - 1]], middle.post[edge[b - 1]]
                    value, m, m_2 = best[:, k - 1, 0], best[:, k - 1, 1], best[:, k - 1, 2]
                    settled |= (value > left) | ((value == left) & ((m < now) | ((m == now) & (m_2 <= now_2))))
                    a = b
                if settled.all():
                    break
            t, place = np.nonzero(best[:, :, 0] > NONE)
            if len(t):
                _, m, m_2, *n = best[t, place].T
                yield pa.record_batch([np.full(len(t), s), targets[t], np.ascontiguousarray(m), np.ascontiguousarray(m_2), *map(np.ascontiguousarray, n), (place + 1).astype("i4")],
                                      names=["source", "target", "mid", "mid2", "n_1", "n_2", "n_3", "rank"])

    return run


def strongest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Per (source, target) the ``k`` simple paths of three edges with the
    largest least count (ties: mid, then mid2) and their ``rank``.

    Sources are dealt to blocks and mid2 to parts of a bounded number of middle
    edges.  A task takes the paths of its sources from the strongest on and
    stops when nothing left can be among the best, so paths are neither listed nor
    sorted on disk; with several parts their best paths are compared at the end.
    """
    edges = stage(edges.where("pre <> post AND n IS NOT NULL").select("pre", "post", F.col("n").cast("long").alias("n")))
    last = in_set(edges, "post", targets)
    first = in_set(edges, "pre", sources)
    middle = in_set(in_set(edges, "post", last.select("pre").distinct()), "pre", first.select("post").distinct())
    n_parts = max(1, -(-edges.count() // PATH_BLOCK))
    blocks, parts = F.sequence(F.lit(0), F.lit(SOURCE_BLOCKS - 1)), F.sequence(F.lit(0), F.lit(n_parts - 1))

    def packed(rows: DataFrame, by: str, name: str, n: int) -> DataFrame:
        lists = rows.withColumn(name, F.pmod(F.xxhash64(by), F.lit(n)).cast("int")).groupBy(name, F.col("pre").alias("id"))
        lists = lists.agg(F.array_sort(F.collect_list(F.struct("post", "n"))).alias("e"))
        return _packed(lists.select(name, "id", F.col("e.post").alias("posts"), F.col("e.n").alias("more")), [name])

    asked = packed(first, "pre", "block", SOURCE_BLOCKS).select("block", F.explode(parts).alias("part"), F.lit(FIRST).alias("kind"), *NO_BLOBS)
    for rows, by, kind in ((middle, "post", MIDDLE), (last, "pre", LAST)):
        asked = asked.unionByName(packed(rows, by, "part", n_parts).select(F.explode(blocks).alias("block"), "part", F.lit(kind).alias("kind"), *NO_BLOBS))
    out = asked.groupBy("block", "part").applyInArrow(_strongest(k), "source long, target long, mid long, mid2 long, n_1 long, n_2 long, n_3 long, rank int")
    if n_parts == 1:
        return out
    order = [F.least("n_1", "n_2", "n_3").desc(), F.asc("mid"), F.asc("mid2")]
    return top_k(out.drop("rank"), ["source", "target"], order, k).select(out.columns)
