"""Removal of long repeated byte strings with suffix arrays.

Every string of ``LENGTH`` bytes has one anchor: the position of its least
hashed gram of ``GRAM`` bytes (the leftmost of equal ones).  Equal strings have
equal anchors at equal offsets, so only strings around an anchor that occurs
again can repeat.  An anchor's context is the text that holds all strings with
that anchor.  Contexts found whole more than once are repeated throughout; for
the others the contexts of one anchor are put side by side, and their suffix
array shows which strings of ``LENGTH`` bytes occur at two places.  The gram
itself is equal in all of them and stands as eight bytes of its hash there.

The suffix array is built by linear grouping: suffixes are grouped by their
Lyndon prefix, the groups are processed in descending order through pointers
to the previous smaller suffix, and the order within the groups is then
emitted from front to back, without renaming and recursion.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractum.llm.textops import text_slices
from tractum.session import stage

LENGTH = 200
GRAM = 100
SIDE_BY_SIDE = 2048  # contexts of one anchor sorted together; larger groups are halved by content
CHUNK = 1 << 16  # bytes sorted together
BROADCAST_ROWS = 200_000  # documents' merged findings are sent to all tasks up to this many; else joined by shuffle
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)


def suffix_array(text: bytes) -> list[int]:
    """Positions of the suffixes of ``text`` in order, shorter first if equal so far."""
    n = len(text)
    size = n + 1  # the end is a suffix too, the least
    order = [n, *sorted(range(n), key=text.__getitem__)]
    group, count, place = [0] * size, [0] * size, [0] * size
    at = 0
    while at < size:  # groups by first byte, named by their first place
        stop = at
        lead = text[order[at]] if order[at] < n else -1
        while stop < size and (text[order[stop]] if order[stop] < n else -1) == lead:
            group[order[stop]] = at
            place[order[stop]] = stop
            stop += 1
        count[at] = stop - at
        at = stop
    before = [-1] * size
    top = size
    while top > 0:
        g = group[order[top - 1]]
        members = order[g:top]
        if len(members) > 1:
            members.sort()
        top = g
        hits: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[i] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        if not hits:
            continue
        if len(hits) == 1:
            (p,) = hits
            moves = [[p]] if count[group[p]] > 1 else []
        else:
            # Those with more members behind them are larger; of equally many, each group moves its own.
            split: dict[tuple[int, int], list[int]] = {}
            for p, k in hits.items():
                split.setdefault((-k, group[p]), []).append(p)
            moves = [split[k] for k in sorted(split)]
        for moved in moves:
            old = group[moved[0]]
            if len(moved) == count[old]:
                continue
            end = old + count[old]
            fresh = end - len(moved)
            count[old] -= len(moved)
            count[fresh] = len(moved)
            for p in moved:  # to the end of the old group
                end -= 1
                q, was = order[end], place[p]
                order[was], place[q] = q, was
                order[end], place[p] = p, end
                group[p] = fresh
    free = list(range(size))  # next place of each group
    out = [-1] * size
    done = [False] * size
    out[0], done[n] = n, True
    for k in range(size):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = before[j]
    return out[1:]


def repeated_starts(short: bytes, at: np.ndarray, data: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the ``starts`` begin a string of ``length`` bytes of ``data``
    that begins at another of them too.  ``short`` is the text with shortened
    grams, ``at`` the same starts in it; its order puts equal strings together."""
    rank = np.empty(len(short) + 1, np.int64)
    rank[suffix_array(short)] = np.arange(len(short))
    order = np.argsort(rank[at])
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)[starts[order]]
    same = (rows[1:] == rows[:-1]).all(axis=1)
    out = np.zeros(len(starts), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


class Hashes:
    """Hashes of any slice of a buffer from running sums of powers."""

    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        cls = type(self)
        with np.errstate(over="ignore"):
            if len(cls._powers) <= len(data):
                m = max(len(data) + 1, 1 << 20)
                cls._powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(m, _BASE))))
                cls._inverses = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(m, _INVERSE))))
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODE[data] * cls._powers[:len(data)], dtype=np.uint64)))

    def of(self, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[stop] - self.sums[start]) * self._inverses[start]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, first start, number of starts, anchor, gram hash, context
    hash) of every anchor of the documents in ``data``; places count from the
    document's start."""
    n, width = len(data), length - gram + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty, empty
    hashes = Hashes(data)
    g = hashes.of(slice(0, n - gram + 1), slice(gram, n + 1))
    least = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:len(least) - (width - reach)], least[width - reach:])
    own = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # anchor of the string at each start
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(own)]
    start = np.flatnonzero(np.arange(len(own)) + length <= offsets[doc + 1])
    own, doc = own[start], doc[start]
    if not len(start):
        return empty, empty, empty, empty, empty, empty
    first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1]))))
    count = np.diff(np.append(first, len(own)))
    lo = start[first]
    context = hashes.of(lo, lo + count - 1 + length)
    begin = offsets[doc[first]]
    return doc[first], lo - begin, count, own[first] - begin, g[own[first]].view(np.int64), context.view(np.int64)


def _pieces(frames: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each asked context: its row in the batch of documents, where it starts and how many strings it holds."""
    for frame in frames:
        for rows, data, offsets in text_slices(frame, "text"):
            spans = rows.column(rows.schema.get_field_index("spans"))
            n = pa.compute.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False)
            yield rows, data, offsets, np.repeat(np.arange(len(rows)), n), spans.flatten(), n


def _sort_contexts(length: int):
    """Settles contexts dealt by anchor: (rid, lo, n) runs of repeated starts."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [f for f in frames if f.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches).sort_by("h")
        h, rid, lo, n, anchor, copies = (table.column(c).to_numpy() for c in ("h", "rid", "lo", "n", "anchor", "copies"))
        body = table.column("body").to_pylist()
        cut = [b[:p] + code.tobytes() + b[p + GRAM:] for b, p, code in zip(body, (anchor - lo).tolist(), h)]
        borders = np.append(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))), len(h))
        at = 0
        while at + 1 < len(borders):
            a, stop, total = borders[at], at + 1, 0
            total = sum(map(len, cut[a:borders[stop]]))
            while stop + 1 < len(borders):
                more = sum(map(len, cut[borders[stop]:borders[stop + 1]]))
                if total + more > CHUNK:
                    break
                total, stop = total + more, stop + 1
            b, at = borders[stop], stop
            sizes, short = np.array([len(x) for x in body[a:b]]), np.array([len(x) for x in cut[a:b]])
            begin, begin_short = np.cumsum(sizes) - sizes, np.cumsum(short) - short
            owner = np.repeat(np.arange(b - a), n[a:b])
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
            hit = repeated_starts(b"".join(cut[a:b]), begin_short[owner] + offset, b"".join(body[a:b]), begin[owner] + offset, length) & (copies[a:b][owner] == 1)
            owner, offset = owner[hit], offset[hit]
            if not len(owner):
                continue
            new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1))))
            run_n = np.diff(np.append(new, len(owner)))
            yield pa.RecordBatch.from_arrays([pa.array(rid[a:b][owner[new]]), pa.array((lo[a:b][owner[new]] + offset[new]).astype(np.int32)), pa.array(run_n.astype(np.int32))], names=["rid", "lo", "n"])

    return run


def _halves(rows: DataFrame, length: int) -> DataFrame:
    """Contexts cut in two by where the anchor lies in a string (``a0 <= place
    < a1``).  All strings of a half hold the bytes from ``a0`` before the anchor
    to the end of the one with the anchor at ``a1 - 1``, so equal strings of a
    half agree on them: their hash makes the half's own group."""
    middle = F.floor((F.col("a0") + F.col("a1")) / 2).cast("int")
    half = F.explode(F.array(F.struct(F.col("a0").alias("b0"), middle.alias("b1")), F.struct(middle.alias("b0"), F.col("a1").alias("b1")))).alias("half")
    cut = rows.select("*", half).select("*", "half.b0", "half.b1").where("b0 < b1")
    first = F.greatest("lo", F.col("anchor") - F.col("b1") + 1)
    last = F.least(F.col("lo") + F.col("n") - 1, F.col("anchor") - F.col("b0"))
    cut = cut.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    common = F.substr("body", F.col("anchor") - F.col("b0") - F.col("lo") + 1, F.col("b0") - F.col("b1") + 1 + length)
    return cut.select(
        F.xxhash64("h", "b0", "b1", common).alias("h"), "rid", F.col("_first").alias("lo"), (F.col("_last") - F.col("_first") + 1).alias("n"), "copies",
        F.substr("body", F.col("_first") - F.col("lo") + 1, F.col("_last") - F.col("_first") + length).alias("body"), "anchor", F.col("b0").alias("a0"), F.col("b1").alias("a1"))


def _settle_crowded(crowded: DataFrame, length: int, sort) -> DataFrame:
    """(rid, lo, n) of repeated starts for anchors with very many contexts.

    Groups are halved until they are small enough to be sorted or hold one
    string only; members of a group alone go, as nothing can equal them.
    Groups are counted before anything meets, and each half keeps its strings,
    so none is lost; the rounds are the logarithm of the string length.
    """
    rows = crowded.withColumn("a0", F.lit(0)).withColumn("a1", F.lit(length - GRAM + 1))
    found = []
    while not rows.isEmpty():
        rows = _halves(rows, length)
        groups = rows.groupBy("h").agg(F.count("*").alias("members"), F.sum("copies").alias("_m")).where("_m > 1").select("h", "members")
        rows = stage(rows.join(groups, "h"))
        small = rows.where((F.col("members") <= SIDE_BY_SIDE) & (F.col("a1") - F.col("a0") > 1))
        found.append(small.repartition("h").mapInArrow(sort, "rid long, lo int, n int"))
        found.append(rows.where("a1 - a0 = 1 and copies = 1").select("rid", "lo", "n"))
        rows = rows.where((F.col("members") > SIDE_BY_SIDE) & (F.col("a1") - F.col("a0") > 1)).drop("members")
    return reduce(DataFrame.unionByName, found) if found else crowded.select("rid", "lo", "n")


def _merge(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins runs of starts that touch: most neighbours do."""
    for frame in frames:
        spans = frame.column(1)
        if not len(spans):
            continue
        flat, sizes = spans.flatten(), pa.compute.list_value_length(spans).to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        lo, n = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
        order = np.lexsort((lo, row))
        row, lo, stop = row[order], lo[order], (lo + n)[order]
        wide = row * (int(stop.max()) + 2)  # rows side by side, apart from each other
        reach = np.maximum.accumulate(stop + wide)
        first = np.flatnonzero(np.concatenate(([True], lo[1:] + wide[1:] > reach[:-1])))
        last = np.append(first[1:], len(lo)) - 1
        begin, end = lo[first], (reach - wide)[last]
        offsets = np.concatenate(([0], np.cumsum(np.bincount(row[first], minlength=len(sizes))))).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array((end - begin).astype(np.int32))], ["lo", "n"])
        yield pa.RecordBatch.from_arrays([frame.column(0), pa.ListArray.from_arrays(pa.array(offsets), items)], names=["rid", "spans"])


def _sent_if_small(df: DataFrame) -> DataFrame:
    df = stage(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rid, spans): for each document with findings the runs (lo, n) of starts
    of repeated strings.  ``docs``: rid (unique) and text."""
    def mark(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for rows, data, offsets in text_slices(frame, "text"):
                doc, lo, n, anchor, h, c = anchors(data, offsets, length)
                if len(doc):
                    rid = rows.column(0).to_numpy()[doc]
                    yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.astype(np.int32)), pa.array(h), pa.array(c)], names=["rid", "lo", "n", "anchor", "h", "c"])

    marked = stage(docs.mapInArrow(mark, "rid long, lo int, n int, anchor int, h long, c long"))
    again = marked.groupBy("h").agg(F.count("*").alias("_m")).where("_m > 1").select("h")
    found = stage(marked.join(again, "h"))
    kinds = found.groupBy("h", "c", "n").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "lo", "anchor")).alias("one"))
    kinds = stage(kinds)
    several = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    whole = found.join(kinds.where("copies > 1").select("h", "c", "n"), ["h", "c", "n"]).select("rid", "lo", "n")
    asked = kinds.join(several, "h").select("h", "kinds", "copies", "n", "one.rid", "one.lo", "one.anchor")
    spans = F.collect_list(F.struct("lo", "n", "anchor", "h", "kinds", "copies")).alias("spans")  # bounded by the document
    texts = docs.join(asked.groupBy("rid").agg(spans).hint("shuffle_merge"), "rid").select("rid", "text", "spans")

    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets, owner, flat, _ in _pieces(frames, length):
            lo, n, anchor, h, kinds, copies = (flat.field(c).to_numpy() for c in range(6))
            start = offsets[owner] + lo
            body = [data[a:b].tobytes() for a, b in zip(start.tolist(), (start + n - 1 + length).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(rows.column(0).to_numpy()[owner]), pa.array(lo), pa.array(n), pa.array(copies), pa.array(body, pa.binary()), pa.array(kinds), pa.array(anchor)],
                                             names=["h", "rid", "lo", "n", "copies", "body", "kinds", "anchor"])

    contexts = stage(texts.mapInArrow(cut, "h long, rid long, lo int, n int, copies long, body binary, kinds long, anchor int"))
    sort = _sort_contexts(length)
    sorted_ = contexts.where(F.col("kinds") <= SIDE_BY_SIDE).repartition("h").mapInArrow(sort, "rid long, lo int, n int")
    settled = _settle_crowded(contexts.where(F.col("kinds") > SIDE_BY_SIDE).drop("kinds"), length, sort)
    every = whole.unionByName(sorted_).unionByName(settled)
    return every.groupBy("rid").agg(F.collect_list(F.struct("lo", "n")).alias("spans")).mapInArrow(_merge, "rid long, spans array<struct<lo:int,n:int>>")


def remove_repeats(df: DataFrame, id_column: str, text: str, length: int = LENGTH) -> DataFrame:
    """``id_column``, ``kept`` (the remaining bytes), ``kept_sha256``,
    ``n_bytes``, ``n_removed`` and ``n_spans`` for every row of ``df``.

    A byte goes if it lies in a string of ``length`` bytes that also starts
    anywhere else, judged on the input.  Texts are their UTF-8 bytes, null is
    empty; shorter texts keep everything; rows with the same or a null id are
    texts of their own, so all of several equal long texts go.  Rows are told
    apart by their place in the input, which a table of files keeps.  Equal
    contexts and, for crowded anchors, equal parts are told by 64-bit hashes.
    Building the result runs jobs and stages tables.
    """
    rows = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    found = _sent_if_small(repeats(rows.select("rid", "text"), length))
    joined = rows.join(found, "rid", "left").select("id", "text", "spans")
    kind = df.schema[id_column].dataType.simpleString()

    def strip(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets, owner, flat, n in _pieces(frames, length):
            edge = np.zeros(len(data) + 1, np.int64)
            if len(owner):
                lo, count = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                start = offsets[owner] + lo
                np.add.at(edge, start, 1)
                np.add.at(edge, start + count - 1 + length, -1)
            gone = np.cumsum(edge)[:-1] > 0
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            borders = offsets[:-1][np.diff(offsets) > 0]
            first[borders] = gone[borders]  # runs don't cross documents
            removed = np.concatenate(([0], np.cumsum(gone)))
            spans = np.concatenate(([0], np.cumsum(first)))
            kept = [data[a:b][~gone[a:b]].tobytes() if removed[b] > removed[a] else data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([
                rows.column(0), pa.array(np.diff(offsets)), pa.array(removed[offsets[1:]] - removed[offsets[:-1]]), pa.array(spans[offsets[1:]] - spans[offsets[:-1]]),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = joined.mapInArrow(strip, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", id_column)
