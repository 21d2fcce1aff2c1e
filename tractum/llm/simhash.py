"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint is cut into m equal segments on a ring.  If two fingerprints
differ in at most r bits, some segment starts a chain in which the first k
segments together differ in at most k * r / m bits, for every k (the strong
form of the pigeonring principle).  Only pairs whose first segment agrees
meet; the chain cuts them down segment by segment before the full Hamming
check.  With r < m the first budget is 0, so the search is complete.  With a
larger r it finds only pairs that agree in a segment; with a similarity these
are a start, and a join on the rare shingles of each text (prefix filter) finds
every similar pair between the components that they leave.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import combinations
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractum.llm.components import components, local_roots
from tractum.llm.forest import Forest, minima
from tractum.llm.textops import Words, segment_sum, text_slices, xxh64
from tractum.session import stage

CELL = 2048  # fingerprints of one first segment that meet in one cell; more are dealt out as pairs of chunks
BLOCK = 1_000_000  # pairs compared at once
CLUSTER = 256  # texts whose sets meet in one place to be compared
SMALL = 64  # nodes of one shingle that meet as pairs; where more meet, their sets are compared as a crowd
CROWD = 2_000_000  # shingles of a chunk of a crowd
SAMPLE = 5_000  # documents whose shingles are counted to put common ones last
COMMON = 300_000  # shingles that are put last
BROADCAST_ROWS = 500_000  # a list of ids up to this long is sent to all tasks; a longer one is joined by shuffle


@dataclass(frozen=True)
class Scheme:
    words: int = 1  # 64-bit words of a fingerprint
    segment_bits: int = 16
    radius: int = 3
    width: int = 5  # words of a shingle
    seed: int = 42

    @property
    def segments(self) -> int:
        return 64 * self.words // self.segment_bits

    def budget(self, k: int) -> int:
        return self.radius * k // self.segments

    def segment(self, fp: np.ndarray, i: int) -> np.ndarray:
        word, shift = divmod((i % self.segments) * self.segment_bits, 64)
        out = fp[:, word] >> np.uint64(shift)
        if shift + self.segment_bits > 64:
            out = out | (fp[:, word + 1] << np.uint64(64 - shift))
        return out & np.uint64((1 << self.segment_bits) - 1)


SKETCH = Forest(trees=16, levels=8)  # 128 MinHash values
EXACT = Scheme(width=3)  # complete at 3 bits of 64
#: Five words and a Jaccard similarity of 0.8: about 39 of 256 bits differ, with a deviation of 6.
SIMILAR = Scheme(words=4, segment_bits=12, radius=56, width=5)


def _binary(values: np.ndarray) -> pa.Array:
    """Rows of 64-bit words as big-endian binary values."""
    data = np.ascontiguousarray(values.astype(">u8"))
    size = data.shape[1] * 8
    offsets = np.arange(0, (len(data) + 1) * size, size, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _words(column: pa.Array, words: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, ">u8").astype(np.uint64).reshape(-1, words)


def fingerprints(df: DataFrame, text: str, keep: list[str], scheme: Scheme) -> DataFrame:
    """``keep`` columns and ``fp`` (binary, most significant bit first).

    Texts are lower-cased (A-Z only).  Bit k is 1 if it is set in over half of
    the XXH64 values of the word shingles, repeats included; every further 64
    bits take another seed.  Fewer words than the width: the whole sequence is
    one shingle.  Null, empty or blank text: all bits 0.
    """
    schema = df.select(*keep).schema.add("fp", "binary")

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for rows, data, offsets in text_slices(frame, "_text"):
                words = Words(data, offsets)
                doc, start, end = words.shingles(scheme.width)
                first = np.searchsorted(doc, np.arange(words.n_docs + 1))
                n = np.diff(first)
                fp = np.zeros((words.n_docs, scheme.words), np.uint64)
                for w in range(scheme.words):
                    h = xxh64(words.data, start, end - start, scheme.seed + w)
                    for bit in range(64):
                        ones = segment_sum((h >> np.uint64(bit)) & np.uint64(1), first)
                        fp[:, w] |= (2 * ones > n).astype(np.uint64) << np.uint64(bit)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), _binary(fp)], names=[*keep, "fp"])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(batches, schema)


def _ring_pairs(fp: np.ndarray, node: np.ndarray, cell: np.ndarray, i: int, scheme: Scheme) -> Iterator[tuple[np.ndarray, ...]]:
    """(left, right, distance) of the pairs in each cell that pass the chain
    from segment ``i`` and the full check.  Where the second budget is small
    its variants are looked up in a sorted array, so that a large cell is not
    paired off.  Blocks bound the memory."""
    _, rank = np.unique(np.stack((cell, scheme.segment(fp, i).astype(np.int64))), axis=1, return_inverse=True)
    base = rank.reshape(-1).astype(np.uint64) << np.uint64(scheme.segment_bits)
    flips = [np.uint64(0)]
    if scheme.budget(2) <= 1:
        second = scheme.segment(fp, i + 1)
        flips = [np.uint64(sum(1 << x for x in c)) for d in range(scheme.budget(2) + 1) for c in combinations(range(scheme.segment_bits), d)]
        base = base | second
    order = np.argsort(base, kind="stable")
    keys = base[order]
    for flip in flips:
        want = base ^ flip
        lo, hits = np.searchsorted(keys, want, "left"), np.searchsorted(keys, want, "right")
        hits -= lo
        upto = np.cumsum(hits)
        at = 0
        while at < len(hits) and upto[-1] > (upto[at - 1] if at else 0):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, "right")))
            count = hits[at:stop]
            left = np.repeat(np.arange(at, min(stop, len(hits))), count)
            step = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
            right = order[lo[left] + step]
            at = stop
            ok = node[left] < node[right]
            left, right = left[ok], right[ok]
            diff = np.zeros(len(left), np.int64)
            for k in range(1, scheme.segments):
                diff += np.bitwise_count(scheme.segment(fp[left], i + k) ^ scheme.segment(fp[right], i + k))
                ok = diff <= scheme.budget(k + 1)
                left, right, diff = left[ok], right[ok], diff[ok]
            diff = np.bitwise_count(fp[left] ^ fp[right]).sum(axis=1).astype(np.int64)
            ok = diff <= scheme.radius
            yield left[ok], right[ok], diff[ok]


def _forest(found: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """One edge per node that keeps what the pairs connect."""
    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    u, v = local_roots(a, b)
    return [(u[u != v], v[u != v], np.zeros((u != v).sum(), np.int64))]


def _closest(found: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """For each node its nearest partner and its least partner."""
    a, b, d = (np.concatenate([f[k] for f in found]) for k in range(3))
    x, y, d = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((d, d))
    kept = []
    for keys in ((y, d, x), (y, x)):
        order = np.lexsort(keys)
        kept.append(order[np.concatenate(([True], x[order][1:] != x[order][:-1]))] if len(order) else order)
    at = np.unique(np.concatenate(kept))
    return [(np.minimum(x, y)[at], np.maximum(x, y)[at], d[at])]


def links(fps: DataFrame, scheme: Scheme, forest: bool) -> DataFrame:
    """Edges ``(a, b)`` between the nodes of ``fps`` (node, fp distinct).

    ``forest``: edges whose components are those of all pairs found.
    Otherwise real pairs: for each node its nearest and its least partner,
    so more may be similar than these.  Either way a task keeps a few edges per node, so a dense group
    gives no quadratic output.  A segment value with more than ``CELL``
    fingerprints is dealt out as pairs of chunks, which keeps every pair.
    """
    def deal(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            fp = _words(frame.column(1), scheme.words)
            for i in range(scheme.segments):
                yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(np.full(len(fp), i, np.int32)),
                                                  pa.array(scheme.segment(fp, i).astype(np.int32))], names=["node", "fp", "i", "seg"])

    rows = fps.select("node", "fp").mapInArrow(deal, "node long, fp binary, i int, seg int")
    hot = rows.groupBy("i", "seg").agg(F.ceil(F.count("*") / CELL).alias("chunks")).where("chunks > 1")
    rows = rows.join(hot, ["i", "seg"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64("node"), F.col("chunks"))
    dealt = rows.select("node", "fp", "i", "seg", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("node", "fp", "i", F.xxhash64("i", "seg", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    reduce = _forest if forest else _closest

    def solve(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(f.column(0).to_numpy(), _words(f.column(1), scheme.words), f.column(2).to_numpy(), f.column(3).to_numpy()) for f in frames if f.num_rows]
        if not got:
            return
        node, fp, at, cell = (np.concatenate(x) for x in zip(*got))
        found, pending = [], 0
        for i in range(scheme.segments):
            own = np.flatnonzero(at == i)
            if not len(own):
                continue
            for left, right, diff in _ring_pairs(fp[own], node[own], cell[own], i, scheme):
                found.append((node[own][left], node[own][right], diff))
                pending += len(left)
                if pending > BLOCK:
                    found = reduce(found)
                    pending = len(found[0][0])
        if found:
            (a, b, diff), = reduce(found)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(diff.astype(np.int32))], names=["a", "b", "diff"])

    pairs = dealt.repartition("cell").mapInArrow(solve, "a long, b long, diff int")
    if forest:
        return pairs.select("a", "b")
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "diff").unionByName(pairs.select("b", "a", "diff").toDF("x", "y", "diff"))
    partners = both.groupBy("x").agg(F.min(F.struct("diff", "y")).alias("near"), F.min("y").alias("least"))
    partners = partners.select("x", F.explode(F.array("near.y", "least")).alias("y"))
    return partners.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _similar(edges: DataFrame, held: DataFrame, text: str, scheme: Scheme, similarity: float) -> DataFrame:
    """The edges whose texts have the Jaccard similarity on distinct shingles;
    nodes are ``_row`` of ``held``.

    Edges that hang together meet in one place, so that the set of each of
    their texts is sent once; clusters of over ``CLUSTER`` texts are cut at
    their hubs: an edge then goes to the end with more edges, and so does the
    other end's set, ``CLUSTER`` of them to a place."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    roots = components(edges)
    named = ends.join(roots, "node", "left").select("node", "degree", F.coalesce("root", "node").alias("root"))
    sizes = named.groupBy("root").agg(F.count("*").alias("texts"))
    named = _sent_if_small(named.join(sizes, "root"))
    a, b = (named.select(F.col("node").alias(n), F.col("degree").alias(f"d_{n}"), F.col("root").alias(f"r_{n}"), F.col("texts").alias(f"t_{n}")) for n in "ab")
    both = edges.join(a, "a").join(b.drop("r_b", "t_b"), "b")
    hub, spoke = (F.when(F.col("d_a") >= F.col("d_b"), F.col(x)).otherwise(F.col(y)) for x, y in (("a", "b"), ("b", "a")))
    parts = F.ceil(F.greatest("d_a", "d_b") / CLUSTER)
    place = F.when(F.col("t_a") <= CLUSTER, F.xxhash64("r_a")).otherwise(F.xxhash64(hub, F.pmod(F.xxhash64(spoke), parts), F.lit(1)))
    placed = stage(both.select(place.alias("place"), "a", "b"))
    sent = _sent_if_small(placed.select("place", F.explode(F.array("a", "b")).alias("node")).distinct())

    def sets(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for rows, h, first in _shingle_sets(frame, text, scheme):
                lists = pa.array([h[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), lists], names=["node", "shingles"])

    wanted = _sent_if_small(ends.select("node"))
    sets_of = held.select(F.col("_row").alias("node"), text).join(wanted, "node").mapInArrow(sets, "node long, shingles binary")
    rows = sets_of.join(sent, "node").select("place", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "shingles").unionByName(
        placed.select("place", "a", "b", F.lit(None).cast("binary").alias("shingles")))

    def check(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, {}  # rows of a place: its sets, then its edges
        for frame in frames:
            x, y = [], []
            for place, a, b, shingles in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), frame.column(2).to_pylist(), frame.column(3)):
                if place != at:
                    at, own = place, {}
                if b is None:
                    own[a] = np.frombuffer(shingles.as_buffer(), np.int64)
                    continue
                u, v = own[a], own[b]
                shared = len(np.intersect1d(u, v, assume_unique=True))
                if shared >= similarity * (len(u) + len(v) - shared):
                    x.append(a)
                    y.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    ordered = rows.repartition("place").sortWithinPartitions("place", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(check, "a long, b long")


def _shingle_sets(frame: pa.RecordBatch, text: str, scheme: Scheme) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, hashes, first): the distinct shingles of text i are hashes[first[i]:first[i + 1]], ascending."""
    for rows, data, offsets in text_slices(frame, text):
        words = Words(data, offsets)
        doc, start, end = words.shingles(scheme.width)
        h = xxh64(words.data, start, end - start, scheme.seed).view(np.int64)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        yield rows, h[new], np.searchsorted(doc[new], np.arange(words.n_docs + 1))


def _common(held: DataFrame, text: str, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur again in a sample of documents, ascending, and their counts.
    They only order the shingles, so the result does not depend on the sample."""
    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for _, h, _ in _shingle_sets(frame, text, scheme):
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    every = max(1, held.count() // SAMPLE)
    sample = held.where(F.pmod(F.xxhash64("_row"), F.lit(every)) == 0).select(text)
    counts = sample.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    got = counts.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = got.column("h").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _prefixes(held: DataFrame, text: str, scheme: Scheme, similarity: float) -> DataFrame:
    """``_row``, ``key`` (of the set of shingles), ``size``, ``prefix`` and ``s0``,
    ``s1`` (one bit of each of 128 MinHash values of the set) of each text.

    In one order of all shingles, rare ones first, two sets of the similarity
    share one of their first size - ceil(similarity * size) + 1 shingles."""
    common, often = _common(held, text, scheme)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for rows, h, first in _shingle_sets(frame, text, scheme):
                size = np.diff(first)
                keys = [blake2b(h[i:j].tobytes(), digest_size=16).digest() for i, j in zip(first[:-1], first[1:])]
                n = np.zeros(len(h), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    n = np.where(common[at] == h, often[at], 0)
                doc = np.repeat(np.arange(len(size)), size)
                some, sketch = np.flatnonzero(size), np.zeros((len(size), 2), np.int64)
                if len(some):
                    bits = minima(h.view(np.uint64), np.append(first[some], first[-1]), SKETCH) & np.uint16(1)
                    sketch[some] = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)
                h = h[np.lexsort((h, n, doc))]
                length = np.where(size > 0, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, 0)
                h = h[np.arange(len(h)) - first[:-1][doc] < length[doc]]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(h))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(keys, pa.binary()), pa.array(size), lists, pa.array(sketch[:, 0]), pa.array(sketch[:, 1])],
                                                  names=["_row", "key", "size", "prefix", "s0", "s1"])

    return held.select("_row", text).mapInArrow(run, "_row long, key binary, size long, prefix array<bigint>, s0 long, s1 long")


def _repeated(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose ``h`` occurs again; all rows of an ``h`` are in one partition."""
    got = [f for f in frames if f.num_rows]
    if got:
        h, node = (np.concatenate([f.column(k).to_numpy() for f in got]) for k in (0, 1))
        order = np.argsort(h, kind="stable")
        h, node = h[order], node[order]
        same = np.concatenate(([False], h[1:] == h[:-1], [False]))
        keep = same[1:] | same[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(node[keep])], names=["h", "node"])


def _cell_pairs(similarity: float):
    """Pairs of different roots and fitting sizes in each ``h``, for cells of up to ``SMALL`` nodes."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [f for f in frames if f.num_rows]
        if not got:
            return
        h, node, root, size = (np.concatenate([f.column(k).to_numpy() for f in got]) for k in range(4))
        order = np.argsort(h, kind="stable")
        h, node, root, size = h[order], node[order], root[order], size[order]
        for step in range(1, SMALL):
            ok = h[step:] == h[:-step] if step < len(h) else np.zeros(0, bool)
            if not ok.any():
                break
            x = np.flatnonzero(ok)
            y = x + step
            fits = np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y])
            x, y = x[fits & (root[x] != root[y])], y[fits & (root[x] != root[y])]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], names=["a", "b"])

    return run


def _crowd_links(crowd: DataFrame, held: DataFrame, text: str, scheme: Scheme, similarity: float) -> DataFrame:
    """Edges that connect what the similar pairs in each cluster of ``crowd``
    (node, root, size, cluster) connect.  All sets of a cluster are compared
    with each other; a big one is dealt out as pairs of chunks."""
    parts = crowd.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("size") / CROWD)).alias("chunks"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks"))
    rows = crowd.join(parts, "cluster").select("node", "root", "cluster", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    rows = rows.select("node", "root", F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    nodes = _sent_if_small(crowd.select("node"))

    def sets(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for some, h, first in _shingle_sets(frame, text, scheme):
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h))], names=["node", "shingles"])

    texts = held.select(F.col("_row").alias("node"), text).join(nodes, "node").mapInArrow(sets, "node long, shingles array<bigint>")
    dealt = rows.join(stage(texts), "node").select("cell", "node", "root", "shingles")

    def solve(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [f for f in frames if f.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        cells = table.column("cell").to_numpy()
        for cell in np.unique(cells):
            part = table.filter(pa.array(cells == cell)).combine_chunks()
            node, label = part.column("node").to_numpy(), part.column("root").to_numpy().copy()
            lists = part.column("shingles").chunk(0)
            size = lists.value_lengths().to_numpy().astype(np.int64)
            first = np.concatenate(([0], np.cumsum(size)))
            _, token = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            mark = np.zeros(int(token.max()) + 1 if len(token) else 1, np.int64)
            a, b = [], []
            for x in range(len(node)):
                fits = (label != label[x]) & (np.minimum(size, size[x]) >= similarity * np.maximum(size, size[x]))
                if not fits.any():
                    continue
                mine = token[first[x]:first[x + 1]]
                mark[mine] = 1
                shared = segment_sum(mark[token], first)
                mark[mine] = 0
                for y in np.flatnonzero(fits & (shared >= similarity * (size + size[x] - shared))):
                    if label[y] != label[x]:
                        a.append(min(node[x], node[y]))
                        b.append(max(node[x], node[y]))
                        label[label == label[y]] = label[x]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.repartition("cell").mapInArrow(solve, "a long, b long")


def _farthest(similarity: float) -> int:
    """Differing bits of the sketches of two sets at the similarity, with six deviations (2e-9) to spare."""
    bits, p = SKETCH.trees * SKETCH.levels, (1 - similarity) / 2
    return int(bits * p + 6 * sqrt(bits * p * (1 - p)))


def _close_sketches(pairs: DataFrame, prefixes: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sketches allow the similarity; most texts that only
    share a passage go, before any set is sent."""
    ends = _sent_if_small(pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct())
    sketches = _sent_if_small(prefixes.select("_row", "s0", "s1").join(ends, "_row"))
    a, b = (sketches.select(F.col("_row").alias(n), F.col("s0").alias(f"{n}0"), F.col("s1").alias(f"{n}1")) for n in "ab")
    differ = sum(F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in (0, 1))
    return pairs.join(a, "a").join(b, "b").where(differ <= _farthest(similarity)).select("a", "b")


def _close_crowds(rows: DataFrame, prefixes: DataFrame, similarity: float) -> DataFrame:
    """Edges that connect the texts of each crowded shingle whose sizes and
    sketches allow the similarity and which are in different components; in
    each task one per text at most.  ``rows``: h, node, root, size, n.  A shingle of
    over ``CELL`` texts is dealt out as pairs of chunks."""
    nodes = _sent_if_small(rows.select(F.col("node").alias("_row")).distinct())
    sketches = _sent_if_small(prefixes.select("_row", "s0", "s1").join(nodes, "_row").withColumnRenamed("_row", "node"))
    chunks = F.ceil(F.col("n") / CELL)
    own = F.pmod(F.xxhash64("node"), chunks)
    dealt = rows.select("h", "node", "root", "size", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node", "root", "size").join(sketches, "node")
    farthest = _farthest(similarity)

    def solve(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [f for f in frames if f.num_rows]
        if not got:
            return
        cell, node, root, size, s0, s1 = (np.concatenate([f.column(k).to_numpy() for f in got]) for k in range(6))
        order = np.argsort(cell, kind="stable")
        cell, node, root, size, s0, s1 = (v[order] for v in (cell, node, root, size, s0, s1))
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        for begin, end in zip(starts, np.append(starts[1:], len(cell))):
            left, right, pending = [], [], 0
            for x in range(begin, end - 1):
                y = np.arange(x + 1, end)
                y = y[(root[y] != root[x]) & (np.minimum(size[y], size[x]) >= similarity * np.maximum(size[y], size[x]))]
                y = y[np.bitwise_count(s0[y] ^ s0[x]) + np.bitwise_count(s1[y] ^ s1[x]) <= farthest]
                left.append(np.full(len(y), node[x]))
                right.append(node[y])
                pending += len(y)
                if pending > BLOCK:
                    left, right = ([v] for v in local_roots(np.concatenate(left), np.concatenate(right)))
                    pending = len(left[0])
            if left:
                a, b = local_roots(np.concatenate(left), np.concatenate(right))
                yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    ordered = dealt.select("cell", "node", "root", "size", "s0", "s1").repartition("cell")
    return ordered.mapInArrow(solve, "a long, b long")


def _all_similar(nodes: DataFrame, edges: DataFrame, prefixes: DataFrame, held: DataFrame, text: str, scheme: Scheme, similarity: float) -> DataFrame:
    """Similar pairs between the components of ``edges`` (similar pairs already
    known), so that together they connect what all similar pairs connect.

    ``nodes``: node; ``prefixes``: as from ``_prefixes``, node is a ``_row``.
    Nodes that share a prefix shingle meet; where all of them are connected
    already there is nothing to find."""
    own = prefixes.join(_sent_if_small(nodes.select(F.col("node").alias("_row"))), "_row").select(F.col("_row").alias("node"), "size", "prefix")
    met = stage(own.select(F.explode("prefix").alias("h"), "node").repartition("h").mapInArrow(_repeated, "h long, node long"))
    named = own.select("node", "size").join(components(edges), "node", "left").select("node", "size", F.coalesce("root", "node").alias("root"))
    rooted = met.join(_sent_if_small(named.join(met.select("node").distinct(), "node")), "node")
    mixed = rooted.groupBy("h").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    cells = stage(rooted.join(mixed.select("h", "n", F.col("low").alias("_low")), "h").select("h", "node", "root", "size", "n"))
    few = cells.where(F.col("n") <= SMALL).select("h", "node", "root", "size").repartition("h")
    pairs = stage(few.mapInArrow(_cell_pairs(similarity), "a long, b long").distinct())
    pairs = stage(_close_sketches(pairs, prefixes, similarity))
    found = _similar(pairs, held, text, scheme, similarity)
    clusters = components(_close_crowds(cells.where(F.col("n") > SMALL), prefixes, similarity))
    members = clusters.select("node", F.col("root").alias("cluster")).unionByName(clusters.select(F.col("root").alias("node"), F.col("root").alias("cluster"))).distinct()
    crowd = stage(members.join(named, "node").select("node", "root", "size", "cluster"))
    return found.unionByName(_crowd_links(crowd, held, text, scheme, similarity))


def _sent_if_small(ids: DataFrame) -> DataFrame:
    ids = stage(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _groups(held: DataFrame, id_column: str, text: str, scheme: Scheme, similarity: float) -> DataFrame:
    """``_row``, ``id_column``, ``fp``, ``root`` (of the group) and ``component_id``
    for each row of ``held``, a staged table with row numbers ``_row``.

    Texts with one set of shingles are one node.  Links are all pairs of nodes
    with the Jaccard similarity: those that fingerprints find come first, and
    a join on shingles finds what is left between their components."""
    marked = stage(fingerprints(held, text, ["_row", id_column], scheme))
    prefixes = stage(_prefixes(held, text, scheme, similarity))
    marked = marked.join(prefixes.select("_row", "key"), "_row")
    nodes = stage(marked.groupBy("key").agg(F.min("_row").alias("node"), F.min("fp").alias("fp"), F.min(id_column).alias("low")))
    edges = stage(links(nodes, scheme, forest=False).distinct())
    edges = stage(_similar(edges, held, text, scheme, similarity))
    rest = _all_similar(nodes.select("node"), edges, prefixes, held, text, scheme, similarity)
    roots = components(edges.unionByName(rest))
    rooted = nodes.join(roots, "node", "left").select("key", "low", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return marked.join(rooted.join(least, "root").select("key", "root", "component_id"), "key").select("_row", id_column, "fp", "root", "component_id")


def _numbered(df: DataFrame) -> DataFrame:
    return stage(df.withColumn("_row", F.monotonically_increasing_id()))


def near_duplicates(df: DataFrame, id_column: str, text: str, scheme: Scheme = SIMILAR, similarity: float | None = 0.8) -> DataFrame:
    """``id_column``, ``fp`` and ``component_id`` (least id reachable) for every row.

    ``similarity``: links are the pairs with this Jaccard similarity on
    distinct word shingles, all of them; None links by Hamming distance alone,
    and texts with one fingerprint are one node.  Rows with a null id have the
    component of their links; it is null only if no member has an id.  Repeated
    ids are all returned.  An empty table gives no rows.  Building the result
    runs jobs and stages tables in the shared folder.
    """
    if similarity is not None:
        return _groups(_numbered(df.select(id_column, text)), id_column, text, scheme, similarity).select(id_column, "fp", "component_id")
    marked = stage(fingerprints(df, text, [id_column], scheme))
    fps = stage(marked.groupBy("fp").agg(F.min(id_column).alias("low")).withColumn("node", F.monotonically_increasing_id()))
    roots = components(links(fps, scheme, forest=True))
    rooted = fps.join(roots, "node", "left").select("fp", "low", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(id_column, "fp", "component_id")


def drop_near_duplicates(df: DataFrame, id_column: str, text: str, scheme: Scheme = SIMILAR, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` that stay: of each group the one with the least id.

    Rows are told apart by their place in a staged copy of the table.  Rows that
    repeat the least id of their group all stay; rows with a null id go if a
    member has an id, and of a group without any id one row stays.
    """
    held = _numbered(df)
    groups = stage(_groups(held, id_column, text, scheme, similarity).select("_row", F.col(id_column).alias("_own"), "root", "component_id"))
    unnamed = groups.where("component_id is null").select("_row", "root")
    first = unnamed.groupBy("root").agg(F.min("_row").alias("_first"))
    gone = groups.where("component_id is not null and not (_own <=> component_id)").select("_row")
    gone = gone.unionByName(unnamed.join(first, "root").where("_row <> _first").select("_row"))
    return held.join(_sent_if_small(gone), "_row", "left_anti").select(*df.columns)
