"""MinHash near-duplicates by an LSH forest.

Every distinct set of word shingles has a signature of ``trees`` labels of
``levels`` MinHash values.  Each tree is the sorted order of its labels, dealt
by range, so that a tree's regions are runs with a common prefix.  Texts that
share ``least`` levels in any tree are candidates.  A region with more than
``region`` texts goes deeper until its parts are small, and there the nearest
neighbours of each text are tried first.  What that leaves apart in a crowded
region is compared in a second pass, each text against all of the region that
are not connected with it yet; the depth follows the number of texts outside the
region's main component, so a large group of copies does not push strays away
from it.  A sketch of one bit per MinHash value and the sizes of the sets
cut candidates down; full sets confirm every link.

Two sets at the limit of 0.85 fail to share three levels in all of 20 trees
with a probability of 5e-9, four levels with 4e-7; they fail the sketch with 3e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractum.llm.components import components
from tractum.llm.textops import Words, segment_sum, text_slices, xxh64
from tractum.session import stage

NEAREST = 3  # neighbours of a text that are tried first in each part of a crowded region
STRAYS = 512  # texts outside the main component of a region that are compared with all of it
CELL = 2048  # texts of a crowded region in one task
CELL_SHINGLES = 2_000_000  # and their shingles
HUB = 256  # partners of a text that are confirmed in one group
BLOCK = 1 << 15  # shingles hashed at once
BROADCAST_ROWS = 200_000  # a list of ids up to this long is sent to all tasks; a longer one is joined by shuffle
PAIR = "a long, b long, dist int"
ENTRY = "tree int, label binary, node long, size long, sketch binary"


@dataclass(frozen=True)
class Forest:
    trees: int = 20
    levels: int = 12
    least: int = 3  # levels that two texts have in common to be candidates
    region: int = 32  # texts that all meet
    width: int = 3  # words of a shingle
    percent: int = 85
    seed: int = 42

    @property
    def farthest(self) -> int:
        """Differing bits of the sketches up to which a pair is a candidate: 5.5 deviations above the mean at the limit."""
        bits, p = self.trees * self.levels, (100 - self.percent) / 200
        return int(bits * p + 5.5 * sqrt(bits * p * (1 - p)))


def _sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of text i are hashes[first[i]:first[i + 1]], ascending."""
    doc, start, end = words.shingles(width)
    h = xxh64(words.data, start, end - start, 42)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(words.n_docs + 1))


def _binary(values: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    n, size = values.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _rows(column: pa.Array, size: int) -> np.ndarray:
    """Binary values of one size as rows of bytes."""
    if column.offset:
        column = pa.concat_arrays([column])
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * size).reshape(-1, size) if len(column) else np.zeros((0, size), np.uint8)


def minima(h: np.ndarray, first: np.ndarray, scheme: Forest) -> np.ndarray:
    """16 bits of each MinHash value of each set, one row per set; no set is empty."""
    odd = np.random.default_rng(scheme.seed).integers(0, 1 << 63, scheme.trees * scheme.levels, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(first) - 1, len(odd)), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(out):
            stop = max(at + 1, int(np.searchsorted(first, first[at] + BLOCK, "right")) - 1)
            part, starts = h[first[at]:first[stop]], first[at:stop] - first[at]
            product = np.empty_like(part)
            for k, a in enumerate(odd):
                np.multiply(part, a, out=product)
                out[at:stop, k] = np.minimum.reduceat(product, starts)
            at = stop
        return ((out * odd[0]) >> np.uint64(48)).astype(np.uint16)


def signatures(held: DataFrame, scheme: Forest) -> DataFrame:
    """``_row``, ``_id``, ``size`` (shingles), ``key`` (of the set) and ``sig``; the last two null for a text without words."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for rows, data, offsets in text_slices(frame, "_text"):
                h, first = _sets(Words(data, offsets), scheme.width)
                size = np.diff(first)
                some = np.flatnonzero(size)
                keys = np.full(len(size), None, object)
                keys[some] = [blake2b(h[first[i]:first[i + 1]].tobytes(), digest_size=16).digest() for i in some]
                sig = np.full(len(size), None, object)
                if len(some):
                    least = minima(h, np.append(first[some], first[-1]), scheme).astype(">u2")
                    sig[some] = [x.tobytes() for x in least]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(size), pa.array(keys, pa.binary()), pa.array(sig, pa.binary()), rows.column(2)], names=names)

    names = ["_row", "size", "key", "sig", "_id"]
    schema = T.StructType().add("_row", "long").add("size", "long").add("key", "binary").add("sig", "binary").add("_id", held.schema["_id"].dataType)
    return held.select("_row", "_text", "_id").mapInArrow(run, schema)


def _entries(nodes: DataFrame, scheme: Forest, *more: str) -> DataFrame:
    """One row per node and tree: the label, the size and the sketch, and the long columns ``more``."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            sig = _rows(frame.column(2), 2 * scheme.trees * scheme.levels)
            sketch = np.packbits(sig[:, 1::2] & 1, axis=1)
            sketch = np.concatenate((sketch, np.zeros((len(sig), -sketch.shape[1] % 8), np.uint8)), axis=1)
            for t in range(scheme.trees):
                label = sig[:, 2 * t * scheme.levels:2 * (t + 1) * scheme.levels]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), _binary(label), frame.column(0), frame.column(1), _binary(sketch),
                                                  *frame.columns[3:]], names=["tree", "label", "node", "size", "sketch", *more])

    return nodes.select("node", "size", "sig", *more).mapInArrow(run, ", ".join([ENTRY, *[f"{c} long" for c in more]]))


def _sketches(column: pa.Array, scheme: Forest) -> np.ndarray:
    return _rows(column, -(-scheme.trees * scheme.levels // 64) * 8).view(np.uint64)


def _alike(x: np.ndarray, y: np.ndarray, size: np.ndarray, sketch: np.ndarray, scheme: Forest) -> tuple[np.ndarray, ...]:
    """The pairs whose sizes and sketches allow a link, with the differing bits."""
    ok = 100 * np.minimum(size[x], size[y]) >= scheme.percent * np.maximum(size[x], size[y])
    x, y = x[ok], y[ok]
    dist = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1).astype(np.int32)
    ok = dist <= scheme.farthest
    return x[ok], y[ok], dist[ok]


def _shared_levels(tree: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Levels that each entry shares with the next of the order."""
    same = np.cumprod(label[1:] == label[:-1], axis=1).sum(axis=1)
    return np.where(tree[1:] == tree[:-1], same, -1)


def _parts(shared: np.ndarray, scheme: Forest) -> tuple[np.ndarray, np.ndarray]:
    """(stop, whole): the end of each entry's part of its region, and whether
    that is the region itself.  Entries that share all levels are cut in runs."""
    n = len(shared) + 1
    stop, whole, open_ = np.zeros(n, np.int64), np.zeros(n, bool), np.ones(n, bool)
    for depth in range(scheme.least, scheme.levels + 1):
        run = np.concatenate(([0], np.cumsum(shared < depth)))
        ends = np.cumsum(np.bincount(run))
        fits = open_ & (np.bincount(run)[run] <= scheme.region)
        stop[fits] = ends[run[fits]]
        if depth == scheme.least:
            whole = fits
        open_ = open_ & ~fits
    left = np.flatnonzero(open_)
    if len(left):
        first = ends[run[left]] - np.bincount(run)[run[left]]
        stop[left] = np.minimum(ends[run[left]], first + ((left - first) // scheme.region + 1) * scheme.region)
    return stop, whole


def _neighbours(tree, label, node, size, sketch, scheme: Forest) -> tuple[np.ndarray, ...]:
    """Candidates (x, y, dist) among entries in order: all pairs of a small region, the nearest ones in parts of a crowded one."""
    shared = _shared_levels(tree, label)
    stop, whole = _parts(shared, scheme)
    found = []
    x, step = np.arange(len(node)), 1
    while len(x):
        x = x[x + step < stop[x]]
        found.append(_alike(x, x + step, size, sketch, scheme))
        step += 1
    x, y, dist = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    small = whole[x]
    u, v, d = (np.concatenate((p[~small], q[~small])) for p, q in ((x, y), (y, x), (dist, dist)))
    order = np.lexsort((node[v], d, u))
    u, v, d = u[order], v[order], d[order]
    begins = np.searchsorted(u, u)
    first = np.arange(len(u)) - begins < NEAREST
    return np.concatenate((x[small], u[first])), np.concatenate((y[small], v[first])), np.concatenate((dist[small], d[first]))


def _pairs(node: np.ndarray, x: np.ndarray, y: np.ndarray, dist: np.ndarray) -> list[pa.Array]:
    a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
    _, at = np.unique(np.stack((a, b)), axis=1, return_index=True)
    return [pa.array(a[at]), pa.array(b[at]), pa.array(dist[at])]


def _ordered_candidates(nodes: DataFrame, scheme: Forest) -> DataFrame:
    """Candidates of the sorted orders.  Each range gives its own and, for the
    border with the next range, the entries within reach of it; those of a
    border then meet."""
    names = ["a", "b", "dist", "border", "side", "tree", "label", "size", "sketch"]

    def columns(table):
        tree, node, size = (table.column(c).to_numpy() for c in ("tree", "node", "size"))
        return (tree, _rows(table.column("label").combine_chunks(), 2 * scheme.levels).view(">u2"), node, size,
                _sketches(table.column("sketch").combine_chunks(), scheme))

    def within(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [f for f in frames if f.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        part, n, reach = TaskContext.get().partitionId(), table.num_rows, min(scheme.region, table.num_rows)
        entries = columns(table)
        pairs = _pairs(entries[2], *_neighbours(*entries, scheme))
        none = len(pairs[0])
        yield pa.RecordBatch.from_arrays([*pairs, *[pa.nulls(none, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary())]], names=names)
        for border, side, rows in ((part, 0, table.slice(n - reach)), (part - 1, 1, table.slice(0, reach))):
            rows = rows.combine_chunks()
            yield pa.RecordBatch.from_arrays([
                rows.column("node").chunk(0), pa.nulls(reach, pa.int64()), pa.nulls(reach, pa.int32()), pa.array(np.full(reach, border, np.int32)),
                pa.array(np.full(reach, side, np.int32)), *[rows.column(c).chunk(0) for c in ("tree", "label", "size", "sketch")]], names=names)

    def across(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("tree", "ascending"), ("label", "ascending"), ("node", "ascending")])
        side = rows.column("side").to_numpy()
        entries = columns(rows)
        x, y, dist = _neighbours(*entries, scheme)
        ok = side[x] != side[y]
        return pa.table(_pairs(entries[2], x[ok], y[ok], dist[ok]), names=["a", "b", "dist"])

    order = ["tree", "label", "node"]
    met = stage(_entries(nodes, scheme).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        within, f"{PAIR}, border int, side int, tree int, label binary, size long, sketch binary"))
    borders = met.where("border is not null").select(F.col("a").alias("node"), "border", "side", "tree", "label", "size", "sketch")
    return met.where("border is null").select("a", "b", "dist").unionByName(borders.groupBy("border").applyInArrow(across, PAIR))


def _cell_links(scheme: Forest):
    """In each cell, links between its strays and the texts at home there that
    join different components: at most one per text.  Rows come sorted by cell."""
    def solve(rows: pa.Table) -> pa.RecordBatch:
        places = rows.column("place").to_numpy()
        a, b = [], []
        starts = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        for begin, end in zip(starts, np.append(starts[1:], len(places))):
            cell = rows.slice(begin, end - begin)
            node, label, size = (cell.column(c).to_numpy().copy() for c in ("node", "root", "size"))
            stray, home = (cell.column(c).to_numpy(zero_copy_only=False) for c in ("stray", "home"))
            first = np.concatenate(([0], np.cumsum(size)))
            _, token = np.unique(np.frombuffer(b"".join(cell.column("shingles").to_pylist()), np.uint64), return_inverse=True)
            mark = np.zeros(len(token) + 1, np.int64)
            for x in np.flatnonzero(stray):
                fits = home & (label != label[x]) & (100 * np.minimum(size, size[x]) >= scheme.percent * np.maximum(size, size[x]))
                if not fits.any():
                    continue
                own = token[first[x]:first[x + 1]]
                mark[own] = 1
                shared = segment_sum(mark[token], first)
                mark[own] = 0
                for y in np.flatnonzero(fits & (100 * shared >= scheme.percent * (size + size[x] - shared))):
                    if label[y] != label[x]:
                        a.append(min(node[x], node[y]))
                        b.append(max(node[x], node[y]))
                        label[label == label[y]] = label[x]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for frame in frames:
            if not frame.num_rows:
                continue
            places = frame.column(0).to_numpy()
            cut = int(np.searchsorted(places, places[-1]))
            if cut or (held and held[-1].column(0)[0].as_py() != places[0]):
                yield solve(pa.Table.from_batches([*held, frame.slice(0, cut)]))
                held = []
            held.append(frame.slice(cut))
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _crowded_links(nodes: DataFrame, held: DataFrame, scheme: Forest) -> DataFrame | None:
    """Links between different components in the crowded regions, as many as
    connect what all links there connect; ``nodes`` have ``root``.  Full sets are compared in cells of a
    region, to which its strays are sent.  Runs jobs; None if no region is
    crowded and mixed."""
    def prefix(depth: int):
        return F.substring("label", 1, 2 * depth).alias("prefix")

    found, depth = None, scheme.least
    pending = _entries(nodes, scheme, "root").select("tree", "label", "node", "size", "root")
    mixed = pending.groupBy("tree", prefix(depth)).agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    regions = _sent_if_small(mixed.where((F.col("n") > scheme.region) & (F.col("low") < F.col("high"))).select("tree", "prefix"))
    pending = stage(pending.withColumn("prefix", F.substring("label", 1, 2 * depth)).join(regions, ["tree", "prefix"]))
    if pending.isEmpty():
        return None
    sets_of = stage(_sets_of(_sent_if_small(pending.select("node").distinct()), held, scheme))
    while not pending.isEmpty():
        per_root = pending.groupBy("tree", "prefix", "root").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
        stats = per_root.groupBy("tree", "prefix").agg(F.sum("n").alias("total"), F.sum("shingles").alias("shingles"), F.max(F.struct("n", "root")).alias("main"))
        cells = F.ceil(F.greatest(F.col("total") / CELL, F.col("shingles") / CELL_SHINGLES))
        stats = _sent_if_small(stats.select("tree", "prefix", F.col("main.root").alias("main"), (F.col("total") - F.col("main.n")).alias("strays"), cells.alias("cells")).where("strays > 0"))
        rows = pending.join(stats, ["tree", "prefix"])
        ready = F.lit(True) if depth == scheme.levels else F.col("strays") <= STRAYS
        own = F.pmod(F.xxhash64("node"), F.col("cells"))
        stray = F.col("root") != F.col("main")
        dealt = rows.where(ready).select("tree", "prefix", "node", "root", stray.alias("stray"), own.alias("own"),
                                         F.explode(F.when(stray, F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).otherwise(F.array(own))).alias("cell"))
        dealt = dealt.select(F.xxhash64("tree", "prefix", "cell").alias("place"), "node", "root", "stray", (F.col("own") == F.col("cell")).alias("home")).join(sets_of, "node")
        dealt = dealt.select("place", "node", "root", F.expr("octet_length(shingles) div 8").cast("long").alias("size"), "stray", "home", "shingles")
        links = stage(dealt.repartition("place").sortWithinPartitions("place").mapInArrow(_cell_links(scheme), "a long, b long"))
        found = links if found is None else found.unionByName(links)
        depth += 1
        pending = stage(rows.where(~ready).select("tree", "label", "node", "size", "root", F.substring("label", 1, 2 * depth).alias("prefix")))
    return found


def _sent_if_small(ids: DataFrame) -> DataFrame:
    ids = stage(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _sets_of(nodes: DataFrame, held: DataFrame, scheme: Forest) -> DataFrame:
    """``node`` and ``shingles`` (their hashes, ascending, eight bytes each) of the texts of ``nodes``."""
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for rows, data, offsets in text_slices(frame, "_text"):
                h, first = _sets(Words(data, offsets), scheme.width)
                lists = pa.array([h[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), lists], names=["node", "shingles"])

    return held.select(F.col("_row").alias("node"), "_text").join(nodes, "node").mapInArrow(run, "node long, shingles binary")


def _confirmed(pairs: DataFrame, held: DataFrame, scheme: Forest) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity.  The end with more
    partners is the hub; its set goes once to each group of ``HUB`` partners."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    degree = ends.groupBy("node").agg(F.count("*").alias("n"))
    degree = _sent_if_small(degree)
    both = pairs.join(degree.withColumnsRenamed({"node": "a", "n": "n_a"}), "a").join(degree.withColumnsRenamed({"node": "b", "n": "n_b"}), "b")
    swap = F.col("n_b") > F.col("n_a")
    spokes = both.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("node"),
                         F.ceil(F.greatest("n_a", "n_b") / HUB).alias("parts"))
    spokes = stage(spokes.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))))

    sets_of = stage(_sets_of(degree.select("node"), held, scheme))
    hubs = spokes.select(F.col("hub").alias("node"), "parts").distinct().join(sets_of, "node")
    hubs = hubs.select(F.col("node").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("node"), "shingles")
    rows = hubs.unionByName(spokes.join(sets_of, "node").select("hub", "part", "node", "shingles"))

    def check(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for frame in frames:
            a, b = [], []
            for hub, node, shingles in zip(frame.column(0).to_pylist(), frame.column(2).to_pylist(), frame.column(3)):
                other = np.frombuffer(shingles.as_buffer(), np.uint64)
                if node is None:
                    own = other
                    continue
                common = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * common >= scheme.percent * (len(own) + len(other) - common):
                    a.append(min(hub, node))
                    b.append(max(hub, node))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    ordered = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("node").asc_nulls_first())
    return ordered.select("hub", "part", "node", "shingles").mapInArrow(check, "a long, b long")


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _linked(pairs: DataFrame, held: DataFrame, scheme: Forest) -> DataFrame:
    """(node, root) of the components of all similar ``pairs``: the nearest
    partner of each text is confirmed first, then every pair that is still in
    two components."""
    pairs = stage(pairs.groupBy("a", "b").agg(F.min("dist").alias("dist")))
    each = pairs.select(F.col("a").alias("x"), F.struct("dist", "b", "a").alias("p")).unionByName(pairs.select(F.col("b").alias("x"), F.struct("dist", "b", "a").alias("p")))
    first = each.groupBy("x").agg(F.min("p").alias("p")).select("p.a", "p.b").distinct()
    roots = stage(components(stage(_confirmed(stage(first), held, scheme))))
    left = pairs.join(roots.withColumnsRenamed({"node": "a", "root": "root_a"}), "a", "left").join(roots.withColumnsRenamed({"node": "b", "root": "root_b"}), "b", "left")
    left = stage(left.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b").join(first, ["a", "b"], "left_anti"))
    return roots if left.isEmpty() else _merged(roots, stage(_confirmed(left, held, scheme)))


def _merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, root) with ``edges`` added: only their roots are joined anew."""
    if edges.isEmpty():
        return roots
    ends = edges
    for end in ("a", "b"):
        named = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
        ends = ends.join(named, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    anew = components(ends)
    old = roots.withColumnRenamed("root", "_at").join(anew.select(F.col("node").alias("_at"), F.col("root").alias("_new")), "_at", "left").select("node", F.coalesce("_new", "_at").alias("root"))
    return stage(old.unionByName(anew.join(roots.select("node"), "node", "left_anti")))


def near_duplicates(df: DataFrame, id_column: str, text: str, scheme: Forest = Forest()) -> DataFrame:
    """``id_column``, ``n_shingles``, ``component_id`` (least id reachable) and
    ``kept`` (the id is the component's) for every row.

    Texts are lower-cased (A-Z only); words are split at white space; a text
    with fewer words than the width is one shingle.  Texts are linked if
    100 * shared >= percent * united shingles.  A text without words (null,
    empty, blank) is linked with nothing and is its own component.  Texts with
    the same set are one node, whatever their number.  Rows with a null id have
    the component of their links (null if no member has an id) and are kept
    only in that case; repeated ids are all returned.  An empty table
    gives no rows.  Building the result runs jobs and stages tables in the
    shared folder.
    """
    held = stage(df.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id()))
    marked = stage(signatures(held, scheme))
    known = marked.select("_row", "_id", "size", "key")
    groups = known.where("size > 0").groupBy("key").agg(F.min("_row").alias("node"), F.min("_id").alias("low"), F.count("*").alias("n"))
    nodes = stage(marked.select(F.col("_row").alias("node"), "size", "sig").join(groups, "node"))
    roots = _linked(_ordered_candidates(nodes, scheme), held, scheme)
    crowded = _crowded_links(_rooted(nodes.select("node", "size", "sig"), roots), held, scheme)
    if crowded is not None:
        roots = _merged(roots, crowded)
    rooted = stage(_rooted(nodes.select("node", "key", "low", "n"), roots))
    least = rooted.where("node <> root").groupBy("root").agg(F.min("low").alias("least")).join(
        rooted.select("node", F.col("low").alias("own")), F.col("root") == F.col("node")).select("root", F.least("least", "own").alias("least"))
    named = rooted.join(_sent_if_small(least), "root", "left").select("key", "n", F.coalesce("least", "low").alias("component_id"))
    named = stage(named)
    # The key of many copies is looked up in each task instead of gathering its rows.
    hot = _sent_if_small(named.where(F.col("n") > CELL).select("key", "component_id"))
    texts = known.where("size > 0")
    found = texts.join(named.where(F.col("n") <= CELL).select("key", "component_id"), "key").unionByName(texts.join(hot, "key").select("key", "_row", "size", "_id", "component_id"))
    out = found.select("_id", "size", "component_id").unionByName(known.where("size = 0").select("_id", "size", F.col("_id").alias("component_id")))
    return out.select(F.col("_id").alias(id_column), F.col("size").alias("n_shingles"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
