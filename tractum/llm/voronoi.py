"""Exact top-k search by inner product as a Voronoi join.

Data and queries are grouped by their nearest pivot.  For a query q and a
group with pivot p and radius r, every member x has q.x <= q.p + |q| r.  The
pivots are data themselves, so the (k+1)-th largest q.p bounds the result from
below before any search.  Only the groups whose bound reaches it get the
query; each is solved locally, in blocks of bounded size, and the blocks'
first k are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractum.operators.ordered import top_k
from tractum.session import stage

MOST_PIVOTS = 1024  # per dimension; bounds what is broadcast
MOST_BLOCK = 4096  # rows of a block, data and queries each


def whole_vectors(df: DataFrame, id_column: str, vector: str, scale: int = 1024) -> DataFrame:
    """(id, dim, vec): components floor(scale * x) as doubles.  Vectors that are
    null or hold null or non-finite components are left out."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return df.where(x.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col(id_column).alias("id"), F.size(x).alias("dim"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("vec"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products.  Doubles hold them up to 2 ** 53; beyond
    that, Python's integers are used; a score outside a long stays at its end."""
    largest = max(1, q.shape[1]) * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(x).max(initial=0))
    if largest < 2.0**53:
        return (q @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    ends = np.iinfo(np.int64)
    return np.clip(whole(q) @ whole(x).T, ends.min, ends.max).astype(np.int64)


def _pivots(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Distinct vectors with the least hashes, per dimension; at most
    ``MOST_PIVOTS`` for each of the few dimensions reach the driver."""
    most = int(min(MOST_PIVOTS, max(16, round(math.sqrt(n)))))
    hashed = rows.withColumn("h", F.xxhash64("vec"))
    least = top_k(hashed.select("dim", "h").distinct(), ["dim"], [F.col("h")], most).select("dim", "h")
    chosen = hashed.join(F.broadcast(least), ["dim", "h"]).groupBy("dim", "h").agg(F.min("vec").alias("vec")).orderBy("dim", "h").collect()
    out: dict[int, list] = {}
    for r in chosen:
        out.setdefault(r.dim, []).append(r.vec)
    return {d: np.array(v, np.float64).reshape(len(v), d) for d, v in out.items()}


def search(df: DataFrame, id_column: str, vector: str, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``df`` that
    ``is_query`` (a condition on ``id``) selects, the ``k`` other rows of the
    same dimension with the highest inner product of floor(scale * x), ties to
    the smaller id; all if there are fewer.

    Rows with the same id are separate candidates and queries; null ids are
    no queries and come last among ties.  No usable vector: no rows.  Building
    the result runs jobs and stages the vectors.
    """
    schema = "query_row long, query_id long, vec_id long, score long"
    rows = stage(whole_vectors(df, id_column, vector, scale)).withColumn("row", F.monotonically_increasing_id())
    n = rows.count()
    pivots = _pivots(rows, n)

    def assign(frames):
        for frame in frames:
            dims = frame.column(1).to_numpy()
            for d in np.unique(dims):
                part = frame.filter(pa.array(dims == d))
                x, p = _matrix(part.column(2), d), pivots[int(d)]
                near, far = [], []
                for at in range(0, len(x), MOST_BLOCK):
                    block = x[at:at + MOST_BLOCK]
                    g = ((p * p).sum(axis=1) - 2 * block @ p.T).argmin(axis=1)
                    near.append(g)
                    far.append(np.sqrt(((block - p[g]) ** 2).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(near).astype(np.int32)), pa.array(np.concatenate(far))], names=[*part.schema.names, "cell", "far"])

    grouped = stage(rows.select("id", "dim", "vec", "row").mapInArrow(assign, "id long, dim int, vec array<double>, row long, cell int, far double"))
    cells = grouped.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # one row per pivot
    radius = {d: np.full(len(p), -1.0) for d, p in pivots.items()}
    for c in cells:
        radius[c.dim][c.cell] = c.radius

    def route(frames):
        """The cells each query needs, and the bound its results must reach."""
        for frame in frames:
            for r in range(frame.num_rows):
                d = frame.column(1)[r].as_py()
                q, p, reach = np.array(frame.column(2)[r].as_py(), np.float64), pivots[d], radius[d]
                at = p @ q
                slack = 1e-9 * (np.abs(at) + 1.0) + 1.0  # rounding of the bounds
                least = np.sort(at)[-k - 1] if len(at) > k else -np.inf
                need = np.flatnonzero((reach >= 0) & (at + np.linalg.norm(q) * np.maximum(reach, 0) * (1 + 1e-9) + slack >= least))
                one = frame.slice(r, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pylist([one | {"cell": int(c), "least": float(least) - 1.0} for c in need], route_schema)

    route_schema = pa.schema([("id", pa.int64()), ("dim", pa.int32()), ("vec", pa.list_(pa.float64())), ("row", pa.int64()), ("cell", pa.int32()), ("least", pa.float64())])
    queries = grouped.where(is_query).select("id", "dim", "vec", "row")
    routed = stage(queries.mapInArrow(route, "id long, dim int, vec array<double>, row long, cell int, least double"))
    # Blocks: data of a cell, and queries that need it, dealt by their row number.
    block = int(min(MOST_BLOCK, max(256, 4 * math.sqrt(n))))
    parts = lambda of: F.ceil(F.col(of) / block).cast("int")
    asked = routed.groupBy("dim", "cell").agg(F.count("*").alias("asked"))
    shares = grouped.groupBy("dim", "cell").agg(F.count("*").alias("held")).join(asked, ["dim", "cell"]).select("dim", "cell", parts("held").alias("blocks"), parts("asked").alias("shares"))
    shares = F.broadcast(shares)  # at most one row per pivot
    deal = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ("id", "dim", "vec", "row", "cell")
    data = grouped.join(shares, ["dim", "cell"]).select(*kept, F.lit(None).cast("double").alias("least"), deal("blocks").alias("block"), every("shares").alias("share"))
    asks = routed.join(shares, ["dim", "cell"]).select(*kept, "least", every("blocks").alias("block"), deal("shares").alias("share"))

    def solve(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        asking = pa.compute.is_valid(table.column("least"))
        q, x = table.filter(asking), table.filter(pa.compute.invert(asking))
        score = _products(_matrix(q.column("vec"), dim), _matrix(x.column("vec"), dim))
        qrow, xrow = q.column("row").to_numpy(), x.column("row").to_numpy()
        ids = x.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()
        least = q.column("least").to_numpy()
        left, right = [], []
        for i in range(len(qrow)):
            at = np.flatnonzero((score[i] >= least[i]) & (xrow != qrow[i]))
            best = at[np.lexsort((ids[at], -score[i][at]))[:k]]
            left.append(np.full(len(best), i))
            right.append(best)
        left, right = np.concatenate(left or [np.zeros(0, int)]).astype(np.int64), np.concatenate(right or [np.zeros(0, int)]).astype(np.int64)
        return pa.table([pa.array(qrow[left]), q.column("id").take(pa.array(left)), x.column("id").take(pa.array(right)), pa.array(score[left, right])], names=["query_row", "query_id", "vec_id", "score"])

    found = data.unionByName(asks).groupBy("dim", "cell", "block", "share").applyInArrow(solve, schema)
    best = top_k(found, ["query_row"], [F.col("score").desc(), F.col("vec_id").asc_nulls_last()], k)
    return best.select("query_id", "rank", "vec_id", "score")
