"""Merkle manifest of a table: a digest per row, per group and of the whole, and a proof for each row.

The leaves of a group are dealt to aligned blocks of ``FANOUT ** DEPTH``.  A
block hashes its own subtree.  Upper levels come by a butterfly exchange: in
round r every block meets the blocks of the sibling subtrees (one of each, the
same place in each), swaps subtree roots with them and hashes the common
ancestor for itself, as all blocks below that ancestor do.  After the last
round each block knows the whole path above it, so nothing is handed down.
A group's root is a leaf of the tree over the groups, built in the same way.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractum.operators.ordered import Ordered
from tractum.session import stage

FANOUT = 8
DEPTH = 4  # levels that a block hashes by itself
PATH = "array<struct<at:int,run:array<string>>>"


def encoded(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def node(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def levels_of(n: int, upto: int, fanout: int = FANOUT) -> int:
    """Levels above ``n`` nodes until one is left, ``upto`` at most."""
    levels = 0
    while n > 1 and levels < upto:
        n = -(-n // fanout)
        levels += 1
    return levels


def subtree(leaves: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes of each level, leaves first."""
    out = [leaves]
    for _ in range(levels):
        below = out[-1]
        out.append([node(below[i:i + fanout]) for i in range(0, len(below), fanout)])
    return out


class Manifest:
    """The trees over the groups of ``rows``; building it runs jobs and stages
    tables in the shared folder.

    ``rows``: group (string, not null), the order columns, ``digest`` and any
    more columns.  ``placed``: the rows with ``_place`` (in the group, from
    0), ``_n`` (rows of the group) and ``_block``.  ``blocks``: for each group
    and block ``root`` (of the group) and ``path``, the runs above the block.
    """

    def __init__(self, rows: DataFrame, group: str, order: list[str], fanout: int = FANOUT, depth: int = DEPTH):
        self.group, self.fanout, self.depth = group, fanout, depth
        size = fanout ** depth
        ranked = Ordered(rows, [group], order).rank("_place")
        counts = ranked.groupBy(group).agg(F.count("*").alias("_n"))
        placed = ranked.join(counts, group).withColumn("_place", F.col("_place") - 1)
        self.placed = stage(placed.withColumn("_block", F.floor(F.col("_place") / size)))
        self.blocks = self._exchange(stage(self._subtrees()))

    def _subtrees(self) -> DataFrame:
        group, fanout, depth = self.group, self.fanout, self.depth

        def hash_block(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("_place")
            n = rows.column("_n")[0].as_py()
            top = subtree(rows.column("digest").to_pylist(), levels_of(n, depth, fanout), fanout)[-1][0]
            return pa.table({group: rows.column(group).slice(0, 1), "_block": rows.column("_block").slice(0, 1), "n": [n], "h": [top]})

        rows = self.placed.select(group, "_block", "_place", "_n", "digest")
        roots = rows.groupBy(group, "_block").applyInArrow(hash_block, f"`{group}` string, _block long, n long, h string")
        size = fanout ** depth
        return roots.select(group, "_block", F.ceil(F.col("n") / size).alias("n_blocks"), "h", F.array().cast(PATH).alias("path"))

    def _exchange(self, blocks: DataFrame) -> DataFrame:
        """Swaps roots among aligned runs of subtrees until each block holds the group's root."""
        group, width = self.group, 1
        most = blocks.agg(F.max("n_blocks")).first()[0] or 1
        while width < most:
            step, fanout = F.lit(width).cast("long"), F.lit(self.fanout).cast("long")
            own = F.floor(F.col("_block") / step)
            first = own - own % fanout
            last = F.least(first + fanout, F.ceil(F.col("n_blocks") / step)) - 1
            asked = blocks.withColumns({"own": own, "first": first}).select("*", F.explode(F.sequence("first", last)).alias("sibling"))
            # A short last subtree has fewer blocks: its blocks answer in turn.
            held = F.least(step, F.col("n_blocks") - F.col("sibling") * step)
            asked = asked.withColumn("partner", F.col("sibling") * step + (F.col("_block") % step) % held)
            told = blocks.select(F.col(group).alias("_g"), F.col("_block").alias("partner"), F.col("h").alias("told"))
            met = asked.join(told, (asked[group] == told["_g"]) & (asked["partner"] == told["partner"]))
            swapped = met.groupBy(group, "_block").agg(
                F.any_value("n_blocks").alias("n_blocks"), F.any_value("h").alias("h"), F.any_value("path").alias("path"),
                F.any_value(F.col("own") - F.col("first")).cast("int").alias("at"),
                F.transform(F.sort_array(F.collect_list(F.struct("sibling", "told"))), lambda x: x["told"]).alias("run"))
            rises = F.ceil(F.col("n_blocks") / step) > 1
            blocks = stage(swapped.select(
                group, "_block", "n_blocks", F.when(rises, F.sha2(F.array_join("run", ""), 256)).otherwise(F.col("h")).alias("h"),
                F.when(rises, F.concat("path", F.array(F.struct("at", "run")))).otherwise(F.col("path")).cast(PATH).alias("path")))
            width *= self.fanout
        return blocks.select(group, "_block", F.col("h").alias("root"), "path")

    def roots(self) -> DataFrame:
        """One row per group: every block of it holds the same root."""
        return self.blocks.where("_block = 0").select(self.group, F.col("root").alias("digest"))

    def paths(self, keep: str) -> DataFrame:
        """``keep``, ``root`` and ``path`` (all runs from the row to the root) of every row."""
        group, fanout, depth = self.group, self.fanout, self.depth

        def run(rows: pa.Table, upper: pa.Table) -> pa.Table:
            rows = rows.sort_by("_place")
            tree = subtree(rows.column("digest").to_pylist(), levels_of(rows.column("_n")[0].as_py(), depth, fanout), fanout)
            upper = upper.to_pylist()[0]
            out = []
            for i in range(rows.num_rows):
                path = []
                for below in tree[:-1]:
                    at, i = i % fanout, i // fanout
                    path.append({"at": at, "run": below[i * fanout:(i + 1) * fanout]})
                out.append(path + upper["path"])
            kind = pa.list_(pa.struct([("at", pa.int32()), ("run", pa.list_(pa.string()))]))
            return pa.table([rows.column(keep), pa.array([upper["root"]] * rows.num_rows, pa.string()), pa.array(out, kind)], names=[keep, "root", "path"])

        rows = self.placed.select(group, "_block", "_place", "_n", "digest", keep)
        schema = self.placed.select(keep).schema.add("root", "string").add("path", self.blocks.schema["path"].dataType)
        return rows.groupBy(group, "_block").cogroup(self.blocks.groupBy(group, "_block")).applyInArrow(run, schema)

    def fold(self, keep: list[str], claimed: str, above: DataFrame | None = None) -> DataFrame:
        """For every row the columns ``keep``, ``subroot``, ``root``,
        ``proof_sha256`` (digest of the siblings on its path, bottom up, left
        to right) and ``folded_root`` (from the digest in column ``claimed``
        and those siblings).  ``above``: group, ``root`` and ``path`` of the
        tree over the groups."""
        group, fanout, depth = self.group, self.fanout, self.depth
        blocks = self.blocks.withColumnRenamed("root", "subroot")
        if above is None:
            blocks = blocks.withColumn("root", F.col("subroot"))
        else:
            over = above.select(F.col(group).alias("_g"), "root", F.col("path").alias("_over"))
            blocks = blocks.join(over, blocks[group] == over["_g"]).withColumn("path", F.concat("path", "_over")).drop("_g", "_over")
        schema = self.placed.select(*[F.col(k) for k in keep]).schema
        for name in ("subroot", "root", "proof_sha256", "folded_root"):
            schema = schema.add(name, "string")

        def prove(rows: pa.Table, upper: pa.Table) -> pa.Table:
            rows = rows.sort_by("_place")
            tree = subtree(rows.column("_d").to_pylist(), levels_of(rows.column("_n")[0].as_py(), depth, fanout), fanout)
            upper = upper.to_pylist()[0]
            path = [(step["at"], step["run"]) for step in upper["path"]]
            others = "".join("".join(run[:at] + run[at + 1:]) for at, run in path).encode()
            proofs, folded = [], []
            for i, now in enumerate(rows.column("_c").to_pylist()):
                seen = hashlib.sha256()
                for below in tree[:-1]:
                    at, i = i % fanout, i // fanout
                    run = below[i * fanout:(i + 1) * fanout]
                    left, right = "".join(run[:at]), "".join(run[at + 1:])
                    seen.update((left + right).encode())
                    now = hashlib.sha256((left + now + right).encode()).hexdigest()
                seen.update(others)
                for at, run in path:
                    now = node(run[:at] + [now] + run[at + 1:])
                proofs.append(seen.hexdigest())
                folded.append(now)
            n = rows.num_rows
            return pa.table([rows.column(f"_k{i}") for i in range(len(keep))] + [
                pa.array([upper["subroot"]] * n, pa.string()), pa.array([upper["root"]] * n, pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string())],
                names=schema.names)

        rows = self.placed.select(F.col(group).alias("_g"), "_block", "_place", "_n", F.col("digest").alias("_d"), F.col(claimed).alias("_c"),
                                  *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)])
        upper = blocks.select(F.col(group).alias("_g"), "_block", "subroot", "root", "path")
        return rows.groupBy("_g", "_block").cogroup(upper.groupBy("_g", "_block")).applyInArrow(prove, schema)


def prove(rows: DataFrame, order: list[str], group: str, keep: list[str], claimed: str, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """``keep``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and
    ``verified`` for every row of ``rows``.

    ``digest``: the row's digest in lowercase hex; ``claimed``: the digest to
    be checked against the proof.  Groups ascend by UTF-8 bytes, null first;
    rows of a group ascend by ``order``, nulls first, and rows that agree there
    by their digest (rows equal in it too are interchangeable).  Repeated rows
    are leaves of their own.  A group of one row has its leaf as its root.  An
    empty table gives no rows.
    """
    named = {k: f"k{i}" for i, k in enumerate(keep)}
    plain = rows.select(F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit("")).alias("g"),
                        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], "digest", F.col(claimed).alias("claimed"),
                        *[F.col(k).alias(v) for k, v in named.items()])
    each = Manifest(plain, "g", [*[f"o{i}" for i in range(len(order))], "digest"], fanout, depth)
    over = Manifest(each.roots().withColumn("all", F.lit("")).withColumnRenamed("g", "name"), "all", ["name"], fanout, depth)
    above = over.paths("name").withColumnRenamed("name", "g")
    out = each.fold(list(named.values()), "claimed", above)
    return out.select(*[F.col(v).alias(k) for k, v in named.items()], "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))
