"""S: scans, sources and sinks."""

import uuid

from pyspark.sql import functions as F

from tractum.catalog.base import query
from tractum.functions.columns import id_from_text
from tractum.session import shared_folder, stage
from tractum.sources import ranges, tables
from tractum.sources.feather import read_feather, write_feather


def _scratch(t, name):
    return f"{shared_folder(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("scan_feather", "pts", """
    SELECT pre, count(*) AS n, CAST(sum(size) AS BIGINT) AS total_size FROM pts GROUP BY pre""")
def scan_feather(t):
    path = _scratch(t, "feather")
    write_feather(t.pts().select("pre", "post", "region", "size"), path).agg(F.sum("n_rows")).first()
    df = read_feather(t.spark, path, ["pre", "size"])
    return df.groupBy("pre").agg(F.count("*").alias("n"), F.sum("size").alias("total_size"))


@query("scan_parquet_project", "", """
    SELECT l_returnflag AS flag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
    FROM lineitem GROUP BY 1""")
def scan_parquet_project(t):
    df = t.read("lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("long").alias("q"))
    return df.groupBy("flag").agg(F.count("*").alias("n"), F.sum("q").alias("quantity"))


@query("scan_parquet_isin", "", """
    SELECT o_custkey AS id, count(*) AS n FROM orders
    WHERE o_custkey IN (1, 4, 7, 9, 25, 60, 61) AND o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1""")
def scan_parquet_isin(t):
    df = t.read("orders").where(
        F.col("o_custkey").isin(1, 4, 7, 9, 25, 60, 61) & F.col("o_orderpriority").isin("1-URGENT", "5-LOW")
    )
    return df.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))


@query("scan_csv_typed", "edg", """
    SELECT region, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS weight, min(pre) AS min_pre, max(post) AS max_post
    FROM edg GROUP BY region""")
def scan_csv_typed(t):
    path = _scratch(t, "csv")
    tables.write_delimited(t.edg(), path, ["pre", "post", "region", "n"], sep="\t")
    df = tables.read_delimited(t.spark, path, "pre LONG, post LONG, region STRING, n LONG", sep="\t")
    return df.groupBy("region").agg(
        F.count("*").alias("n_rows"), F.sum("n").alias("weight"), F.min("pre").alias("min_pre"),
        F.max("post").alias("max_post"),
    )


@query("node_universe", "", """
    SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_ids, min(o_custkey) AS first_id, max(o_custkey) AS last_id,
           CAST(count(*) - count(DISTINCT o_custkey) AS BIGINT) AS n_repeats FROM orders""")
def node_universe(t):
    ids = t.read("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return ids.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_ids"), F.min("id").alias("first_id"),
        F.max("id").alias("last_id"), (F.sum("n") - F.count("*")).alias("n_repeats"),
    )


@query("json_map_explode", "", """
    SELECT event_type, key, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.' || key) AS BIGINT)) AS BIGINT) AS total
    FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events) e GROUP BY 1, 2""")
def json_map_explode(t):
    entries = tables.json_entries(t.read("events").select("event_type", "props"), "props", "bigint")
    return entries.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.sum("entry").alias("total"))


# The column sets that identify a layout.
LAYOUTS = {
    "contact_points": ("l_suppkey", "l_partkey", "l_linenumber"),
    "claims": ("o_orderkey", "o_custkey", "o_orderpriority"),
    "samples": ("event_id", "user_id", "event_type"),
}


@query("schema_dispatch", "", """
    SELECT 'contact_points' AS layout, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_ids FROM lineitem
    UNION ALL SELECT 'claims', count(*), count(DISTINCT o_custkey) FROM orders
    UNION ALL SELECT 'samples', count(*), count(DISTINCT user_id) FROM events""")
def schema_dispatch(t):
    id_of = {"contact_points": "l_suppkey", "claims": "o_custkey", "samples": "user_id"}
    out = None
    for name in ("lineitem", "orders", "events"):
        df = t.read(name)
        layout = tables.dispatch(df, LAYOUTS)
        one = df.agg(F.lit(layout).alias("layout"), F.count("*").alias("n_rows"),
                     F.count_distinct(id_of[layout]).alias("n_ids"))
        out = one if out is None else out.unionByName(one)
    return out


def _inventory_sql():
    columns = {
        "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
        "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                   ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
        "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    }
    parts = [
        f"SELECT '{tab}' AS table_name, '{c}' AS column_name, '{typ}' AS type, count(*) AS n_rows, "
        f"count(*) FILTER (WHERE {c} IS NULL) AS n_nulls FROM {tab}"
        for tab, cols in columns.items() for c, typ in cols
    ]
    return " UNION ALL ".join(parts)


@query("schema_inventory", "", _inventory_sql())
def schema_inventory(t):
    out = None
    for name in ("supplier", "orders", "labels"):
        one = tables.schema_inventory(t.read(name), name)
        out = one if out is None else out.unionByName(one)
    return out


@query("sink_parquet_roundtrip", "edg", """
    SELECT region, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS weight FROM edg GROUP BY region""")
def sink_parquet_roundtrip(t):
    return stage(t.edg()).groupBy("region").agg(F.count("*").alias("n_rows"), F.sum("n").alias("weight"))


@query("sink_csv_roundtrip", "edg", """
    SELECT CAST(720575940000000000 + pre AS VARCHAR) AS pre_id, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS weight
    FROM edg GROUP BY 1""")
def sink_csv_roundtrip(t):
    path = _scratch(t, "csv")
    edges = t.edg().withColumn("pre_id", F.lit(720575940000000000) + F.col("pre"))
    tables.write_delimited(edges, path, ["pre_id", "post", "n"], id_columns=["pre_id"])
    back = tables.read_delimited(t.spark, path, "pre_id STRING, post LONG, n LONG")
    exact = back.withColumn("id", id_from_text("pre_id"))
    return exact.groupBy(F.col("id").cast("string").alias("pre_id")).agg(
        F.count("*").alias("n_rows"), F.sum("n").alias("weight")
    )


@query("audit_json", "pts", """
    SELECT '{"n_points":' || count(*) || ',"n_self":' || count(*) FILTER (WHERE pre = post)
           || ',"total_size":' || sum(size) || '}' AS audit FROM pts""")
def audit_json(t):
    return tables.audit_json(t.pts().agg(
        F.count("*").alias("n_points"), F.count_if(F.expr("pre = post")).alias("n_self"),
        F.sum("size").alias("total_size"),
    ))


@query("stage_reuse", "edg", """
    SELECT pre, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS weight FROM edg GROUP BY pre""")
def stage_reuse(t):
    inputs = [t.path("lineitem"), t.path("supplier")]
    tables.named_stage(t.edg(), "edges", inputs)
    again = tables.named_stage(t.edg(), "edges", inputs)  # reads what the first call wrote
    return again.groupBy("pre").agg(F.count("*").alias("n_rows"), F.sum("n").alias("weight"))


@query("file_manifest")
def file_manifest(t):
    return tables.file_manifest(t.spark, t.folder, "*.parquet")


@query("file_tree_digests")
def file_tree_digests(t):
    """Digest trees of the files, hashed by ranges of 64 KiB."""
    hashed = stage(ranges.range_digests(ranges.file_ranges(t.spark, t.folder, "*.parquet", 1 << 16)))
    return ranges.tree_digest(hashed)


@query("scan_feather_isin", "pts", """
    SELECT pre, region, count(*) AS n FROM pts WHERE pre IN (3, 7, 9) GROUP BY ALL""")
def scan_feather_isin(t):
    """The list of ids reaches the source: sorted files skip most batches."""
    path = _scratch(t, "feather")
    write_feather(t.pts().select("pre", "region", "size").repartitionByRange("pre").sortWithinPartitions("pre"), path).agg(F.sum("n_rows")).first()
    return read_feather(t.spark, path, ["pre", "region"]).where(F.col("pre").isin(3, 7, 9)).groupBy("pre", "region").agg(F.count("*").alias("n"))


@query("partial_scan_flag", "pts", """
    SELECT true AS complete, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS weight FROM pts
    UNION ALL SELECT false, NULL, NULL""")
def partial_scan_flag(t):
    full = tables.scan_totals(t.pts(), F.col("size"))
    return full.unionByName(tables.scan_totals(t.pts(), F.col("size"), fraction=0.1, seed=7))
