"""J: joins (geometry joins J20, J22-J24 are in ``geometry``)."""

from pyspark.sql import functions as F

from tractum.catalog.base import query
from tractum.functions import columns as C
from tractum.operators import aggs as A
from tractum.operators import graph as G
from tractum.operators import joins as J
from tractum.operators import positions as P
from tractum.operators.matching import greedy_match, nearest_control

PAIR, KEY3 = ["pre", "post"], ["pre", "post", "region"]


def delta_sql(a, b, keys):
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    cols = ", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in keys)
    return f"""SELECT {cols}, a.n AS n_a, b.n AS n_b, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta,
        CASE WHEN b.n IS NULL THEN 'only_a' WHEN a.n IS NULL THEN 'only_b' WHEN a.n = b.n THEN 'both_same'
        ELSE 'both_different' END AS cls FROM {a} a FULL JOIN {b} b ON {on}"""


@query("edge_delta_region", "r2 r3", delta_sql("r2", "r3", KEY3))
def edge_delta_region(t):
    return J.version_delta(t.r2(), t.r3(), KEY3)


@query("edge_delta_pair", "v2 v3", delta_sql("v2", "v3", PAIR))
def edge_delta_pair(t):
    return J.version_delta(t.v2(), t.v3(), PAIR)


@query("reconcile_edges", "pts edg", """
    SELECT * FROM (SELECT coalesce(a.pre, b.pre) AS pre, coalesce(a.post, b.post) AS post, coalesce(a.region, b.region) AS region,
        coalesce(a.n, 0) AS n_raw, coalesce(b.n, 0) AS n_pub,
        CASE WHEN b.n IS NULL THEN 'raw_only' WHEN a.n IS NULL THEN 'published_only' ELSE 'different_count' END AS kind
        FROM (SELECT pre, post, region, count(*) AS n FROM pts WHERE size > 1 GROUP BY 1, 2, 3) a FULL JOIN
             (SELECT pre, post, CASE WHEN region = 'None' THEN 'UNASGD' ELSE region END AS region, n FROM edg WHERE n > 1) b
        ON a.pre = b.pre AND a.post = b.post AND a.region = b.region) s WHERE n_raw <> n_pub""")
def reconcile_edges(t):
    raw = t.pts().where("size > 1").groupBy(*KEY3).agg(F.count("*").alias("n"))
    published = t.edg().where("n > 1").withColumn("region", C.align_region("region"))
    return J.reconcile(raw, published, KEY3)


@query("anti_membership", "v2 v3 nod", """
    SELECT 'v2' AS version, 'pre' AS direction, count(*) AS n_rows FROM v2 WHERE pre NOT IN (SELECT id FROM nod WHERE cell_type <> '')
    UNION ALL SELECT 'v2', 'post', count(*) FROM v2 WHERE post NOT IN (SELECT id FROM nod WHERE cell_type <> '')
    UNION ALL SELECT 'v3', 'pre', count(*) FROM v3 WHERE pre NOT IN (SELECT id FROM nod WHERE cell_type <> '')
    UNION ALL SELECT 'v3', 'post', count(*) FROM v3 WHERE post NOT IN (SELECT id FROM nod WHERE cell_type <> '')""")
def anti_membership(t):
    ids, out = t.nod().where("cell_type <> ''").select("id"), None
    for version in ("v2", "v3"):
        for end in ("pre", "post"):
            one = J.not_in_set(getattr(t, version)(), end, ids).agg(
                F.lit(version).alias("version"), F.lit(end).alias("direction"), F.count("*").alias("n_rows"))
            out = one if out is None else out.union(one)
    return out


@query("enrich_endpoints", "pairs nod", """
    SELECT p.pre, p.post, p.n, coalesce(a.cell_type, '') AS pre_cell_type, coalesce(a.side, '') AS pre_side,
           coalesce(b.cell_type, '') AS post_cell_type, coalesce(b.side, '') AS post_side
    FROM pairs p LEFT JOIN nod a ON p.pre = a.id LEFT JOIN nod b ON p.post = b.id""")
def enrich_endpoints(t):
    return J.enrich_endpoints(t.pairs(), t.nod(), ["cell_type", "side"])


CONNECTED3 = "(SELECT pre FROM v3 UNION SELECT post FROM v3)"


@query("both_connected", "v2 v3", """
    SELECT a.pre, a.post, a.n FROM v3 a JOIN (SELECT pre AS id FROM v2 UNION SELECT post FROM v2) x ON a.pre = x.id
    JOIN (SELECT pre AS id FROM v2 UNION SELECT post FROM v2) y ON a.post = y.id
    WHERE NOT EXISTS (SELECT 1 FROM v2 WHERE v2.pre = a.pre AND v2.post = a.post)""")
def both_connected(t):
    v2 = t.v2()
    new = t.v3().join(v2.select(*PAIR), PAIR, "left_anti")
    return J.both_in_set(new, G.connected_nodes(v2)).select("pre", "post", "n")


@query("touch_isolate", "pairs nod", """
    SELECT p.pre, p.post, p.n FROM pairs p LEFT JOIN (SELECT DISTINCT post AS id FROM pairs) a ON p.pre = a.id
    LEFT JOIN (SELECT DISTINCT post AS id FROM pairs) b ON p.post = b.id WHERE a.id IS NULL OR b.id IS NULL""")
def touch_isolate(t):
    reached = t.pairs().select("post").distinct()
    marked = J.mark(J.mark(t.pairs(), "pre", reached, "a"), "post", reached, "b")
    return marked.where("NOT a OR NOT b").select("pre", "post", "n")


@query("in_subquery_or", "pairs nod", """
    SELECT pre, post, n FROM pairs WHERE pre IN (SELECT id FROM nod WHERE side = 'left' AND super_class = 'ASIA')
    OR post IN (SELECT id FROM nod WHERE side = 'left' AND super_class = 'ASIA')""")
def in_subquery_or(t):
    return J.touches_set(t.pairs(), t.nod().where("side = 'left' AND super_class = 'ASIA'").select("id"))


@query("class_crosswalk", "r2 r3 v2 v3", f"""
    SELECT p.cls AS pair_class, r.cls AS region_class, count(*) AS n_rows, CAST(sum(r.delta) AS BIGINT) AS delta
    FROM ({delta_sql("r2", "r3", KEY3)}) r JOIN ({delta_sql("v2", "v3", PAIR)}) p ON r.pre = p.pre AND r.post = p.post GROUP BY 1, 2""")
def class_crosswalk(t):
    r = J.version_delta(t.r2(), t.r3(), KEY3).select(*PAIR, F.col("cls").alias("region_class"), "delta")
    p = J.version_delta(t.v2(), t.v3(), PAIR).select(*PAIR, F.col("cls").alias("pair_class"))
    return r.join(p, PAIR).groupBy("pair_class", "region_class").agg(F.count("*").alias("n_rows"), F.sum("delta").alias("delta"))


UNION_SQL = """(SELECT coalesce(a.pre, b.pre) AS pre, coalesce(a.post, b.post) AS post, a.n AS n2, b.n AS n3
                FROM v2 a FULL JOIN v3 b ON a.pre = b.pre AND a.post = b.post)"""


def version_edges(t):
    return t.v2().withColumnRenamed("n", "n2").join(t.v3().withColumnRenamed("n", "n3"), PAIR, "full")


@query("version_union", "v2 v3", f"SELECT * FROM {UNION_SQL} s")
def version_union(t):
    return version_edges(t)


@query("join_checked", "pairs nod", """
    SELECT cell_type, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS weight FROM pairs JOIN nod ON pre = id GROUP BY 1""")
def join_checked(t):
    df = J.join_checked(t.pairs(), t.nod().withColumnRenamed("id", "pre"), ["pre"], "inner", "many_to_one")
    return df.groupBy("cell_type").agg(F.count("*").alias("n_rows"), F.sum("n").alias("weight"))


XW = """(SELECT DISTINCT old_id, id AS new_id, method FROM (
          SELECT old_a AS old_id, id, 'old_a' AS method FROM xwalk UNION ALL SELECT old_b, id, 'old_b' FROM xwalk
          UNION ALL SELECT old_c, id, 'old_c' FROM xwalk) u WHERE old_id IS NOT NULL)"""
# Each order asks for an id by up to three old ids, some of which exist.
REQ = """(SELECT o_orderkey AS request_id, CASE o_orderkey % 4 WHEN 0 THEN o_custkey + 5000000 WHEN 1 THEN o_custkey + 6000000
          WHEN 2 THEN o_custkey + 7000000 ELSE o_custkey + 5000700 END AS old_id FROM orders
          UNION SELECT o_orderkey, o_custkey % 900 + 6000000 FROM orders)"""
CAND = f"""(SELECT request_id, method, CASE method WHEN 'old_a' THEN 1 WHEN 'old_c' THEN 2 ELSE 3 END AS priority,
            min(new_id) AS new_id, min(new_id) = max(new_id) AS is_unique FROM {REQ} q JOIN {XW} x USING (old_id) GROUP BY 1, 2, 3)"""
METHODS = ["old_a", "old_c", "old_b"]


def _crosswalk(t):
    return J.unpivot_ids(t.xwalk(), "id", ["old_a", "old_b", "old_c"])


def _requests(t):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    one = F.when(k == 0, c + 5000000).when(k == 1, c + 6000000).when(k == 2, c + 7000000).otherwise(c + 5000700)
    both = F.explode(F.array(one, c % 900 + 6000000))
    return t.read("orders").select(F.col("o_orderkey").alias("request_id"), both.alias("old_id")).distinct()


@query("crosswalk_unpivot", "xwalk", f"SELECT * FROM {XW} x")
def crosswalk_unpivot(t):
    return _crosswalk(t)


@query("resolve_ids", "xwalk", f"""
    SELECT q.request_id, b.new_id, coalesce(b.method, 'unresolved') AS method, coalesce(b.conflict, false) AS conflict
    FROM (SELECT DISTINCT request_id FROM {REQ} r) q LEFT JOIN (SELECT request_id, arg_min(new_id, priority) AS new_id,
      arg_min(method, priority) AS method, min(new_id) <> max(new_id) AS conflict FROM {CAND} c WHERE is_unique GROUP BY 1) b
    ON q.request_id = b.request_id""")
def resolve_ids(t):
    return J.resolve_ids(_requests(t), _crosswalk(t), METHODS)


@query("resolution_coverage", "xwalk", f"""
    SELECT method, count(*) AS n_requests, count(*) FILTER (WHERE is_unique) AS n_unique, count(*) FILTER (WHERE NOT is_unique)
           AS n_ambiguous, count(DISTINCT new_id) AS n_ids FROM {CAND} c GROUP BY 1""")
def resolution_coverage(t):
    return J.resolution_candidates(_requests(t), _crosswalk(t), METHODS).groupBy("method").agg(
        F.count("*").alias("n_requests"), F.count_if("is_unique").alias("n_unique"),
        F.count_if(~F.col("is_unique")).alias("n_ambiguous"), F.count_distinct("new_id").alias("n_ids"))


@query("crossmatch_targets", "claims", """
    SELECT claim_id, root_id, source_id, label FROM claims WHERE root_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def crossmatch_targets(t):
    return J.in_set(t.claims(), "root_id", t.read("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")).select("claim_id", "root_id", "source_id", "label")


COORDS = [f"{end}_{axis}" for end in ("pre", "post") for axis in "xyz"]


@query("exact_site_matches", "pts", """
    SELECT pre, post, CAST(sum(least(na, nb)) AS BIGINT) AS exact_sites FROM
      (SELECT pre, post, pre_x, pre_y, pre_z, post_x, post_y, post_z, count(*) AS na FROM pts WHERE ln <= 4 GROUP BY ALL) a JOIN
      (SELECT pre, post, pre_x, pre_y, pre_z, post_x, post_y, post_z, count(*) AS nb FROM pts WHERE ln >= 3 GROUP BY ALL) b
      USING (pre, post, pre_x, pre_y, pre_z, post_x, post_y, post_z) GROUP BY 1, 2""")
def exact_site_matches(t):
    return J.exact_site_matches(t.pts().where("ln <= 4"), t.pts().where("ln >= 3"), PAIR, COORDS)


INDEX_SQL = """idx AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM nod),
    e AS (SELECT pre, post, n, a.i + CASE WHEN (pre * 31 + post) % 97 = 0 THEN 1 ELSE 0 END AS pre_index,
        CASE WHEN (pre + post * 17) % 89 = 0 THEN -1 ELSE b.i END AS post_index, CASE WHEN pre % 3 = 0 THEN -1 ELSE 1 END AS sign,
        CASE WHEN pre % 3 = 0 THEN -n ELSE n END + CASE WHEN (pre * 7 + post) % 83 = 0 THEN 1 ELSE 0 END AS signed
      FROM pairs JOIN idx a ON a.id = pre JOIN idx b ON b.id = post)"""


@query("index_id_consistency", "pairs nod", "WITH " + INDEX_SQL + """
    SELECT count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS weight,
      count(*) FILTER (WHERE pre_index < 0 OR pre_index >= k) AS pre_out_of_range, count(*) FILTER (WHERE post_index < 0 OR post_index >= k) AS post_out_of_range,
      count(*) FILTER (WHERE pre_index BETWEEN 0 AND k - 1 AND x.id <> pre) AS pre_mismatches, count(*) FILTER (WHERE post_index BETWEEN 0 AND k - 1 AND y.id <> post) AS post_mismatches,
      count(*) FILTER (WHERE sign * n <> signed) AS sign_mismatches, count(*) FILTER (WHERE sign > 0) AS n_positive, count(*) FILTER (WHERE sign < 0) AS n_negative
    FROM e LEFT JOIN idx x ON x.i = pre_index LEFT JOIN idx y ON y.i = post_index, (SELECT count(*) AS k FROM nod) c""")
def index_id_consistency(t):
    """``ids[index] = id`` on both ends and sign times weight, over edges into which faults of every kind are put by rule."""
    places = P.positions(t.nod())
    e = P.indexed(t.pairs().join(t.nod().select(F.col("id").alias("pre")), "pre", "left_semi").join(t.nod().select(F.col("id").alias("post")), "post", "left_semi"), places)
    pre, post, n = F.col("pre"), F.col("post"), F.col("n")
    sign = F.when(pre % 3 == 0, -1).otherwise(1)
    rows = e.select("pre", "post", "n", (F.col("pre_index") + F.when((pre * 31 + post) % 97 == 0, 1).otherwise(0)).alias("pre_index"),
                    F.when((pre + post * 17) % 89 == 0, F.lit(-1).cast("long")).otherwise(F.col("post_index")).alias("post_index"), sign.alias("sign"),
                    (sign * n + F.when((pre * 7 + post) % 83 == 0, 1).otherwise(0)).alias("signed"))
    return P.check_positions(rows, places)


@query("graph_equality", "pairs edg", """
    SELECT count(*) AS n_pairs, count(*) FILTER (WHERE a.n IS NULL OR b.n IS NULL) AS one_sided,
           count(*) FILTER (WHERE a.n <> b.n) AS unequal
    FROM pairs a FULL JOIN (SELECT pre, post, sum(n) AS n FROM edg GROUP BY 1, 2) b ON a.pre = b.pre AND a.post = b.post""")
def graph_equality(t):
    d = J.version_delta(t.pairs(), t.edg().groupBy(*PAIR).agg(F.sum("n").alias("n")), PAIR)
    return d.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("cls").startswith("only")).alias("one_sided"),
                 F.count_if(F.col("cls") == "both_different").alias("unequal"))


@query("type_pair_recurrence", "v2 v3 nod", """
    WITH e AS (SELECT v.pre, v.post, v.n, a.cell_type AS pt, b.cell_type AS qt FROM v3 v JOIN nod a ON v.pre = a.id
               JOIN nod b ON v.post = b.id),
         s AS (SELECT a.cell_type AS pt, b.cell_type AS qt, count(*) AS support, sum(n) AS w FROM v2 v JOIN nod a ON v.pre = a.id
               JOIN nod b ON v.post = b.id WHERE n >= 6 AND a.cell_type <> '' AND b.cell_type <> '' GROUP BY 1, 2)
    SELECT e.pre, e.post, e.n, coalesce(s.support, 0) AS support, CASE WHEN e.pt = '' OR e.qt = '' THEN 'type_unknown'
           WHEN s.support IS NULL THEN 'type_pair_new' ELSE 'type_pair_recurs' END AS status
    FROM e LEFT JOIN s ON e.pt = s.pt AND e.qt = s.qt""")
def type_pair_recurrence(t):
    nod = t.nod()
    known = J.both_in_set(t.v3(), nod.select("id"))
    e = J.enrich_endpoints(known, nod, ["cell_type"])
    ref = J.enrich_endpoints(J.both_in_set(t.v2().where("n >= 6"), nod.select("id")), nod, ["cell_type"])
    support = ref.where("pre_cell_type <> '' AND post_cell_type <> ''").groupBy("pre_cell_type", "post_cell_type").agg(
        F.count("*").alias("_s"))
    status = C.first_match([
        (F.expr("pre_cell_type = '' OR post_cell_type = ''"), F.lit("type_unknown")),
        (F.col("_s").isNull(), F.lit("type_pair_new"))], F.lit("type_pair_recurs"))
    return e.join(support, ["pre_cell_type", "post_cell_type"], "left").select(
        "pre", "post", "n", F.coalesce("_s", F.lit(0)).alias("support"), status.alias("status"))


@query("claims_attach", "claims", """
    SELECT source_id, count(*) AS n_claims, count(*) FILTER (WHERE c_custkey IS NOT NULL) AS n_matched,
           count(*) FILTER (WHERE c_custkey IS NULL) AS n_unmatched, count(DISTINCT root_id) AS n_ids
    FROM claims LEFT JOIN customer ON root_id = c_custkey GROUP BY 1""")
def claims_attach(t):
    attached = J.attach_claims(t.claims(), t.read("customer").select("c_custkey"))
    return attached.groupBy("source_id").agg(
        F.count("*").alias("n_claims"), F.count_if("exact_match").alias("n_matched"),
        F.count_if(~F.col("exact_match")).alias("n_unmatched"), F.count_distinct("root_id").alias("n_ids"))


@query("profile_join", "", """
    SELECT c_custkey AS id, p.total, p.forced, p.total - p.forced AS non_forced FROM customer JOIN
      (SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS forced FROM orders GROUP BY 1) p
    ON c_custkey = o_custkey""")
def profile_join(t):
    profile = t.read("orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("forced"))
    ids = t.read("customer").select(F.col("c_custkey").alias("id"))
    return J.join_checked(ids, profile, ["id"], "inner", "one_to_one").withColumn("non_forced", F.col("total") - F.col("forced"))


@query("cross_source_summary", "nod pairs claims smp", """
    SELECT id, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in, coalesce(c.n, 0) AS n_claims, coalesce(s.n, 0) AS n_samples,
           CASE WHEN coalesce(c.n, 0) > 0 AND coalesce(o.n, 0) > 0 AND coalesce(s.n, 0) > 0 THEN 1
                WHEN coalesce(c.n, 0) > 0 AND coalesce(o.n, 0) > 0 THEN 2 WHEN coalesce(o.n, 0) > 0 THEN 3 ELSE 4 END AS priority
    FROM nod LEFT JOIN (SELECT pre, count(*) AS n FROM pairs GROUP BY 1) o ON id = o.pre
    LEFT JOIN (SELECT post, count(*) AS n FROM pairs GROUP BY 1) i ON id = i.post
    LEFT JOIN (SELECT root_id, count(*) AS n FROM claims GROUP BY 1) c ON id = c.root_id - 100
    LEFT JOIN (SELECT id AS sid, count(*) AS n FROM smp WHERE spike = 1 GROUP BY 1) s ON id = s.sid""")
def cross_source_summary(t):
    sources = {
        "n_out": t.pairs().groupBy(F.col("pre").alias("id")).agg(F.count("*").alias("n_out")),
        "n_in": t.pairs().groupBy(F.col("post").alias("id")).agg(F.count("*").alias("n_in")),
        "n_claims": t.claims().groupBy((F.col("root_id") - 100).alias("id")).agg(F.count("*").alias("n_claims")),
        "n_samples": t.smp().where("spike = 1").groupBy("id").agg(F.count("*").alias("n_samples")),
    }
    df = t.nod().select("id")
    for source in sources.values():
        df = df.join(source, "id", "left")
    df = df.fillna(0, list(sources))
    priority = C.first_match([
        (F.expr("n_claims > 0 AND n_out > 0 AND n_samples > 0"), F.lit(1)),
        (F.expr("n_claims > 0 AND n_out > 0"), F.lit(2)), (F.expr("n_out > 0"), F.lit(3))], F.lit(4))
    return df.withColumn("priority", priority)


@query("side_audit", "nod", """
    SELECT a_b, b_c, (a_b = 'different' AND b_c = 'same') AS first_opposes_both, count(*) AS n FROM
      (SELECT CASE WHEN a = b THEN 'same' ELSE 'different' END AS a_b, CASE WHEN c IS NULL THEN 'unknown' WHEN b = c THEN 'same'
       ELSE 'different' END AS b_c FROM (SELECT n.side AS a, CASE WHEN s_nationkey % 2 = 0 THEN 'left' ELSE 'right' END AS b,
       CASE WHEN s_acctbal < 0 THEN NULL WHEN s_acctbal < 5000 THEN 'left' ELSE 'right' END AS c
       FROM nod n JOIN supplier ON n.id = s_suppkey) s) q GROUP BY 1, 2, 3""")
def side_audit(t):
    other = t.read("supplier").select(
        F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") % 2 == 0, "left").otherwise("right").alias("b"),
        F.when(F.col("s_acctbal") < 0, None).when(F.col("s_acctbal") < 5000, "left").otherwise("right").alias("c"))
    df = t.nod().join(other, "id").select(C.match_status("side", "b").alias("a_b"), C.match_status("b", "c").alias("b_c"))
    return df.withColumn("first_opposes_both", F.expr("a_b = 'different' AND b_c = 'same'")).groupBy(
        "a_b", "b_c", "first_opposes_both").agg(F.count("*").alias("n"))


@query("peer_cohort", "nod pairs", """
    WITH b AS (SELECT id, cell_type, side, coalesce(max(n), 0) AS best FROM nod LEFT JOIN pairs ON pre = id WHERE cell_type <> '' GROUP BY 1, 2, 3)
    SELECT CAST(th AS INTEGER) AS min_n, id, cell_type, side FROM b, (VALUES (1), (2), (5), (10), (15)) l(th) WHERE best >= th
      AND EXISTS (SELECT 1 FROM b o WHERE o.cell_type = b.cell_type AND o.side = b.side AND o.best < th)""")
def peer_cohort(t):
    """Nodes with outputs whose type and side also has a node without, at each limit; the limit 1 takes every pair."""
    best = t.pairs().groupBy(F.col("pre").alias("id")).agg(F.max("n").alias("best"))
    limits = F.array(*[F.lit(x) for x in (1, 2, 5, 10, 15)])
    nod = t.nod().where("cell_type <> ''").join(best, "id", "left").select(
        "id", "cell_type", "side", F.coalesce("best", F.lit(0)).alias("best"), F.explode(limits).alias("min_n"))
    cohort = ["min_n", "cell_type", "side"]
    lonely = nod.where("best < min_n").select(*cohort).distinct()
    return nod.where("best >= min_n").join(lonely, cohort, "left_semi").select("min_n", "id", "cell_type", "side")


PROJECT_SQL = """(SELECT a.cell_type, a.side, b.cell_type AS partner_type, sum(n) AS w FROM pairs JOIN nod a ON pre = a.id
    JOIN nod b ON post = b.id WHERE a.cell_type <> '' AND b.cell_type <> '' GROUP BY 1, 2, 3)"""


def _cohort_flow(t):
    nod = t.nod().where("cell_type <> ''")
    e = J.enrich_endpoints(J.both_in_set(t.pairs(), nod.select("id")), nod, ["cell_type", "side"])
    return e.groupBy(F.col("pre_cell_type").alias("cell_type"), F.col("pre_side").alias("side"),
                     F.col("post_cell_type").alias("partner_type")).agg(F.sum("n").alias("w"))


@query("project_cohort", "pairs nod", f"""
    SELECT nod.id, cell_type, side, partner_type, w AS weight, r AS rank FROM nod JOIN (SELECT *, CAST(row_number() OVER
      (PARTITION BY cell_type, side ORDER BY w DESC, partner_type) AS INTEGER) AS r FROM
      (SELECT cell_type, side, partner_type, CAST(w AS BIGINT) AS w FROM {PROJECT_SQL} f)) g
    USING (cell_type, side) WHERE r <= 5""")
def project_cohort(t):
    members = t.nod().where("cell_type <> ''").select("id", "cell_type", "side")
    out = J.project_cohort(_cohort_flow(t), members, ["cell_type", "side"], [F.desc("w"), F.asc("partner_type")], 5)
    return out.withColumnRenamed("w", "weight")


@query("map_coverage", "nod", """
    SELECT c_mktsegment AS segment, CASE WHEN n.id IS NULL THEN 'unmapped' WHEN n.side = CASE WHEN c_custkey % 4 < 2 THEN 'left'
           ELSE 'right' END THEN 'mapped_same_side' ELSE 'mapped_no_same_side' END AS status, count(*) AS n_rows
    FROM customer LEFT JOIN nod n ON c_custkey = n.id GROUP BY 1, 2""")
def map_coverage(t):
    side = F.when(F.col("c_custkey") % 4 < 2, "left").otherwise("right")
    df = t.read("customer").join(t.nod(), F.col("c_custkey") == F.col("id"), "left")
    status = C.first_match([(F.col("id").isNull(), F.lit("unmapped")), (F.col("side") == side, F.lit("mapped_same_side"))],
                           F.lit("mapped_no_same_side"))
    return df.groupBy(F.col("c_mktsegment").alias("segment"), status.alias("status")).agg(F.count("*").alias("n_rows"))


# Nodes of suppliers with a small balance play the stimulated sources.
DEG_SQL = """(SELECT id, super_class, side, id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000) AS is_source, (SELECT count(*) FROM pairs WHERE pre = id) AS od,
              (SELECT count(*) FROM pairs WHERE post = id) AS idg FROM nod)"""


def _matching_nodes(t):
    d = A.degrees(t.pairs(), t.nod().select("id"))
    role = t.read("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") < 2000).alias("is_source"))
    return t.nod().select("id", "super_class", "side").join(d.select("id", "in_degree", "out_degree"), "id").join(role, "id")


@query("matched_control", "nod pairs", f"""
    SELECT id AS source, arg_min(cid, (score, cid)) AS control FROM (SELECT s.id, c.id AS cid,
       round(abs(ln(1 + s.idg) - ln(1 + c.idg)) + abs(ln(1 + s.od) - ln(1 + c.od)), 9) AS score
     FROM {DEG_SQL} s LEFT JOIN {DEG_SQL} c ON s.super_class = c.super_class AND NOT c.is_source WHERE s.is_source) q GROUP BY 1""")
def matched_control(t):
    nodes = _matching_nodes(t)
    return nearest_control(nodes.where("is_source"), nodes.where("NOT is_source"), ["super_class"]).select("source", "control")


@query("matched_control_no_reuse", "nod pairs", f"""
    WITH RECURSIVE d AS (SELECT * FROM {DEG_SQL} x), c AS (SELECT *, min(id) OVER (PARTITION BY super_class, side, idg, od) AS cid FROM d WHERE NOT is_source),
      s AS (SELECT *, row_number() OVER (PARTITION BY super_class, side ORDER BY id) AS k FROM d WHERE is_source),
      g AS (SELECT DISTINCT super_class, side, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS source, CAST(NULL AS BIGINT) AS control, CAST([] AS BIGINT[]) AS used FROM s
        UNION ALL SELECT g.super_class, g.side, g.k + 1, s.id, arg_min(c.id, (round(abs(ln(1 + s.idg) - ln(1 + c.idg)) + abs(ln(1 + s.od) - ln(1 + c.od)), 9), c.cid, c.id)),
          list_append(g.used, arg_min(c.id, (round(abs(ln(1 + s.idg) - ln(1 + c.idg)) + abs(ln(1 + s.od) - ln(1 + c.od)), 9), c.cid, c.id)))
        FROM g JOIN s ON s.super_class = g.super_class AND s.side = g.side AND s.k = g.k + 1
        LEFT JOIN c ON c.super_class = g.super_class AND c.side = g.side AND NOT list_contains(g.used, c.id) GROUP BY g.super_class, g.side, g.k, s.id, g.used)
    SELECT super_class, side, source, control FROM g WHERE source IS NOT NULL""")
def matched_control_no_reuse(t):
    nodes = _matching_nodes(t)
    return greedy_match(nodes.where("is_source"), nodes.where("NOT is_source"), ["super_class", "side"])


@query("filtered_consistency", "edg pairs", """
    WITH x AS (SELECT pre, post, region, n + CASE WHEN (pre + post) % 41 = 0 THEN 1 ELSE 0 END AS n FROM edg WHERE (pre, post) IN (SELECT pre, post FROM pairs WHERE n >= 5)
        AND (pre * 3 + post) % 37 <> 0 UNION ALL SELECT pre, post, 'nowhere', n FROM pairs WHERE n >= 5 AND (pre + post * 5) % 43 = 0),
      strong AS (SELECT pre, post FROM pairs WHERE n >= 5)
    SELECT (SELECT count(*) FROM strong WHERE (pre, post) IN (SELECT pre, post FROM x)) AS n_filtered_pairs, count(*) AS n_filtered_rows,
      count(*) FILTER (WHERE e.n IS NULL) AS n_not_in_full, count(*) FILTER (WHERE e.n <> x.n) AS n_wrong_count,
      (SELECT count(*) FROM strong WHERE (pre, post) NOT IN (SELECT pre, post FROM x)) AS n_pairs_missing
    FROM x LEFT JOIN edg e USING (pre, post, region)""")
def filtered_consistency(t):
    """An export of the pairs with total >= 5 must be a subset of the full
    table with equal counts, and hold exactly those pairs.  Pairs left out, rows
    that exist nowhere and wrong counts are put into the export by rule."""
    full, pre, post = t.edg(), F.col("pre"), F.col("post")
    strong = t.pairs().where("n >= 5")
    export = full.join(strong.select(*PAIR), PAIR, "left_semi").where((pre * 3 + post) % 37 != 0)
    export = export.withColumn("n", F.col("n") + F.when((pre + post) % 41 == 0, 1).otherwise(0)).unionByName(
        strong.where((pre + post * 5) % 43 == 0).select(*PAIR, F.lit("nowhere").alias("region"), "n"))
    cmp = export.withColumnRenamed("n", "n_x").join(full, KEY3, "left").agg(
        F.count("*").alias("n_filtered_rows"), F.count_if(F.col("n").isNull()).alias("n_not_in_full"),
        F.count_if(F.col("n") != F.col("n_x")).alias("n_wrong_count"))
    totals = full.groupBy(*PAIR).agg(F.sum("n").alias("n")).where("n >= 5")
    pairs = totals.join(export.select(*PAIR).distinct().withColumn("here", F.lit(True)), PAIR, "left").agg(
        F.count("here").alias("n_filtered_pairs"), F.count_if(F.col("here").isNull()).alias("n_pairs_missing"))
    return cmp.select("*", pairs.select("n_filtered_pairs").scalar().alias("n_filtered_pairs"),
                      pairs.select("n_pairs_missing").scalar().alias("n_pairs_missing"))


@query("key_union_compare", "r2 r3", """
    SELECT coalesce(a.pre, b.pre) AS pre, coalesce(a.post, b.post) AS post, coalesce(a.region, b.region) AS region,
           coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, a.n IS NOT NULL AND b.n IS NOT NULL AS in_both
    FROM r2 a FULL JOIN r3 b ON a.pre = b.pre AND a.post = b.post AND a.region = b.region""")
def key_union_compare(t):
    return J.key_union(t.r2(), t.r3(), KEY3)


@query("absence_check", "v2 v3", """
    SELECT count(*) AS n_keys, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM v2 WHERE v2.pre = v3.pre AND v2.post = v3.post))
           AS n_present FROM v3 WHERE n = 1""")
def absence_check(t):
    weak = t.v3().where("n = 1").select(*PAIR)
    present = weak.join(t.v2().select(*PAIR, F.lit(True).alias("here")), PAIR, "left")
    return present.agg(F.count("*").alias("n_keys"), F.count("here").alias("n_present"))


@query("endpoint_explode", "edg nod", """
    SELECT * FROM (SELECT pre AS id, post AS partner, 'pre' AS role, region, n FROM edg
      UNION ALL SELECT post, pre, 'post', region, n FROM edg) e WHERE id IN (SELECT id FROM nod WHERE super_class = 'ASIA')""")
def endpoint_explode(t):
    return J.explode_endpoints(t.edg(), t.nod().where("super_class = 'ASIA'").select("id"))
