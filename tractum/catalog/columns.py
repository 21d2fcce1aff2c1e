"""P: projections, filters and predicates."""

from pyspark.sql import functions as F

from tractum.catalog.base import query
from tractum.functions import columns as C
from tractum.functions import rules as R
from tractum.operators import joins as J
from tractum.operators.graph import drop_accounting as account_drops
from tractum.plans.checks import violations



def _n(df, *keys):
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def _members(t):
    """Universe used by membership queries: the annotated (typed) nodes."""
    return t.nod().where("cell_type <> ''").select("id")


MEMBERS = "(SELECT id FROM nod WHERE cell_type <> '')"


@query("clean_sentinels", "nod", """
    SELECT CASE WHEN lower(trim(v)) IN ('', 'na', 'nan', 'none', 'null', '<na>', '-') THEN NULL ELSE trim(v) END AS label,
           count(*) AS n
    FROM (SELECT CASE WHEN l_linenumber = 1 THEN ' None ' WHEN l_linenumber = 2 THEN 'NA' WHEN l_linenumber = 3 THEN '-'
                 ELSE concat(' ', l_returnflag, ' ') END AS v FROM lineitem) s GROUP BY 1""")
def clean_sentinels(t):
    ln = F.col("l_linenumber")
    v = F.when(ln == 1, " None ").when(ln == 2, "NA").when(ln == 3, "-").otherwise(F.concat(F.lit(" "), "l_returnflag", F.lit(" ")))
    return _n(t.read("lineitem").select(C.clean(v).alias("label")), "label")


@query("region_align", "pts", """
    SELECT region AS region_literal, CASE WHEN region IS NULL OR trim(region) = '' OR region = 'None' THEN 'UNASGD'
           ELSE region END AS region, count(*) AS n FROM pts GROUP BY 1, 2""")
def region_align(t):
    return _n(t.pts().select(F.col("region").alias("region_literal"), C.align_region("region").alias("region")),
              "region_literal", "region")


@query("require_columns", "edg", "SELECT region, count(*) AS n FROM edg GROUP BY region")
def require_columns(t):
    return _n(J.require_columns(t.edg(), ["pre", "post", "region", "n"], exact=True), "region")


@query("reject_bad_rows", "edg", """
    SELECT 'null_key' AS problem, count(*) FILTER (WHERE pre IS NULL OR post IS NULL) AS n FROM edg
    UNION ALL SELECT 'not_positive', count(*) FILTER (WHERE n <= 0) FROM edg
    UNION ALL SELECT 'self_loop', count(*) FILTER (WHERE pre = post) FROM edg""")
def reject_bad_rows(t):
    return violations(t.edg(), {
        "null_key": F.col("pre").isNull() | F.col("post").isNull(),
        "not_positive": F.col("n") <= 0,
        "self_loop": F.col("pre") == F.col("post"),
    })


@query("fill_and_count_nulls", "v2 v3", """
    SELECT CAST(sum(coalesce(v2.n, 0)) AS BIGINT) AS n_v2, CAST(sum(coalesce(v3.n, 0)) AS BIGINT) AS n_v3,
           count(*) FILTER (WHERE v2.n IS NULL) AS null_v2, count(*) FILTER (WHERE v3.n IS NULL) AS null_v3
    FROM v2 FULL JOIN v3 ON v2.pre = v3.pre AND v2.post = v3.post""")
def fill_and_count_nulls(t):
    d = J.version_delta(t.v2(), t.v3(), ["pre", "post"])
    zero = F.lit(0)
    return d.agg(
        F.sum(F.coalesce("n_a", zero)).alias("n_v2"), F.sum(F.coalesce("n_b", zero)).alias("n_v3"),
        F.count_if(F.col("n_a").isNull()).alias("null_v2"), F.count_if(F.col("n_b").isNull()).alias("null_v3"),
    )


@query("self_loops", "edg", """
    SELECT region, count(*) FILTER (WHERE pre = post) AS n_self, CAST(coalesce(sum(n) FILTER (WHERE pre = post), 0) AS BIGINT)
           AS self_weight, count(*) FILTER (WHERE pre <> post) AS n_other FROM edg GROUP BY region""")
def self_loops(t):
    same = F.expr("pre = post")
    return t.edg().groupBy("region").agg(
        F.count_if(same).alias("n_self"), F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0)).alias("self_weight"),
        F.count_if(~same).alias("n_other"),
    )


@query("threshold_edges", "pairs", "SELECT pre, post, n FROM pairs WHERE n >= 5")
def threshold_edges(t):
    return t.pairs().where("n >= 5")


@query("both_in_set", "pairs nod", f"SELECT * FROM pairs WHERE pre IN {MEMBERS} AND post IN {MEMBERS}")
def both_in_set(t):
    return J.both_in_set(t.pairs(), _members(t))


@query("touches_set", "pairs nod", f"""
    SELECT pre, post, n FROM pairs WHERE pre IN (SELECT id FROM nod WHERE cell_type = '')
    OR post IN (SELECT id FROM nod WHERE cell_type = '')""")
def touches_set(t):
    return J.touches_set(t.pairs(), t.nod().where("cell_type = ''").select("id"))


@query("bipartite_slice", "pairs nod", """
    SELECT pre, post, n FROM pairs WHERE pre IN (SELECT id FROM nod WHERE super_class = 'ASIA')
    AND post IN (SELECT id FROM nod WHERE super_class = 'EUROPE')""")
def bipartite_slice(t):
    nod = t.nod()
    return J.bipartite(t.pairs(), nod.where("super_class = 'ASIA'").select("id"), nod.where("super_class = 'EUROPE'").select("id"))


@query("domain_check", "pts", """
    SELECT 'prob_outside' AS problem, count(*) FILTER (WHERE NOT (prob BETWEEN 0 AND 1)) AS n FROM pts
    UNION ALL SELECT 'score_below_50', count(*) FILTER (WHERE score_a < 50) FROM pts
    UNION ALL SELECT 'not_finite', count(*) FILTER (WHERE isnan(prob) OR isinf(prob)) FROM pts""")
def domain_check(t):
    return violations(t.pts(), {
        "prob_outside": ~C.in_unit_interval("prob"), "score_below_50": F.col("score_a") < 50,
        "not_finite": ~C.is_finite("prob"),
    })


@query("one_hot", "", """
    SELECT l_returnflag AS flag, sum(CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS "F",
           sum(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END) AS "O" FROM lineitem GROUP BY 1""")
def one_hot(t):
    df = t.read("lineitem").select(F.col("l_returnflag").alias("flag"), *C.one_hot("l_linestatus", ["F", "O"]))
    return df.groupBy("flag").agg(F.sum("F").alias("F"), F.sum("O").alias("O"))


@query("clip_nonfinite", "pts", """
    SELECT ln, round(sum(CASE WHEN isfinite(p) THEN least(greatest(p, 0.0), 1.0) ELSE 0.0 END), 6) AS total, count(*) AS n
    FROM (SELECT ln, CASE WHEN ln = 1 THEN CAST('nan' AS DOUBLE) WHEN ln = 2 THEN CAST('inf' AS DOUBLE)
          WHEN ln = 3 THEN CAST('-inf' AS DOUBLE) ELSE prob END AS p FROM pts) s GROUP BY ln""")
def clip_nonfinite(t):
    inf, ln = float("inf"), F.col("ln")
    p = F.when(ln == 1, float("nan")).when(ln == 2, inf).when(ln == 3, -inf).otherwise(F.col("prob"))
    df = t.pts().select("ln", C.clip_probability(p).alias("p"))
    return df.groupBy("ln").agg(F.round(F.sum("p"), 6).alias("total"), F.count("*").alias("n"))


@query("normalize_side", "nod", """
    SELECT raw, CASE lower(trim(raw)) WHEN 'l' THEN 'left' WHEN 'left' THEN 'left' WHEN 'r' THEN 'right' WHEN 'right' THEN 'right'
           WHEN 'm' THEN 'center' WHEN 'center' THEN 'center' END AS side, count(*) AS n
    FROM (SELECT CASE WHEN id % 5 = 0 THEN upper(left(side, 1)) WHEN id % 5 = 1 THEN 'M' WHEN id % 5 = 2 THEN '?' ELSE side END
          AS raw FROM nod) s GROUP BY 1, 2""")
def normalize_side(t):
    k = F.col("id") % 5
    raw = F.when(k == 0, F.upper(F.left("side", F.lit(1)))).when(k == 1, "M").when(k == 2, "?").otherwise(F.col("side"))
    df = t.nod().select(raw.alias("raw"))
    return _n(df.withColumn("side", C.normalize_side("raw")), "raw", "side")


@query("side_relation", "edg nod", """
    SELECT region, CASE WHEN right(region, 2) NOT IN ('_L', '_R') THEN 'unknown'
           WHEN (right(region, 2) = '_L') = (side = 'left') THEN 'same_side' ELSE 'opposite_side' END AS relation,
           count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS weight FROM edg JOIN nod ON edg.pre = nod.id GROUP BY 1, 2""")
def side_relation(t):
    df = t.edg().join(t.nod(), F.col("pre") == F.col("id"))
    return df.groupBy("region", C.side_relation("side", "region").alias("relation")).agg(
        F.count("*").alias("n_rows"), F.sum("n").alias("weight"))


SIDES_SRC = """(SELECT id, super_class, CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN 'left' ELSE 'right' END AS root_side,
                CASE WHEN id % 4 = 0 THEN '' ELSE side END AS soma_side FROM nod)"""


def _sides(t):
    k = F.col("id") % 3
    return t.nod().select(
        "id", "super_class", F.when(k == 0, "").when(k == 1, "left").otherwise("right").alias("root_side"),
        F.when(F.col("id") % 4 == 0, "").otherwise(F.col("side")).alias("soma_side"))


@query("fallback_side", "nod", f"""
    SELECT id, CASE WHEN super_class = 'ASIA' THEN coalesce(nullif(root_side, ''), nullif(soma_side, ''))
                    ELSE coalesce(nullif(soma_side, ''), nullif(root_side, '')) END AS side,
           CASE WHEN super_class = 'ASIA' THEN CASE WHEN root_side <> '' THEN 'root' WHEN soma_side <> '' THEN 'soma' END
                ELSE CASE WHEN soma_side <> '' THEN 'soma' WHEN root_side <> '' THEN 'root' END END AS basis
    FROM {SIDES_SRC} s""")
def fallback_side(t):
    root, soma = ("root", F.col("root_side")), ("soma", F.col("soma_side"))
    chosen = F.when(F.col("super_class") == "ASIA", C.first_text_with_basis([root, soma])).otherwise(
        C.first_text_with_basis([soma, root]))
    return _sides(t).select("id", chosen.alias("c")).select("id", F.col("c.value").alias("side"), F.col("c.basis").alias("basis"))


@query("fallback_label", "", """
    SELECT p_partkey AS id, coalesce(nullif(p_type, 'ECONOMY'), nullif(p_name, 'red widget'), p_brand) AS label,
           CASE WHEN p_type <> 'ECONOMY' THEN 'type' WHEN p_name <> 'red widget' THEN 'name' ELSE 'brand' END AS basis,
           contains(coalesce(nullif(p_type, 'ECONOMY'), nullif(p_name, 'red widget'), p_brand), 'ring') AS ambiguous FROM part""")
def fallback_label(t):
    pick = C.first_text_with_basis([
        ("type", F.nullif(F.col("p_type"), F.lit("ECONOMY"))), ("name", F.nullif(F.col("p_name"), F.lit("red widget"))),
        ("brand", F.col("p_brand"))])
    df = t.read("part").select(F.col("p_partkey").alias("id"), pick.alias("c"))
    return df.select("id", F.col("c.value").alias("label"), F.col("c.basis").alias("basis"),
                     F.contains("c.value", F.lit("ring")).alias("ambiguous"))


@query("display_name", "nod", """
    SELECT id, coalesce(nullif(cell_type, ''), nullif(CASE WHEN id % 2 = 0 THEN super_class ELSE '' END, ''),
           'unnamed ' || id) AS name FROM nod""")
def display_name(t):
    alt = F.when(F.col("id") % 2 == 0, F.col("super_class")).otherwise("")
    return t.nod().select("id", C.first_text("cell_type", alt, F.concat(F.lit("unnamed "), F.col("id").cast("string"))).alias("name"))


@query("match_status", "nod pairs", """
    SELECT CASE WHEN a.cell_type = '' OR b.cell_type = '' THEN 'unknown' WHEN a.cell_type = b.cell_type THEN 'same'
           ELSE 'different' END AS type_status, CASE WHEN a.side = b.side THEN 'same' ELSE 'different' END AS side_status,
           count(*) AS n FROM pairs p JOIN nod a ON p.pre = a.id JOIN nod b ON p.post = b.id GROUP BY 1, 2""")
def match_status(t):
    e = J.enrich_endpoints(J.both_in_set(t.pairs().select("pre", "post"), t.nod().select("id")), t.nod(), ["cell_type", "side"])
    return _n(e.select(C.match_status("pre_cell_type", "post_cell_type").alias("type_status"),
                       C.match_status("pre_side", "post_side").alias("side_status")), "type_status", "side_status")


@query("rule_map", "", """
    SELECT event_type, CASE WHEN event_type LIKE 'c%' THEN 'forward' WHEN event_type LIKE '%e%' THEN 'turn' END AS channel,
           CASE WHEN event_type LIKE 'c%' OR event_type LIKE '%e%' THEN 'mapped' ELSE 'no_rule' END AS status, count(*) AS n
    FROM events GROUP BY 1, 2, 3""")
def rule_map(t):
    rules = [("^c", "forward"), ("e", "turn")]
    df = t.read("events").select("event_type", R.first_rule(F.col("event_type"), rules).alias("channel"))
    return _n(df.withColumn("status", F.when(F.col("channel").isNull(), "no_rule").otherwise("mapped")),
              "event_type", "channel", "status")


@query("prefix_category", "", """
    SELECT CASE WHEN starts_with(p_name, 'small') THEN 'small' WHEN starts_with(p_name, 'large') THEN 'large'
           WHEN starts_with(p_name, 'red') OR starts_with(p_name, 'blue') THEN 'coloured' ELSE 'other' END AS category,
           count(*) AS n FROM part GROUP BY 1""")
def prefix_category(t):
    cat = R.prefix_category(F.col("p_name"), [("small", "small"), ("large", "large"), ("red", "coloured"), ("blue", "coloured")], "other")
    return _n(t.read("part").select(cat.alias("category")), "category")


@query("eligibility_flags", "nod", """
    SELECT id, reason, reason IS NULL AND super_class <> 'AFRICA' AS eligible FROM
      (SELECT id, super_class, CASE WHEN cell_type = '' THEN 'no_type' WHEN super_class = 'ASIA' AND side = 'left'
              THEN 'side_conflict' END AS reason FROM nod) s""")
def eligibility_flags(t):
    reason = C.first_match([
        (F.col("cell_type") == "", F.lit("no_type")),
        ((F.col("super_class") == "ASIA") & (F.col("side") == "left"), F.lit("side_conflict"))])
    df = t.nod().withColumn("reason", reason)
    return df.select("id", "reason", (F.col("reason").isNull() & (F.col("super_class") != "AFRICA")).alias("eligible"))


@query("mapping_status", "claims nod", """
    SELECT CASE WHEN n.id IS NULL THEN 'absent' WHEN n.cell_type = '' THEN 'present_untyped'
           WHEN (c.label = 'O') = (n.side = 'left') THEN 'agrees' ELSE 'conflict' END AS status, count(*) AS n
    FROM (SELECT root_id % 150 AS root_id, label FROM claims) c LEFT JOIN nod n ON c.root_id = n.id GROUP BY 1""")
def mapping_status(t):
    c = t.claims().select((F.col("root_id") % 150).alias("root_id"), "label")
    df = c.join(t.nod(), F.col("root_id") == F.col("id"), "left")
    status = C.first_match([
        (F.col("id").isNull(), F.lit("absent")), (F.col("cell_type") == "", F.lit("present_untyped")),
        ((F.col("label") == "O") == (F.col("side") == "left"), F.lit("agrees"))], F.lit("conflict"))
    return _n(df.select(status.alias("status")), "status")


TIERS_SRC = """(SELECT nod.id, count(*) FILTER (WHERE region = 'None') AS raw_rows, count(*) FILTER (WHERE n = 1) AS seg_rows,
                count(*) FILTER (WHERE n >= 3) AS strong_rows, count(pre) AS all_rows, max(cell_type) AS cell_type
                FROM nod LEFT JOIN edg ON edg.pre = nod.id GROUP BY nod.id)"""


def _tier_rows(t):
    e = t.edg().withColumnRenamed("pre", "id")
    return t.nod().join(e, "id", "left").groupBy("id").agg(
        F.count_if(F.col("region") == "None").alias("raw_rows"), F.count_if(F.col("n") == 1).alias("seg_rows"),
        F.count_if(F.col("n") >= 3).alias("strong_rows"), F.count("post").alias("all_rows"), F.max("cell_type").alias("cell_type"))


@query("evidence_tier", "edg nod", f"""
    SELECT id, CASE WHEN raw_rows > 70 THEN 'A_raw_exception' WHEN seg_rows > 220 THEN 'B_segment_contact'
           WHEN cell_type <> '' THEN 'C_type_only' ELSE 'no_released_support' END AS tier FROM {TIERS_SRC} s""")
def evidence_tier(t):
    tier = R.evidence_tier(F.col("raw_rows") > 70, F.col("seg_rows") > 220, F.col("cell_type") != "")
    return _tier_rows(t).select("id", tier.alias("tier"))


@query("review_band", "edg nod", f"""
    SELECT id, CASE WHEN raw_rows > 72 THEN 'point_exception' WHEN strong_rows > 55 THEN 'strong_export'
           WHEN strong_rows > 50 THEN 'weak_pairs_only' WHEN seg_rows > 230 THEN 'segment_only'
           WHEN all_rows > 0 THEN 'self_contacts_only' ELSE 'no_direct_points' END AS band FROM {TIERS_SRC} s""")
def review_band(t):
    band = R.review_band(F.col("raw_rows") > 72, F.col("strong_rows") > 55, F.col("strong_rows") > 50, F.col("seg_rows") > 230,
                         F.col("all_rows") > 0)
    return _tier_rows(t).select("id", band.alias("band"))


@query("partner_class", "pts nod", f"""
    SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_pre' WHEN b THEN 'only_post' ELSE 'neither' END AS partner_class,
           count(*) AS n FROM (SELECT pre IN {MEMBERS} AS a, post IN {MEMBERS} AS b FROM pts) s GROUP BY 1""")
def partner_class(t):
    return _n(J.partner_class(t.pts().select("pre", "post"), _members(t)), "partner_class")


@query("recentre_coords", "tree", """
    SELECT node_id, (x - cx) / 1000 AS x_um, (y - cy) / 1000 AS y_um, (z - cz) / 1000 AS z_um
    FROM tree, (SELECT (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz FROM tree) c""")
def recentre_coords(t):
    tree = t.tree()
    def centred(a):
        centre = tree.agg((F.min(a) + F.max(a)) / 2).scalar()
        return ((F.col(a) - centre) / 1000).alias(f"{a}_um")
    return tree.select("node_id", *[centred(a) for a in "xyz"])


@query("signed_weight", "pairs", """
    SELECT pre, post, round(0.5 * ln(1 + n) * ((pre % 7) / 7.0::DOUBLE - (post % 5) / 5.0::DOUBLE), 6) AS weight FROM pairs""")
def signed_weight(t):
    w = C.signed_weight("n", (F.col("pre") % 7) / F.lit(7.0), (F.col("post") % 5) / F.lit(5.0), 0.5)
    return t.pairs().select("pre", "post", F.round(w, 6).alias("weight"))


@query("exclusion_accounting", "pts nod", f"""
    SELECT CASE WHEN pre = post THEN 'self_contact' WHEN region = 'None' THEN 'no_region' WHEN size < 10 THEN 'too_small'
           WHEN NOT post IN (SELECT id FROM nod) THEN 'unknown_post' ELSE 'kept' END AS reason, count(*) AS n FROM pts GROUP BY 1""")
def exclusion_accounting(t):
    df = J.mark(t.pts().select("pre", "post", "region", "size"), "post", t.nod().select("id"), "known")
    reason = C.first_match([
        (F.expr("pre = post"), F.lit("self_contact")), (F.col("region") == "None", F.lit("no_region")),
        (F.col("size") < 10, F.lit("too_small")), (~F.col("known"), F.lit("unknown_post"))], F.lit("kept"))
    return _n(df.select(reason.alias("reason")), "reason")


@query("drop_accounting", "edg nod", f"""
    SELECT CASE WHEN NOT pre IN {MEMBERS} THEN 'pre_outside' WHEN NOT post IN {MEMBERS} THEN 'post_outside'
           WHEN n < 2 THEN 'low_weight' ELSE 'kept' END AS reason, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS weight
    FROM edg GROUP BY 1""")
def drop_accounting(t):
    return account_drops(t.edg(), _members(t), min_weight=2)
