"""Q1-Q12: composite audits, reconciliations and review queues."""

from pyspark.sql import functions as F

from tractum.catalog.base import query
from tractum.catalog.joins import KEY3, PAIR, delta_sql
from tractum.functions import columns as C
from tractum.operators import joins as J
from tractum.operators.tasks import grouped
from tractum.plans import audits, reconcile, reviews
from tractum.plans.checks import ledger, require_passed

TYPED = "(SELECT id FROM nod WHERE cell_type <> '')"


def _typed(t):
    return t.nod().where("cell_type <> ''").select("id")


@query("table_audit", "pts nod", f"""
    WITH c AS (SELECT *, pre IN {TYPED} AS a, post IN {TYPED} AS b FROM pts)
    SELECT 'total' AS metric, 'rows' AS label, count(*) AS value FROM pts
    UNION ALL SELECT 'total', 'size', CAST(sum(size) AS BIGINT) FROM pts
    UNION ALL SELECT 'total', 'prob_outside', count(*) FILTER (WHERE NOT prob BETWEEN 0 AND 1) FROM pts
    UNION ALL SELECT 'total', 'self', count(*) FILTER (WHERE pre = post) FROM pts
    UNION ALL SELECT 'region', region, count(*) FROM pts GROUP BY 2
    UNION ALL SELECT 'membership', CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_pre' WHEN b THEN 'only_post' ELSE 'neither' END, count(*) FROM c GROUP BY 2
    UNION ALL SELECT 'distinct', 'n_pre', count(DISTINCT pre) FROM pts UNION ALL SELECT 'distinct', 'n_post', count(DISTINCT post) FROM pts
    UNION ALL SELECT 'distinct', 'n_any', count(*) FROM (SELECT pre FROM pts UNION SELECT post FROM pts) u
    UNION ALL SELECT 'distinct', 'n_in_universe', count(*) FROM (SELECT pre AS id FROM pts UNION SELECT post FROM pts) u WHERE id IN {TYPED}
    UNION ALL (SELECT 'top_pre', CAST(pre AS VARCHAR), count(*) AS k FROM pts GROUP BY pre ORDER BY k DESC, pre LIMIT 10)
    UNION ALL (SELECT 'top_post', CAST(post AS VARCHAR), count(*) AS k FROM pts GROUP BY post ORDER BY k DESC, post LIMIT 10)""")
def table_audit(t):
    return audits.table_audit(t.pts(), _typed(t))


ALIGNED = "CASE WHEN region IS NULL OR trim(region) = '' OR region = 'None' THEN 'UNASGD' ELSE region END"


@query("explain_residual", "pts", f"""
    SELECT * FROM (SELECT coalesce(a.pre, b.pre) AS pre, coalesce(a.post, b.post) AS post, coalesce(a.region, b.region) AS region, coalesce(a.n, 0) AS n_raw,
      coalesce(b.n, 0) AS n_pub, CASE WHEN b.n IS NULL THEN 'raw_only' WHEN a.n IS NULL THEN 'published_only' ELSE 'different_count' END AS kind
      FROM (SELECT pre, post, {ALIGNED} AS region, count(*) AS n FROM pts GROUP BY 1, 2, 3) a FULL JOIN
           (SELECT pre, post, {ALIGNED} AS region, count(*) AS n FROM pts WHERE size > 2 GROUP BY 1, 2, 3) b
      ON a.pre = b.pre AND a.post = b.post AND a.region = b.region) s WHERE n_raw <> n_pub""")
def explain_residual(t):
    """The published side lacks the smallest contacts and writes the missing
    region differently; only the former remains after alignment."""
    published = reconcile.region_rows(t.pts().where("size > 2").withColumn("region", C.align_region("region")))
    return reconcile.explain_residual(reconcile.region_rows(t.pts()), published)


PUBLISHED = f"(SELECT pre, post, {ALIGNED} AS region, count(*) AS n FROM pts WHERE size >= 5 AND pre <> post GROUP BY 1, 2, 3)"


@query("filter_rule_search", "pts", f"""
    WITH r AS (SELECT CAST(s AS INTEGER) AS min_size, a AS no_self, b AS no_exception, c AS aligned FROM generate_series(1, 20) g(s), (VALUES (false), (true)) x(a), (VALUES (false), (true)) y(b), (VALUES (false), (true)) z(c)),
      g AS (SELECT min_size, no_self, no_exception, aligned, pre, post, CASE WHEN aligned THEN {ALIGNED} ELSE region END AS region, count(*) AS have FROM pts, r
            WHERE size >= min_size AND NOT (no_self AND pre = post) AND NOT (no_exception AND (pre = 7 OR post = 7)) GROUP BY ALL),
      w AS (SELECT r.*, p.pre, p.post, p.region, p.n AS want FROM {PUBLISHED} p, r)
    SELECT min_size, no_self, no_exception, aligned, CAST(sum(coalesce(have, 0)) AS BIGINT) AS points_kept, CAST(sum(coalesce(want, 0)) AS BIGINT) AS published_sum,
      count(*) FILTER (WHERE coalesce(have, 0) <> coalesce(want, 0)) AS key_mismatches, CAST(sum(abs(coalesce(have, 0) - coalesce(want, 0))) AS BIGINT) AS absolute_difference,
      count(*) FILTER (WHERE want IS NULL) AS point_only_keys, count(*) FILTER (WHERE have IS NULL) AS connection_only_keys
    FROM g FULL JOIN w USING (min_size, no_self, no_exception, aligned, pre, post, region) GROUP BY 1, 2, 3, 4""")
def filter_rule_search(t):
    published = reconcile.region_rows(t.pts().where("size >= 5 AND pre <> post").withColumn("region", C.align_region("region")))
    return reconcile.filter_rule_search(t.pts(), published, 20, exception_id=7)


@query("point_connection_recon", "pts nod", """
    WITH k AS (SELECT pre, post FROM pts WHERE size >= 45 AND pre <> post AND pre <> 7 AND post <> 7),
      e AS (SELECT pre AS id, pre = post AS s, pre = 7 OR post = 7 AS x FROM pts UNION ALL SELECT post, false, pre = 7 OR post = 7 FROM pts WHERE pre <> post)
    SELECT id, count(*) AS n_points, count(*) FILTER (WHERE s) AS n_self, count(*) FILTER (WHERE x) AS n_exception, count(*) FILTER (WHERE NOT s AND NOT x) AS n_kept,
      CASE WHEN id IN (SELECT pre FROM k UNION SELECT post FROM k) THEN 'connected' WHEN id = 7 THEN 'exception' WHEN count(*) = count(*) FILTER (WHERE s) THEN 'self_only' ELSE 'other' END AS class
    FROM e WHERE id IN (SELECT id FROM nod) GROUP BY 1""")
def point_connection_recon(t):
    kept = t.pts().where("size >= 45 AND pre <> post AND pre <> 7 AND post <> 7")
    return reconcile.point_connection_recon(t.pts(), kept, t.nod().select("id"), exception_id=7)


EXPORT = f"""(SELECT pre, post, {ALIGNED} AS region, count(*) + CASE WHEN (pre + post * 3) % 197 = 0 THEN 1 ELSE 0 END AS n FROM pts
              WHERE pre <> post AND pre <> 7 AND post <> 7 AND (pre * 5 + post) % 211 <> 0 GROUP BY 1, 2, 3)"""


@query("point_key_recon", "pts", f"""
    WITH p AS (SELECT pre, post, {ALIGNED} AS region, region IS NULL OR trim(region) = '' AS blank, pre = post AS s, pre = 7 OR post = 7 AS x FROM pts),
      r AS (SELECT pre, post, region, count(*) AS n FROM p WHERE NOT s AND NOT x GROUP BY 1, 2, 3), e AS {EXPORT},
      k AS (SELECT CASE WHEN e.n IS NULL THEN 'point_only' WHEN r.n IS NULL THEN 'connection_only' WHEN r.n <> e.n THEN 'different_count' ELSE 'equal' END AS item FROM r FULL JOIN e USING (pre, post, region)),
      f AS (SELECT count(*) AS a, count(*) FILTER (WHERE s AND NOT x) AS b, count(*) FILTER (WHERE s AND x) AS c, count(*) FILTER (WHERE x AND NOT s) AS d, count(*) FILTER (WHERE NOT s AND NOT x) AS g,
        count(*) FILTER (WHERE blank) AS h, count(*) FILTER (WHERE blank AND NOT s AND NOT x) AS i, (SELECT CAST(sum(n) AS BIGINT) FROM e) AS j,
        (SELECT count(*) FROM (SELECT DISTINCT pre, post, region FROM p WHERE x AND NOT s) q) AS l FROM p)
    SELECT 'points' AS section, unnest(['all', 'self', 'self_exception', 'exception', 'retained', 'blank', 'blank_retained', 'connections', 'exception_keys']) AS item, unnest([a, b, c, d, g, h, i, j, l]) AS value FROM f
    UNION ALL SELECT 'keys', item, count(*) FROM k GROUP BY 2
    UNION ALL SELECT 'check', 'points_add_up', CAST((a = b + c + d + j)::INT AS BIGINT) FROM f UNION ALL SELECT 'check', 'views_agree', CAST(1 AS BIGINT)
    UNION ALL SELECT 'check', 'keys_and_counts_equal', CAST((SELECT count(*) = 0 FROM k WHERE item <> 'equal')::INT AS BIGINT)""")
def point_key_recon(t):
    """The export lacks some keys and miscounts others, by rule; each key comes once per end, as views of selected nodes do."""
    pre, post = F.col("pre"), F.col("post")
    export = t.pts().where("pre <> post AND pre <> 7 AND post <> 7").where((pre * 5 + post) % 211 != 0)
    export = grouped(export.select(*PAIR, C.align_region("region").alias("region")), PAIR, KEY3, [F.count("*").alias("n")], t.size())
    export = export.withColumn("n", F.col("n") + F.when((pre + post * 3) % 197 == 0, 1).otherwise(0))
    return reconcile.key_recon(t.pts(), export.unionByName(export), exception_id=7)


@query("pair_candidates", "pts v2", f"""
    WITH p AS (SELECT pre, post, {ALIGNED} AS region, okey * 10 + ln AS source FROM pts WHERE ln >= 3 AND pre <> post AND pre <> 7 AND post <> 7),
      k AS (SELECT pre, post, region, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, pre, post, region) AS review_rank FROM p GROUP BY 1, 2, 3),
      c AS (SELECT *, (row_number() OVER (PARTITION BY pre, post, region ORDER BY source) - 1) // 4 AS chunk FROM p)
    SELECT k.*, (pre, post) IN (SELECT pre, post FROM p GROUP BY 1, 2 HAVING count(*) >= 5) AS in_export, (pre, post) IN (SELECT pre, post FROM v2) AS in_original, chunk, n_items, points
    FROM k JOIN (SELECT pre, post, region, chunk, count(*) AS n_items, string_agg(source::VARCHAR, ';' ORDER BY source) AS points FROM c GROUP BY 1, 2, 3, 4) l USING (pre, post, region)""")
def pair_candidates(t):
    points = t.pts().where("ln >= 3")
    strong = points.where("pre <> post AND pre <> 7 AND post <> 7").groupBy("pre", "post").agg(F.count("*").alias("n")).where("n >= 5")
    return reconcile.pair_candidates(points, strong, t.v2(), 7, F.col("okey") * 10 + F.col("ln"), chunk=4)


@query("annotation_coverage", "nod pairs", """
    WITH a AS (SELECT id, cell_type, super_class, side FROM nod UNION ALL SELECT id, cell_type, NULL, side FROM nod WHERE id % 10 = 0),
      u AS (SELECT id FROM nod WHERE id % 4 <> 0 UNION SELECT id + 1000000 FROM nod WHERE id % 5 = 0),
      l AS (SELECT 'cell_type' AS metric, CASE WHEN cell_type IS NULL OR trim(cell_type) = '' THEN '(missing)' ELSE cell_type END AS label FROM a
        UNION ALL SELECT 'super_class', CASE WHEN super_class IS NULL OR trim(super_class) = '' THEN '(missing)' ELSE super_class END FROM a UNION ALL SELECT 'side', side FROM a),
      c AS (SELECT metric, label, count(*)::DOUBLE AS value, row_number() OVER (PARTITION BY metric ORDER BY count(*) DESC, label) AS r FROM l GROUP BY 1, 2),
      m AS (SELECT count(*) AS n, count(DISTINCT id) AS k, count(*) FILTER (WHERE id IN (SELECT id FROM u)) AS hit, count(DISTINCT id) FILTER (WHERE id IN (SELECT id FROM u)) AS known, (SELECT count(*) FROM u) AS size FROM a)
    SELECT 'coverage' AS metric, unnest(['rows', 'unique_ids', 'repeated_rows', 'matched_rows', 'matched_share_of_rows', 'annotated_share_of_universe']) AS label,
      unnest([n::DOUBLE, k::DOUBLE, (n - k)::DOUBLE, hit::DOUBLE, hit::DOUBLE / n, known::DOUBLE / size]) AS value FROM m
    UNION ALL SELECT metric, label, value FROM c WHERE r <= 20""")
def annotation_coverage(t):
    """Annotations with repeated rows, some without a class, against a universe that lacks some nodes and has others."""
    nodes, columns = t.nod(), ["id", "cell_type", "super_class", "side"]
    rows = nodes.select(*columns).unionByName(nodes.where("id % 10 = 0").withColumn("super_class", F.lit(None).cast("string")).select(*columns))
    universe = nodes.where("id % 4 <> 0").select("id").union(nodes.where("id % 5 = 0").select(F.col("id") + 1000000))
    return audits.annotation_coverage(rows, columns[1:], universe, top=20)


@query("audit_cross_checks", "pts edg pairs", """
    SELECT 'edges_equal_points' AS name, (SELECT count(*) FROM pts) = (SELECT sum(n) FROM edg) AS passed, (SELECT CAST(sum(n) AS BIGINT) FROM edg) AS n_left, (SELECT count(*) FROM pts) AS n_right, CAST(0 AS BIGINT) AS n_unequal
    UNION ALL SELECT 'regions_equal_points', count(*) = 0, (SELECT CAST(sum(n) AS BIGINT) FROM edg WHERE pre <> post), (SELECT count(*) FROM pts), count(*)
      FROM (SELECT region, count(*) AS n FROM pts GROUP BY 1) a FULL JOIN (SELECT region, sum(n) AS n FROM edg WHERE pre <> post GROUP BY 1) b USING (region) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)
    UNION ALL SELECT 'strong_edges_at_most_points', true, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM pairs WHERE n >= 5), (SELECT count(*) FROM pts), 0
    UNION ALL SELECT 'sample_equals_points', NULL, NULL, NULL, NULL UNION ALL SELECT 'absent_equals_points', NULL, NULL, NULL, NULL""")
def audit_cross_checks(t):
    """Totals and regions of several products; a partial scan and an absent product leave their checks open."""
    def figure(df, product, name, item, complete=True):
        # A total stands also where no row is left: it is zero, not absent.
        value = df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("value")).withColumn("item", F.lit(None).cast("string")) if item is None else df.groupBy(item.alias("item")).agg(F.sum("n").alias("value"))
        return value.select(F.lit(product).alias("product"), F.lit(name).alias("figure"), "item", "value", F.lit(complete).alias("complete"))

    whole, region = None, F.col("region")
    points = t.pts().select("region", F.lit(1).cast("long").alias("n"))
    parts = [figure(points, "points", "rows", whole), figure(points, "points", "regions", region), figure(t.edg(), "edges", "sum", whole),
             figure(t.edg().where("pre <> post"), "edges", "regions", region), figure(t.pairs().where("n >= 5"), "strong", "sum", whole),
             figure(points.sample(0.2, 3), "sample", "rows", whole, complete=False)]
    figures = parts[0]
    for p in parts[1:]:
        figures = figures.unionByName(p)
    rows = ("points", "rows")
    return audits.cross_checks(figures, [
        ("edges_equal_points", "equal", ("edges", "sum"), rows), ("regions_equal_points", "equal", ("edges", "regions"), ("points", "regions")),
        ("strong_edges_at_most_points", "at_most", ("strong", "sum"), rows), ("sample_equals_points", "equal", ("sample", "rows"), rows),
        ("absent_equals_points", "equal", ("absent", "sum"), rows)])


@query("dual_detector_review", "pts nod r2 r3", f"""
    SELECT *, row_number() OVER (ORDER BY CASE evidence_class WHEN 'pair_dual' THEN 0 WHEN 'pair_only_a' THEN 1 WHEN 'pair_only_b' THEN 2 WHEN 'segment_dual' THEN 3
        WHEN 'segment_only_a' THEN 4 ELSE 5 END, least(n_a, n_b) DESC, greatest(n_a, n_b) DESC, pre, post, region) AS review_rank FROM
     (SELECT pre, post, region, n_a, n_b, coalesce(exact_sites, 0) AS exact_sites, CASE WHEN k THEN CASE WHEN n_a > 0 AND n_b > 0 THEN 'pair_dual' WHEN n_a > 0 THEN 'pair_only_a' ELSE 'pair_only_b' END
        WHEN n_a > 0 AND n_b > 0 THEN 'segment_dual' WHEN n_a > 0 THEN 'segment_only_a' ELSE 'segment_only_b' END AS evidence_class FROM
      (SELECT coalesce(a.pre, b.pre) AS pre, coalesce(a.post, b.post) AS post, coalesce(a.region, b.region) AS region, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b,
         coalesce(a.pre, b.pre) IN {TYPED} AND coalesce(a.post, b.post) IN {TYPED} AS k FROM r2 a FULL JOIN r3 b ON a.pre = b.pre AND a.post = b.post AND a.region = b.region) u
      LEFT JOIN (SELECT pre, post, region, CAST(sum(least(na, nb)) AS BIGINT) AS exact_sites FROM (SELECT pre, post, region, pre_x, pre_y, pre_z, post_x, post_y, post_z, count(*) AS na FROM pts WHERE ln <= 4 GROUP BY ALL) x
        JOIN (SELECT pre, post, region, pre_x, pre_y, pre_z, post_x, post_y, post_z, count(*) AS nb FROM pts WHERE ln >= 3 GROUP BY ALL) y USING (pre, post, region, pre_x, pre_y, pre_z, post_x, post_y, post_z) GROUP BY 1, 2, 3) s USING (pre, post, region)) q""")
def dual_detector_review(t):
    return reviews.dual_detector_review(t.pts().where("ln <= 4"), t.pts().where("ln >= 3"), _typed(t), SITE)


SITE = [f"{end}_{axis}" for end in ("pre", "post") for axis in "xyz"]
EVIDENCE = f"""(SELECT pre AS id, region, n, CASE WHEN region = 'None' AND n >= 5 THEN 'raw' ELSE 'segment' END AS evidence FROM edg
               WHERE (region = 'None' AND n >= 5) OR (post NOT IN {TYPED} AND n >= 4))"""


@query("review_queue", "edg nod pairs", f"""
    WITH e AS (SELECT * FROM {EVIDENCE} x), c AS (SELECT id, count(*) FILTER (WHERE evidence = 'raw') AS raw_rows, CAST(coalesce(sum(n) FILTER (WHERE evidence = 'raw'), 0) AS BIGINT) AS raw_points,
        count(*) FILTER (WHERE evidence = 'segment') AS segment_rows, CAST(coalesce(sum(n) FILTER (WHERE evidence = 'segment'), 0) AS BIGINT) AS segment_points,
        count(*) FILTER (WHERE evidence = 'segment' AND n > 1) AS repeated_segment_rows FROM e GROUP BY 1),
      h AS (SELECT pre AS id, count(*) AS hypothesis_rows, max(n) AS best_support FROM pairs GROUP BY 1),
      w AS (SELECT id, region, CAST(sum(n) AS BIGINT) AS w FROM e GROUP BY 1, 2),
      d AS (SELECT id, arg_min(region, (-w, region)) AS dominant_region, string_agg(concat(region, ':', w), ';' ORDER BY w DESC, region) AS regions FROM w GROUP BY 1),
      q AS (SELECT nod.id, coalesce(raw_rows, 0) AS raw_rows, coalesce(raw_points, 0) AS raw_points, coalesce(segment_rows, 0) AS segment_rows, coalesce(segment_points, 0) AS segment_points,
        coalesce(repeated_segment_rows, 0) AS repeated_segment_rows, coalesce(hypothesis_rows, 0) AS hypothesis_rows, coalesce(best_support, 0) AS best_support,
        coalesce(dominant_region, '') AS dominant_region, coalesce(regions, '') AS regions, CASE WHEN raw_rows > 0 THEN 'A_raw_exception' WHEN segment_rows > 0 THEN 'B_segment_contact'
          WHEN hypothesis_rows > 0 THEN 'C_type_only' ELSE 'no_released_support' END AS tier FROM nod LEFT JOIN c USING (id) LEFT JOIN h USING (id) LEFT JOIN d USING (id))
    SELECT *, row_number() OVER (ORDER BY tier, raw_points DESC, segment_points DESC, best_support DESC, id) AS review_rank FROM q""")
def review_queue(t):
    typed = _typed(t)
    rows = J.mark(t.edg(), "post", typed, "_typed")
    raw = F.expr("region = 'None' AND n >= 5")
    rows = rows.where(raw | (~F.col("_typed") & (F.col("n") >= 4))).select(
        F.col("pre").alias("id"), "region", "n", F.when(raw, "raw").otherwise("segment").alias("evidence"))
    hypotheses = t.pairs().select(F.col("pre").alias("id"), F.col("n").alias("support"))
    return reviews.review_queue(t.nod().select("id"), rows, hypotheses)


@query("integrated_queue", "pairs edg nod", f"""
    WITH e AS (SELECT pre AS id, post AS partner, n FROM pairs UNION ALL SELECT post, pre, n FROM pairs WHERE pre <> post),
      c AS (SELECT CAST(th AS INTEGER) AS min_n, id, count(*) FILTER (WHERE id <> partner) AS pairs, count(*) FILTER (WHERE id <> partner AND n >= th) AS strong_pairs,
        count(*) FILTER (WHERE id = partner) AS self_pairs, count(*) FILTER (WHERE n = 1) AS single_pairs, CAST(sum(n) AS BIGINT) AS points,
        CAST(coalesce(sum(n) FILTER (WHERE id = partner), 0) AS BIGINT) AS self_points FROM e, (VALUES (2), (5), (10), (15)) l(th) GROUP BY 1, 2),
      g AS (SELECT pre AS id, CAST(sum(n) AS BIGINT) AS segment_points FROM edg WHERE post NOT IN {TYPED} GROUP BY 1),
      m AS (SELECT CAST(th AS INTEGER) AS min_n, id FROM nod, (VALUES (2), (5), (10), (15)) l(th)),
      q AS (SELECT m.min_n, m.id, coalesce(pairs, 0) AS pairs, coalesce(strong_pairs, 0) AS strong_pairs, coalesce(self_pairs, 0) AS self_pairs, coalesce(single_pairs, 0) AS single_pairs,
        coalesce(points, 0) AS points, coalesce(self_points, 0) AS self_points, coalesce(segment_points, 0) AS segment_points
        FROM m LEFT JOIN c ON c.id = m.id AND c.min_n = m.min_n LEFT JOIN g ON g.id = m.id),
      b AS (SELECT *, CASE WHEN id = 7 THEN 'point_exception' WHEN strong_pairs > 0 THEN 'strong_export' WHEN pairs > 0 THEN 'weak_pairs_only' WHEN segment_points > 0 THEN 'segment_only'
        WHEN points > 0 AND self_points = points THEN 'self_contacts_only' ELSE 'no_direct_points' END AS band FROM q)
    SELECT *, row_number() OVER (PARTITION BY min_n ORDER BY band, strong_pairs DESC, points DESC, id) AS review_rank FROM b""")
def integrated_queue(t):
    """One queue for each count from which a pair is strong; the reference's own is 5."""
    segments = J.mark(t.edg(), "post", _typed(t), "_typed").where("NOT _typed").select(F.col("pre").alias("id"), "n")
    return reviews.integrated_queue(t.nod().select("id"), t.pairs(), segments, (2, 5, 10, 15), exception_id=7)


@query("version_comparison", "v2 v3 r3 nod", f"""
    WITH d AS ({delta_sql("v2", "v3", PAIR)}), k AS (SELECT pre AS id FROM v2 UNION SELECT post FROM v2),
      top AS (SELECT * FROM d WHERE pre IN (SELECT id FROM k) AND post IN (SELECT id FROM k) ORDER BY abs(delta) DESC, pre, post LIMIT 100)
    SELECT top.pre, top.post, n_a, n_b, delta, cls, coalesce(a.cell_type, '') AS pre_cell_type, coalesce(a.super_class, '') AS pre_super_class, coalesce(a.side, '') AS pre_side,
      coalesce(b.cell_type, '') AS post_cell_type, coalesce(b.super_class, '') AS post_super_class, coalesce(b.side, '') AS post_side, coalesce(g.regions, '') AS regions
    FROM top LEFT JOIN nod a ON top.pre = a.id LEFT JOIN nod b ON top.post = b.id
    LEFT JOIN (SELECT pre, post, string_agg(DISTINCT region, ';' ORDER BY region) AS regions FROM r3 GROUP BY 1, 2) g ON g.pre = top.pre AND g.post = top.post""")
def version_comparison(t):
    return audits.most_changed_pairs(t.r2(), t.r3(), t.nod(), 100)


@query("version_audit", "r2 r3 v2 v3", f"""
    WITH r AS ({delta_sql("r2", "r3", ["pre", "post", "region"])}), p AS ({delta_sql("v2", "v3", PAIR)}),
      ka AS (SELECT pre AS id FROM v2 UNION SELECT post FROM v2), kb AS (SELECT pre AS id FROM v3 UNION SELECT post FROM v3),
      k AS (SELECT coalesce(ka.id, kb.id) AS id, ka.id IS NOT NULL AS a, kb.id IS NOT NULL AS b FROM ka FULL JOIN kb ON ka.id = kb.id),
      w AS (SELECT n_b, CASE WHEN pre NOT IN (SELECT id FROM ka) OR post NOT IN (SELECT id FROM ka) THEN 'touches_isolate' WHEN n_b >= 10 THEN '10+' WHEN n_b >= 5 THEN '5-9'
        WHEN n_b >= 2 THEN '2-4' ELSE '1' END AS item FROM p WHERE cls = 'only_b')
    SELECT 'region' AS section, cls AS item, count(*) AS n_keys, CAST(coalesce(sum(n_a), 0) AS BIGINT) AS n_a, CAST(coalesce(sum(n_b), 0) AS BIGINT) AS n_b FROM r GROUP BY 2
    UNION ALL SELECT 'pair', cls, count(*), CAST(coalesce(sum(n_a), 0) AS BIGINT), CAST(coalesce(sum(n_b), 0) AS BIGINT) FROM p GROUP BY 2
    UNION ALL SELECT 'node', CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' ELSE 'only_b' END, count(*), count(*) FILTER (WHERE a), count(*) FILTER (WHERE b) FROM k GROUP BY 2
    UNION ALL SELECT 'new_pair', item, count(*), CAST(0 AS BIGINT), CAST(sum(n_b) AS BIGINT) FROM w GROUP BY 2
    UNION ALL SELECT 'check', 'contacts_a', CAST(((SELECT sum(n) FROM r2) = (SELECT sum(n) FROM v2))::INT AS BIGINT), CAST((SELECT sum(n) FROM r2) AS BIGINT), CAST((SELECT sum(n) FROM v2) AS BIGINT)
    UNION ALL SELECT 'check', 'contacts_b', CAST(((SELECT sum(n) FROM r3) = (SELECT sum(n) FROM v3))::INT AS BIGINT), CAST((SELECT sum(n) FROM r3) AS BIGINT), CAST((SELECT sum(n) FROM v3) AS BIGINT)
    UNION ALL SELECT 'check', 'new_pairs_partition', CAST(((SELECT count(*) FROM p WHERE cls = 'only_b') = (SELECT count(*) FROM w))::INT AS BIGINT), (SELECT count(*) FROM p WHERE cls = 'only_b'), (SELECT count(*) FROM w)""")
def version_audit(t):
    return audits.version_audit(t.r2(), t.r3())


@query("node_catalog", "claims", """
    SELECT c_custkey AS id, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END), ''), l.labels, 'node ' || c_custkey) AS display_name,
      coalesce(l.labels, 'unknown') AS labels, coalesce(s.sources, '') AS sources, coalesce(l.n, 0) AS n_claims
    FROM customer LEFT JOIN (SELECT root_id, string_agg(label, '|' ORDER BY f) AS labels, CAST(sum(n) AS BIGINT) AS n FROM
       (SELECT root_id, label, min(claim_id) AS f, count(*) AS n FROM claims GROUP BY 1, 2) q GROUP BY 1) l ON c_custkey = l.root_id
    LEFT JOIN (SELECT root_id, string_agg(DISTINCT source_id, '|' ORDER BY source_id) AS sources FROM claims GROUP BY 1) s ON c_custkey = s.root_id""")
def node_catalog(t):
    name = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name"))
    return audits.node_catalog(t.read("customer").select(F.col("c_custkey").alias("id"), name.alias("name")), t.claims())


@query("unmatched_claims", "claims", "SELECT claim_id, root_id, source_id, label, score FROM claims WHERE root_id NOT IN (SELECT c_custkey FROM customer)")
def unmatched_claims(t):
    return audits.unmatched_claims(t.claims(), t.read("customer").select("c_custkey"))


def _audit_sql(v):
    ids = f"(SELECT pre AS id FROM {v} UNION SELECT post FROM {v})"
    return f"""SELECT '{v}' AS version, count(*) AS n_pairs, CAST(sum(n) AS BIGINT) AS weight, min(n) AS min_n, max(n) AS max_n, count(*) FILTER (WHERE pre = post) AS n_self,
      count(DISTINCT pre) AS n_pre, count(DISTINCT post) AS n_post, (SELECT count(*) FROM {ids} i) AS n_any, (SELECT count(*) FROM {ids} i WHERE id IN (SELECT id FROM nod)) AS n_in_universe,
      (SELECT count(*) FROM {ids} i WHERE id NOT IN (SELECT id FROM nod)) AS n_missing FROM {v}"""


@query("edgelist_audit", "v2 v3 nod", _audit_sql("v2") + " UNION ALL " + _audit_sql("v3"))
def edgelist_audit(t):
    ids = t.nod().select("id")
    return audits.edgelist_audit(t.v2(), "v2", ids).unionByName(audits.edgelist_audit(t.v3(), "v3", ids))


@query("check_ledger", "v2 v3 r2", f"""
    WITH d AS ({delta_sql("v2", "v3", PAIR)})
    SELECT name, expected = actual AS passed, expected, actual FROM (
      SELECT 'weight_a_conserved' AS name, (SELECT CAST(sum(n) AS BIGINT) FROM v2) AS expected, (SELECT CAST(sum(n_a) AS BIGINT) FROM d) AS actual
      UNION ALL SELECT 'weight_b_conserved', (SELECT CAST(sum(n) AS BIGINT) FROM v3), (SELECT CAST(sum(n_b) AS BIGINT) FROM d)
      UNION ALL SELECT 'pairs_a_conserved', (SELECT count(*) FROM v2), (SELECT count(n_a) FROM d)
      UNION ALL SELECT 'delta_is_difference', (SELECT CAST(sum(n) AS BIGINT) FROM v3) - (SELECT CAST(sum(n) AS BIGINT) FROM v2), (SELECT CAST(sum(delta) AS BIGINT) FROM d)
      UNION ALL SELECT 'regions_sum_to_pairs', (SELECT CAST(sum(n) AS BIGINT) FROM v2), (SELECT CAST(sum(n) AS BIGINT) FROM r2)) c""")
def check_ledger(t):
    d = J.version_delta(t.v2(), t.v3(), PAIR).agg(
        F.sum("n_a").alias("da"), F.sum("n_b").alias("db"), F.count("n_a").alias("pa"), F.sum("delta").alias("dd"))
    metrics = d.select(
        "*", t.v2().agg(F.sum("n")).scalar().alias("wa"), t.v3().agg(F.sum("n")).scalar().alias("wb"),
        t.v2().agg(F.count("*")).scalar().alias("na"), t.r2().agg(F.sum("n")).scalar().alias("ra"))
    c = F.col
    return require_passed(ledger(metrics, {
        "weight_a_conserved": (c("wa"), c("da")), "weight_b_conserved": (c("wb"), c("db")), "pairs_a_conserved": (c("na"), c("pa")),
        "delta_is_difference": (c("wb") - c("wa"), c("dd")), "regions_sum_to_pairs": (c("wa"), c("ra"))}))
