"""A: aggregations (skeleton aggregates A33-A37 are in ``geometry``)."""

from pyspark.sql import functions as F

from tractum.catalog.base import query
from tractum.catalog.joins import KEY3, PAIR, delta_sql, version_edges
from tractum.functions import columns as C
from tractum.operators import aggs as A
from tractum.operators import joins as J
from tractum.operators import sketches as K
from tractum.operators.keys import join_null_safe
from tractum.operators.ordered import order_statistics, top_k
from tractum.operators.tasks import grouped
from tractum.session import stage

PAIR_DELTA = delta_sql("v2", "v3", PAIR)
REGION_DELTA = delta_sql("r2", "r3", KEY3)


def pair_delta(t):
    return J.version_delta(t.v2(), t.v3(), PAIR)


def region_delta(t):
    return J.version_delta(t.r2(), t.r3(), KEY3)


@query("pair_region_agg", "pts", """
    SELECT pre, post, region, CAST(sum(size) AS BIGINT) AS n, count(*) AS source_rows FROM pts GROUP BY 1, 2, 3""")
def pair_region_agg(t):
    return t.pts().groupBy(*KEY3).agg(F.sum("size").alias("n"), F.count("*").alias("source_rows"))


@query("pair_agg", "edg", """
    SELECT pre, post, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_regions FROM edg GROUP BY 1, 2""")
def pair_agg(t):
    return t.edg().groupBy(*PAIR).agg(F.sum("n").alias("n"), F.count("*").alias("n_regions"))


@query("weighted_channels", "pts", """
    SELECT * FROM (SELECT pre, post, CAST(sum(size) AS BIGINT) AS n, CAST(sum(CAST(prob AS DECIMAL(12, 9)) * size) AS DOUBLE) / sum(size) AS p,
      CAST(sum(CAST(1 - prob AS DECIMAL(12, 9)) * size) AS DOUBLE) / sum(size) AS q FROM pts GROUP BY 1, 2) s WHERE n >= 100""")
def weighted_channels(t):
    df = t.pts().select("pre", "post", F.col("size").alias("n"), F.col("prob").alias("p"), (1 - F.col("prob")).alias("q"))
    return A.weighted_channels(df, PAIR, ["p", "q"], "n", 100)


@query("value_counts", "pts", "SELECT region, count(*) AS n FROM pts GROUP BY 1")
def value_counts(t):
    return A.value_counts(t.pts(), "region")


@query("weighted_counts", "pts", "SELECT region, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS weight FROM pts GROUP BY 1")
def weighted_counts(t):
    return A.weighted_counts(t.pts(), ["region"], "size")


def _stats_sql(domains, table):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) FILTER (WHERE {c} IS NULL) AS nulls, round(sum(CAST({c} AS DOUBLE)), 4)
        AS sum, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 6) AS mean,
        count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS outside FROM {table}""" for c, (lo, hi) in domains.items())


DOMAINS = {"prob": (0.0, 0.9), "score_a": (5.0, 45.0), "size": (1.0, 50.0)}


@query("column_stats", "pts", _stats_sql(DOMAINS, "pts"))
def column_stats(t):
    out = A.column_stats(t.pts(), DOMAINS)
    return out.withColumn("sum", F.round("sum", 4)).withColumn("mean", F.round("mean", 6))


@query("quality_profile", "mat", """
    SELECT 'vec_id' AS "column", count(vec_id) AS n_values, CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS non_finite,
           count(*) FILTER (WHERE vec_id < 0) AS negative, CAST(min(vec_id) AS DOUBLE) AS min, CAST(max(vec_id) AS DOUBLE) AS max FROM embeddings
    UNION ALL SELECT 'embedding', count(score), CAST(0 AS BIGINT), CAST(0 AS BIGINT), count(*) FILTER (WHERE score < 0), min(score), max(score) FROM mat
    UNION ALL SELECT 'label', count(label), CAST(0 AS BIGINT), CAST(0 AS BIGINT), count(*) FILTER (WHERE label < 0), CAST(min(label) AS DOUBLE),
           CAST(max(label) AS DOUBLE) FROM embeddings""")
def quality_profile(t):
    return A.quality_profile(t.read("embeddings"))


@query("distinct_sketch", "pts", """
    SELECT 'pre' AS role, count(DISTINCT pre) AS n_exact, true AS within_bound, true AS parts_equal_whole FROM pts
    UNION ALL SELECT 'post', count(DISTINCT post), true, true FROM pts
    UNION ALL SELECT 'any', count(*), true, true FROM (SELECT pre FROM pts UNION SELECT post FROM pts) u""")
def distinct_sketch(t):
    """Sketches stored per region and brought up to date from a second load,
    against the sketch of all rows at once and the exact count."""
    ends, points = ["pre", "post"], t.pts().select("pre", "post", "region", "ln")
    first = stage(K.part_sketches(points.where("ln <= 3"), ["region"], ends))
    second = stage(K.part_sketches(points.where("ln > 3"), ["region"], ends))
    stored = stage(K.merged(first.unionByName(second), ends, ["region"]))

    def counted(sketches, suffix):
        return K.estimates(K.across(sketches, ends, "any"), [*ends, "any"]).unpivot([], [*ends, "any"], "role", suffix)

    parts = counted(K.merged(stored, ends), "n_parts")
    whole = counted(K.merged(K.part_sketches(points, [], ends), ends), "n_whole")
    ids = points.select(F.explode(F.array(*[F.struct(F.lit(e).alias("role"), F.col(e).alias("id")) for e in ends])).alias("e")).select("e.*").distinct()
    ids = ids.unionByName(ids.select(F.lit("any").alias("role"), "id").distinct())
    exact = ids.groupBy("role").agg(F.count("*").alias("n_exact"))
    return exact.join(parts, "role").join(whole, "role").select(
        "role", "n_exact", (F.abs(F.col("n_parts") - F.col("n_exact")) <= K.BOUND * F.col("n_exact")).alias("within_bound"),
        (F.col("n_parts") == F.col("n_whole")).alias("parts_equal_whole"))


@query("distinct_endpoints", "pairs nod", """
    SELECT count(DISTINCT pre) AS n_pre, count(DISTINCT post) AS n_post,
      (SELECT count(*) FROM (SELECT pre FROM pairs UNION SELECT post FROM pairs) u) AS n_any,
      (SELECT count(*) FROM (SELECT pre AS id FROM pairs UNION SELECT post FROM pairs) u WHERE id IN (SELECT id FROM nod)) AS n_in_universe
    FROM pairs""")
def distinct_endpoints(t):
    return A.distinct_endpoints(t.pts(), t.nod().select("id"))


@query("membership_confusion", "pts nod", """
    SELECT region, count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a AND NOT b) AS n_only_pre,
      count(*) FILTER (WHERE b AND NOT a) AS n_only_post, count(*) FILTER (WHERE NOT a AND NOT b) AS n_neither, count(*) AS n_rows
    FROM (SELECT region, pre IN (SELECT id FROM nod WHERE side = 'left') AS a, post IN (SELECT id FROM nod WHERE side = 'left') AS b
          FROM pts) s GROUP BY 1""")
def membership_confusion(t):
    df = J.partner_class(t.pts().select("pre", "post", "region"), t.nod().where("side = 'left'").select("id"))
    counts = [F.count_if(F.col("partner_class") == c).alias(f"n_{c}") for c in ("both", "only_pre", "only_post", "neither")]
    return df.groupBy("region").agg(*counts, F.count("*").alias("n_rows"))


LIMITS = [5, 10, 15, 20]


@query("threshold_counts", "v2 v3", f"""
    SELECT cls, count(*) AS n_rows, {", ".join(f"count(*) FILTER (WHERE n >= {x}) AS ge_{x}" for x in LIMITS)}, max(n) AS largest
    FROM (SELECT cls, greatest(coalesce(n_a, 0), coalesce(n_b, 0)) AS n FROM ({PAIR_DELTA}) d) s GROUP BY 1""")
def threshold_counts(t):
    zero = F.lit(0)
    df = pair_delta(t).withColumn("n", F.greatest(F.coalesce("n_a", zero), F.coalesce("n_b", zero)))
    return A.threshold_counts(df, ["cls"], "n", LIMITS)


@query("strength_buckets", "pairs", """
    SELECT CASE WHEN n >= 20 THEN '20+' WHEN n >= 10 THEN '10-19' WHEN n >= 5 THEN '5-9' WHEN n >= 2 THEN '2-4' ELSE '1' END AS bucket,
           count(*) AS n_pairs, CAST(sum(n) AS BIGINT) AS weight FROM pairs GROUP BY 1""")
def strength_buckets(t):
    return t.pairs().groupBy(C.bucket("n", [1, 2, 5, 10, 20]).alias("bucket")).agg(
        F.count("*").alias("n_pairs"), F.sum("n").alias("weight"))


@query("flow_matrix", "pairs nod", """
    SELECT coalesce(nullif(a.super_class, ''), '[unannotated]') AS pre_class, coalesce(nullif(b.super_class, ''), '[unannotated]') AS post_class,
           count(*) AS n_pairs, CAST(sum(n) AS BIGINT) AS weight FROM pairs LEFT JOIN nod a ON pre = a.id LEFT JOIN nod b ON post = b.id GROUP BY 1, 2""")
def flow_matrix(t):
    e = J.enrich_endpoints(t.pairs(), t.nod(), ["super_class"])
    def label(c):
        return C.first_match([(F.col(c) == "", F.lit("[unannotated]"))], F.col(c))
    return e.groupBy(label("pre_super_class").alias("pre_class"), label("post_super_class").alias("post_class")).agg(
        F.count("*").alias("n_pairs"), F.sum("n").alias("weight"))


@query("region_change", "r2 r3", f"""
    SELECT cls, region, count(*) AS n_rows, CAST(coalesce(sum(n_a), 0) AS BIGINT) AS weight_a, CAST(coalesce(sum(n_b), 0) AS BIGINT) AS weight_b,
           CAST(sum(delta) AS BIGINT) AS delta FROM ({REGION_DELTA}) d GROUP BY 1, 2""")
def region_change(t):
    zero = F.lit(0)
    return region_delta(t).groupBy("cls", "region").agg(
        F.count("*").alias("n_rows"), F.coalesce(F.sum("n_a"), zero).alias("weight_a"),
        F.coalesce(F.sum("n_b"), zero).alias("weight_b"), F.sum("delta").alias("delta"))


@query("delta_direction", "v2 v3", f"""
    SELECT CASE WHEN delta > 0 THEN 'higher' WHEN delta < 0 THEN 'lower' ELSE 'same' END AS direction, count(*) AS n_pairs,
           CAST(sum(delta) AS BIGINT) AS delta FROM ({PAIR_DELTA}) d WHERE cls IN ('both_same', 'both_different') GROUP BY 1""")
def delta_direction(t):
    direction = F.when(F.col("delta") > 0, "higher").when(F.col("delta") < 0, "lower").otherwise("same")
    shared = pair_delta(t).where(F.col("cls").startswith("both"))
    return shared.groupBy(direction.alias("direction")).agg(F.count("*").alias("n_pairs"), F.sum("delta").alias("delta"))


@query("delta_totals", "v2 v3", f"""
    SELECT cls, count(*) AS n_rows, CAST(coalesce(sum(n_a), 0) AS BIGINT) AS weight_a, CAST(coalesce(sum(n_b), 0) AS BIGINT) AS weight_b
    FROM ({PAIR_DELTA}) d GROUP BY 1""")
def delta_totals(t):
    return pair_delta(t).groupBy("cls").agg(
        F.count("*").alias("n_rows"), F.coalesce(F.sum("n_a"), F.lit(0)).alias("weight_a"),
        F.coalesce(F.sum("n_b"), F.lit(0)).alias("weight_b"))


@query("label_inventory", "r2 r3", """
    SELECT 'a' AS source, region, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS weight FROM r2 GROUP BY 2
    UNION ALL SELECT 'b', region, count(*), CAST(sum(n) AS BIGINT) FROM r3 GROUP BY 2""")
def label_inventory(t):
    return A.weighted_counts(t.r2(), ["region"]).withColumn("source", F.lit("a")).unionByName(
        A.weighted_counts(t.r3(), ["region"]).withColumn("source", F.lit("b")))


_AXES = [f"{end}_{axis}" for end in ("pre", "post") for axis in "xyz"]
_MEANS = ", ".join(f"CAST(sum(CAST({c} AS DECIMAL(18, 4))) AS DOUBLE) / count({c}) AS {name}" for c, name in [
    ("score_a", "score_mean"), ("prob", "prob_mean"), *[(a, f"{a[:-1]}c{a[-1]}") for a in _AXES]])


@query("evidence_rollup", "pts", f"""
    SELECT p.pre, p.post, p.region, c.chunk, p.n_points, c.n_items, c.rows_text, p.score_min, p.score_mean, p.score_max, p.prob_min, p.prob_mean, p.prob_max,
      p.pre_cx, p.pre_cy, p.pre_cz, p.post_cx, p.post_cy, p.post_cz
    FROM (SELECT pre, post, region, count(*) AS n_points, min(score_a) AS score_min, max(score_a) AS score_max, min(prob) AS prob_min, max(prob) AS prob_max,
          {_MEANS} FROM pts GROUP BY 1, 2, 3) p JOIN
      (SELECT pre, post, region, (rn - 1) // 8 AS chunk, count(*) AS n_items, string_agg(CAST(okey AS VARCHAR), ';' ORDER BY rn) AS rows_text
       FROM (SELECT pre, post, region, okey, row_number() OVER (PARTITION BY pre, post, region ORDER BY okey, ln, pre_y) AS rn FROM pts) r GROUP BY 1, 2, 3, 4) c
    ON p.pre IS NOT DISTINCT FROM c.pre AND p.post IS NOT DISTINCT FROM c.post AND p.region IS NOT DISTINCT FROM c.region""")
def evidence_rollup(t):
    """Groups, scores and centroids as in the reference: pair and region, both scores, six axes; unknown ends are keys too."""
    pts = t.pts()
    figures = [F.count("*").alias("n_points")]
    for c, name in (("score_a", "score"), ("prob", "prob")):
        figures += [F.min(c).alias(f"{name}_min"), A.exact_mean(c).alias(f"{name}_mean"), F.max(c).alias(f"{name}_max")]
    figures += [A.exact_mean(a).alias(f"{a[:-1]}c{a[-1]}") for a in _AXES]
    stats = grouped(pts.select(*KEY3, "score_a", "prob", *_AXES), PAIR, KEY3, figures, t.size())
    ids = A.chunked_list(pts.select(*KEY3, "okey", "ln", "pre_y"), KEY3, ["okey", "ln", "pre_y"], F.col("okey"), "rows_text", chunk=8)
    return join_null_safe(stats, ids, KEY3)


@query("string_agg_distinct", "edg", """
    SELECT pre, string_agg(DISTINCT region, ';' ORDER BY region) AS regions FROM edg GROUP BY 1""")
def string_agg_distinct(t):
    return A.distinct_text(t.edg(), ["pre"], "region", "regions")


@query("string_agg_limit", "edg", """
    SELECT pre, CASE WHEN len(l) <= 3 THEN array_to_string(l, ';') ELSE array_to_string(l[1:3], ';') || '...(' || len(l) || ' total)' END AS regions
    FROM (SELECT pre, list(DISTINCT region ORDER BY region) AS l FROM edg GROUP BY 1) s""")
def string_agg_limit(t):
    labels = t.edg().select("pre", "region").distinct()
    return labels.groupBy("pre").agg(C.join_limited(F.array_sort(F.collect_list("region")), 3).alias("regions"))


@query("label_histogram_text", "edg", """
    SELECT pre, string_agg(region || ':' || w, ';' ORDER BY w DESC, region) AS histogram FROM
      (SELECT pre, region, CAST(sum(n) AS BIGINT) AS w FROM edg GROUP BY 1, 2) s GROUP BY 1""")
def label_histogram_text(t):
    return A.histogram_text(t.edg(), ["pre"], "region", "histogram", F.col("n"))


@query("dominant_category", "edg", """
    SELECT pre, region AS dominant, w AS n FROM (SELECT pre, region, w, row_number() OVER (PARTITION BY pre ORDER BY w DESC, region) AS r
      FROM (SELECT pre, region, CAST(sum(n) AS BIGINT) AS w FROM edg GROUP BY 1, 2) q) s WHERE r = 1""")
def dominant_category(t):
    return A.dominant(t.edg(), ["pre"], "region", F.col("n"))


@query("node_coverage", "pts nod edg", """
    SELECT id, coalesce(a.n, 0) AS pre_points, coalesce(b.n, 0) AS post_points, coalesce(c.n, 0) AS pre_published,
           coalesce(d.n, 0) AS post_published, coalesce(a.n, 0) - coalesce(c.n, 0) AS pre_missing, coalesce(b.n, 0) - coalesce(d.n, 0) AS post_missing
    FROM nod LEFT JOIN (SELECT pre, count(*) AS n FROM pts GROUP BY 1) a ON id = a.pre
    LEFT JOIN (SELECT post, count(*) AS n FROM pts GROUP BY 1) b ON id = b.post
    LEFT JOIN (SELECT pre, CAST(sum(n) AS BIGINT) AS n FROM edg WHERE n > 1 GROUP BY 1) c ON id = c.pre
    LEFT JOIN (SELECT post, CAST(sum(n) AS BIGINT) AS n FROM edg WHERE n > 1 GROUP BY 1) d ON id = d.post""")
def node_coverage(t):
    pts, published = t.pts(), t.edg().where("n > 1")
    df = t.nod().select("id")
    names = []
    for label, source, weight in (("points", pts, F.count("*")), ("published", published, F.sum("n"))):
        for end in ("pre", "post"):
            df = df.join(source.groupBy(F.col(end).alias("id")).agg(weight.alias(f"{end}_{label}")), "id", "left")
            names.append(f"{end}_{label}")
    df = df.fillna(0, names)
    return df.select("id", *names, (F.col("pre_points") - F.col("pre_published")).alias("pre_missing"),
                     (F.col("post_points") - F.col("post_published")).alias("post_missing"))


@query("cross_checks", "pts edg r2", """
    SELECT coalesce(a.region, b.region) AS region, coalesce(a.n, 0) AS n_points, coalesce(b.n, 0) AS n_edges,
           coalesce(c.n, 0) AS n_partial, coalesce(a.n, 0) = coalesce(b.n, 0) AS edges_agree, coalesce(a.n, 0) = coalesce(c.n, 0) AS partial_agrees
    FROM (SELECT region, count(*) AS n FROM pts GROUP BY 1) a FULL JOIN (SELECT region, CAST(sum(n) AS BIGINT) AS n FROM edg GROUP BY 1) b
    ON a.region = b.region LEFT JOIN (SELECT region, CAST(sum(n) AS BIGINT) AS n FROM r2 GROUP BY 1) c ON c.region = a.region""")
def cross_checks(t):
    a = t.pts().groupBy("region").agg(F.count("*").alias("n_points"))
    b = t.edg().groupBy("region").agg(F.sum("n").alias("n_edges"))
    c = t.r2().groupBy("region").agg(F.sum("n").alias("n_partial"))
    df = a.join(b, "region", "full").join(c, "region", "left").fillna(0, ["n_points", "n_edges", "n_partial"])
    return df.withColumn("edges_agree", F.expr("n_points = n_edges")).withColumn("partial_agrees", F.expr("n_points = n_partial"))


@query("degrees", "pairs nod", """
    SELECT id, coalesce(o.d, 0) AS out_degree, coalesce(o.w, 0) AS out_weight, coalesce(i.d, 0) AS in_degree, coalesce(i.w, 0) AS in_weight
    FROM nod LEFT JOIN (SELECT pre, count(*) AS d, CAST(sum(n) AS BIGINT) AS w FROM pairs GROUP BY 1) o ON id = o.pre
    LEFT JOIN (SELECT post, count(*) AS d, CAST(sum(n) AS BIGINT) AS w FROM pairs GROUP BY 1) i ON id = i.post""")
def degrees(t):
    return A.degrees(t.pairs(), t.nod().select("id"))


@query("input_sum", "pairs nod", """
    SELECT post AS id, CAST(sum(n) AS BIGINT) AS input FROM pairs WHERE pre <> post AND post IN (SELECT id FROM nod WHERE side = 'left') GROUP BY 1""")
def input_sum(t):
    e = J.in_set(t.pairs().where("pre <> post"), "post", t.nod().where("side = 'left'").select("id"))
    return e.groupBy(F.col("post").alias("id")).agg(F.sum("n").alias("input"))


MASKS = {"all": "true", "inside": "a AND b", "touching": "a OR b", "inside_strong": "a AND b AND n >= 5"}


@query("subgraph_profile", "pairs nod", " UNION ALL ".join(f"""
    SELECT '{m}' AS mask, count(*) AS n_rows, CAST(coalesce(sum(n), 0) AS BIGINT) AS weight, count(DISTINCT pre) AS n_pre, count(DISTINCT post) AS n_post
    FROM (SELECT pre, post, n, pre IN (SELECT id FROM nod WHERE super_class = 'ASIA') AS a, post IN (SELECT id FROM nod WHERE super_class = 'ASIA') AS b
          FROM pairs) s WHERE {c}""" for m, c in MASKS.items()))
def subgraph_profile(t):
    ids = t.nod().where("super_class = 'ASIA'").select("id")
    marked = J.mark(J.mark(t.pairs(), "pre", ids, "a"), "post", ids, "b")
    masks = F.array_compact(F.array(*[F.when(F.expr(c), m) for m, c in MASKS.items()]))
    held = marked.select(F.explode(masks).alias("mask"), "pre", "post", "n").groupBy("mask").agg(
        F.count("*").alias("n_rows"), F.sum("n").alias("weight"), F.count_distinct("pre").alias("n_pre"),
        F.count_distinct("post").alias("n_post"))
    # A mask that holds no edge keeps its row.
    named = t.spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in MASKS])).alias("mask"))
    return named.join(held, "mask", "left").fillna(0, ["n_rows", "weight", "n_pre", "n_post"])


def _typed_edges(t):
    nod = t.nod()
    return J.enrich_endpoints(J.both_in_set(t.pairs(), nod.select("id")), nod, ["cell_type", "side"])


TYPED = """(SELECT pre, post, n, a.cell_type AS pre_type, a.side AS pre_side, b.cell_type AS post_type, b.side AS post_side
            FROM pairs JOIN nod a ON pre = a.id JOIN nod b ON post = b.id)"""


@query("partner_type_rollup", "pairs nod", f"""
    SELECT pre_type AS pre_cell_type, pre_side, post_type AS post_cell_type, CAST(sum(n) AS BIGINT) AS contacts, count(*) AS n_pairs,
           count(DISTINCT pre) AS n_sources, count(DISTINCT post) AS n_partners FROM {TYPED} e GROUP BY 1, 2, 3""")
def partner_type_rollup(t):
    return A.type_rollup(_typed_edges(t), ["pre_cell_type", "pre_side", "post_cell_type"])


@query("prevalence_share", "pairs nod", f"""
    SELECT r.pre_type, r.post_type, r.n_sources, c.size AS cohort, round(r.n_sources / c.size, 6) AS prevalence, r.contacts,
           CAST(sum(r.contacts) OVER (PARTITION BY r.pre_type) AS BIGINT) AS cohort_contacts,
           round(r.contacts / sum(r.contacts) OVER (PARTITION BY r.pre_type), 6) AS share
    FROM (SELECT pre_type, post_type, count(DISTINCT pre) AS n_sources, CAST(sum(n) AS BIGINT) AS contacts FROM {TYPED} e GROUP BY 1, 2) r
    JOIN (SELECT cell_type, count(*) AS size FROM nod GROUP BY 1) c ON r.pre_type = c.cell_type""")
def prevalence_share(t):
    e = _typed_edges(t).groupBy(F.col("pre_cell_type").alias("pre_type"), F.col("post_cell_type").alias("post_type")).agg(
        F.count_distinct("pre").alias("n_sources"), F.sum("n").alias("contacts"))
    cohort = t.nod().groupBy(F.col("cell_type").alias("pre_type")).agg(F.count("*").alias("cohort"))
    df = A.share_of_total(e.join(cohort, "pre_type"), ["pre_type"], "contacts", "cohort_contacts", "share")
    return df.withColumn("share", F.round("share", 6)).withColumn("prevalence", F.round(C.safe_ratio("n_sources", "cohort"), 6))


@query("peer_support", "pairs nod", f"""
    WITH per AS (SELECT pre_type, pre_side, pre, post_type, sum(n) AS w FROM {TYPED} e WHERE pre_type <> '' AND post_type <> '' GROUP BY 1, 2, 3, 4),
      size AS (SELECT pre_type, pre_side, count(DISTINCT pre) AS peers FROM {TYPED} e WHERE pre_type <> '' GROUP BY 1, 2),
      s AS (SELECT pre_type, pre_side, post_type, count(*) AS support, CAST(sum(w) AS BIGINT) AS contacts, peers,
            count(*) / peers AS fraction FROM per JOIN size USING (pre_type, pre_side) GROUP BY pre_type, pre_side, post_type, peers)
    SELECT pre_type AS cell_type, pre_side AS side, post_type AS target_type, support, contacts, peers, round(fraction, 4) AS fraction, rank FROM
      (SELECT *, CAST(row_number() OVER (PARTITION BY pre_type, pre_side ORDER BY fraction DESC, contacts DESC, post_type) AS INTEGER) AS rank
       FROM s WHERE peers >= 2 AND support >= 2 AND fraction >= 0.05) q WHERE rank <= 5""")
def peer_support(t):
    """Per (type, side): partner types by the share of peers that have them."""
    cohort = ["cell_type", "side"]
    e = _typed_edges(t).where("pre_cell_type <> ''").withColumnsRenamed(
        {"pre_cell_type": "cell_type", "pre_side": "side", "post_cell_type": "target_type"})
    peers = e.groupBy(*cohort).agg(F.count_distinct("pre").alias("peers"))
    per_peer = e.where("target_type <> ''").groupBy(*cohort, "pre", "target_type").agg(F.sum("n").alias("w"))
    support = per_peer.groupBy(*cohort, "target_type").agg(F.count("*").alias("support"), F.sum("w").alias("contacts"))
    df = support.join(peers, cohort).withColumn("fraction", C.safe_ratio("support", "peers"))
    gated = df.where("peers >= 2 AND support >= 2 AND fraction >= 0.05")
    top = top_k(gated, cohort, [F.desc("fraction"), F.desc("contacts"), F.asc("target_type")], 5)
    return top.withColumn("fraction", F.round("fraction", 4))


@query("version_jaccard", "v2 v3", """
    SELECT coalesce(a.pre, b.pre) AS pre, count(*) FILTER (WHERE a.n IS NOT NULL AND b.n IS NOT NULL) AS shared,
           count(*) FILTER (WHERE a.n >= 5 AND b.n >= 5) AS shared_strong, count(*) AS union_pairs,
           round(count(*) FILTER (WHERE a.n IS NOT NULL AND b.n IS NOT NULL) / count(*), 6) AS jaccard
    FROM v2 a FULL JOIN v3 b ON a.pre = b.pre AND a.post = b.post GROUP BY 1""")
def version_jaccard(t):
    df = version_edges(t).groupBy("pre").agg(
        F.count_if(F.expr("n2 IS NOT NULL AND n3 IS NOT NULL")).alias("shared"),
        F.count_if(F.expr("n2 >= 5 AND n3 >= 5")).alias("shared_strong"), F.count("*").alias("union_pairs"))
    return df.withColumn("jaccard", F.round(C.safe_ratio("shared", "union_pairs"), 6))


@query("partner_patterns", "v2 v3 nod", """
    WITH e AS (SELECT coalesce(a.pre, b.pre) AS pre, coalesce(a.post, b.post) AS post, a.n AS n2, b.n AS n3
               FROM v2 a FULL JOIN v3 b ON a.pre = b.pre AND a.post = b.post),
      g AS (SELECT x.cell_type, y.super_class AS partner_class, count(DISTINCT pre) FILTER (WHERE n2 IS NOT NULL) AS v2_homologs,
        count(DISTINCT post) FILTER (WHERE n2 IS NOT NULL) AS v2_partners, count(n2) AS v2_rows, CAST(coalesce(sum(n2), 0) AS BIGINT) AS v2_contacts,
        count(DISTINCT pre) FILTER (WHERE n3 IS NOT NULL) AS v3_homologs, count(DISTINCT post) FILTER (WHERE n3 IS NOT NULL) AS v3_partners,
        count(n3) AS v3_rows, CAST(coalesce(sum(n3), 0) AS BIGINT) AS v3_contacts, count(*) FILTER (WHERE n2 IS NOT NULL AND n3 IS NOT NULL) AS shared,
        count(*) FILTER (WHERE n2 >= 7 AND n3 >= 7) AS shared_strong, count(DISTINCT pre) AS homologs,
        count(*) FILTER (WHERE x.side <> y.side) AS side_conflicts, count(*) AS n_all
        FROM e JOIN nod x ON pre = x.id JOIN nod y ON post = y.id WHERE x.cell_type <> '' GROUP BY 1, 2)
    SELECT cell_type, partner_class, v2_homologs, v2_partners, v2_rows, v2_contacts, v3_homologs, v3_partners, v3_rows, v3_contacts, shared,
           shared_strong, round(shared / n_all, 6) AS jaccard, CASE WHEN shared_strong > 0 AND homologs >= 2 AND side_conflicts * 2 < n_all THEN 1
           WHEN shared_strong > 0 AND side_conflicts * 2 < n_all THEN 2 ELSE 3 END AS priority FROM g""")
def partner_patterns(t):
    nod = t.nod()
    e = J.enrich_endpoints(J.both_in_set(version_edges(t), nod.select("id")), nod, ["cell_type", "super_class", "side"])
    g = e.where("pre_cell_type <> ''").groupBy(F.col("pre_cell_type").alias("cell_type"), F.col("post_super_class").alias("partner_class"))
    def version(v):
        has = F.col(f"n{v}").isNotNull()
        return [F.count_distinct(F.when(has, F.col("pre"))).alias(f"v{v}_homologs"),
                F.count_distinct(F.when(has, F.col("post"))).alias(f"v{v}_partners"), F.count(f"n{v}").alias(f"v{v}_rows"),
                F.coalesce(F.sum(f"n{v}"), F.lit(0)).alias(f"v{v}_contacts")]
    df = g.agg(*version(2), *version(3), F.count_if(F.expr("n2 IS NOT NULL AND n3 IS NOT NULL")).alias("shared"),
               F.count_if(F.expr("n2 >= 7 AND n3 >= 7")).alias("shared_strong"), F.count_distinct("pre").alias("_homologs"),
               F.count_if(F.expr("pre_side <> post_side")).alias("_conflicts"), F.count("*").alias("_all"))
    priority = C.first_match([
        (F.expr("shared_strong > 0 AND _homologs >= 2 AND _conflicts * 2 < _all"), F.lit(1)),
        (F.expr("shared_strong > 0 AND _conflicts * 2 < _all"), F.lit(2))], F.lit(3))
    return df.withColumn("jaccard", F.round(C.safe_ratio("shared", "_all"), 6)).withColumn("priority", priority).drop(
        "_homologs", "_conflicts", "_all")


@query("status_tally", "pairs nod", """
    SELECT pre AS id, count(*) FILTER (WHERE s = 'same') AS n_same, count(*) FILTER (WHERE s = 'different') AS n_different,
           count(*) FILTER (WHERE s = 'unknown') AS n_unknown FROM (SELECT pre, CASE WHEN a.cell_type = '' OR b.cell_type = '' THEN 'unknown'
             WHEN a.super_class = b.super_class THEN 'same' ELSE 'different' END AS s FROM pairs JOIN nod a ON pre = a.id JOIN nod b ON post = b.id) q GROUP BY 1""")
def status_tally(t):
    nod = t.nod()
    e = J.enrich_endpoints(J.both_in_set(t.pairs(), nod.select("id")), nod, ["cell_type", "super_class"])
    s = F.when(F.expr("pre_cell_type = '' OR post_cell_type = ''"), "unknown").otherwise(C.match_status("pre_super_class", "post_super_class"))
    return e.select(F.col("pre").alias("id"), s.alias("s")).groupBy("id").agg(
        *[F.count_if(F.col("s") == x).alias(f"n_{x}") for x in ("same", "different", "unknown")])


QUARTERS = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


@query("percentile_summary", "pts", """
    SELECT region, count(pre_y) AS n, min(pre_y) AS min, max(pre_y) AS max, round(quantile_cont(pre_y, 0.25), 6) AS p25,
      round(quantile_cont(pre_y, 0.5), 6) AS median, round(quantile_cont(pre_y, 0.75), 6) AS p75, round(quantile_cont(pre_y, 0.95), 6) AS p95
    FROM pts GROUP BY 1""")
def percentile_summary(t):
    out = order_statistics(t.pts().select("region", "pre_y"), ["region"], "pre_y", QUARTERS)
    return out.select("region", "n", "min", "max", *[F.round(q, 6).alias(q) for q in QUARTERS])


@query("claims_rollup", "claims nod", """
    SELECT c_custkey AS id, coalesce(l.labels, 'unknown') AS labels, coalesce(l.n, 0) AS n_claims FROM customer LEFT JOIN
      (SELECT root_id, string_agg(label, '|' ORDER BY first_seen) AS labels, CAST(sum(n) AS BIGINT) AS n FROM
         (SELECT root_id, label, min(claim_id) AS first_seen, count(*) AS n FROM claims GROUP BY 1, 2) f GROUP BY 1) l ON c_custkey = l.root_id""")
def claims_rollup(t):
    return claim_labels(t.read("customer").select(F.col("c_custkey").alias("id")), t.claims())


def claim_labels(universe, claims):
    """One row per id: distinct labels in first-seen order; the row count of
    the universe is kept."""
    seen = claims.groupBy("root_id", "label").agg(F.min("claim_id").alias("first"), F.count("*").alias("n"))
    listed = seen.groupBy(F.col("root_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("first", "label"))).alias("l"), F.sum("n").alias("n_claims"))
    labels = F.array_join(F.transform("l", lambda x: x["label"]), "|")
    return universe.join(listed.select("id", labels.alias("labels"), "n_claims"), "id", "left").select(
        "id", F.coalesce("labels", F.lit("unknown")).alias("labels"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"))


TYPES = ["click", "error", "purchase", "signup", "view"]
PIVOT = "(SELECT id, " + ", ".join(f"count(*) FILTER (WHERE scenario = '{x}') AS \"{x}\"" for x in TYPES) + " FROM smp GROUP BY 1)"


@query("argmax_conditions", "smp", f"""
    SELECT id, top, array_to_string([v FOR v IN [{", ".join(f"CASE WHEN {x} = top THEN '{x}' END" for x in TYPES)}] IF v IS NOT NULL], ';') AS conditions
    FROM (SELECT *, greatest({", ".join(TYPES)}) AS top FROM {PIVOT} p) q""")
def argmax_conditions(t):
    p = A.condition_pivot(t.smp().withColumn("one", F.lit(1).cast("long")), "id", "scenario", "one", TYPES)
    return p.select("id", F.greatest(*TYPES).alias("top"), F.array_join(C.argmax_names({x: x for x in TYPES}), ";").alias("conditions"))


@query("condition_pivot", "smp", f"SELECT * FROM {PIVOT} p")
def condition_pivot(t):
    return A.condition_pivot(t.smp().withColumn("one", F.lit(1).cast("long")), "id", "scenario", "one", TYPES)


@query("group_composition", "", """
    SELECT p_brand AS grp, count(*) AS n_rows, count(*) FILTER (WHERE p_type <> 'ECONOMY') AS n_typed,
           count(*) FILTER (WHERE p_size > 40) AS n_large, count(*) FILTER (WHERE p_type = 'ECONOMY' AND p_size > 40) AS n_disagree FROM part GROUP BY 1""")
def group_composition(t):
    return t.read("part").groupBy(F.col("p_brand").alias("grp")).agg(
        F.count("*").alias("n_rows"), F.count_if(F.expr("p_type <> 'ECONOMY'")).alias("n_typed"),
        F.count_if(F.expr("p_size > 40")).alias("n_large"),
        F.count_if(F.expr("p_type = 'ECONOMY' AND p_size > 40")).alias("n_disagree"))


@query("label_conflicts", "", """
    SELECT lang, count(*) AS n_both, count(*) FILTER (WHERE predicted <> quality) AS n_conflicts,
           round(count(*) FILTER (WHERE predicted <> quality) / count(*), 6) AS rate
    FROM (SELECT lang, CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END AS predicted, quality FROM documents JOIN labels USING (doc_id)) s GROUP BY 1""")
def label_conflicts(t):
    df = t.read("documents").select("doc_id", "lang", F.when(F.col("n_chars") >= 500, 1).otherwise(0).alias("predicted")).join(
        t.read("labels"), "doc_id")
    out = df.groupBy("lang").agg(F.count("*").alias("n_both"), F.count_if(F.expr("predicted <> quality")).alias("n_conflicts"))
    return out.withColumn("rate", F.round(C.safe_ratio("n_conflicts", "n_both"), 6))


@query("trial_rates", "smp", """
    SELECT scenario, id, n AS n_in_window, round(n / 0.4, 6) AS rate, first_ms FROM (SELECT scenario, id,
      count(*) FILTER (WHERE t_ms % 1000 >= 100 AND t_ms % 1000 < 500) AS n, min(CASE WHEN t_ms % 1000 >= 100 THEN t_ms END) AS first_ms FROM smp GROUP BY 1, 2) s""")
def trial_rates(t):
    """Each second is a trial; counts fall in [100, 500) ms of it."""
    inside = F.expr("t_ms % 1000 >= 100 AND t_ms % 1000 < 500")
    df = t.smp().groupBy("scenario", "id").agg(
        F.count_if(inside).alias("n_in_window"), F.min(F.when(F.expr("t_ms % 1000 >= 100"), F.col("t_ms"))).alias("first_ms"))
    return df.withColumn("rate", F.round(F.col("n_in_window") / F.lit(0.4), 6))


@query("coverage_2x2", "v2 v3 nod", """
    WITH a AS (SELECT pre AS id, max(n) AS best FROM v2 GROUP BY 1), b AS (SELECT pre AS id, max(n) AS best FROM v3 GROUP BY 1)
    SELECT super_class, CAST(th AS INTEGER) AS min_n, coalesce(a.best >= th, false) AS in_a, coalesce(b.best >= th, false) AS in_b, count(*) AS n
    FROM nod LEFT JOIN a ON a.id = nod.id LEFT JOIN b ON b.id = nod.id, (VALUES (1), (5), (10)) l(th) GROUP BY 1, 2, 3, 4""")
def coverage_2x2(t):
    """Coverage by any pair, and by pairs of 5 and 10 contacts."""
    df = t.nod()
    for version, name in ((t.v2(), "_a"), (t.v3(), "_b")):
        df = df.join(version.groupBy(F.col("pre").alias("id")).agg(F.max("n").alias(name)), "id", "left")
    each = df.select("super_class", F.explode(F.array(*[F.lit(x) for x in (1, 5, 10)])).alias("min_n"), "_a", "_b")
    inside = [F.coalesce(F.col(c) >= F.col("min_n"), F.lit(False)).alias(f"in{c}") for c in ("_a", "_b")]
    return each.select("super_class", "min_n", *inside).groupBy("super_class", "min_n", "in_a", "in_b").agg(F.count("*").alias("n"))


@query("ratio_table", "", """
    SELECT o_orderpriority AS experiment, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS extended,
           round(count(*) FILTER (WHERE o_orderstatus = 'O') / count(*), 6) AS ratio, CAST(NULL AS DOUBLE) AS ratio_of_none FROM orders GROUP BY 1""")
def ratio_table(t):
    df = t.read("orders").groupBy(F.col("o_orderpriority").alias("experiment")).agg(
        F.count("*").alias("total"), F.count_if(F.expr("o_orderstatus = 'O'")).alias("extended"))
    return df.withColumn("ratio", F.round(C.safe_ratio("extended", "total"), 6)).withColumn(
        "ratio_of_none", C.safe_ratio("extended", F.col("total") - F.col("total")))


@query("progress_share", "", """
    SELECT o_orderpriority AS stage, CAST(sum(least(k, 4)) AS BIGINT) AS done, count(*) * 4 AS planned, round(100 * sum(least(k, 4)) / (count(*) * 4), 6) AS percent
    FROM (SELECT o_orderkey, o_orderpriority, count(l_orderkey) AS k FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) s GROUP BY 1""")
def progress_share(t):
    """Each order is a chunk of four parts; more parts than planned do not count."""
    parts = t.read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("k"))
    df = t.read("orders").select("o_orderkey", F.col("o_orderpriority").alias("stage")).join(parts, "o_orderkey", "left").fillna(0, ["k"])
    out = df.groupBy("stage").agg(F.sum(F.least("k", F.lit(4))).alias("done"), (F.count("*") * 4).alias("planned"))
    return out.withColumn("percent", F.round(100 * C.safe_ratio("done", "planned"), 6))
