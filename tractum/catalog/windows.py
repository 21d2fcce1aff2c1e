"""W, L and U: ranks, trailing windows, top-k, sampling and set operations."""

from pyspark.sql import functions as F

from tractum.catalog.base import query
from tractum.catalog.joins import PAIR, UNION_SQL, version_edges
from tractum.functions import columns as C
from tractum.operators import aggs as A
from tractum.operators import joins as J
from tractum.operators import sets as S
from tractum.operators.graph import connected_nodes as endpoints
from tractum.operators.ordered import lag_within, rank_within, top_k, trailing_sum, upper_median as positional_median, weighted_decay
from tractum.operators.series import autocorrelation, peaks, rhythm



@query("rank_in_group", "edg", """
    SELECT pre, post, region, n, row_number() OVER (PARTITION BY region ORDER BY n DESC, pre, post) AS rank FROM edg""")
def rank_in_group(t):
    return rank_within(t.edg(), ["region"], [F.desc("n"), F.asc("pre"), F.asc("post")])


@query("review_rank", "pairs", """
    SELECT pre, post, n, row_number() OVER (ORDER BY n DESC, pre, post) AS review_rank FROM pairs WHERE pre <> post""")
def review_rank(t):
    return rank_within(t.pairs().where("pre <> post"), [], [F.desc("n"), F.asc("pre"), F.asc("post")], "review_rank")


@query("examples_per_stratum", "edg", """
    SELECT region, pre, post, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY n DESC, pre, post) AS INTEGER) AS rank FROM edg) s WHERE rank <= 8""")
def examples_per_stratum(t):
    return top_k(t.edg(), ["region"], [F.desc("n"), F.asc("pre"), F.asc("post")], 8)


@query("shared_count", "edg", """
    SELECT e.*, c.n_regions, c.n_rows FROM edg e JOIN (SELECT pre, count(DISTINCT region) AS n_regions, count(*) AS n_rows FROM edg GROUP BY 1) c USING (pre)""")
def shared_count(t):
    return A.group_size(A.group_size(t.edg(), ["pre"], "n_regions", distinct="region"), ["pre"], "n_rows")


@query("share_of_total", "edg", """
    SELECT pre, post, region, n, CAST(sum(n) OVER (PARTITION BY pre) AS BIGINT) AS total, n / sum(n) OVER (PARTITION BY pre) AS share FROM edg""")
def share_of_total(t):
    return A.share_of_total(t.edg(), ["pre"], "n", "total", "share")


WIDTH = 6 * 3600 * 1000


@query("trailing_rate", "smp", f"""
    SELECT DISTINCT id, t_ms, spikes, spikes * 1000 / {WIDTH} AS rate_hz FROM (SELECT id, t_ms,
      CAST(sum(spike) OVER (PARTITION BY id ORDER BY t_ms RANGE BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS spikes FROM smp) s""")
def trailing_rate(t):
    out = trailing_sum(t.smp(), ["id"], "t_ms", "spike", WIDTH, "spikes")
    return out.withColumn("rate_hz", F.col("spikes") * 1000 / F.lit(WIDTH))


@query("inter_event_interval", "smp", """
    SELECT id, count(*) AS n_events, count(gap) AS n_gaps, CAST(sum(gap) AS BIGINT) AS total_gap, sum(gap) / count(gap) AS mean_gap_ms,
           1000 / (sum(gap) / count(gap)) AS frequency_hz, min(gap) AS min_gap, max(gap) AS max_gap
    FROM (SELECT id, t_ms - lag(t_ms) OVER (PARTITION BY id ORDER BY t_ms, event_id) AS gap FROM smp WHERE spike = 1) s GROUP BY 1""")
def inter_event_interval(t):
    df = lag_within(t.smp().where("spike = 1").select("id", "t_ms", "event_id"), ["id"], ["t_ms", "event_id"], ["t_ms"])
    gaps = df.withColumn("gap", F.col("t_ms") - F.col("prev_t_ms")).groupBy("id").agg(
        F.count("*").alias("n_events"), F.count("gap").alias("n_gaps"), F.sum("gap").alias("total_gap"),
        F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"))
    mean = C.safe_ratio("total_gap", "n_gaps")
    return gaps.withColumn("mean_gap_ms", mean).withColumn("frequency_hz", F.try_divide(F.lit(1000.0), mean))


_SERIES = """
    WITH s AS (SELECT id, t_ms, row_number() OVER (PARTITION BY id ORDER BY t_ms, event_id) - 1 AS i, floor(value / 10) AS v FROM smp WHERE value IS NOT NULL AND NOT isnan(value)),
      r AS (SELECT id, i, v, lag(v) OVER w AS pv, lead(v) OVER w AS nv, lead(i) OVER w AS nxt FROM
        (SELECT *, lag(v) OVER (PARTITION BY id ORDER BY i) IS DISTINCT FROM v AS new FROM s) c WHERE new WINDOW w AS (PARTITION BY id ORDER BY i)),
      p AS (SELECT * FROM r WHERE v > pv AND v > nv),
      h AS (SELECT p.id, p.i, p.v, p.nxt, coalesce(max(CASE WHEN y.i < p.i THEN y.i END), -1) AS l, coalesce(min(CASE WHEN y.i > p.i THEN y.i END), 1000000000) AS u
        FROM p LEFT JOIN r y ON y.id = p.id AND y.v > p.v GROUP BY 1, 2, 3, 4),
      b AS (SELECT h.id, (h.i + h.nxt - 1) // 2 AS i, h.v, h.v - greatest(min(CASE WHEN y.i <= h.i THEN y.v END), min(CASE WHEN y.i >= h.i THEN y.v END)) AS prominence
        FROM h JOIN r y ON y.id = h.id AND y.i > h.l AND y.i < h.u GROUP BY h.id, h.i, h.nxt, h.v),
      peak AS (SELECT b.id, b.i, s.t_ms, b.v, b.prominence FROM b JOIN (SELECT id, greatest(0.01, 0.05 * (max(v) - min(v))) AS least FROM s GROUP BY 1) a USING (id)
        JOIN s ON s.id = b.id AND s.i = b.i WHERE b.prominence >= a.least)"""


def _series(t):
    return t.smp().where("value is not null and not isnan(value)").select("id", "t_ms", "event_id", F.floor(F.col("value") / 10).cast("double").alias("v"))


def _prominent(t):
    series = _series(t)
    least = series.groupBy("id").agg(F.greatest(F.lit(0.01), 0.05 * (F.max("v") - F.min("v"))).alias("least"))
    return peaks(series, "id", ["t_ms", "event_id"], "v", ["t_ms"]).join(least, "id").where("prominence >= least").drop("least")


@query("prominence_peaks", "smp", _SERIES + " SELECT id, i, t_ms, v, prominence FROM peak")
def prominence_peaks(t):
    """Peaks at least 0.01 and a twentieth of the series' range above their surroundings."""
    return _prominent(t)


@query("peak_periods", "smp", _SERIES + """
    SELECT id, count(*) AS n_peaks, CAST(sum(gap) AS BIGINT) AS total_gap, sum(gap) / count(gap) AS mean_period_ms, 1000 / (sum(gap) / count(gap)) AS frequency_hz
    FROM (SELECT id, t_ms - lag(t_ms) OVER (PARTITION BY id ORDER BY i) AS gap FROM peak) g GROUP BY 1""")
def peak_periods(t):
    gaps = lag_within(_prominent(t).select("id", "i", "t_ms"), ["id"], ["i"], ["t_ms"]).withColumn("gap", F.col("t_ms") - F.col("prev_t_ms"))
    out = gaps.groupBy("id").agg(F.count("*").alias("n_peaks"), F.sum("gap").alias("total_gap"), F.count("gap").alias("_n"))
    mean = C.safe_ratio("total_gap", "_n")
    return out.withColumn("mean_period_ms", mean).withColumn("frequency_hz", F.try_divide(F.lit(1000.0), mean)).drop("_n")


_LAGS = """
    WITH s AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY t_ms, event_id) AS i, value AS v FROM smp WHERE value IS NOT NULL AND NOT isnan(value)),
      x AS (SELECT s.id, i, n, v - m AS x FROM s JOIN (SELECT id, count(*) AS n, avg(v) AS m FROM s GROUP BY 1) a USING (id)),
      c AS (SELECT a.id, a.n, l.lag, round(CASE WHEN q.total > 0 THEN sum(a.x * b.x) / q.total ELSE 0 END, 6) AS r FROM x a JOIN (VALUES (1), (2), (3), (5), (8)) l(lag) ON l.lag < a.n
        JOIN x b ON b.id = a.id AND b.i = a.i + l.lag JOIN (SELECT id, sum(x * x) AS total FROM x GROUP BY 1) q ON q.id = a.id GROUP BY a.id, a.n, l.lag, q.total)"""
LAGS = (1, 2, 3, 5, 8)


def _correlations(t):
    out = autocorrelation(t.smp().select("id", "t_ms", "event_id", "value"), "id", ["t_ms", "event_id"], "value", LAGS)
    return out.withColumn("r", F.round("r", 6))


@query("autocorrelation", "smp", _LAGS + " SELECT id, n, lag, r FROM c")
def autocorrelation_of_values(t):
    return _correlations(t)


@query("rhythm_score", "smp", _LAGS + """
    SELECT id, r AS score, lag, 1.0::DOUBLE / (lag * 0.5::DOUBLE) AS frequency FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY r DESC, lag) = 1""")
def rhythm_score(t):
    return rhythm(_correlations(t), "id", 0.5)


@query("first_occurrence", "claims", """
    SELECT root_id, arg_min(label, claim_id) AS label, arg_min(source_id, claim_id) AS source_id, min(claim_id) AS claim_id FROM claims GROUP BY 1""")
def first_occurrence(t):
    return t.claims().groupBy("root_id").agg(
        F.min_by("label", "claim_id").alias("label"), F.min_by("source_id", "claim_id").alias("source_id"),
        F.min("claim_id").alias("claim_id"))


@query("upper_median", "pts", """
    SELECT region, n, score_a AS upper_median FROM (SELECT region, score_a, row_number() OVER (PARTITION BY region ORDER BY score_a) AS r,
      count(*) OVER (PARTITION BY region) AS n FROM pts) s WHERE r = n // 2 + 1""")
def upper_median(t):
    return positional_median(t.pts().select("region", "score_a"), ["region"], "score_a")


@query("first_event", "smp", "SELECT id, min(CASE WHEN spike > 0 THEN t_ms END) AS first_ms FROM smp GROUP BY 1")
def first_event(t):
    return t.smp().groupBy("id").agg(F.min(F.when(F.col("spike") > 0, F.col("t_ms"))).alias("first_ms"))


@query("ewma", "smp", """
    SELECT id, count(*) AS n_samples, round(sum(0.2 * power(0.8, age - 1) * value), 6) AS ewma FROM
      (SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY t_ms DESC, event_id DESC) AS age FROM smp) s GROUP BY 1""")
def ewma(t):
    out = weighted_decay(t.smp().select("id", "t_ms", "event_id", "value"), ["id"], ["t_ms", "event_id"], "value", 0.2)
    return out.withColumn("ewma", F.round("ewma", 6))


@query("top_n_pairs", "v2 v3", f"""
    SELECT pre, post, n3 AS n FROM {UNION_SQL} u WHERE n2 IS NULL ORDER BY n3 DESC, pre, post LIMIT 50""")
def top_n_pairs(t):
    only = t.v3().join(t.v2().select(*PAIR), PAIR, "left_anti")
    return only.orderBy(F.desc("n"), F.asc("pre"), F.asc("post")).limit(50)


@query("top_nodes", "pairs", "SELECT post AS id, CAST(sum(n) AS BIGINT) AS weight FROM pairs GROUP BY 1 ORDER BY weight DESC, id LIMIT 10")
def top_nodes(t):
    return t.pairs().groupBy(F.col("post").alias("id")).agg(F.sum("n").alias("weight")).orderBy(F.desc("weight"), F.asc("id")).limit(10)


@query("composite_sort", "v2 v3", f"""
    SELECT pre, post, n2, n3, row_number() OVER (ORDER BY least(coalesce(n2, 0), coalesce(n3, 0)) DESC, n3 DESC NULLS LAST, n2 ASC NULLS LAST, post DESC, pre) AS position
    FROM {UNION_SQL} u""")
def composite_sort(t):
    zero = F.lit(0)
    weakest = F.least(F.coalesce("n2", zero), F.coalesce("n3", zero))
    df = version_edges(t).withColumn("_w", weakest)
    order = [F.desc("_w"), F.desc_nulls_last("n3"), F.asc_nulls_last("n2"), F.desc("post"), F.asc("pre")]
    return rank_within(df, [], order, "position").drop("_w")


@query("review_list", "v2 v3 nod", f"""
    SELECT pre, post, n2 AS n, coalesce(a.cell_type, '') AS pre_cell_type, coalesce(b.cell_type, '') AS post_cell_type
    FROM {UNION_SQL} u LEFT JOIN nod a ON pre = a.id LEFT JOIN nod b ON post = b.id WHERE n3 IS NULL AND n2 >= 2""")
def review_list(t):
    only = t.v2().where("n >= 2").join(t.v3().select(*PAIR), PAIR, "left_anti")
    return J.enrich_endpoints(only, t.nod(), ["cell_type"]).orderBy(F.desc("n"), F.asc("pre"), F.asc("post"))


_SAMPLE_SQL = """
    WITH RECURSIVE h AS (SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS s, 0 AS i, CAST(2166136261 AS BIGINT) AS v FROM customer
      UNION ALL SELECT id, s, i + 1, CAST((CAST(xor(v, ascii(substr(s, i + 1, 1))::BIGINT) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT) FROM h WHERE i < length(s)),
      k AS (SELECT c_mktsegment, count(*) AS size FROM customer GROUP BY 1)
    SELECT c.c_mktsegment, c_custkey AS id FROM customer c JOIN k USING (c_mktsegment) JOIN h ON h.id = c_custkey AND i = length(s) WHERE size <= 280 OR v % 8 = 0"""


@query("stratified_sample", "", _SAMPLE_SQL)
def stratified_sample(t):
    """Every row of small classes, one in ``stride`` by FNV-1a of the id of large ones."""
    customers = t.read("customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    return S.stratified_sample(customers, "c_mktsegment", "id", 280, 8)


@query("stratified_classes", "", """
    SELECT c_mktsegment AS category, count(*) AS n_full, count(*) <= 280 AS kept_whole FROM customer GROUP BY 1""")
def stratified_classes(t):
    sizes = t.read("customer").groupBy(F.col("c_mktsegment").alias("category")).agg(F.count("*").alias("n_full"))
    return sizes.withColumn("kept_whole", F.col("n_full") <= 280)


@query("connected_nodes", "pairs", "SELECT pre AS id FROM pairs UNION SELECT post FROM pairs")
def connected_nodes(t):
    return endpoints(t.pts())


@query("union_labelled", "r2 r3", """
    SELECT version, region, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS weight, CAST(sum(extra) AS BIGINT) AS extra FROM
     (SELECT 'v2' AS version, region, n, NULL AS extra FROM r2 UNION ALL SELECT 'v3', region, n, 1 FROM r3) u GROUP BY 1, 2""")
def union_labelled(t):
    u = S.union_labelled({"v2": t.r2(), "v3": t.r3().withColumn("extra", F.lit(1).cast("long"))}, "version")
    return u.groupBy("version", "region").agg(F.count("*").alias("n_rows"), F.sum("n").alias("weight"), F.sum("extra").alias("extra"))


@query("set_diff", "pairs nod", """
    SELECT 'only_a' AS side, id FROM (SELECT id FROM nod EXCEPT SELECT post FROM pairs) a
    UNION ALL SELECT 'only_b', post FROM (SELECT post FROM pairs EXCEPT SELECT id FROM nod) b""")
def set_diff(t):
    return S.both_differences(t.nod().select("id"), t.pts().select(F.col("post").alias("id")))


@query("set_intersect", "v2 v3", "SELECT pre, post FROM v2 INTERSECT SELECT pre, post FROM v3")
def set_intersect(t):
    return t.v2().select(*PAIR).intersect(t.v3().select(*PAIR))


@query("set_relations", "pairs nod", """
    SELECT (SELECT count(*) FROM (SELECT id FROM nod EXCEPT SELECT pre FROM pairs) x) = 0 AS a_in_b,
           (SELECT count(*) FROM (SELECT pre FROM pairs EXCEPT SELECT id FROM nod) x) = 0 AS b_in_a,
           (SELECT count(*) FROM (SELECT pre FROM pairs INTERSECT SELECT id FROM nod) x) = 0 AS disjoint""")
def set_relations(t):
    return S.relations(t.nod().select("id"), t.pts().select(F.col("pre").alias("id")))


@query("partition_check", "", """
    SELECT (SELECT count(*) FROM customer) AS n_universe, count(*) AS n_covered, count(*) FILTER (WHERE k > 1) AS n_overlapping,
      (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS n_uncovered
    FROM (SELECT o_custkey, count(DISTINCT o_orderstatus) AS k FROM orders GROUP BY 1) g""")
def partition_check(t):
    groups = t.read("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("grp"))
    return S.partition_check(groups, t.read("customer").select(F.col("c_custkey").alias("id")))


@query("distinct_rows", "pairs nod", """
    SELECT DISTINCT pre, post, n FROM (SELECT * FROM pairs WHERE n >= 10 UNION ALL SELECT * FROM pairs WHERE pre IN (SELECT id FROM nod WHERE side = 'left')) u""")
def distinct_rows(t):
    left = J.in_set(t.pairs(), "pre", t.nod().where("side = 'left'").select("id"))
    return t.pairs().where("n >= 10").unionByName(left).dropDuplicates()


@query("union_directions", "pairs", """
    SELECT 'outgoing' AS direction, pre AS id, count(*) AS n_partners, CAST(sum(n) AS BIGINT) AS contacts FROM pairs GROUP BY 2
    UNION ALL SELECT 'incoming', post, count(*), CAST(sum(n) AS BIGINT) FROM pairs GROUP BY 2""")
def union_directions(t):
    def side(end):
        return t.pairs().groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n_partners"), F.sum("n").alias("contacts"))
    return S.union_labelled({"outgoing": side("pre"), "incoming": side("post")}, "direction")
