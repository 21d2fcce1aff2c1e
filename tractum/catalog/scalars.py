"""H and F: scalar functions and the UDF surface."""

from pyspark.sql import functions as F

from tractum.catalog.base import query
from tractum.functions import columns as C
from tractum.functions import udfs as U



def _n(df, *keys):
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


@query("str_clean", "", """
    SELECT doc_id, lower(trim(regexp_replace(text, '^﻿', ''))) AS cleaned, replace(lang, 'e', 'E') AS lang FROM
      (SELECT doc_id, concat(chr(65279), '  ', text, ' ') AS text, lang FROM documents) s""".replace("\\ufeff", "﻿"))
def str_clean(t):
    text = F.concat(F.lit("﻿  "), "text", F.lit(" "))
    return t.read("documents").select("doc_id", F.lower(F.trim(C.strip_bom(text))).alias("cleaned"), F.replace("lang", F.lit("e"), F.lit("E")).alias("lang"))


@query("str_predicates", "", """
    SELECT starts_with(url, 'https') AS secure, contains(url, 'example.net') AS net, ends_with(url, '#top') AS top,
           split_part(url, '/', 4) AS section, count(*) AS n FROM pages GROUP BY ALL""")
def str_predicates(t):
    u = F.col("url")
    df = t.read("pages").select(u.startswith("https").alias("secure"), u.contains("example.net").alias("net"), u.endswith("#top").alias("top"),
                                F.split_part(u, F.lit("/"), F.lit(4)).alias("section"))
    return _n(df, "secure", "net", "top", "section")


@query("split_explode", "", """
    SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) s GROUP BY 1""")
def split_explode(t):
    return _n(t.read("part").select(F.explode(F.split("p_name", " ")).alias("word")), "word")


@query("regex_id_parse", "", """
    SELECT CAST(nullif(regexp_extract(label, '^([0-9]{15,20})(,[0-9]{15,20})?$', 1), '') AS BIGINT) AS id, count(*) AS n FROM
      (SELECT CASE WHEN o_orderkey % 3 = 0 THEN CAST(720575940000000000 + o_custkey AS VARCHAR) WHEN o_orderkey % 3 = 1
        THEN concat(720575940000000000 + o_custkey, ',', 720575940000000001 + o_custkey) ELSE concat('x', o_custkey) END AS label FROM orders) s GROUP BY 1""")
def regex_id_parse(t):
    base, k = F.lit(720575940000000000) + F.col("o_custkey"), F.col("o_orderkey") % 3
    label = F.when(k == 0, base.cast("string")).when(k == 1, F.concat_ws(",", base.cast("string"), (base + 1).cast("string"))).otherwise(
        F.concat(F.lit("x"), F.col("o_custkey").cast("string")))
    return _n(t.read("orders").select(C.id_from_text(label).alias("id")), "id")


@query("id_rebuild", "", """
    SELECT c_custkey AS suffix, CAST(concat('720575940', lpad(CAST(c_custkey AS VARCHAR), 9, '0')) AS BIGINT) AS id FROM customer""")
def id_rebuild(t):
    return t.read("customer").select(F.col("c_custkey").alias("suffix"), C.rebuild_id("720575940", "c_custkey").alias("id"))


@query("digits_only", "", """
    SELECT regexp_full_match(v, '[0-9]+') AS digits, count(*) AS n FROM (SELECT split_part(c_name, '#', 1 + CAST(c_custkey % 2 AS INTEGER)) AS v FROM customer) s GROUP BY 1""")
def digits_only(t):
    part = F.split_part("c_name", F.lit("#"), (1 + F.col("c_custkey") % 2).cast("int"))
    return _n(t.read("customer").select(C.digits_only(part).alias("digits")), "digits")


@query("strict_cast", "", """
    SELECT CASE WHEN regexp_full_match(trim(v), '-?[0-9]+') THEN try_cast(trim(v) AS BIGINT) END AS value,
           CASE WHEN regexp_full_match(trim(v), '-?[0-9]+') THEN 'ok' ELSE 'not_an_integer' END AS reason, b AS flag, count(*) AS n
    FROM (SELECT CASE WHEN o_custkey % 3 = 0 THEN concat(' ', o_custkey % 50) WHEN o_custkey % 3 = 1 THEN concat('-', o_custkey % 50) ELSE concat(o_custkey % 50, '.5') END AS v,
          o_orderstatus = 'F' AS b FROM orders) s GROUP BY 1, 2, 3""")
def strict_cast(t):
    m, k = (F.col("o_custkey") % 50).cast("string"), F.col("o_custkey") % 3
    v = F.when(k == 0, F.concat(F.lit(" "), m)).when(k == 1, F.concat(F.lit("-"), m)).otherwise(F.concat(m, F.lit(".5")))
    flag = F.when(F.col("o_orderstatus") == "F", "True").otherwise("f")
    df = t.read("orders").select(v.alias("v"), C.strict_bool(flag).alias("flag"))
    df = df.select(C.strict_int("v").alias("value"), "flag")
    return _n(df.withColumn("reason", F.when(F.col("value").isNull(), "not_an_integer").otherwise("ok")), "value", "reason", "flag")


@query("distance_3d", "pts", """
    SELECT okey, ln, pre, post, sqrt((pre_x - post_x) * (pre_x - post_x) + (pre_y - post_y) * (pre_y - post_y) + (pre_z - post_z) * (pre_z - post_z)) AS dist,
           (pre_x + post_x) / 2 AS mid_x FROM pts""")
def distance_3d(t):
    d = C.distance(["pre_x", "pre_y", "pre_z"], ["post_x", "post_y", "post_z"])
    return t.pts().select("okey", "ln", "pre", "post", d.alias("dist"), ((F.col("pre_x") + F.col("post_x")) / 2).alias("mid_x"))


@query("math_scalars", "pts", """
    SELECT size, round(ln(1 + size), 9) AS log1p, round(exp(-size / 10.0::DOUBLE), 9) AS decay, least(size, 10) AS low, greatest(size, 10) AS high,
           abs(size - 25) AS gap, CAST(round_even(size / 50.0::DOUBLE * 255, 0) AS INTEGER) AS quantised, count(*) AS n FROM pts GROUP BY size""")
def math_scalars(t):
    s = F.col("size")
    return _n(t.pts(), "size").select(
        "size", F.round(F.log1p(s), 9).alias("log1p"), F.round(F.exp(-s / F.lit(10.0)), 9).alias("decay"), F.least(s, F.lit(10)).alias("low"),
        F.greatest(s, F.lit(10)).alias("high"), F.abs(s - 25).alias("gap"), C.quantise_probability(s / F.lit(50.0)).alias("quantised"), "n")


@query("safe_ratio", "pairs", """
    SELECT pre, CAST(sum(n) FILTER (WHERE pre = post) AS BIGINT) AS self_n, count(*) FILTER (WHERE n >= 14) AS strong,
           sum(n) FILTER (WHERE n >= 14) / nullif(count(*) FILTER (WHERE n >= 14), 0) AS mean_strong FROM pairs GROUP BY 1""")
def safe_ratio(t):
    strong = F.col("n") >= 14
    df = t.pairs().groupBy("pre").agg(F.sum(F.when(F.expr("pre = post"), F.col("n"))).alias("self_n"), F.count_if(strong).alias("strong"),
                                      F.sum(F.when(strong, F.col("n"))).alias("_s"))
    return df.select("pre", "self_n", "strong", C.safe_ratio("_s", "strong").alias("mean_strong"))


@query("delta_expr", "v2 v3", """
    SELECT a.pre, a.post, b.n - a.n AS delta, 100 * (b.n - a.n) / a.n AS percent FROM v2 a JOIN v3 b ON a.pre = b.pre AND a.post = b.post""")
def delta_expr(t):
    df = t.v2().withColumnRenamed("n", "a").join(t.v3().withColumnRenamed("n", "b"), ["pre", "post"])
    delta = F.col("b") - F.col("a")
    return df.select("pre", "post", delta.alias("delta"), C.safe_ratio(100 * delta, "a").alias("percent"))


@query("null_logic", "nod", """
    SELECT coalesce(nullif(cell_type, ''), '[untyped]') AS label, CASE WHEN nullif(cell_type, '') IS NULL THEN 0 ELSE 1 END AS typed, count(*) AS n FROM nod GROUP BY 1, 2""")
def null_logic(t):
    named = F.nullif(F.col("cell_type"), F.lit(""))
    return _n(t.nod().select(F.coalesce(named, F.lit("[untyped]")).alias("label"), F.when(named.isNull(), 0).otherwise(1).alias("typed")), "label", "typed")


_FNV_SQL = """
    WITH RECURSIVE h AS (SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS s, 0 AS i, CAST(2166136261 AS BIGINT) AS v FROM customer
      UNION ALL SELECT id, s, i + 1, CAST((CAST(xor(v, ascii(substr(s, i + 1, 1))::BIGINT) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT) FROM h WHERE i < length(s))
    SELECT id, v AS hash, v % 8 AS phase FROM h WHERE i = length(s)"""


@query("stable_hash", "", _FNV_SQL)
def stable_hash(t):
    df = t.read("customer").select(F.col("c_custkey").alias("id"), C.fnv1a("c_custkey").alias("hash"))
    return df.withColumn("phase", F.pmod("hash", F.lit(8).cast("long")))


@query("content_hash", "", """
    SELECT doc_id, md5(text) AS md5, sha256(concat('{"doc_id":', doc_id, ',"lang":"', lang, '"}')) AS row_sha256 FROM documents""")
def content_hash(t):
    return t.read("documents").select("doc_id", F.md5("text").alias("md5"), F.sha2(C.canonical_json(["lang", "doc_id"]), 256).alias("row_sha256"))


@query("json_scalar", "", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, concat('{"id":', user_id, ',"type":"', event_type, '"}') AS packed FROM events""")
def json_scalar(t):
    packed = F.to_json(F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("type")))
    return t.read("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), packed.alias("packed"))


@query("array_scalar", "", """
    SELECT vec_id, list_min(embedding)::DOUBLE AS lowest, len(list_distinct(embedding)) AS n_distinct, list_sort(embedding)[1:3][3]::DOUBLE AS third,
           list_max(list_transform(range(1, 64), lambda i: abs(embedding[i + 1]::DOUBLE - embedding[i]::DOUBLE))) AS largest_step FROM embeddings""")
def array_scalar(t):
    e = F.transform("embedding", lambda x: x.cast("double"))
    steps = F.zip_with(F.slice(e, 2, F.size(e) - 1), F.slice(e, 1, F.size(e) - 1), lambda b, a: F.abs(b - a))
    return t.read("embeddings").select(
        "vec_id", F.array_min(e).alias("lowest"), F.size(F.array_distinct("embedding")).cast("long").alias("n_distinct"),
        F.element_at(F.slice(F.array_sort(e), 1, 3), 3).alias("third"), F.array_max(steps).alias("largest_step"))


@query("map_lookup", "", """
    SELECT lang, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'other' END AS name, count(*) AS n FROM documents GROUP BY 1, 2""")
def map_lookup(t):
    df = t.read("documents").select("lang", C.map_lookup("lang", {"en": "English", "de": "German"}, F.lit("other")).alias("name"))
    return _n(df, "lang", "name")


@query("array_flatten", "mat", """
    SELECT label, count(*) AS n_values, min(score) AS lowest, max(score) AS highest FROM mat JOIN embeddings ON row_id = vec_id GROUP BY 1""")
def array_flatten(t):
    df = t.read("embeddings").select("label", F.explode("embedding").alias("_s")).select("label", F.col("_s").cast("double").alias("s"))
    return df.groupBy("label").agg(F.count("*").alias("n_values"), F.min("s").alias("lowest"), F.max("s").alias("highest"))


@query("udf_scalar", "", _FNV_SQL.replace(", v % 8 AS phase", ""))
def udf_scalar(t):
    """The vectorised twin of ``stable_hash``."""
    return t.read("customer").select(F.col("c_custkey").alias("id"), U.fnv1a_udf(F.col("c_custkey").cast("string")).alias("hash"))


@query("udaf_string", "edg", """
    SELECT pre, CASE WHEN len(l) <= 2 THEN array_to_string(l, ';') ELSE array_to_string(l[1:2], ';') || '...(' || len(l) || ' total)' END AS regions
    FROM (SELECT pre, list(DISTINCT region ORDER BY region) AS l FROM edg GROUP BY 1) s""")
def udaf_string(t):
    """Grouped-aggregate UDF over rows already reduced to distinct labels."""
    return t.edg().select("pre", "region").distinct().groupBy("pre").agg(U.limited_join_udaf("region").alias("regions"))


@query("udf_grouped_map", "smp", """
    SELECT id, count(*) AS n_peaks, min(t) AS first_peak, max(t) AS last_peak FROM (SELECT id, t, v, lag(v) OVER w AS a, lead(v) OVER w AS b
      FROM (SELECT id, t_ms // 86400000 AS t, count(*) AS v FROM smp GROUP BY 1, 2) d WINDOW w AS (PARTITION BY id ORDER BY t)) s
    WHERE v > coalesce(a, -1) AND v >= coalesce(b, -1) GROUP BY 1""")
def udf_grouped_map(t):
    """Local maxima of each id's daily counts: a group is one row per day."""
    daily = t.smp().groupBy("id", F.expr("t_ms div 86400000").alias("t")).agg(F.count("*").alias("v"))
    return daily.groupBy("id").applyInPandas(U.peaks, "id long, n_peaks long, first_peak long, last_peak long")


@query("udtf_path_edges", "edg", """
    SELECT region, role, count(*) AS n_rows, count(DISTINCT id) AS n_ids FROM (SELECT region, 'pre' AS role, pre AS id FROM edg
      UNION ALL SELECT region, 'post', post FROM edg) e GROUP BY 1, 2""")
def udtf_path_edges(t):
    """Endpoint rows from a vectorised Python table function over the edge table."""
    ends = U.EndpointRows(t.edg().select("pre", "post", "region").asTable())
    per_id = ends.groupBy("region", "role", "id").agg(F.count("*").alias("n"))
    return per_id.groupBy("region", "role").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_ids"))
