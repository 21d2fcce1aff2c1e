"""Q13-Q17: text and file registries."""

import uuid

from pyspark.sql import functions as F

from tractum.catalog.base import query
from tractum.plans import registry as R
from tractum.plans.stored import Registry
from tractum.session import shared_folder

RULES = [("example\\.net", "verified_license", "CC-BY-4.0"), ("^https:", "general_policy", "CC-BY-NC-4.0"), ("/(en|de)/", "declared", "MIT")]
_when = lambda i: " ".join(f"WHEN regexp_matches(url, '{r[0]}') THEN '{r[i]}'" for r in RULES)


@query("registry_classify", "", f"""
    SELECT page_id, CASE {_when(1)} ELSE 'not_cleared' END AS status, CASE {_when(2)} ELSE 'source_terms' END AS license FROM pages""")
def registry_classify(t):
    rules = [(F.col("url").rlike(p), s, x) for p, s, x in RULES]
    return R.classify(t.read("pages").select("page_id", "url"), rules, ("not_cleared", "source_terms")).drop("url")


def _q(pattern):
    return pattern.replace("'", "''")


# Lines that releases must not carry are added to each text, from its own data.
EXTRA_SQL = """concat(text, '\n/home/', lang, '_', doc_id, '/notes C:\\Users\\', source, '\\x https://chatgpt.com/c/', md5(text), '?q=1 http://localhost:', 1000 + doc_id % 9, '/v ',
    CASE WHEN doc_id % 5 = 0 THEN concat('ghp_', md5(text), 'ABCDEF') ELSE '' END)"""


@query("text_scrub", "", f"""
    SELECT doc_id, CAST(len(regexp_extract_all(t, '{_q(R.SESSION)}')) AS INTEGER) AS n_session,
      CAST(len(regexp_extract_all(regexp_replace(t, '{_q(R.SESSION)}', '<PRIVATE_SESSION_URL_REMOVED>', 'g'), '{_q(R.HOME)}')) AS INTEGER) AS n_home,
      CAST(len(regexp_extract_all(t, '{_q(R.LOCAL)}')) AS INTEGER) AS n_local, CAST(len(regexp_extract_all(t, '{_q(R.SECRETS["private_key"])}')) AS INTEGER) AS n_private_key,
      CAST(len(regexp_extract_all(t, '{_q(R.SECRETS["service_token"])}')) AS INTEGER) AS n_service_token, NOT regexp_matches(t, '{_q("|".join(R.SECRETS.values()))}') AS publishable,
      CASE WHEN NOT regexp_matches(t, '{_q("|".join(R.SECRETS.values()))}') THEN regexp_replace(regexp_replace(t, '{_q(R.SESSION)}', '<PRIVATE_SESSION_URL_REMOVED>', 'g'), '{_q(R.HOME)}', '<USER_HOME>', 'g') END AS t
    FROM (SELECT doc_id, {EXTRA_SQL} AS t FROM documents) s""")
def text_scrub(t):
    d = F.col("doc_id").cast("string")
    token = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("ghp_"), F.md5("text"), F.lit("ABCDEF"))).otherwise("")
    text = F.concat(
        "text", F.lit("\n/home/"), "lang", F.lit("_"), d, F.lit("/notes C:\\Users\\"), "source", F.lit("\\x https://chatgpt.com/c/"), F.md5("text"),
        F.lit("?q=1 http://localhost:"), (1000 + F.col("doc_id") % 9).cast("string"), F.lit("/v "), token)
    return R.scrub_text(t.read("documents").select("doc_id", text.alias("t")), "t")


@query("inclusion_rules", "", """
    SELECT included, reason, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes FROM (SELECT size, CASE WHEN size > 3000 THEN false WHEN regexp_matches(url, '\\?') THEN false
        WHEN regexp_matches(url, '/(en|fr)/') THEN true ELSE false END AS included, CASE WHEN size > 3000 THEN 'oversized' WHEN regexp_matches(url, '\\?') THEN 'runtime_query'
        WHEN regexp_matches(url, '/(en|fr)/') THEN 'documentation' ELSE 'outside_scope' END AS reason FROM (SELECT url, length(html) AS size FROM pages) p) s GROUP BY 1, 2""")
def inclusion_rules(t):
    files = t.read("pages").select("url", F.length("html").alias("size"))
    rules = [(F.col("size") > 3000, False, "oversized"), (F.col("url").rlike("\\?"), False, "runtime_query"),
             (F.col("url").rlike("/(en|fr)/"), True, "documentation")]
    df = R.include(files, rules, (False, "outside_scope"))
    return df.groupBy("included", "reason").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


@query("link_check", "", """
    WITH l AS (SELECT DISTINCT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages) u WHERE NOT regexp_matches(link, '^(https?:|#|mailto:)'))
    SELECT page_id, link, split_part(link, '#', 1) AS target, split_part(link, '#', 1) IN (SELECT '/' || split_part(url, '/', 4) FROM pages) AS found FROM l""")
def link_check(t):
    pages = t.read("pages")
    targets = pages.select(F.concat(F.lit("/"), F.split_part("url", F.lit("/"), F.lit(4))).alias("target"))
    return R.check_links(pages, "html", 'href="([^"]+)"', targets)


@query("upsert_by_id", "", """
    SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_totalprice, o_orderkey) AS price, min(o_orderkey) AS position, count(*) AS n_loads FROM orders GROUP BY 1""")
def upsert_by_id(t):
    entries = t.read("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"))
    return R.upsert(entries, "id", "seq")


@query("registry_stored", "", """
    SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1""")
def registry_stored(t):
    """The registry kept in files by ranges of ids, in two loads; the second replaces entries of the first."""
    entries = t.read("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"))
    path = f"{shared_folder(t.spark).rstrip('/')}/registry-{uuid.uuid4().hex}"
    kept = Registry(t.spark, path, entries.drop("seq").schema, "id", 256)
    middle = entries.agg(F.expr("max(seq) div 2")).first()[0] or 0
    kept.upsert(entries.where(F.col("seq") <= middle), "seq")
    kept.upsert(entries.where(F.col("seq") > middle), "seq")
    return kept.read()
