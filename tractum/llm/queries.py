"""The registered queries opN_<name>: whole tables, production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractum.llm import forest, merkle, mixing, packing, pitman_yor, rules, secrets, simhash, suffixes, tokenfile, variants, voronoi, warc
from tractum.llm.base import ORACLES, QUERIES, query, read
from tractum.session import shared_folder, stage


@query("op7_warc")
def op7_warc(spark, folder: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write_captures(read(spark, folder, "pages", "page_id", "url", "html"), path)
    captures = stage(warc.assemble(warc.read_records(spark, path, payloads=False)).select(
        "id", "capture.*", F.element_at("metadata.fields", "page").cast("long").alias("page_id")))
    origins = captures.where(F.col("type") == "response").select(F.col("id").alias("_origin"), F.col("page_id").alias("origin_page"))
    return captures.join(origins, F.col("refers_to") == F.col("_origin"), "left").select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("origin_page").alias("refers_to"))


@query("op8_packing")
def op8_packing(spark, folder: str) -> DataFrame:
    """Words of a document and one end mark are its length."""
    docs = read(spark, folder, "documents", "doc_id", "text")
    return packing.pack(docs, "doc_id", mixing.word_count(F.col("text")) + 1)


@query("op9_simhash")
def op9_simhash(spark, folder: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", simhash.EXACT, None)
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark, folder: str) -> DataFrame:
    out = suffixes.remove_repeats(read(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op2_tokens")
def op2_tokens(spark, folder: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    tokenfile.write_tokens(read(spark, folder, "documents", "doc_id", "text"), path, "doc_id", "text")
    return tokenfile.read_tokens(spark, path, with_ids=False).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query("op3_secrets")
def op3_secrets(spark, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    found = secrets.scan(docs, "text", secrets.fit(docs, "doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] < len(secrets.PATTERNS))
    counts = [secrets.count_of(F.col("secrets"), i).alias(f"n_{kind}") for i, kind in enumerate(secrets.KINDS)]
    return found.select("doc_id", *counts, F.sha2(secrets.as_text(base), 256).alias("base_sha256"), secrets.as_text(F.col("secrets")).alias("spans"))


@query("op4_mixing")
def op4_mixing(spark, folder: str) -> DataFrame:
    out = mixing.plan(read(spark, folder, "documents", "doc_id", "text", "source"), "doc_id", "source", "text")
    return out.select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"))


@query("op5_topk", """
    WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op5_topk(spark, folder: str) -> DataFrame:
    return voronoi.search(read(spark, folder, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", F.col("id") % 100 == 0)


@query("op6_quality")
def op6_quality(spark, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text", "lang")
    out = rules.judge(docs, read(spark, folder, "labels", "doc_id", "quality"))
    return out.select("doc_id", *rules.BASE, "base_failed", "kept", F.concat_ws(",", "failed").alias("failed_rules"))


@query("op10_pitman_yor")
def op10_pitman_yor(spark, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    return pitman_yor.score(docs, "doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)


@query("op11_minhash")
def op11_minhash(spark, folder: str) -> DataFrame:
    return forest.near_duplicates(read(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


@query("op12_merkle")
def op12_merkle(spark, folder: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    docs = read(spark, folder, "documents", *fields)
    leaf = merkle.digest(*[merkle.encoded(F.col(c)) for c in fields])
    changed = merkle.digest(*[merkle.encoded(F.col(c)) for c in fields[:-1]], merkle.encoded(tampered))
    rows = docs.select("doc_id", "lang", leaf.alias("digest"), F.when(third, changed).otherwise(leaf).alias("claimed"))
    return merkle.prove(rows.withColumn("leaf", F.col("digest")), ["doc_id"], "lang", ["doc_id", "leaf"], "claimed")


@query("op13_variants")
def op13_variants(spark, folder: str) -> DataFrame:
    words = variants.vocabulary(read(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", lose=31)
    return variants.forms(words)


def load():
    return QUERIES, ORACLES
