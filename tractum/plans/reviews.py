"""Review queues: evidence classes in a deterministic order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractum.functions.rules import DETECTOR_RANK, TIERS, detector_class, evidence_tier, rank_of, review_band
from tractum.operators.aggs import dominant, histogram_text
from tractum.operators.joins import exact_site_matches, key_union, mark
from tractum.operators.keys import join_null_safe
from tractum.operators.ordered import rank_within

KEY3 = ["pre", "post", "region"]


def dual_detector_review(a: DataFrame, b: DataFrame, known: DataFrame, coordinates: list[str]) -> DataFrame:
    """(pair, region) keys seen by either detector, classed and ranked."""

    def counts(df: DataFrame) -> DataFrame:
        return df.groupBy(*KEY3).agg(F.count("*").alias("n"))

    keys = join_null_safe(key_union(counts(a), counts(b), KEY3), exact_site_matches(a, b, KEY3, coordinates), KEY3, "left")
    keys = mark(mark(keys, "pre", known, "_pre"), "post", known, "_post")
    cls = detector_class(F.col("_pre") & F.col("_post"), F.col("n_a"), F.col("n_b"))
    df = keys.select(*KEY3, "n_a", "n_b", F.coalesce("exact_sites", F.lit(0)).alias("exact_sites"), cls.alias("evidence_class"))
    order = [
        rank_of(F.col("evidence_class"), DETECTOR_RANK).asc(), F.least("n_a", "n_b").desc(), F.greatest("n_a", "n_b").desc(),
        F.asc("pre"), F.asc("post"), F.asc("region"),
    ]
    return rank_within(df, [], order, "review_rank")


def review_queue(nodes: DataFrame, rows: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """One row per node: its evidence by class, the tier and the queue position.

    ``nodes``: id; ``rows``: id, region, n, evidence ('raw' or 'segment');
    ``hypotheses``: id, support.
    """

    def of(kind: str):
        return F.col("evidence") == kind

    counts = rows.groupBy("id").agg(
        F.count_if(of("raw")).alias("raw_rows"), F.coalesce(F.sum(F.when(of("raw"), F.col("n"))), F.lit(0)).alias("raw_points"),
        F.count_if(of("segment")).alias("segment_rows"),
        F.coalesce(F.sum(F.when(of("segment"), F.col("n"))), F.lit(0)).alias("segment_points"),
        F.count_if(of("segment") & (F.col("n") > 1)).alias("repeated_segment_rows"),
    )
    by_type = hypotheses.groupBy("id").agg(F.count("*").alias("hypothesis_rows"), F.max("support").alias("best_support"))
    regions = dominant(rows, ["id"], "region", F.col("n")).select("id", F.col("dominant").alias("dominant_region"))
    listed = histogram_text(rows, ["id"], "region", "regions", F.col("n"))
    df = nodes
    for part in (counts, by_type, regions, listed):
        df = df.join(part, "id", "left")
    numbers = [c for c in counts.columns + by_type.columns if c != "id"]
    df = df.fillna(0, numbers).fillna("", ["dominant_region", "regions"])
    tier = evidence_tier(F.col("raw_rows") > 0, F.col("segment_rows") > 0, F.col("hypothesis_rows") > 0)
    df = df.withColumn("tier", tier)
    order = [rank_of(F.col("tier"), TIERS).asc(), F.desc("raw_points"), F.desc("segment_points"), F.desc("best_support"), F.asc("id")]
    return rank_within(df, [], order, "review_rank")


def integrated_queue(nodes: DataFrame, pairs: DataFrame, segments: DataFrame, limits: Sequence[int], exception_id: int) -> DataFrame:
    """Per limit and node: pairs, points and band from two detectors' evidence.

    ``pairs``: pre, post, n of all pairs, whatever their count; ``segments``:
    id, n of points of the second detector on unknown partners.  Bands in
    order: the named exception, a pair of at least ``min_n`` contacts, any
    pair, only segments, only points on itself, none.  ``min_n`` takes each of ``limits``.
    """
    ends = pairs.select(F.col("pre").alias("id"), F.col("post").alias("partner"), "n").union(pairs.where("pre <> post").select("post", "pre", "n"))
    other, itself = F.expr("id <> partner"), F.expr("id = partner")
    counts = ends.groupBy("id").agg(
        F.count_if(other).alias("pairs"), *[F.count_if(other & (F.col("n") >= x)).alias(f"_strong_{x}") for x in limits],
        F.count_if(itself).alias("self_pairs"), F.count_if(F.col("n") == 1).alias("single_pairs"),
        F.sum("n").alias("points"), F.coalesce(F.sum(F.when(itself, F.col("n"))), F.lit(0)).alias("self_points"),
    )
    by_segment = segments.groupBy("id").agg(F.sum("n").alias("segment_points"))
    numbers = ["pairs", "self_pairs", "single_pairs", "points", "self_points", "segment_points"]
    df = nodes.join(counts, "id", "left").join(by_segment, "id", "left").fillna(0, [*numbers, *[f"_strong_{x}" for x in limits]])
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("min_n"), F.col(f"_strong_{x}").alias("strong_pairs")) for x in limits]))
    df = df.select("id", *numbers, each.alias("_limit")).select("_limit.min_n", "id", "_limit.strong_pairs", *numbers)
    band = review_band(F.col("id") == exception_id, F.col("strong_pairs") > 0, F.col("pairs") > 0, F.col("segment_points") > 0,
                       F.expr("points > 0 AND self_points = points"))
    order = [F.asc("band"), F.desc("strong_pairs"), F.desc("points"), F.asc("id")]
    return rank_within(df.withColumn("band", band), ["min_n"], order, "review_rank")
