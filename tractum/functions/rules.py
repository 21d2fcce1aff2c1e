"""Ordered-rule classifiers over columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tractum.functions.columns import first_match


def first_rule(c: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Result of the first ``(regex, result)`` whose regex occurs in ``c``."""
    return first_match([(c.rlike(p), F.lit(r)) for p, r in rules], None if default is None else F.lit(default))


def prefix_category(c: Column, prefixes: Sequence[tuple[str, str]], default: str) -> Column:
    return first_match([(c.startswith(p), F.lit(r)) for p, r in prefixes], F.lit(default))


# The tiers of evidence, strongest first.
TIERS = ("A_raw_exception", "B_segment_contact", "C_type_only", "no_released_support")


def evidence_tier(raw: Column, segment: Column, hypothesis: Column) -> Column:
    """Strongest evidence a node has."""
    found = [(c, F.lit(tier)) for c, tier in zip((raw, segment, hypothesis), TIERS)]
    return first_match(found, F.lit(TIERS[-1]))


def review_band(exception: Column, strong: Column, weak: Column, segment: Column, self_only: Column) -> Column:
    return first_match(
        [
            (exception, F.lit("point_exception")), (strong, F.lit("strong_export")), (weak, F.lit("weak_pairs_only")),
            (segment, F.lit("segment_only")), (self_only, F.lit("self_contacts_only")),
        ],
        F.lit("no_direct_points"),
    )


def detector_class(both_known: Column, n_a: Column, n_b: Column) -> Column:
    """Six evidence classes of a (pair, region) seen by two detectors."""
    a, b = n_a > 0, n_b > 0
    return first_match(
        [
            (both_known & a & b, F.lit("pair_dual")), (both_known & a, F.lit("pair_only_a")),
            (both_known, F.lit("pair_only_b")), (a & b, F.lit("segment_dual")), (a, F.lit("segment_only_a")),
        ],
        F.lit("segment_only_b"),
    )


# Fixed order of the six classes in a review queue.
DETECTOR_RANK = ("pair_dual", "pair_only_a", "pair_only_b", "segment_dual", "segment_only_a", "segment_only_b")


def rank_of(c: Column, order: Sequence[str]) -> Column:
    return first_match([(c == v, F.lit(i)) for i, v in enumerate(order)], F.lit(len(order)))
