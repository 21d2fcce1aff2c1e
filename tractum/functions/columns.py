"""Column builders: cleaning, labels, domains, ids and numbers (no Python on rows)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that means "no value" in the published tables.
MISSING_TEXT = ("", "na", "nan", "none", "null", "<na>", "-")
# Spellings of sides and of booleans.
SIDES = {"l": "left", "left": "left", "r": "right", "right": "right", "m": "center", "center": "center"}
TRUE_TEXT, FALSE_TEXT = ("true", "t"), ("false", "f")
# 32-bit FNV-1a offset basis and prime.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
UNASSIGNED = "UNASGD"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Trimmed text, or NULL where the text stands for a missing value."""
    text = F.trim(_c(c))
    return F.when(F.lower(text).isin(*MISSING_TEXT), None).otherwise(text)


def strip_bom(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "^﻿", "")


def align_region(c: Column | str, unassigned: str = UNASSIGNED) -> Column:
    """Region label for comparisons; the literal stays in its own column."""
    c = _c(c)
    return F.when(c.isNull() | (F.trim(c) == "") | (c == "None"), unassigned).otherwise(c)


def first_text(*cs: Column | str) -> Column:
    """First non-empty text."""
    return F.coalesce(*[F.nullif(F.trim(_c(c)), F.lit("")) for c in cs])


def first_text_with_basis(candidates: Sequence[tuple[str, Column]]) -> Column:
    """struct(value, basis): the first non-empty candidate and its name."""
    value = first_text(*[c for _, c in candidates])
    basis = F.lit(None).cast("string")
    for name, c in reversed(candidates):
        basis = F.when(first_text(c).isNotNull(), name).otherwise(basis)
    return F.struct(value.alias("value"), basis.alias("basis"))


def in_unit_interval(c: Column | str) -> Column:
    return _c(c).between(0.0, 1.0)


def is_finite(c: Column | str) -> Column:
    c = _c(c).cast("double")
    return ~F.isnan(c) & (F.abs(c) != float("inf"))


def clip_probability(c: Column | str) -> Column:
    """Whatever is not finite becomes 0, the rest is clipped to [0, 1]; NULL stays."""
    c = _c(c).cast("double")
    return F.when(is_finite(c), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))).when(c.isNotNull(), F.lit(0.0))


def quantise_probability(c: Column | str) -> Column:
    """0..255, halves to even."""
    return F.bround(_c(c) * 255).cast("int")


def one_hot(c: Column | str, labels: Sequence[str]) -> list[Column]:
    """One 0/1 double per label; a label outside the list fails the job."""
    c = _c(c)
    known = F.when(c.isin(*labels), c).otherwise(F.raise_error(F.concat(F.lit("unknown label "), c)).cast("string"))
    return [(known == F.lit(x)).cast("double").alias(x) for x in labels]


def map_lookup(c: Column | str, table: Mapping[str, object], default: Column | None = None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), _c(c))
    return found if default is None else F.coalesce(found, default)


def normalize_side(c: Column | str) -> Column:
    return map_lookup(F.lower(F.trim(_c(c))), SIDES)


def side_relation(side: Column | str, region: Column | str) -> Column:
    """Whether a node's side agrees with the _L/_R suffix of a region."""
    suffix = F.right(_c(region), F.lit(2))
    region_side = F.when(suffix == "_L", "left").when(suffix == "_R", "right")
    return (
        F.when(region_side.isNull() | _c(side).isNull(), "unknown")
        .when(region_side == _c(side), "same_side")
        .otherwise("opposite_side")
    )


def match_status(a: Column | str, b: Column | str) -> Column:
    a, b = clean(a), clean(b)
    return F.when(a.isNull() | b.isNull(), "unknown").when(a == b, "same").otherwise("different")


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first rule whose condition holds."""
    (cond, value), *rest = rules
    out = F.when(cond, value)
    for cond, value in rest:
        out = out.when(cond, value)
    return out if default is None else out.otherwise(default)


def bucket(c: Column | str, lower_bounds: Sequence[int]) -> Column:
    """Labels like ``1``, ``2-4``, ``100+`` for ascending inclusive lower bounds."""
    c = _c(c)
    bounds = list(lower_bounds)
    rules = [(c >= bounds[-1], F.lit(f"{bounds[-1]}+"))]
    for lo, nxt in zip(reversed(bounds[:-1]), reversed(bounds[1:])):
        rules.append((c >= lo, F.lit(str(lo) if nxt - lo == 1 else f"{lo}-{nxt - 1}")))
    return first_match(rules, F.lit("below"))


def delta_class(n_a: Column | str, n_b: Column | str) -> Column:
    n_a, n_b = _c(n_a), _c(n_b)
    return (
        F.when(n_b.isNull(), "only_a")
        .when(n_a.isNull(), "only_b")
        .when(n_a == n_b, "both_same")
        .otherwise("both_different")
    )


def signed_weight(n: Column | str, excitatory: Column | str, inhibitory: Column | str, gain: float = 1.0) -> Column:
    return F.lit(gain) * F.log1p(_c(n)) * (_c(excitatory) - _c(inhibitory))


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def strict_int(c: Column | str) -> Column:
    return F.when(F.trim(_c(c)).rlike("^-?[0-9]+$"), F.expr(f"try_cast(trim({c}) AS BIGINT)"))


def strict_bool(c: Column | str) -> Column:
    text = F.lower(F.trim(_c(c)))
    return (
        F.when(text.isin(*TRUE_TEXT), True)
        .when(text.isin(*FALSE_TEXT), False)
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))
    )


def digits_only(c: Column | str) -> Column:
    return _c(c).rlike("^[0-9]+$")


def id_from_text(c: Column | str, lo: int = 15, hi: int = 20) -> Column:
    """Id of a ``id`` or ``id,id`` label, NULL if it has another form."""
    number = f"[0-9]{{{lo},{hi}}}"
    first = F.regexp_extract(_c(c), f"^({number})(,{number})?$", 1)
    return F.nullif(first, F.lit("")).try_cast("long")


def rebuild_id(prefix: str, suffix: Column | str, width: int = 9) -> Column:
    """Full id from a shared prefix and a suffix that lost its leading zeros."""
    return F.concat(F.lit(prefix), F.lpad(_c(suffix).cast("string"), width, "0")).cast("long")


def distance(a: Sequence[Column | str], b: Sequence[Column | str]) -> Column:
    total = None
    for p, q in zip(a, b):
        d = _c(p) - _c(q)
        total = d * d if total is None else total + d * d
    return F.sqrt(total)


def joint_rms(pre_a, post_a, pre_b, post_b) -> Column:
    """Root mean square of the pre-site and the post-site distance."""
    total = None
    for p, q in zip([*pre_a, *post_a], [*pre_b, *post_b]):
        d = _c(p) - _c(q)
        total = d * d if total is None else total + d * d
    return F.sqrt(total / 2)


def segment_fraction(p, a, b) -> Column:
    """Where on segment a-b (0..1, clamped) the point p projects; 0 if a = b."""
    dot, length2 = None, None
    for pi, ai, bi in zip(p, a, b):
        step = _c(bi) - _c(ai)
        part = (_c(pi) - _c(ai)) * step
        dot = part if dot is None else dot + part
        length2 = step * step if length2 is None else length2 + step * step
    t = F.coalesce(F.try_divide(dot, length2), F.lit(0.0))
    return F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))


def segment_distance(p, a, b) -> Column:
    t = segment_fraction(p, a, b)
    foot = [_c(ai) + t * (_c(bi) - _c(ai)) for ai, bi in zip(a, b)]
    return distance(p, foot)


def fnv1a(c: Column | str) -> Column:
    """32-bit FNV-1a of ASCII text, as BIGINT, without leaving the JVM."""
    chars = F.split(_c(c).cast("string"), "")
    return F.aggregate(
        chars,
        F.lit(FNV_OFFSET).cast("long"),
        lambda h, ch: F.when(ch == "", h).otherwise(
            h.bitwiseXOR(F.ascii(ch).cast("long")).__mul__(F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(4294967295))
        ),
    )


def join_limited(values: Column, limit: int, sep: str = ";") -> Column:
    """First ``limit`` of a sorted array joined, then ``...(N total)``."""
    head = F.array_join(F.slice(values, 1, limit), sep)
    return F.when(F.size(values) <= limit, head).otherwise(
        F.concat(head, F.lit("...("), F.size(values).cast("string"), F.lit(" total)"))
    )


def argmax_names(columns: Mapping[str, Column | str]) -> Column:
    """Array of the names whose column equals the largest column."""
    top = F.greatest(*[_c(c) for c in columns.values()])
    return F.array_compact(F.array(*[F.when(_c(c) == top, name) for name, c in columns.items()]))


def canonical_json(columns: Sequence[str]) -> Column:
    """JSON text with keys in name order."""
    return F.to_json(F.struct(*sorted(columns)))
