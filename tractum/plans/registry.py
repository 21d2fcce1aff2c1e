"""Text and file registries: scrub, classify, include, link check, upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractum.functions.columns import first_match
from tractum.sources.tables import spread

# Patterns of secrets (counted, never published), of personal
# home folders and of private session addresses (replaced), of local addresses
# (counted), and of links that are not checked.
SECRETS = {
    "private_key": r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----",
    "service_token": r"\b(?:sk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{32,}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|AKIA[A-Z0-9]{16})\b",
}
HOME = r"""(?i)[A-Za-z]:[\\/]+Users[\\/]+[^\\/\s"'<>]+|/(?:home|Users)/[^/\s"'<>]+"""
SESSION = r"""(?i)https?://chatgpt\.com/c/[a-f0-9-]{16,}[^\s"<>]*|codex://threads/[a-f0-9-]{16,}[^\s"<>]*"""
LOCAL = r"""https?://(?:localhost|127\.0\.0\.1)(?::\d+)?[^\s"<>)]*"""
NOT_LOCAL = "^(https?:|#|mailto:)"
REPLACEMENTS = (("session", SESSION, "<PRIVATE_SESSION_URL_REMOVED>"), ("home", HOME, "<USER_HOME>"))


def scrub_text(df: DataFrame, column: str) -> DataFrame:
    """Replaces what must not be published and counts it per rule; rows with a
    secret are marked as not publishable and their text withheld."""
    df = spread(df)
    text, counts = F.col(column), []
    for name, pattern, replacement in REPLACEMENTS:
        counts.append(F.regexp_count(text, F.lit(pattern)).alias(f"n_{name}"))
        text = F.regexp_replace(text, pattern, replacement)
    counts.append(F.regexp_count(F.col(column), F.lit(LOCAL)).alias("n_local"))
    found = [F.regexp_count(F.col(column), F.lit(p)).alias(f"n_{name}") for name, p in SECRETS.items()]
    publishable = ~F.col(column).rlike("|".join(f"(?:{p})" for p in SECRETS.values()))
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *counts, *found, publishable.alias("publishable"), F.when(publishable, text).alias(column))


def classify(df: DataFrame, rules: Sequence[tuple[Column, str, str]], default: tuple[str, str]) -> DataFrame:
    """Adds ``status`` and ``license`` of the first rule that holds."""
    status = first_match([(c, F.lit(s)) for c, s, _ in rules], F.lit(default[0]))
    licence = first_match([(c, F.lit(x)) for c, _, x in rules], F.lit(default[1]))
    return df.withColumn("status", status).withColumn("license", licence)


def include(df: DataFrame, rules: Sequence[tuple[Column, bool, str]], default: tuple[bool, str]) -> DataFrame:
    """Adds ``included`` and ``reason`` of the first rule that holds."""
    included = first_match([(c, F.lit(i)) for c, i, _ in rules], F.lit(default[0]))
    reason = first_match([(c, F.lit(r)) for c, _, r in rules], F.lit(default[1]))
    return df.withColumn("included", included).withColumn("reason", reason)


def check_links(pages: DataFrame, text: str, pattern: str, targets: DataFrame, skip: str = NOT_LOCAL) -> DataFrame:
    """(page_id, link, target, found) for each distinct local link of a text;
    the part after ``#`` does not name another target."""
    links = pages.select("page_id", F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("link"))
    local = links.where(~F.col("link").rlike(skip)).distinct().withColumn("target", F.split_part("link", F.lit("#"), F.lit(1)))
    known = targets.toDF("target").distinct().withColumn("_there", F.lit(True))
    return local.join(known, "target", "left").withColumn("found", F.col("_there").isNotNull()).drop("_there")


def upsert(entries: DataFrame, key: str, load_order: str) -> DataFrame:
    """Last entry per key; the position of its first load is kept."""
    rest = [c for c in entries.columns if c not in (key, load_order)]
    last = entries.groupBy(key).agg(F.max_by(F.struct(*rest), load_order).alias("_e"), F.min(load_order).alias("position"),
                                    F.count("*").alias("n_loads"))
    return last.select(key, "_e.*", "position", "n_loads")
