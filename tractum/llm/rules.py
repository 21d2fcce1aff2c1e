"""Quality rules with risk-controlled thresholds.

Each rule is a score per document, higher is worse.  For each stratum, a tuning
part of the labelled documents proposes a cutoff per rule that rejects mostly
bad documents and picks the rules that add to each other; the held-out part
certifies them.  A cutoff is certified if the exact binomial (Clopper-Pearson)
upper bound of its false rejection rate is at most the rule's share of
``risk``.  Cutoffs of one rule are tested in a fixed sequence from the most to
the least tolerant, ending at the first failure, so a sequence has the error of
one test; over rules and strata the confidence is corrected by Bonferroni.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractum.llm.textops import SPACE, Words, segment_sum, text_slices, xxh64
from tractum.session import stage

SYMBOLS = "#*$%&|<>"
WINDOW = 8
GRID = 1000  # scores are whole numbers from 0 to GRID
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("symbols", "duplicate_lines", "repetition", "capitals", "punctuation", "digits", "long_words", "short_words")


def _signals(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    words = Words(data, offsets, lower=False)
    n = words.n_docs

    def per_doc(mask: np.ndarray) -> np.ndarray:
        return segment_sum(mask, offsets)

    space = (data == SPACE) | ((data >= 9) & (data <= 13))
    point = (data & 0xC0) != 0x80
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    lower = (data >= 97) & (data <= 122)
    # Lines with a word, as slices between line feeds and text borders.
    stops = np.unique(np.concatenate((np.flatnonzero(data == 10) + 1, offsets)))
    start, end = stops[:-1], stops[1:]
    end = end - (data[end - 1] == 10) if len(end) else end
    solid = np.concatenate(([0], np.cumsum(~space)))
    full = solid[end] > solid[start]
    start, end = start[full], end[full]
    line_doc = np.searchsorted(offsets, start, "right") - 1
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    line = pd.DataFrame({"d": line_doc, "h": xxh64(padded, start, end - start, 7), "n": end - start})
    n_lines = np.bincount(line_doc, minlength=n)
    n_dup = np.bincount(line_doc[line.duplicated().to_numpy()], minlength=n)
    # Windows of eight words, as sums of word hashes times powers.
    repeat = np.zeros(n, np.int64)
    if len(words.start) >= WINDOW:
        h, m = words.hashes(11), len(words.start) - WINDOW + 1
        with np.errstate(over="ignore"):
            window, power = np.zeros(m, np.uint64), np.uint64(1)
            for k in range(WINDOW):
                window += h[k:k + m] * power
                power *= np.uint64(0x9E3779B97F4A7C15)
        inside = words.doc[:m] == words.doc[WINDOW - 1:]
        at = np.flatnonzero(inside)
        again = pd.DataFrame({"d": words.doc[at], "w": window[at]}).duplicated(keep=False).to_numpy()
        mark = np.zeros(len(words.start) + 1, np.int64)
        np.add.at(mark, at[again], 1)
        np.add.at(mark, at[again] + WINDOW, -1)
        covered = np.cumsum(mark)[:-1] > 0
        repeat = np.bincount(words.doc[covered], minlength=n)
    return {
        "n_words": words.count, "word_chars": per_doc(point & ~space), "n_symbols": per_doc(np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8))),
        "n_dup_lines": n_dup, "n_repeat_words": repeat, "n_lines": n_lines, "n_upper": per_doc(upper), "n_lower": per_doc(lower), "n_digits": per_doc(digit),
        "n_punct": per_doc((data > 32) & (data < 127) & ~upper & ~lower & ~digit),
    }


def measure(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and the counts of ``_signals`` (long) for every text;
    null, empty and blank texts have zeros."""
    names = list(_signals(np.zeros(0, np.uint8), np.zeros(1, np.int64)))
    schema = df.select(*keep).schema
    for name in names:
        schema = schema.add(name, "long")

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for rows, data, offsets in text_slices(frame, "_text"):
                got = _signals(data, offsets)
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), *(pa.array(got[k].astype(np.int64)) for k in names)], names=[*keep, *names])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(batches, schema)


def scores() -> dict[str, Column]:
    """Rule scores from the counts, as whole numbers from 0 to ``GRID``."""
    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.least(F.lit(GRID), F.floor(part * GRID / whole))).otherwise(0).cast("int")

    c = F.col
    return {
        "symbols": share(c("n_symbols"), c("word_chars")), "duplicate_lines": share(c("n_dup_lines"), c("n_lines")), "repetition": share(c("n_repeat_words"), c("n_words")),
        "capitals": share(c("n_upper"), c("n_upper") + c("n_lower")), "punctuation": share(c("n_punct"), c("word_chars")), "digits": share(c("n_digits"), c("word_chars")),
        "long_words": share(c("word_chars"), c("n_words") * 50), "short_words": F.when(c("n_words") > 0, GRID - share(c("word_chars"), c("n_words") * 10)).otherwise(0).cast("int"),
    }


@dataclass(frozen=True)
class Risk:
    risk: float = 0.03  # share of good documents of a stratum that all rules together may reject
    error: float = 0.05  # chance that any certified cutoff breaks its bound
    precision: float = 0.9  # share of bad documents that each further step of a proposed cutoff must have
    gain: float = 0.05  # share of the bad documents that a further rule must catch
    tuning: float = 0.4  # share of the labelled documents that proposes; the rest certifies


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), in logs."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i]) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def cutoffs(labelled: DataFrame, stratum: str, good: Column, tuning: Column, risk: Risk = Risk()) -> DataFrame:
    """(stratum, rule, cutoff): scores above the cutoff are rejected; rules
    without a certified cutoff have no row.

    ``labelled``: rule scores, the stratum and what ``good`` and ``tuning``
    read.  All labelled rows count; they are reduced to counts per score (at
    most GRID + 1) or per set of rules (at most 2 ** rules) before grouping.
    Runs jobs and stages tables.
    """
    kind = labelled.schema[stratum].dataType.simpleString()
    rows = labelled.select(F.col(stratum).alias("stratum"), good.alias("good"), tuning.alias("tuning"), *RULES)
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("score")) for r in RULES])).alias("p")
    tune, fine = F.col("tuning"), F.col("good")
    hist = stage(rows.select("stratum", "good", "tuning", pairs).groupBy("stratum", "p.rule", "p.score").agg(
        F.count_if(tune & fine).alias("tune_good"), F.count_if(tune & ~fine).alias("tune_bad"), F.count_if(~tune & fine).alias("hold_good")))

    def propose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("score", ascending=False)
        # The cutoff down to which every step pays: bad ones found against good ones lost.
        value = ((1 - risk.precision) * part["tune_bad"] - risk.precision * part["tune_good"]).cumsum()
        fit = part[(value > 0) & (value == value.max())][:1]
        return pd.DataFrame({"stratum": fit["stratum"], "rule": fit["rule"], "proposed": fit["score"].astype("int32") - 1})

    proposed = stage(hist.groupBy("stratum", "rule").applyInPandas(propose, f"stratum {kind}, rule string, proposed int"))
    wide = _per_stratum(proposed, "proposed")
    sets = rows.where(tune & ~fine).join(wide, F.col("stratum").eqNullSafe(F.col("_stratum_of"))).select(
        "stratum", *[F.coalesce(F.col(r) > F.col(f"_{r}"), F.lit(False)).alias(r) for r in RULES]).groupBy("stratum", *RULES).agg(F.count("*").alias("n"))

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        """Greedily the rules that catch the most bad documents not yet caught."""
        left, chosen, least = part, [], max(1, risk.gain * part["n"].sum())
        while True:
            caught = {r: left.loc[left[r], "n"].sum() for r in RULES if r not in chosen}
            best = max(caught, key=caught.get, default=None)
            if best is None or caught[best] < least:
                break
            chosen.append(best)
            left = left[~left[best]]
        return pd.DataFrame({"stratum": [part["stratum"].iloc[0]] * len(chosen), "rule": chosen, "share": [1.0 / max(1, len(chosen))] * len(chosen)})

    picked = stage(sets.groupBy("stratum").applyInPandas(pick, f"stratum {kind}, rule string, share double"))
    level = risk.error / max(1, picked.count())
    tested = hist.alias("h").join(proposed.alias("p"), F.expr("h.stratum <=> p.stratum and h.rule = p.rule")).join(
        picked.alias("c"), F.expr("h.stratum <=> c.stratum and h.rule = c.rule")).select("h.stratum", "h.rule", "h.score", "h.hold_good", "p.proposed", "c.share")

    def certify(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("score", ascending=False)
        n, best = int(part["hold_good"].sum()), None
        for score, k, last, share in zip(part["score"], part["hold_good"].cumsum(), part["proposed"], part["share"]):
            if score <= last or n == 0 or binomial_tail(int(k), n, risk.risk * share) > level:
                break
            best = int(score) - 1
        found = [] if best is None else [best]
        return pd.DataFrame({"stratum": part["stratum"].iloc[:len(found)], "rule": part["rule"].iloc[:len(found)], "cutoff": pd.array(found, "int32")})

    return tested.groupBy("stratum", "rule").applyInPandas(certify, f"stratum {kind}, rule string, cutoff int")


def _per_stratum(limits: DataFrame, value: str) -> DataFrame:
    return limits.groupBy(F.col("stratum").alias("_stratum_of")).agg(*[F.max(F.when(F.col("rule") == r, F.col(value))).alias(f"_{r}") for r in RULES])


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def fit(signals: DataFrame, labels: DataFrame, id_column: str, stratum: str, label: str = "quality", risk: Risk = Risk()) -> DataFrame:
    """One row of certified cutoffs per stratum, from the labelled rows of
    ``signals`` that pass the base rules.  Runs jobs."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg((F.min(label) > 0).alias("_good"))
    scored = signals.where(~_base_failed()).select(id_column, stratum, *[s.alias(name) for name, s in scores().items()])
    labelled = scored.join(known, F.col(id_column) == F.col("_id"))
    tuning = F.pmod(F.xxhash64("_id"), F.lit(1000)) < int(1000 * risk.tuning)
    return stage(_per_stratum(cutoffs(labelled, stratum, F.col("_good"), tuning, risk), "cutoff"))


def verdicts(signals: DataFrame, stratum: Column, limits: DataFrame) -> DataFrame:
    """Adds ``base_failed``, ``failed`` (rules that reject) and ``kept``."""
    scored = signals.withColumns({"base_failed": _base_failed(), **{f"_score_{name}": s for name, s in scores().items()}})
    joined = scored.join(limits, stratum.eqNullSafe(F.col("_stratum_of")), "left")
    failed = F.filter(F.array(*[F.when(F.col(f"_score_{r}") > F.col(f"_{r}"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    out = joined.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    return out.drop("_stratum_of", *[f"_{r}" for r in RULES], *[f"_score_{r}" for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", risk: Risk = Risk()) -> DataFrame:
    """``id_column``, the base counts, ``base_failed``, ``kept`` and ``failed``
    (the rules that reject it) for every row of ``docs``.

    Base rules: fewer than 20 words, or over 30 % of the words in repeated
    windows.  The learned rules judge the rest; a stratum without enough
    labels rejects nothing.  Null texts have no words and fail.  A null stratum
    is a stratum; null labels and ids don't take part in learning.  Rows with
    the same id are judged each.  Building the result runs jobs.
    """
    signals = stage(measure(docs.select(id_column, text, F.col(stratum).alias("_stratum")), text, [id_column, "_stratum"]))
    limits = fit(signals, labels, id_column, "_stratum", label, risk)
    return verdicts(signals, F.col("_stratum"), limits).select(id_column, *BASE, "base_failed", "kept", "failed")


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", risk: Risk = Risk()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, judged row by row, so rows
    with a null or repeated id are judged by their own text.  Runs jobs."""
    signals = stage(measure(docs.select(id_column, text, F.col(stratum).alias("_stratum")), text, [id_column, "_stratum"]))
    limits = fit(signals, labels, id_column, "_stratum", label, risk)
    rows = measure(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_own")), "_own", ["_row"])
    return verdicts(rows, F.col(f"_row.{stratum}"), limits).where("kept").select("_row.*")
