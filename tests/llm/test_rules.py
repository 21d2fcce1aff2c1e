"""Quality signals against a plain version; certified cutoffs against their bound."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tractum.llm import rules
from tractum.llm.queries import op6_quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_signals_on_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op6_quality(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_edge_texts(spark):
    texts = [None, "", " \t\n", "a", "\n\nx\n x\nx\n", "a b c d e f g h " * 9000, "é" * 50, "x\r\nx\r\n x", "a a a a a a a a a", "<b>#1</b>\x0b\x0cend"]
    df = spark.createDataFrame([(i, t, "n_words", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = {r.doc_id: r for r in rules.judge(df, labels).collect()}
    for i, t in enumerate(texts):
        assert tuple(rows[i][c] for c in rules.BASE) == plain(t), t
    assert rules.judge(df.limit(0), labels).count() == 0


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 0, 0.3), (40, 7, 0.2), (500, 3, 0.01), (5, 5, 0.5)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(rules.binomial_tail(k, n, p) - want) < 1e-9


def labelled(spark, n, noise):
    """Bad documents score over 500 for symbols; ``noise`` of the good ones do too."""
    x = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("u"), (F.col("id") % 5 == 0).alias("bad"), "id")
    score = F.when(F.col("bad") | (F.col("u") < int(noise * 1000)), 600 + F.col("u") % 100).otherwise(F.col("u") % 300).cast("int")
    zero = [F.lit(0).alias(r) for r in rules.RULES if r != "symbols"]
    return x.select("id", "bad", F.lit(None).cast("string").alias("s"), score.alias("symbols"), *zero)


def test_cutoffs_hold_their_bound(spark):
    good, tuning = ~F.col("bad"), F.col("id") % 10 < 4
    found = rules.cutoffs(labelled(spark, 10_000, 0.0), "s", good, tuning).collect()
    assert [(r.stratum, r.rule) for r in found] == [(None, "symbols")] and 300 <= found[0].cutoff < 600
    # Too few labels: nothing is certified.  Good documents beyond the proposal: only what the bound allows.
    assert rules.cutoffs(labelled(spark, 100, 0.0), "s", good, tuning).count() == 0
    noisy = labelled(spark, 10_000, 0.06)
    found = rules.cutoffs(noisy, "s", good, tuning, rules.Risk(precision=0.5)).collect()
    fine = noisy.where("not bad")
    assert all(fine.where(F.col("symbols") > r.cutoff).count() <= 0.03 * fine.count() for r in found)
    assert fine.where("symbols >= 600").count() > 0.05 * fine.count()
