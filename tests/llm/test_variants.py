"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tractum.llm import variants
from tractum.llm.queries import op13_variants


def plain_words(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            count[word] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_forms(words):
    near = {w: [] for w in words}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w in words:
        for m in (len(w) - 1, len(w), len(w) + 1):
            near[w] += [v for v in by_length.get(m, []) if v != w and one_apart(w, v)]
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = plain_forms(plain_words(rows))
    assert got(op13_variants(spark, folder)) == want
    assert any(w[1] for w in want)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_dense_words_over_many_ranges(spark, ranges):
    """Words over three letters: runs of equal letters, shared prefixes across ranges, chains of forms, ties."""
    rng = random.Random(ranges)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(7, 10))): rng.choice([2, 3, 25, 300, 4000]) for _ in range(700)}
    words |= {"aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaaa": 200, "z" * 3000: 2, "z" * 3001: 50, "z" * 1500 + "y" + "z" * 1500: 3}
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(list(words.items()), "word string, n long")
        assert got(variants.forms(df)) == plain_forms(words)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_texts_with_nulls_repeats_and_clashing_names(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "Another another ANOTHER anothér"), (4, "anothér " * 40 + "anothérs anothérs other"), (4, "anothér " * 40 + "anothérs"),
            (5, "x1Writing,writing_wrìting wrìting writin " * 30), (6, "q" * 60_000 + " " + "q" * 60_000)]
    df = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in rows], "doc_id long, text string, word string, n int, place int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_words(rows)
    assert got(op13_variants(spark, str(tmp_path))) == plain_forms(want)
    assert len(want) > 5


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert variants.forms(variants.vocabulary(df, "doc_id", "text")).count() == 0
