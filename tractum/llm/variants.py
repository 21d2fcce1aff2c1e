"""Spelling variants: words at edit distance one, found through pairs of trie nodes.

The words are put into a trie and, reversed, into a second one, and the nodes
of both are numbered.  A word of m letters passes the pairs (node of its first
i letters, node of its last m - i - 1 letters): all but letter i.  Two words
that share such a pair differ by the letter at i.  The pairs (first i, last
m - i) stand for a word with room for one more letter at i; such a pair met by
a skipped one is an insertion.  Pairs are integers and exact: no candidate
needs a check, and a pair is shared by at most as many words as there are
letters.

A trie over sorted words needs no links: a word adds the nodes below its common
prefix with the word before.  Words are sorted by range; each range numbers its
own new nodes, and one row per range tells the next what its first word shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractum.session import stage

LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
ROOT = -1  # number of the empty prefix


def vocabulary(docs: DataFrame, id_column: str, text: str, lose: int | None = None) -> DataFrame:
    """``word`` and ``n`` of the words of at least ``LEAST_LENGTH`` letters and
    ``LEAST_COUNT`` occurrences in whole texts; A-Z are lower-cased.

    ``lose``: where it divides h, the unsigned CRC-32 of ``<id>:<word>``, the
    occurrence loses its letter h % length (a null id is written as nothing).
    Null, empty and blank texts have no words.
    """
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    words = runs.where(F.length("run") >= LEAST_LENGTH).select("id", F.translate("run", UPPER, LOWER).alias("word"))
    if lose is not None:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (F.col("h") % F.length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.withColumn("h", h).select(F.when(F.col("h") % lose == 0, shorter).otherwise(F.col("word")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _shared(a: str, b: str) -> int:
    return len(commonprefix((a, b)))


def _in_order(frames: Iterator[pa.RecordBatch]) -> list[tuple[int, str]]:
    """(place, word) in order of place."""
    got = [(f.column(0).to_pylist(), f.column(1).to_pylist()) for f in frames]
    return sorted((at, word) for places, words in got for at, word in zip(places, words))


def _ends(rows: pa.Table) -> pa.Table:
    """Of a range: number of nodes, first and last word, and the nodes of the last word, numbered from 0."""
    words = _in_order(rows.select(["place", "word"]).to_batches())
    path, n, before = [], 0, ""
    for _, word in words:
        common = _shared(before, word)
        path[common:] = range(n, n + len(word) - common)
        n += len(word) - common
        before = word
    return pa.table({"part": rows.column("part").slice(0, 1), "n": [n], "first": [words[0][1]], "last": [before], "path": pa.array([path], pa.list_(pa.int64()))})


def numbered(words: DataFrame, reverse: bool) -> DataFrame:
    """``word``, ``place`` (in code-point order of the words, or of the
    reversed ones) and ``nodes``: the number of the trie node at each depth
    from 0.  Runs jobs: the sorted words are staged, and one row per range is
    brought together to number the ranges one after the other."""
    key = F.reverse("word") if reverse else F.col("word")
    rows = words.select(key.alias("word"))
    rows = stage(rows.repartitionByRange("word").sortWithinPartitions("word").withColumn("place", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("place", 33))
    ends = rows.groupBy("part").applyInArrow(_ends, "part long, n long, first string, last string, path array<bigint>").collect()
    starts, base, before, path = {}, 0, "", []
    for end in sorted(ends, key=lambda r: r["part"]):
        carried = path[:_shared(before, end["first"])]
        starts[end["part"]] = (base, carried)
        through = min(len(carried), _shared(end["first"], end["last"]))  # nodes of the last word that older ranges made
        path = carried[:through] + [base + x for x in end["path"][through:]]
        base, before = base + end["n"], end["last"]

    def number(rows: pa.Table) -> pa.Table:
        base, carried = starts[rows.column("part")[0].as_py()]
        places, names, lists = [], [], []
        path, n, before = list(carried), base, ""
        for place, word in _in_order(rows.select(["place", "word"]).to_batches()):
            common = _shared(before, word)
            new = list(range(n, n + len(word) - common))
            n += len(new)
            if not before:  # what the first word shares with the range before has its number there
                new[:len(carried)] = carried
            path[common:] = new
            before = word
            places.append(place)
            names.append(word[::-1] if reverse else word)
            lists.append([ROOT, *path])
        return pa.table({"word": pa.array(names, pa.string()), "place": pa.array(places, pa.int64()), "nodes": pa.array(lists, pa.list_(pa.int64()))})

    return rows.groupBy("part").applyInArrow(number, "word string, place long, nodes array<bigint>")


def _pairs_of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node pairs of each word: role 0 has room for a letter, 1 and 2 skip
    one.  Role 2: the letter repeats the one before it, so that the same
    shorter word comes from skipping that one."""
    for frame in frames:
        for row in range(0, frame.num_rows, 2000):
            some = frame.slice(row, 2000)
            lengths = np.array([len(w) for w in some.column(0).to_pylist()])
            letters = np.frombuffer("".join(some.column(0).to_pylist()).encode("utf-32-le"), np.uint32)
            ahead, behind = some.column(3).flatten().to_numpy(), some.column(4).flatten().to_numpy()
            first = np.cumsum(lengths + 1) - (lengths + 1)  # of the word's nodes: one more than letters
            word = np.repeat(np.arange(len(lengths)), lengths + 1)
            i = np.arange(len(word)) - first[word]
            own = first[word] + lengths[word] - i
            room = (ahead, behind[own], word, np.zeros(len(word), np.int8))
            skip = np.flatnonzero(i < lengths[word])
            at = skip - word[skip]  # place of the skipped letter among all letters
            again = (i[skip] > 0) & (letters[at] == letters[at - 1])
            left = (ahead[skip], behind[own[skip] - 1], word[skip], 1 + again.astype(np.int8))
            p, s, word, role = (np.concatenate(x) for x in zip(room, left))
            place, n = some.column(1).to_numpy(), some.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(s), pa.array(place[word]), pa.array(n[word]), pa.array(role)], names=["p", "s", "place", "n", "role"])


def _meet(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words from rows sorted by node pair; a pair's rows may go on in the next batch."""
    held = None
    names = ["a", "b", "n_b"]

    def near(cols):
        p, s, place, n, role = cols
        out = []
        step = 1
        x = np.arange(len(p))
        while len(x):
            x = x[x + step < len(p)]
            x = x[(p[x] == p[x + step]) & (s[x] == s[x + step])]
            y = x + step
            low = np.minimum(role[x], role[y])
            ok = (low > 0) | (np.maximum(role[x], role[y]) == 1)  # two skips, or room for a letter and a skip
            out.append((x[ok], y[ok]))
            step += 1
        x, y = (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        a, b, m = np.concatenate((place[x], place[y])), np.concatenate((place[y], place[x])), np.concatenate((n[y], n[x]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(m)], names=names)

    for frame in frames:
        if not frame.num_rows:
            continue
        cols = [c.to_numpy() for c in frame.columns]
        if held is not None:
            cols = [np.concatenate(c) for c in zip(held, cols)]
        p, s = cols[:2]
        last = np.flatnonzero((p != p[-1]) | (s != s[-1]))
        cut = last[-1] + 1 if len(last) else 0
        held = [c[cut:] for c in cols]
        if cut:
            yield near([c[:cut] for c in cols])
    if held is not None:
        yield near(held)


def near_words(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placed, near) for ``words`` (word not null and distinct, n).

    ``placed``: word, n and ``place``, which ascends in code-point order.
    ``near``: places ``a``, ``b`` of each two words at edit distance one and
    ``n_b``, once in each direction.
    """
    words = stage(words.select("word", "n"))
    ahead = numbered(words, False).select("word", "place", F.col("nodes").alias("ahead"))
    behind = numbered(words, True).select("word", F.col("nodes").alias("behind"))
    both = stage(words.join(ahead, "word").join(behind, "word").select("word", "place", "n", "ahead", "behind"))
    pairs = both.mapInArrow(_pairs_of, "p long, s long, place long, n long, role byte")
    near = pairs.repartition("p", "s").sortWithinPartitions("p", "s").mapInArrow(_meet, "a long, b long, n_b long")
    return both.select("word", "n", "place"), near


def forms(words: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word.

    A word's form is its near word of largest n (ties: the smallest word), if
    that is at least ``RATIO`` times the word's own; ``root`` follows forms to
    the last, by pointer jumping.  A word without near words has itself as its
    root.  An empty table gives no rows.
    """
    placed, near = near_words(words)
    best = near.groupBy("a").agg(F.count("*").alias("n_near"), F.max(F.struct("n_b", (-F.col("b")).alias("minus"))).alias("best"))
    joined = placed.join(best.withColumnRenamed("a", "place"), "place", "left")
    known = stage(joined.select("place", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                F.when(F.col("best.n_b") >= RATIO * F.col("n"), F.struct((-F.col("best.minus")).alias("place"), F.col("best.n_b").alias("n"))).alias("form")))
    steps = stage(known.where("form is not null").select("place", F.col("form.place").alias("to")))
    while True:
        further = steps.select(F.col("place").alias("to"), F.col("to").alias("next"))
        moved = stage(steps.join(further, "to", "left").select("place", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        steps = moved.select("place", "to")
        if moved.where("moved").isEmpty():
            break
    name = known.select(F.col("place").alias("_at"), F.col("word").alias("_name"))
    formed = known.where("form is not null").join(steps, "place")
    formed = formed.join(name.withColumnsRenamed({"_at": "_f", "_name": "form_word"}), F.col("form.place") == F.col("_f"))
    formed = formed.join(name.withColumnsRenamed({"_at": "_r", "_name": "root_word"}), F.col("to") == F.col("_r"))
    alone = known.where("form is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", F.lit(None).cast("long").alias("form_n"))
    return formed.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", F.col("form.n").alias("form_n")).unionByName(alone)
