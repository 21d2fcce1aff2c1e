"""Secret scan in DataFrame functions only: fixed patterns, and character
Markov models of random strings and ordinary identifiers.

A candidate string is a secret if the log-likelihood ratio of the two models,
summed over its character transitions, exceeds a threshold.  The models are
trained from labelled samples: values that the patterns find (random) and the
words of the same texts outside them (ordinary).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the contract, in their listed order.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",  # AKIA[A-Z0-9]+ of 16 or more characters
    "hex": r"[0-9a-f]{32,}",  # maximal runs of 32 or more
}
KINDS = (*PATTERNS, "random")
LEAST_ASSIGNED = 8
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
WORD = r"[A-Za-z][A-Za-z0-9+/_=-]{7,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
STATES = len(ALPHABET) + 1  # 0: any other character
SAMPLE_DOCS = 20_000  # expected number of documents that train the models
THRESHOLD = 12.0  # log-odds that a candidate must reach
CHUNK = 256


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _found(df: DataFrame, text: str, pattern: str, name: str, group: int | None = None) -> DataFrame:
    """Adds ``name``: array of (start, end, value) of all matches, in code
    points; ``value`` is the match or its ``group``.

    Splitting at the matches gives the text between them, so positions are
    sums of lengths.  They are summed in chunks, which keeps a text with very
    many matches from quadratic work.
    """
    t, p = F.col(text), F.lit(pattern)
    hit = t.rlike(pattern)
    df = df.withColumn("_gaps", F.when(hit, F.transform(F.split(t, pattern, -1), lambda x: F.length(x).cast("long"))))
    df = df.withColumn("_all", F.when(F.col("_gaps").isNotNull(), F.regexp_extract_all(t, p, F.lit(0))))
    df = df.withColumn("_values", F.col("_all") if group is None else F.when(F.col("_gaps").isNotNull(), F.regexp_extract_all(t, p, F.lit(group))))
    df = df.withColumn("_lengths", F.transform("_all", lambda x: F.length(x).cast("long")))
    df = df.withColumn("_steps", F.zip_with("_gaps", "_lengths", lambda a, b: a + F.coalesce(b, F.lit(0).cast("long"))))
    last = F.ceil(F.size("_steps") / CHUNK).cast("int") - 1
    df = df.withColumn("_sums", F.transform(F.sequence(F.lit(0), last), lambda k: _sum(F.slice("_steps", k * CHUNK + 1, F.lit(CHUNK)))))
    df = df.withColumn("_before", F.transform(F.sequence(F.lit(0), last), lambda k: _sum(F.slice("_sums", F.lit(1), k))))

    def place(value: Column, i: Column) -> Column:
        chunk = F.floor(i / CHUNK).cast("int")
        start = F.get("_before", chunk) + _sum(F.slice("_steps", chunk * CHUNK + 1, i - chunk * CHUNK)) + F.get("_gaps", i)
        return F.struct(start.alias("start"), (start + F.get("_lengths", i)).alias("end"), value.alias("value"))

    spans = F.coalesce(F.transform("_values", place), F.array().cast("array<struct<start:bigint,end:bigint,value:string>>"))
    return df.withColumn(name, spans).drop("_gaps", "_all", "_values", "_lengths", "_steps", "_sums", "_before")


def _base(df: DataFrame, text: str) -> DataFrame:
    for kind, pattern in PATTERNS.items():
        df = _found(df, text, pattern, f"_{kind}", 2 if kind == "assign" else None)
    return df.withColumn("_assign", F.filter("_assign", lambda x: F.length(x["value"]) >= LEAST_ASSIGNED))


def _state(value: Column, at: Column) -> Column:
    return F.instr(F.lit(ALPHABET), F.substr(value, at, F.lit(1)))


def labelled_samples(df: DataFrame, id_column: str, text: str, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(value, random, n): strings of a hash-chosen sample of documents, about
    ``sample_docs`` of them or all if there are fewer."""
    rows = df.count()
    share = 1.0 if rows <= sample_docs else sample_docs / rows
    chosen = df.where(F.pmod(F.xxhash64(id_column), F.lit(1_000_000)) < int(share * 1_000_000)).select(F.coalesce(text, F.lit("")).alias("_t"))
    marked = _base(chosen, "_t")
    values = F.concat(*[F.transform(f"_{k}", lambda x: F.struct(x["value"].alias("value"), F.lit(True).alias("random"))) for k in PATTERNS])
    rest = F.col("_t")
    for pattern in PATTERNS.values():
        rest = F.regexp_replace(rest, pattern, " ")
    words = F.transform(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0)), lambda x: F.struct(x.alias("value"), F.lit(False).alias("random")))
    return marked.select(F.explode(F.concat(values, words)).alias("s")).groupBy("s.value", "s.random").agg(F.count("*").alias("n"))


def train(samples: DataFrame, random_prior: float = float(STATES), ordinary_prior: float = 2.0) -> list[float]:
    """Log-likelihood ratios of all transitions, by row of the first state.

    ``samples``: (value, random, n).  The priors are the weight of a uniform
    distribution in each row.  The result has STATES squared entries; only the
    counts of transitions reach the driver.
    """
    v = F.col("value")
    steps = F.explode(F.transform(F.sequence(F.lit(2), F.length(v)), lambda i: F.struct(_state(v, i - 1).alias("a"), _state(v, i).alias("b")))).alias("p")
    counts = samples.where(F.length(v) >= 2).select("random", "n", steps).groupBy("random", "p.a", "p.b").agg(F.sum("n").alias("n")).collect()
    table = {True: {}, False: {}}
    total = {True: [0] * STATES, False: [0] * STATES}
    for r in counts:
        table[r.random][r.a, r.b] = r.n
        total[r.random][r.a] += r.n

    def logp(kind: bool, prior: float, a: int, b: int) -> float:
        return math.log((table[kind].get((a, b), 0) + prior / STATES) / (total[kind][a] + prior))

    return [logp(True, random_prior, a, b) - logp(False, ordinary_prior, a, b) for a in range(STATES) for b in range(STATES)]


def ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string: random against ordinary."""
    table = F.lit(model)
    return F.aggregate(F.sequence(F.lit(2), F.length(value)), F.lit(0.0),
                       lambda acc, i: acc + F.element_at(table, _state(value, i - 1) * STATES + _state(value, i) + 1))


def _with_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def scan(df: DataFrame, text: str, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``df`` and ``secrets``: array of (start, kind, end) in
    order, ``kind`` an index into KINDS, code points, end exclusive.

    Candidates of the models are runs of 16 or more characters with a letter;
    numbers alone are no secrets.  One that overlaps a pattern's span adds
    nothing.  Null and empty texts have none.  A column ``secrets`` of ``df``
    is replaced; names that start with an underscore are reserved.
    """
    rows = _base(df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))), "_t")
    rows = _found(rows, "_t", CANDIDATE, "_candidates")
    spans = [_with_kind(F.col(f"_{k}"), i) for i, k in enumerate(PATTERNS)]
    rows = rows.withColumn("_spans", F.concat(*spans))
    fresh = F.filter("_candidates", lambda c: c["value"].rlike("[A-Za-z]") & ~F.exists("_spans", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])) & (ratio(c["value"], model) > threshold))
    more = _with_kind(fresh, len(PATTERNS))
    return rows.withColumn("secrets", F.array_sort(F.concat("_spans", more))).drop("_t", "_spans", "_candidates", *[f"_{k}" for k in PATTERNS])


def fit(df: DataFrame, id_column: str, text: str, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Models trained from the texts themselves; runs a job."""
    return train(labelled_samples(df, id_column, text, sample_docs))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str, mark: str = "<SECRET>") -> DataFrame:
    """Replaces each span of ``secrets`` (overlapping ones together) by
    ``mark`` and drops the column.  Texts without a span are unchanged."""
    n = F.size("secrets")
    ends = F.transform("secrets", lambda s: s["end"])
    rows = df.withColumn("_ends", ends)
    last = F.ceil(n / CHUNK).cast("int") - 1
    rows = rows.withColumn("_tops", F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.array_max(F.slice("_ends", k * CHUNK + 1, F.lit(CHUNK))))))

    def reach(i: Column) -> Column:
        """Largest end of the spans before the i-th, found by chunks."""
        chunk = F.floor(i / CHUNK).cast("int")
        return F.greatest(F.array_max(F.slice("_tops", F.lit(1), chunk)), F.array_max(F.slice("_ends", chunk * CHUNK + 1, i - chunk * CHUNK)), F.lit(0).cast("long"))

    rows = rows.withColumn("_reach", F.transform("secrets", lambda s, i: reach(i)))
    t = F.col(text)
    parts = F.transform("secrets", lambda s, i: F.when(s["start"] >= F.get("_reach", i), F.concat(
        F.substr(t, (F.get("_reach", i) + 1).cast("int"), (s["start"] - F.get("_reach", i)).cast("int")), F.lit(mark))).otherwise(F.lit("")))
    tail = F.substr(t, (F.array_max("_ends") + 1).cast("int"))
    clean = F.when(n > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(t)
    return rows.withColumn(text, clean).drop("_ends", "_tops", "_reach", "secrets")
