"""Sketches, key reconciliation, cross checks and annotation coverage on small tables with planted faults."""

from pyspark.sql import functions as F

from tractum.operators import sketches as K
from tractum.plans import audits, reconcile
from tractum.session import stage

PTS = "pre long, post long, region string, name string"


def test_stored_sketches_merge(spark):
    """Three loads put together one by one equal one sketch of all, within the stated bound; NULL is no value."""
    df = spark.range(0, 60_000).select((F.col("id") % 7).alias("part"), (F.col("id") * 7919 % 30_011).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") + 10 ** 12).alias("b"))
    cols = ["a", "b"]
    stored = stage(K.part_sketches(df.where("part < 2"), ["part"], cols))
    for lo, hi in ((2, 5), (5, 7)):
        more = K.part_sketches(df.where(f"part >= {lo} and part < {hi}"), ["part"], cols)
        stored = stage(K.merged(stored.unionByName(more), cols, ["part"]))
    parts = K.estimates(K.across(K.merged(stored, cols), cols, "either"), [*cols, "either"]).first()
    whole = K.estimates(K.across(K.merged(K.part_sketches(df, [], cols), cols), cols, "either"), [*cols, "either"]).first()
    assert parts == whole
    for got, want in zip(parts, (30_011, 30_000, 60_011)):
        assert abs(got - want) <= K.BOUND * want


def figures(df):
    return {(r["section"], r["item"]): r["value"] for r in df.collect()}


def test_points_against_an_export_by_key(spark):
    points = spark.createDataFrame(
        [(1, 2, "r", "a"), (1, 2, "r", "b"), (1, 2, None, "c"), (1, 2, " ", "d"), (3, 3, "r", "e"), (7, 7, None, "f"), (7, 2, "r", "g"), (2, 7, "r", "h"), (4, 5, "r", "i")], PTS)
    conns = "pre long, post long, region string, n long"
    exact = [(1, 2, "r", 2), (1, 2, "UNASGD", 2), (4, 5, "r", 1)]
    good = figures(reconcile.key_recon(points, spark.createDataFrame(exact + exact[:1], conns), 7))
    assert {k[1]: v for k, v in good.items() if k[0] == "check"} == {"points_add_up": 1, "views_agree": 1, "keys_and_counts_equal": 1}
    assert good["keys", "equal"] == 3 and [good["points", k] for k in ("all", "self", "self_exception", "exception", "retained", "blank", "blank_retained", "exception_keys")] == [9, 1, 1, 2, 5, 3, 2, 2]
    faults = [(1, 2, "r", 3), (1, 2, "r", 2), (1, 2, "UNASGD", 9), (8, 9, "r", 1)]
    bad = figures(reconcile.key_recon(points, spark.createDataFrame(faults, conns), 7))
    assert {k[1]: v for k, v in bad.items() if k[0] == "check"} == {"points_add_up": 0, "views_agree": 0, "keys_and_counts_equal": 0}
    assert {k[1]: v for k, v in bad.items() if k[0] == "keys"} == {"equal": 1, "different_count": 1, "connection_only": 1, "point_only": 1}


def test_pairs_keep_all_their_points(spark):
    points = spark.createDataFrame([(1, 2, "r", f"{i:02}") for i in range(7)] + [(1, 2, None, "x"), (5, 4, "r", "y"), (5, 5, "r", "z"), (7, 1, "r", "w")], PTS)
    pairs = spark.createDataFrame([(1, 2)], "pre long, post long")
    out = reconcile.pair_candidates(points, pairs, spark.createDataFrame([(5, 4)], "pre long, post long"), 7, F.col("name"), chunk=3)
    got = sorted((r.review_rank, r.chunk, r.n, r.in_export, r.in_original, r.points) for r in out.collect())
    assert got == [(1, 0, 7, True, False, "00;01;02"), (1, 1, 7, True, False, "03;04;05"), (1, 2, 7, True, False, "06"), (2, 0, 1, True, False, "x"), (3, 0, 1, False, True, "y")]


def test_checks_stay_open_on_partial_scans(spark):
    rows = [("a", "sum", None, 10, True), ("b", "sum", None, 10, True), ("c", "sum", None, 12, True), ("p", "sum", None, 10, False),
            ("a", "by", "x", 4, True), ("a", "by", "y", 6, True), ("b", "by", "x", 4, True), ("b", "by", "z", 6, True)]
    df = spark.createDataFrame(rows, "product string, figure string, item string, value long, complete boolean")
    checks = [("same", "equal", ("a", "sum"), ("b", "sum")), ("more", "equal", ("a", "sum"), ("c", "sum")), ("most", "at_most", ("a", "sum"), ("c", "sum")), ("least", "at_most", ("c", "sum"), ("a", "sum")),
              ("partial", "equal", ("a", "sum"), ("p", "sum")), ("absent", "equal", ("a", "sum"), ("q", "sum")), ("items", "equal", ("a", "by"), ("b", "by"))]
    got = {r["name"]: (r.passed, r.n_unequal) for r in audits.cross_checks(df, checks).collect()}
    assert got == {"same": (True, 0), "more": (False, 1), "most": (True, 0), "least": (False, 1), "partial": (None, None), "absent": (None, None), "items": (False, 2)}


def test_annotations_without_a_universe(spark):
    nodes = spark.createDataFrame([(1, "a"), (1, "a"), (2, " "), (3, None)], "id long, kind string")
    got = {(r.metric, r.label): r.value for r in audits.annotation_coverage(nodes, ["kind"], None).collect()}
    assert got == {("coverage", "rows"): 4, ("coverage", "unique_ids"): 3, ("coverage", "repeated_rows"): 1, ("coverage", "matched_rows"): None, ("coverage", "matched_share_of_rows"): None,
                   ("coverage", "annotated_share_of_universe"): None, ("kind", "(missing)"): 2, ("kind", "a"): 2}
