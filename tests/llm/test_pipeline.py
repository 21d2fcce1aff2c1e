"""The pipeline against its stages' plain versions."""

import re

import corpus_pipeline as P
from test_secrets import plain as plain_spans

WORDS = r"[^\x20\x09-\x0D]+"


def test_stages_on_whole_table(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [{r.doc_id: r for r in docs.collect()}]
    current = docs
    for i, (_, step) in enumerate(P.STAGES):
        step(spark, current, folder).write.parquet(str(tmp_path / str(i)))
        current = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert current.schema.simpleString() == docs.schema.simpleString()
        tables.append(current.collect())
    start, ruled, single, clean, mixed, packed = tables
    # Rules: the base rules hold, labelled good documents that pass them stay, texts are untouched.
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id for r in ruled}
    assert all(r == start[r.doc_id] for r in ruled) and len(ruled) == len(kept)
    for i, r in start.items():
        if len(re.findall(WORDS, r.text or "")) < 20:
            assert i not in kept
    assert sum(i in kept for i, q in labels.items() if q) > 0.9 * sum(labels.values())
    # Copies: of equal texts one stays, the least id; no other text disappears without a partner.
    least = {}
    for r in ruled:
        least[r.text] = min(r.doc_id, least.get(r.text, r.doc_id))
    ids = {r.doc_id for r in single}
    assert ids <= set(least.values()) and len(ids) > 0.97 * len(least)
    # Secrets: every fixed span is gone.
    assert {r.doc_id for r in clean} == ids
    for r in clean:
        assert r.n_chars == len(r.text) and (r.text == start[r.doc_id].text or "<SECRET>" in r.text)
        assert not any(k > 0 for _, k, _ in plain_spans(r.text))
        if not plain_spans(start[r.doc_id].text) and "<SECRET>" not in r.text:
            assert r.text == start[r.doc_id].text
    # Mix: copies of the clean documents, three at most.
    clean_rows = {r.doc_id: r for r in clean}
    copies = {}
    for r in mixed:
        assert r == clean_rows[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3
    # Packing: all words and end marks.
    assert sum(r.length for r in packed) == sum(len(re.findall(WORDS, r.text)) + 1 for r in mixed)


def test_edges(spark, tmp_path):
    good = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    rows = [(1, good, "en", "a", 5, "x"), (2, good, "en", "a", 5, "x"), (3, None, None, None, None, None), (None, good + " more", None, None, 0, "x"), (4, "", "en", "b", 0, ""), (5, good[::-1], "en", "b", 3, "y"), (5, good[::-1], "en", "b", 3, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = P.quality_rules(spark, df, str(tmp_path))
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1, 2, 5, 5]
    docs = P.near_duplicates(spark, docs, str(tmp_path))
    assert sorted(r.doc_id or 0 for r in docs.collect()) in ([0, 1, 5, 5], [1, 5, 5])
    assert P.run(spark, str(tmp_path)).count() > 0
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0
