"""Token files: exact round trips, the tokenizer's own ids, damage is found."""

import json
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tractum.llm import tokenfile
from tractum.llm.queries import op2_tokens

ENCODER = tokenfile.Encoder("word_bpe_49k.json")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535), max_size=60), min_size=1, max_size=8))
def test_coder_round_trip(blocks):
    arrays = [np.array(b, np.int64) for b in blocks]
    back = tokenfile.decode(tokenfile.encode(arrays), [len(a) for a in arrays])
    assert all(np.array_equal(a, b) for a, b in zip(arrays, back))


def test_coder_compresses_what_repeats():
    rng = random.Random(1)
    line = [rng.randrange(49408) for _ in range(60)]
    blocks = [np.array((line * 70)[:4096]), np.array([rng.choice(line[:8]) for _ in range(4096)]), np.array([rng.randrange(65536) for _ in range(4096)])]
    coded = tokenfile.encode(blocks)
    assert len(coded[0]) < 0.15 * 8192 and len(coded[1]) < 0.3 * 8192 and len(coded[2]) < 1.1 * 8192
    assert all(np.array_equal(a, b) for a, b in zip(blocks, tokenfile.decode(coded, [4096] * 3)))


def check(rows, table):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for r in sorted(table, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[1]), want


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    got, want = check(op2_tokens(spark, folder).collect(), spark.read.parquet(f"{folder}/documents.parquet").collect())
    assert got == want


@pytest.mark.parametrize("shard", [48 << 20, 2000])
def test_edges(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(tokenfile, "SHARD_BYTES", shard)
    texts = [None, "", "  \t\n", "Hello  WORLD's é É", "<|endoftext|> x<|startoftext|>", "á b ́c", "ΟΔΟΣ ΣΑΣ ß", "日本語 テスト", "x y z\x0b", "word " * 9000] + [f"text {i} of many" for i in range(40)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, shard int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got, want = check(op2_tokens(spark, str(tmp_path)).collect(), df.collect())
    assert got == want
    again = spark.createDataFrame([(7, "same id"), (7, "same id"), (7, None)], "doc_id long, text string")
    tokenfile.write_tokens(again, str(tmp_path / "t"), "doc_id", "text")
    back = tokenfile.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.id for r in back] == [7, 7, 7] and all(len(r.ids) == r.n_tokens and r.ids[-1] == 2 for r in back)
    tokenfile.write_tokens(df.limit(0), str(tmp_path / "none"), "doc_id", "text")
    assert tokenfile.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_damage_is_found(spark, tmp_path):
    """A flipped bit anywhere but in the coder's last bytes, which may be slack."""
    rng = random.Random(2)
    df = spark.createDataFrame([(1, " ".join(f"w{rng.randrange(10**6)}" for _ in range(300)))], "doc_id long, text string")
    tokenfile.write_tokens(df, str(tmp_path / "t"), "doc_id", "text")
    path = next(p for p in (tmp_path / "t").iterdir() if p.name.startswith("part") and p.stat().st_size)
    whole = path.read_bytes()
    for k, at in enumerate((1, 6, 22, 34, 45, 52, 200, len(whole) // 2, len(whole) - 3)):
        data = bytearray(whole)
        data[at] ^= 4
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "x").write_bytes(bytes(data))
        with pytest.raises(Exception, match="damaged|no block|wrong place"):
            tokenfile.read_tokens(spark, str(tmp_path / str(k))).collect()


def test_many_ids_are_coded_in_step():
    """A large block takes a few hundred steps, and fewer bits than its order-0 entropy."""
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).drop_null().combine_chunks()
    ids = np.concatenate(list(ENCODER.ids(texts)))
    began = time.process_time()
    (coded,) = tokenfile.encode([ids])
    (back,) = tokenfile.decode([coded], [len(ids)])
    assert len(ids) > 100_000 and time.process_time() - began < 15 and np.array_equal(back, ids)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert 8 * len(coded) < -(share * np.log2(share)).sum() * len(ids)


@pytest.mark.parametrize("ids", [[1, 1 << 16], [-1, 5]])
def test_ids_out_of_range_are_refused(ids):
    with pytest.raises(ValueError, match="16 bits"):
        tokenfile.encode([np.array(ids, np.int64)])


def test_rare_and_frequent_ids():
    """Nearly as many ids as there can be, more than have a frequency, and one id only."""
    rng = np.random.default_rng(4)
    for ids in (rng.permutation(np.repeat(np.arange(65536), 7)), np.full(5000, 65535), np.arange(513)):
        (back,) = tokenfile.decode(tokenfile.encode([ids]), [len(ids)])
        assert np.array_equal(back, ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(
    st.sampled_from(["'s", "'T", "'re", "'", "<|endoftext|>", "<", "don't", "É'S", "ß", "ÿ×÷", "ªµº²½", "e\u0301", "Σ", "İ", " ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "日本", "x1y22", "...'ll", "__"]),
    st.text(max_size=6))).map("".join), min_size=1, max_size=5))
def test_encoder_gives_the_ids_of_whole_texts(texts):
    want = [ENCODER.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ENCODER.by_word and [x.tolist() for x in ENCODER.ids(pa.array(texts, pa.string()))] == want


def test_encoder_of_another_tokenizer(tmp_path):
    """One that keeps white space and case is given whole texts."""
    spec = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    spec["normalizer"] = None
    (tmp_path / "t.json").write_text(json.dumps(spec))
    encoder = tokenfile.Encoder(str(tmp_path / "t.json"))
    texts = ["A b  C", "", "e\u0301 x"]
    assert not encoder.by_word
    assert [x.tolist() for x in encoder.ids(pa.array(texts))] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("size", [1, 7, 10, 1000])
def test_parts_keep_all_rows(monkeypatch, size):
    monkeypatch.setattr(tokenfile, "PART_BYTES", size)
    rows = [(i, "x" * (i * 5 % 11)) for i in range(40)]
    frames = [pa.RecordBatch.from_pylist([{"id": i, "text": t} for i, t in rows[a:a + 9]], pa.schema([("id", pa.int64()), ("text", pa.string())])) for a in range(0, 40, 9)]
    parts = list(tokenfile._parts(iter(frames + [frames[0].slice(0, 0)])))
    assert [(r["id"], r["text"]) for p in parts for r in p.to_pylist()] == rows
    assert all(len(p) == 1 or sum(len(r["text"]) for r in p.to_pylist()) <= size for p in parts)
