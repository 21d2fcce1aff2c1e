"""Token ids in compressed binary files.

File format: a sequence of blocks, each followed by the separator ``END``.  A
block is a header (magic, shard, block number, documents, ids, coded bytes), a
table of its documents (id, whether null, whether it begins here, its ids
here), the crc32 of header, table and coded ids, the crc32 of the ids, and the
coded ids.  Blocks are independent: a long document runs over several, and
each resets the model.

Each id has one candidate: what followed the two ids before, or else what
followed the one before.  Orders 0 to 2 (no, one and two ids before) each say
how likely it is; a mixer weighs them by how well they did, and the mix drives
a range coder (rANS).  Any other id is coded by the frequencies of such ids in
its block, or spelled out if it is rare.  A
block is cut into lanes of ``STEPS`` ids, which share the model and are coded
in step, one array element per lane, with whole numbers only, so files decode
alike everywhere.
"""

from __future__ import annotations

import json
import math
import os
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractum.session import stage

BLOCK = 1 << 21  # ids of a block
STEPS = 512  # ids of a lane
SHARD_BYTES = 48 << 20  # text of one file
BITS = 16  # of an id
RARE = 6  # ids coded less often are spelled out
KNOWN = 1 << 15  # ids with a frequency, at most
PART_BYTES = 48 << 20  # text split at once
MAGIC, END = b"TIDS", b"\r\nTIDS\r\n"
HEADER, CHECK = struct.Struct("<4sqqiii"), struct.Struct("<II")
ENTRY = np.dtype([("id", "<i8"), ("null", "u1"), ("begins", "u1"), ("n", "<i4")])

_STRETCH = np.array([round(256 * math.log((i + 0.5) / (4096 - i - 0.5))) for i in range(4096)], np.int64)
_SQUASH = np.array([min(65536 - 32, max(32, round(65536 / (1 + math.exp(-i / 256))))) for i in range(-2047, 2048)], np.int64)
_RATE = np.array([131072 // (2 * n + 3) for n in range(63)] + [1040], np.int64)  # a new slot learns fast
_LOW = 1 << 31  # least state of a lane
_WORD = 0xFFFFFFFF
_NEW = 13000 << 6  # chance of a new candidate, seen 0 times
_WEAK = 16000  # a candidate below this chance leaves when it is wrong


class _Model:
    """Candidates for the next id of all lanes, and their chances by orders 0 to 2.

    A slot holds a check value, an id, its chance (16 bits) and how often it
    was tried (6 bits).  Lanes that meet in a slot leave the last one's update."""

    def __init__(self, ids: int, lanes: int):
        self.bits = min(19, max(12, ids.bit_length() + 1))
        self.tables = np.full(1 << BITS, _NEW), np.full(1 << BITS, _NEW), np.zeros(1 << self.bits, np.int64)
        self.w, self.bias, self.known = np.full(3, 26000), -(1 << 24), 0
        self.one, self.two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.room = np.empty((2, 3, lanes), np.int64)

    def predict(self, live: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates of the first ``live`` lanes, and their shares of 2 ** 16."""
        one = self.one[:live]
        h = (one * 0x9E3779B1 + self.two[:live] * 0x85EBCA77) & _WORD
        h ^= h >> 15
        h *= 0x2545F491
        self.place, self.check = (h & _WORD) >> 32 - self.bits, (h >> 32 & 4095) + 1 << 38
        self.held, self.own = self.room[:, :, :live]
        held, own = self.held, self.own
        held[1], held[2] = self.tables[1][one], self.tables[2][self.place]
        own[1:] = held[1:] >> 22
        self.fits = (held[2] >> 38 == self.check >> 38).astype(np.int64)
        own[2] &= 0xFFFF
        own[0] = own[1] + (own[2] - own[1]) * self.fits
        held[0] = self.tables[0][own[0]]
        self.chance = held >> 6 & 0xFFFF
        self.stretched = _STRETCH[self.chance >> 4]
        self.stretched[1] *= own[1] == own[0]
        self.stretched[2] *= self.fits
        w = self.w.tolist()
        dot = self.stretched[0] * w[0] + self.stretched[1] * w[1] + self.stretched[2] * w[2] + self.fits * self.known + self.bias >> 16
        self.mixed = _SQUASH[np.clip(dot, -2047, 2047) + 2047]
        return own[0], self.mixed

    def learn(self, ids: np.ndarray) -> None:
        live = len(ids)
        hit = (self.own == ids).astype(np.int64)
        tried = self.held & 63
        hit <<= 16
        change = hit - self.chance
        change *= _RATE[tried]
        change >>= 16
        self.chance += change
        change <<= 6
        change += self.held
        change += tried < 63
        keep = (self.chance >= _WEAK).astype(np.int64)
        keep |= hit >> 16
        keep[2] &= self.fits
        fresh = (ids << 22) + _NEW
        one = self.one[:live]
        self.tables[0][self.own[0]] = change[0]
        self.tables[1][one] = fresh + (change[1] - fresh) * keep[1]
        fresh += self.check
        self.tables[2][self.place] = fresh + (change[2] - fresh) * keep[2]
        error = hit[0] - self.mixed
        self.w += (self.stretched @ error) // live >> 9
        self.bias += (int(error.sum()) // live) << 5
        self.known += (int(error @ self.fits) // live) << 5
        self.two[:live] = one
        one[:] = ids


def _lanes(n: int) -> tuple[int, int, list[int]]:
    """Lanes of n ids, steps, and how many lanes each step has."""
    lanes = -(-n // STEPS)
    steps = -(-n // lanes)
    return lanes, steps, [-(-(n - t) // steps) for t in range(steps)]


def _shares(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Ids with a frequency, theirs and (last) that of all others as shares of
    2 ** 16, and both as bytes."""
    known = np.argsort(-counts, kind="stable")[:KNOWN]
    known = np.sort(known[counts[known] >= RARE])
    seen = np.append(counts[known], counts.sum() - counts[known].sum())
    share = 1 + seen * (65536 - len(seen)) // max(1, int(seen.sum()))
    share[np.argmax(share)] += 65536 - share.sum()
    table = np.append(np.diff(known, prepend=0), share - 1).astype("<u2").tobytes()
    return known, share, zlib.compress(CHECK.pack(len(known), 0) + table)


def _encode(ids: np.ndarray) -> bytes:
    n = len(ids)
    if not n:
        return b""
    if int(ids.min()) < 0 or int(ids.max()) >> BITS:
        raise ValueError(f"an id is negative or has more than {BITS} bits")
    lanes, steps, live = _lanes(n)
    grid = np.zeros(lanes * steps, np.uint16)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    share_of, missed = np.zeros((steps, lanes), np.int64), np.zeros((steps, lanes), bool)
    model = _Model(n, lanes)
    for t, k in enumerate(live):
        token = grid[t, :k].astype(np.int64)
        candidate, share_of[t, :k] = model.predict(k)
        np.not_equal(candidate, token, out=missed[t, :k])
        model.learn(token)
    known, share, table = _shares(np.bincount(grid[missed], minlength=1 << BITS))
    begin, place = np.cumsum(share) - share, np.full(1 << BITS, len(known), np.int64)
    place[known] = np.arange(len(known))
    x, words = np.full(lanes, _LOW, np.int64), []

    def push(at, low, width):
        """Codes one choice of the lanes ``at``."""
        old = x[at]
        full = old >= width << 31
        words.append((old[full] & 0xFFFF).astype("<u2"))
        old = np.where(full, old >> 16, old)
        turns = old // width
        x[at] = (turns << 16) + (old - turns * width) + low

    for t in range(steps - 1, -1, -1):
        k = live[t]
        lost = np.flatnonzero(missed[t, :k])
        if len(lost):
            token = grid[t, lost].astype(np.int64)
            which = place[token]
            rare = which == len(known)
            if rare.any():
                push(lost[rare], token[rare], np.ones(int(rare.sum()), np.int64))
            push(lost, begin[which], share[which])
        p, miss = share_of[t, :k], missed[t, :k]
        push(slice(0, k), p * miss, p + (65536 - 2 * p) * miss)
    body = np.concatenate([np.concatenate([x >> 32, x >> 16 & 0xFFFF, x & 0xFFFF]).astype("<u2"), *reversed(words)])
    return struct.pack("<i", len(table)) + table + body.tobytes()


def _decode(coded: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    (length,) = struct.unpack_from("<i", coded)
    table = zlib.decompress(coded[4:4 + length])
    k, _ = CHECK.unpack_from(table)
    table = np.frombuffer(table, "<u2", offset=CHECK.size).astype(np.int64)
    known, share = np.cumsum(table[:k]), table[k:] + 1
    begin, owner = np.cumsum(share) - share, np.repeat(np.arange(k + 1), share)
    known = np.append(known, 0)
    lanes, steps, live = _lanes(n)
    words = np.frombuffer(coded, "<u2", offset=4 + length).astype(np.int64)
    x, at = (words[:lanes] << 32) + (words[lanes:2 * lanes] << 16) + words[2 * lanes:3 * lanes], 3 * lanes
    grid, model = np.zeros((steps, lanes), np.uint16), _Model(n, lanes)

    def pull(state, low, width):
        """The states after one choice is taken out."""
        nonlocal at
        state = width * (state >> 16) + (state & 0xFFFF) - low
        need = np.flatnonzero(state < _LOW)
        state[need] = (state[need] << 16) + words[at:at + len(need)]
        at += len(need)
        return state

    for t, k in enumerate(live):
        token, p = model.predict(k)
        token, miss = token.copy(), (x[:k] & 0xFFFF) >= p
        x[:k] = pull(x[:k], p * miss, p + (65536 - 2 * p) * miss)
        lost = np.flatnonzero(miss)
        if len(lost):
            which = owner[x[lost] & 0xFFFF]
            x[lost] = pull(x[lost], begin[which], share[which])
            token[lost] = known[which]
            rare = lost[which == len(known) - 1]
            if len(rare):
                token[rare] = x[rare] & 0xFFFF
                x[rare] = pull(x[rare], token[rare], 1)
        grid[t, :k] = token
        model.learn(token)
    return grid.T.reshape(-1)[:n].astype(np.int64)


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Coded bytes of each block of ids below 2 ** 16."""
    return [_encode(ids) for ids in blocks]


def decode(coded: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """The ids of each block."""
    return [_decode(data, n) for data, n in zip(coded, counts)]


_SPACED = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_BY_WORD = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPACED}, "behavior": "Removed", "invert": True},
                                           {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)  # these drop white space and never join across it
_LATIN = r"\A[!-;=-~\t-\rÀ-ÖØ-öø-ÿ]*\z"  # NFC as they are; no start of a special token
_PIECES = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+)"


def _byte_names() -> dict[int, int]:
    """The character that the byte-level tokenizer writes for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(others)}


_NAMES = _byte_names()


class Encoder:
    """Ids of texts by the tokenizers library.

    If the tokenizer splits at white space as ``_BY_WORD`` does, the ids of a
    text are those of its words between spaces, and each distinct word of the
    given texts is encoded once.  Words of Latin-1 letters and ASCII need no
    normalizer but lower case; each distinct piece of theirs goes to the
    library's model once.  Any other tokenizer is given whole texts."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        if not os.path.isabs(tokenizer):
            import public_tokenizers

            tokenizer = public_tokenizers.path(tokenizer)
        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.model = self.tokenizer.model
        self.by_word = (spec["normalizer"], spec["pre_tokenizer"]) == _BY_WORD and not spec["truncation"] and not spec["padding"] and all(
            t["content"].startswith("<") and " " not in t["content"] and not t["lstrip"] and not t["rstrip"] for t in spec["added_tokens"])

    def _piece(self, piece: str) -> list[int]:
        name = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_NAMES)
        return [t.id for t in self.model.tokenize(name)]

    def _pool(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, where those of each begin, and how many they are."""
        plain = pc.match_substring_regex(words, _LATIN)
        cut = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), _PIECES, r" \1 "), " ")
        pieces = pc.utf8_trim_whitespace(cut.flatten()).dictionary_encode()
        ids, begin, long = _lay(map(self._piece, pieces.dictionary.to_numpy(zero_copy_only=False)))
        at, ends = _spread(begin, long, pieces.indices.to_numpy())
        other, _, more = _lay(self.tokenizer.encode(w, add_special_tokens=False).ids for w in words.filter(pc.invert(plain)).to_pylist())
        plain, count = plain.to_numpy(zero_copy_only=False), np.zeros(len(words), np.int64)
        count[plain], count[~plain] = np.diff(np.append(0, ends)[cut.offsets.to_numpy()]), more
        start = np.zeros(len(words), np.int64)
        for kind, before in ((plain, 0), (~plain, len(at))):
            start[kind] = np.cumsum(count[kind]) - count[kind] + before
        return np.concatenate([ids[at], other]), start, count

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Of each text, in order."""
        if not self.by_word:
            for text in texts:
                yield np.array(self.tokenizer.encode(text.as_py(), add_special_tokens=False).ids, np.uint32)
            return
        split = pc.split_pattern(texts, " ")
        first, words = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        del texts, split  # only the distinct words are needed from here
        which, (ids, begin, long) = words.indices.to_numpy(), self._pool(words.dictionary)
        pa.default_memory_pool().release_unused()
        for a, b in zip(first[:-1], first[1:]):
            yield ids[_spread(begin, long, which[a:b])[0]]


def _parts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about PART_BYTES, at least one row each."""
    held, size = [], 0
    for frame in frames:
        ends = np.append(0, np.cumsum(pc.binary_length(frame.column(1)).to_numpy(), dtype=np.int64))
        at = 0
        while at < len(frame):
            to = int(np.searchsorted(ends, ends[at] + PART_BYTES - size, "right")) - 1
            to = max(to, at if held else at + 1)
            held += [frame.slice(at, to - at)] * (to > at)
            size, at = size + int(ends[to] - ends[at]), to
            if at < len(frame):
                yield _joined(held)
                size = 0
    if held:
        yield _joined(held)


def _joined(frames: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch; the list is emptied."""
    table = pa.Table.from_batches(frames).combine_chunks()
    frames.clear()
    return table.to_batches()[0]


def _lay(found: Iterable[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One array of all ids, where each list begins in it, and its length."""
    ids, ends = array("I"), array("q")
    for one in found:
        ids.extend(one)
        ends.append(len(ids))
    ends = np.array(ends, np.int64)
    begin = np.append(0, ends)[:-1]
    return np.array(ids, np.uint32), begin, ends - begin


def _spread(begin: np.ndarray, long: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ids of the lists ``which``, one after another, and where each of them ends."""
    n = long[which]
    ends = np.cumsum(n)
    return np.repeat(begin[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0), ends


def _pack(shard: int, number: int, entries: list[tuple], ids: np.ndarray) -> bytes:
    coded = _encode(ids)
    front = HEADER.pack(MAGIC, shard, number, len(entries), len(ids), len(coded)) + np.array(entries, ENTRY).tobytes()
    return front + CHECK.pack(zlib.crc32(coded, zlib.crc32(front)), zlib.crc32(ids.astype("<u4").tobytes())) + coded


def write_tokens(df: DataFrame, path: str, id_column: str, text: str, tokenizer: str = "word_bpe_49k.json", end: int = 2) -> None:
    """Writes the ids of all texts to files under ``path``, one per shard, in
    ascending order of ``id_column`` (nulls first) over shards and files.

    Null text is empty: only the end id.  Rows with the same id follow each
    other in any order and may run over shards.  Whole texts, whatever length.
    """
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(shards, F.col("id").asc_nulls_first(), "_tie")
    dealt = dealt.sortWithinPartitions(F.col("id").asc_nulls_first(), "_tie").select("id", "text")

    def blocks(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, number = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        entries, parts, held = [], [], 0

        def close():
            nonlocal number, entries, parts, held
            out = _pack(shard, number, entries, np.concatenate(parts))
            number, entries, parts, held = number + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["value"])

        for frame in _parts(frames):
            names, found = frame.column(0).to_pylist(), encoder.ids(frame.column(1))
            del frame
            for name, ids in zip(names, found):
                ids, at = np.append(ids, np.uint32(end)), 0
                while at < len(ids):
                    take = min(BLOCK - held, len(ids) - at)
                    entries.append((name or 0, name is None, at == 0, take))
                    parts.append(ids[at:at + take])
                    at, held = at + take, held + take
                    if held == BLOCK:
                        yield close()
        if held:
            yield close()

    text_rows = dealt.mapInArrow(blocks, "value binary").select(F.col("value").cast("string").alias("value"))
    text_rows.write.option("lineSep", END.decode()).text(path)


def _parse(data: bytes) -> Iterator[tuple[tuple, np.ndarray, int, bytes]]:
    """(header, table, crc32 of the ids, coded ids) of each block, once header, table and coded ids are checked."""
    at = 0
    while at < len(data):
        front = at
        head = HEADER.unpack_from(data, at) if at + HEADER.size <= len(data) else (b"",)
        if head[0] != MAGIC or min(head[3:]) < 0 or len(data) < at + HEADER.size + ENTRY.itemsize * head[3] + CHECK.size:
            raise ValueError(f"no block at byte {at}")
        at += HEADER.size
        table = np.frombuffer(data, ENTRY, head[3], at)
        at += ENTRY.itemsize * head[3]
        crc, (stated, of_ids) = zlib.crc32(data[front:at]), CHECK.unpack_from(data, at)
        at += CHECK.size
        coded = data[at:at + head[5]]
        at += head[5]
        if data[at:at + len(END)] != END:
            raise ValueError(f"a block ends in the wrong place at byte {at}")
        if zlib.crc32(coded, crc) != stated:
            raise ValueError(f"block {head[2]} of shard {head[1]} is damaged")
        at += len(END)
        yield head, table, of_ids, coded


def read_tokens(spark: SparkSession, path: str, id_type: str = "long", with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) per document from the files;
    ``start`` counts the ids of all documents before it.  Every block is
    checked; a damaged one fails the job."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("content")

    def documents(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("shard", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)
        for frame in frames:
            for content in frame.column(0):
                done, current, start = [], None, 0
                blocks = sorted(_parse(content.as_buffer().to_pybytes()), key=lambda b: b[0][1:3])
                for k, (head, table, stated, coded) in enumerate(blocks, 1):
                    raw, at = _decode(coded, head[4]).astype("<u4"), 0
                    if zlib.crc32(raw.tobytes()) != stated:
                        raise ValueError(f"block {head[2]} of shard {head[1]} is damaged")
                    for name, null, begins, n in table.tolist():
                        piece, at = raw[at:at + n], at + n
                        if begins:
                            current = {"id": None if null else name, "shard": head[1], "start": start, "n_tokens": 0, "ids_crc32": 0, "ids": []}
                            done.append(current)
                        current["n_tokens"] += n
                        current["ids_crc32"] = zlib.crc32(piece, current["ids_crc32"])
                        if with_ids:
                            current["ids"].append(piece.astype(np.int32))
                        start += n
                    closed, done = (done[:-1], done[-1:]) if k < len(blocks) else (done, [])
                    if closed:
                        for d in closed:
                            d["ids"] = np.concatenate(d["ids"]) if d["ids"] else None
                        yield pa.RecordBatch.from_pylist([{n: d[n] for n in schema.names} for d in closed], schema)

    columns = "id long, shard long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    found = stage(files.mapInArrow(documents, columns))
    before = found.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))  # one row per file
    sizes = {r.shard: r._n for r in before.collect()}
    total, offsets = 0, []
    for shard in sorted(sizes):
        offsets.append((shard, total))
        total += sizes[shard]
    starts = F.broadcast(spark.createDataFrame(offsets, "shard long, _before long"))
    out = found.join(starts, "shard").withColumn("start", F.col("start") + F.col("_before")).drop("_before", "shard")
    return out.withColumn("id", F.col("id").cast(id_type))
