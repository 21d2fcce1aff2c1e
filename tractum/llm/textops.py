"""Numpy helpers on batches of texts, used inside Arrow tasks.

A batch is one byte buffer with document offsets, so the cost per word is a few
array operations and not a Python call.  All helpers read whole texts; long
inputs are only cut between documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BATCH_BYTES = 4 << 20  # text per inner batch; a longer single text makes a batch of its own
SPACE = 32


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) in pieces of about ``BATCH_BYTES``; null is empty text."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(offsets, offsets[row] + BATCH_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), len(texts))
        yield batch.slice(row, stop - row), data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts.

    ``data`` holds the words of all texts, each followed by one space, so words
    i..j of one text are the bytes ``start[i]:end[j]`` of ``data``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        word = ~((data == SPACE) | ((data >= 9) & (data <= 13)))
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        begins = word & (first[:-1] | np.concatenate(([True], ~word[:-1])))
        ends = word & (first[1:] | np.concatenate((~word[1:], [True])))
        self.source_start = np.flatnonzero(begins)
        self.source_end = np.flatnonzero(ends) + 1
        lengths = self.source_end - self.source_start
        n = len(lengths)
        self.n_docs = len(offsets) - 1
        self.doc = np.searchsorted(offsets, self.source_start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))  # first word of each text
        self.count = np.diff(self.first)
        self.start = np.cumsum(lengths + 1) - (lengths + 1)
        self.end = self.start + lengths
        self.data = np.full(int(lengths.sum()) + n + 8, SPACE, np.uint8)  # 8 bytes of padding for wide reads
        kept = data[word]
        if lower:
            kept = np.where((kept >= 65) & (kept <= 90), kept + 32, kept).astype(np.uint8)
        self.data[np.arange(len(kept)) + np.repeat(np.arange(n), lengths)] = kept

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, end) of every run of ``width`` words; a text with
        fewer words has its whole sequence as the only one."""
        per_doc = np.where(self.count >= width, self.count - width + 1, (self.count > 0).astype(np.int64))
        doc = np.repeat(np.arange(self.n_docs), per_doc)
        rank = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        first = self.first[doc] + rank
        last = first + np.minimum(self.count[doc], width) - 1
        return doc, self.start[first], self.end[last]

    def hashes(self, seed: int = 42) -> np.ndarray:
        return xxh64(self.data, self.start, self.end - self.start, seed)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (  # fixed values of the published XXH64 function
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _mix(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many slices of ``data`` at once; ``data`` has 8 bytes of padding."""
    with np.errstate(over="ignore"):
        seed = np.uint64(seed)
        wide = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
        half = np.ndarray((max(len(data) - 3, 0),), "<u4", data, strides=(1,))
        at = start.astype(np.int64).copy()
        stop = at + length
        out = np.full(len(at), seed + _P5, np.uint64)
        long = np.flatnonzero(length >= 32)
        if len(long):
            lanes = [np.full(len(long), v, np.uint64) for v in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            p, live = at[long], np.arange(len(long))
            while len(live):
                for k in range(4):
                    lanes[k][live] = _mix(lanes[k][live], wide[p[live] + 8 * k])
                p[live] += 32
                live = live[stop[long[live]] - p[live] >= 32]
            h = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
            for k in range(4):
                h = (h ^ _mix(np.zeros(len(long), np.uint64), lanes[k])) * _P1 + _P4
            out[long], at[long] = h, p
        out += length.astype(np.uint64)
        live = np.flatnonzero(stop - at >= 8)
        while len(live):
            h = out[live] ^ _mix(np.zeros(len(live), np.uint64), wide[at[live]])
            out[live] = _rotl(h, 27) * _P1 + _P4
            at[live] += 8
            live = live[stop[live] - at[live] >= 8]
        live = np.flatnonzero(stop - at >= 4)
        if len(live):
            h = out[live] ^ (half[at[live]].astype(np.uint64) * _P1)
            out[live] = _rotl(h, 23) * _P2 + _P3
            at[live] += 4
        live = np.flatnonzero(stop > at)
        while len(live):
            h = out[live] ^ (data[at[live]].astype(np.uint64) * _P5)
            out[live] = _rotl(h, 11) * _P1
            at[live] += 1
            live = live[stop[live] > at[live]]
        out ^= out >> np.uint64(33)
        out *= _P2
        out ^= out >> np.uint64(29)
        out *= _P3
        out ^= out >> np.uint64(32)
    return out


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]``; empty segments give 0."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]
