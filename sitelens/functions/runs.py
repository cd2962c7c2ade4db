"""Runs of keyword tokens, looked up among many terms at once: what a task does with a batch of texts.

Texts come in lower case. Their tokens are those of ``text.keyword_tokens``; hashes only rule out, so every run that is a
term comes out, and few others do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .text import NOISE

_INSIDE = np.zeros(256, bool)
_INSIDE[[*b"abcdefghijklmnopqrstuvwxyz0123456789'-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[[*b"0123456789"]] = True
_LONGEST = max(map(len, NOISE))  # eight letters at most: a word of noise is one number
_NOISE = np.unique(np.array([int.from_bytes(w.encode(), "little") for w in NOISE], np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PROBES = 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Tokens:
    """The tokens of texts, each followed by one space: a run of a text's tokens is one range of ``data``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = _INSIDE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        cut[0] = True
        before = np.append(False, inside[:-1])
        starts = np.flatnonzero(inside & (~before | cut))
        ends = np.flatnonzero(before & (~inside | cut))
        letters = np.append(0, np.cumsum(~_DIGIT[data]))
        size = ends - starts
        keep = (size > 1) & (letters[ends] > letters[starts])
        few = np.flatnonzero(keep & (size <= _LONGEST))
        name = np.zeros(len(few), np.uint64)
        for k in range(_LONGEST):
            there = size[few] > k
            name[there] |= data[starts[few[there]] + k].astype(np.uint64) << np.uint64(8 * k)
        keep[few[np.isin(name, _NOISE)]] = False
        starts, size = starts[keep], size[keep]
        self.row = np.searchsorted(offsets, starts, "right") - 1
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size
        spaced = np.append(data, np.uint8(32))
        self.data = spaced[np.minimum(np.repeat(starts - self.starts, size + 1) + np.arange(int((size + 1).sum())), len(data))]
        self.data[self.ends] = 32
        n = len(self.data)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _powers(_BASE, n), out=self.total[1:])
        self.inverse = _powers(_INVERSE, n + 1)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every run of ``n`` tokens of one text: its first token, and a hash of its bytes."""
        first = np.flatnonzero(self.row[n - 1 :] == self.row[: max(0, len(self.row) - n + 1)])
        a, b = self.starts[first], self.ends[first + n - 1]
        return first, _mix((self.total[b] - self.total[a]) * self.inverse[a] + (b - a).astype(np.uint64))


def _blocks(batch: pa.RecordBatch, budget: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, Tokens, np.ndarray]]:
    """Rows (key long, text, ...) of about ``budget`` bytes, their tokens and keys."""
    texts = batch.column("text").cast(pa.large_string())
    keys = batch.column("key").to_numpy().view(np.uint64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + budget, "right")) - 1)
        yield batch.slice(i, j - i), Tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), keys[i:j]
        i = j


def _places(names: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return (names + np.uint64(probe) * ((names >> np.uint64(32)) | np.uint64(1))) & np.uint64((1 << bits) - 1)


def marks(bits: int):
    """(word, bit) of a Bloom filter of 2 ** ``bits`` bits, for rows (key, text) whose texts are runs of tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, tokens, keys in _blocks(batch):
                size = np.bincount(tokens.row, minlength=len(keys))
                for n in np.unique(size[size > 0]).tolist():
                    first, hashes = tokens.runs(n)
                    whole = size[tokens.row[first]] == n
                    names = _mix(hashes[whole] ^ keys[tokens.row[first[whole]]])
                    at = np.concatenate([_places(names, bits, k) for k in range(_PROBES)])
                    yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((at & np.uint64(63)).astype(np.int32))], ["word", "bit"])

    return work


def hits(table: np.ndarray, bits: int, sizes: list[int], carry: list[str]):
    """(``carry``, term) for every run of ``sizes`` tokens of the rows (key, text, ``carry``) that the filter ``table`` may hold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, tokens, keys in _blocks(batch):
                for n in sizes:
                    first, hashes = tokens.runs(n)
                    names = _mix(hashes ^ keys[tokens.row[first]])
                    for k in range(_PROBES):
                        at = _places(names, bits, k)
                        held = np.flatnonzero((table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
                        first, names = first[held], names[held]
                    if not len(first):
                        continue
                    a, size = tokens.starts[first], tokens.ends[first + n - 1] - tokens.starts[first]
                    ends = np.cumsum(size)
                    text = tokens.data[np.repeat(a - (ends - size), size) + np.arange(int(ends[-1]))]
                    terms = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(text))
                    own = pa.array(tokens.row[first])
                    yield pa.record_batch([*(rows.column(c).take(own) for c in carry), terms], [*carry, "term"])

    return work
