"""Vectorised text helpers used inside Spark tasks: each works on the UTF-8 bytes of an Arrow batch.

Nothing here holds more than one block of texts (about ``budget`` bytes, or one text if that is longer).
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        found = np.cumprod(steps, dtype=np.uint64)
        if n > 1 << 21:  # the powers for a very long text don't stay in the worker
            return found
        _powers[key] = found
    return _powers[key][:n]


def text_blocks(column, budget: int = 1 << 20, lower: bool = False):
    """Yields (first row, bytes, offsets of rows) for runs of rows of about ``budget`` bytes. Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    array = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        array = pc.utf8_lower(array)
    n = len(array)
    if n == 0:
        return
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + n + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + budget, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space; a run ends with its text."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def changes(ordered: np.ndarray) -> np.ndarray:
    """Whether each of ordered values is the first of its kind."""
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return first


def different(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different value, in order of values, and which of them stands at each place."""
    order = np.argsort(hashes)
    new = changes(hashes[order])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def ragged(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of ``flat`` one after another."""
    return flat[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


class Known:
    """Runs of ids (one of each of ``sides``) by the hashes of what they stand for: all ids one after another, and where runs begin and end."""

    def __init__(self, sides: int, kind: str):
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sides = [(np.zeros(0, kind), np.zeros(1, np.int64))] * sides

    def more_than(self, most: int) -> bool:
        """Whether these are more runs, or runs of eight ids on average."""
        return len(self.hashes) > most or max(len(ids) for ids, _ in self.sides) > 8 * most

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Their numbers here; -1 for one that isn't known."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.slots[at], -1)

    def lacks(self, hashes: np.ndarray, older: Known) -> np.ndarray:
        """Places of hashes that are known neither here nor in ``older``; what only that knows is taken over."""
        missing = np.flatnonzero(self.find(hashes) < 0)
        there = older.find(hashes[missing])
        self.add(hashes[missing[there >= 0]], older.take(there[there >= 0]))
        return missing[there < 0]

    def add(self, hashes: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """``sides`` are ids and how many each run has."""
        order = np.argsort(hashes)
        where = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.slots = np.insert(self.hashes, where, hashes[order]), np.insert(self.slots, where, len(self.slots) + order)
        self.sides = [(np.concatenate([ids, more]), np.concatenate([bounds, bounds[-1] + np.cumsum(size)])) for (ids, bounds), (more, size) in zip(self.sides, sides, strict=True)]

    def take(self, slots: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        sizes = [bounds[slots + 1] - bounds[slots] for _, bounds in self.sides]
        return [(ragged(ids, bounds[slots], size), size) for (ids, bounds), size in zip(self.sides, sizes, strict=True)]


def row_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, positions, "right") - 1


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of a row, and their rows. A row of fewer words gives one shingle of them all."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = hashes.copy()
    whole = np.ones(n, bool)
    for k in range(1, size):
        m = max(0, n - k)
        same = np.zeros(n, bool)
        same[:m] = rows[k:] == rows[:m]
        step = np.zeros(n, np.uint64)
        step[:m] = hashes[k:]
        total = np.where(same, total * _BASE + step, total)
        whole &= same
    first = np.empty(n, bool)
    first[0], first[1:] = True, rows[1:] != rows[:-1]
    keep = whole | (first & ~whole)
    return mix(total[keep]), rows[keep]


def shingle_block(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = word_spans(data, offsets)
    return shingles(span_hashes(data, starts, ends), row_of(offsets, starts), size)


def release() -> None:
    """Gives what was freed back to the system: workers live on from stage to stage."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(work):
    """A function of batches, after the last of which what it held goes back to the system."""

    def run(batches):
        yield from work(batches)
        release()

    return run


def shared_folder(spark) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one below the working folder where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return folder or "file://" + os.path.abspath("spark-warehouse/checkpoints")


def saved(frame, name: str):
    """Writes a frame as Parquet into the shared folder and reads it back: its lineage ends there and outlives executors."""
    import uuid

    path = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
