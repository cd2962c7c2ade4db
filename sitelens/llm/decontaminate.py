"""Benchmark decontamination by greedy string tiling over shared-token seeds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import row_of, shingles, span_hashes, text_blocks, word_spans

#: ASCII punctuation counts as white space between tokens.
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32
_BITS = 20


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of each row, and their rows."""
    data = _BLANK[data]
    starts, ends = word_spans(data, offsets)
    return span_hashes(data, starts, ends), row_of(offsets, starts)


def greedy_tiles(text_at: np.ndarray, item_at: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Tiles (place in text, place in item, length): the longest match of tokens free on both sides, again and again.

    ``text_at`` and ``item_at`` are where seeds of ``size`` equal tokens start. Seeds that follow one another on a
    diagonal are one match; a match that meets tokens already taken falls apart into its free parts.
    """
    order = np.lexsort((text_at, text_at - item_at))
    a, b = text_at[order], item_at[order]
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(a) != 1) | (np.diff(a - b) != 0)
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(a))) + size - 1
    heap = [(-n, x, y) for n, x, y in zip(length.tolist(), a[at].tolist(), b[at].tolist(), strict=True)]
    heapq.heapify(heap)
    text_taken, item_taken, tiles = set(), set(), []
    while heap:
        n, x, y = heapq.heappop(heap)
        n = -n
        free = [i for i in range(n) if x + i not in text_taken and y + i not in item_taken]
        if len(free) == n:
            tiles.append((x, y, n))
            text_taken.update(range(x, x + n))
            item_taken.update(range(y, y + n))
            continue
        run = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - run >= size:
                    heapq.heappush(heap, (run - k, x + free[run], y + free[run]))
                run = k
    return tiles


def _tile_block(items, min_tile: int, min_coverage: float):
    """A function from a batch of (doc_id, text) to its matches with ``items``, a list of (item_id, text)."""
    array = pa.array([t for _, t in items], pa.string())
    token, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for first, data, offsets in text_blocks(array, 1 << 24, lower=True):
        h, r = _tokens(data, offsets)
        token, row = np.append(token, h), np.append(row, r + first)
    length = np.bincount(row, minlength=len(items))
    enough = length[row] >= min_tile
    token, row = token[enough], row[enough]
    seed, seed_row = shingles(token, row, min_tile)
    begins = np.searchsorted(row, np.arange(len(items)))
    seed_at = np.arange(len(seed)) - np.searchsorted(seed_row, np.arange(len(items)))[seed_row] if len(seed) else begins[:0]
    order = np.argsort(seed, kind="stable")
    seed, seed_row, seed_at = seed[order], seed_row[order], seed_at[order]
    wanted = np.zeros(1 << _BITS, bool)
    wanted[(seed & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    ids = np.array([i for i, _ in items], np.int64)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for first, data, offsets in text_blocks(batch.column("text"), lower=True):
                tokens, rows = _tokens(data, offsets)
                codes, code_rows = shingles(tokens, rows, min_tile)
                place = np.arange(len(codes)) - np.searchsorted(code_rows, np.arange(len(offsets)))[code_rows] if len(codes) else np.zeros(0, np.int64)
                hit = np.flatnonzero(wanted[(codes & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
                low, high = np.searchsorted(seed, codes[hit], "left"), np.searchsorted(seed, codes[hit], "right")
                n = high - low
                at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
                doc, item, text_at, item_at = np.repeat(code_rows[hit], n), seed_row[at], np.repeat(place[hit], n), seed_at[at]
                order = np.lexsort((item_at, item, doc))
                doc, item, text_at, item_at = doc[order], item[order], text_at[order], item_at[order]
                cut = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(item) != 0))) if len(doc) else []
                for a, b in zip(cut, [*cut[1:], len(doc)], strict=False):
                    size = int(length[item[a]])
                    # Tiles have min_tile tokens for each of their seeds at most, so fewer seeds can't reach the coverage.
                    if len(np.unique(item_at[a:b])) * min_tile < min_coverage * size:
                        continue
                    tiles = greedy_tiles(text_at[a:b], item_at[a:b], min_tile)
                    covered = sum(x[2] for x in tiles)
                    if covered >= min_coverage * size:
                        found.append((first + int(doc[a]), int(ids[item[a]]), covered / size, len(tiles), max(x[2] for x in tiles), covered))
            rows = [x[0] for x in found]
            rest = [pa.array([x[k] for x in found], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int32()), (4, pa.int32()), (5, pa.int32()))]
            yield pa.record_batch([batch.column("doc_id").take(pa.array(rows, pa.int64())), *rest], ["doc_id", "item_id", "coverage", "n_tiles", "longest", "covered"])

    return match


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, min_tile: int = 3, min_coverage: float = 0.5, block_chars: int = 1 << 24) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest, covered): the benchmark items that rows of ``docs`` (doc_id, text) hold.

    Tokens are lower-case words without ASCII punctuation. A pair that shares seeds of ``min_tile`` tokens is tiled: the
    longest match of untaken tokens is taken, as often as one of ``min_tile`` tokens is left, in whatever order the text
    has them. It is reported if the tiles cover ``min_coverage`` of the item's tokens. The benchmark (item_id, text) is
    sent to the tasks in blocks of at most about ``block_chars`` characters, so that its size is bounded whatever it is.
    Null and empty texts and items of fewer than ``min_tile`` tokens match nothing. Repeated rows and items are each
    reported for themselves; an empty table gives no rows; other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null and item_id is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        part = docs.mapInArrow(_tile_block([tuple(r) for r in own], min_tile, min_coverage), "doc_id long, item_id long, coverage double, n_tiles int, longest int, covered int")
        found = part if found is None else found.unionByName(part)
    return found


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items, with the items and their coverage."""
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
