"""Licence scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import mix, row_of, shingles, span_hashes, text_blocks, word_spans

#: Notices by which public licences are declared, with the licences' usual short names.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[*range(33, 45), 47, *range(58, 65), *range(91, 97), *range(123, 127)]] = 32
_BITS = 18


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes, rows, starts and ends of lower-case words without punctuation around them."""
    data = _BLANK[data]
    starts, ends = word_spans(data, offsets)
    trimmed = ends - ((data[ends - 1] == 46) & (ends - 1 > starts))  # a full stop at a word's end
    return span_hashes(data, starts, trimmed), row_of(offsets, starts), starts, ends


class TemplateIndex:
    """For each window length and band, the lowest shingles of the templates of about that length.

    A band is one MinHash value. A window of similarity s to a template shares one of ``bands`` values with probability
    1 - (1 - s) ** bands: over 0.999 998 at s = 2/3, which is what a window of a template's length has at containment 0.8.
    """

    def __init__(self, templates: list[tuple[str, str]], size: int = 5, bands: int = 12):
        self.size, self.bands = size, bands
        self.names = [n for n, _ in templates]
        array = pa.array([t for _, t in templates], pa.string())
        self.sets: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(templates)
        for first, data, offsets in text_blocks(array, 1 << 24, lower=True):
            words, rows, _, _ = _words(data, offsets)
            code, code_rows = shingles(words, rows, size)
            for r in range(len(offsets) - 1):
                self.sets[first + r] = np.unique(code[code_rows == r])
        self.lengths = sorted({self.length_of(len(s)) for s in self.sets if len(s)})
        self.keys: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in self.lengths:
            own = [i for i, s in enumerate(self.sets) if len(s) and self.length_of(len(s)) == n]
            for b in range(bands):
                low = np.array([self.rank(self.sets[i], b).min() for i in own], np.uint64)
                order = np.argsort(low)
                table = np.zeros(1 << _BITS, bool)
                table[(low & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
                self.keys[n, b] = (low[order], np.array(own)[order], table)

    @staticmethod
    def length_of(n: int) -> int:
        return 1 << max(0, (n - 1).bit_length())

    @staticmethod
    def rank(code: np.ndarray, band: int) -> np.ndarray:
        return mix(code ^ np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))

    def retrieve(self, code: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(window length, template, window starts) for windows of consecutive shingles that share a band with a template."""
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for b in range(self.bands):
            low, span = self.rank(code, b), 1
            for n in self.lengths:
                while span < n and len(low) > span:
                    low = np.minimum(low[:-span], low[span:])
                    span *= 2
                stride = max(1, min(span, n) // 4)
                keys, owners, table = self.keys[n, b]
                seen = low[::stride]
                hit = np.flatnonzero(table[(seen & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
                for k in range(len(keys)):
                    at = hit[seen[hit] == keys[k]]
                    if len(at):
                        found.setdefault((min(span, n), int(owners[k])), []).append(at * stride)
        for (n, t), at in found.items():
            yield n, t, np.unique(np.concatenate(at))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, *, size: int = 5, bands: int = 12, min_containment: float = 0.8) -> DataFrame:
    """(doc_id, license, template, containment, start_byte, end_byte): the templates that rows of ``docs`` (doc_id, text) hold.

    Windows of 1, 2, 4, ... shingles of ``size`` words overlap by three quarters (those of under four start at each
    word); a template is compared with the windows of its own length, rounded up. A template is reported once for each row: at
    the retrieved window that, with a template's length on either side, holds the largest share of its shingles, if that
    is ``min_containment`` or more. Ties go to the earliest. Null and empty texts hold nothing; repeated rows are each
    reported; other columns are ignored. A list of templates is part of the program, so its size does not grow.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates, size, bands)
        for batch in batches:
            out = []
            for first, data, offsets in text_blocks(batch.column("text"), lower=True):
                words, rows, starts, ends = _words(data, offsets)
                code, code_rows = shingles(words, rows, size)
                if not len(code):
                    continue
                word_at = np.searchsorted(rows, np.arange(len(offsets)))
                first_code = np.searchsorted(code_rows, np.arange(len(offsets)))
                best: dict[tuple[int, int], tuple[float, int, int]] = {}
                for n, t, at in index.retrieve(code):
                    wanted = index.sets[t]
                    for i in at.tolist():
                        for r in {int(code_rows[i]), int(code_rows[min(i + n, len(code)) - 1])}:
                            a, b = max(first_code[r], i - n), min(first_code[r + 1], i + 2 * n)
                            inside = np.flatnonzero(np.isin(code[a:b], wanted))
                            share = len(np.unique(code[a:b][inside])) / len(wanted)
                            if share >= min_containment:
                                w = word_at[r] - first_code[r] + a
                                last = min(w + int(inside[-1]) + size, word_at[r + 1]) - 1
                                one = (-share, int(starts[w + int(inside[0])] - offsets[r]), int(ends[last] - offsets[r]))
                                best[r, t] = min(best.get((r, t), one), one)
                out += [(first + r, t, -s, a, b) for (r, t), (s, a, b) in sorted(best.items())]
            ids = batch.column("doc_id").take(pa.array([x[0] for x in out], pa.int64()))
            yield pa.record_batch([ids, pa.array([index.names[x[1]] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), *(pa.array([x[k] for x in out], t) for k, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64())))], ["doc_id", "license", "template", "containment", "start_byte", "end_byte"])

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return typed.mapInArrow(scan, "doc_id long, license string, template int, containment double, start_byte long, end_byte long")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """The licence notices in all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
