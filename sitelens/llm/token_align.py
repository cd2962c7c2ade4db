"""Alignment of two tokenizers over the same bytes: divide and conquer at the cuts that both make, and how often ids go together."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Known, changes, different, ragged, row_of, saved, span_hashes, text_blocks, tidy

_MARK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PIECES = 1 << 15  # ids of the second tokenizer; a pair of ids is first * _PIECES + second


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one visible character: itself if it is one, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Vocabulary:
    """The bytes of every id, one after another, with their starts and lengths; and the ids in decimal digits with what follows them."""

    def __init__(self, tokens: list[bytes], end: bytes):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        digits = [str(i).encode() for i in range(len(tokens))]
        self.n_digits = np.array([len(d) for d in digits], np.int64)
        # Eight bytes each, the unused ones zero: before another token of its group, and at the group's end.
        self.digits, self.last = (np.frombuffer(b"".join((d + sign).ljust(8, b"\0") for d in digits), np.uint64) for sign in (b",", end))

    def ends(self, ids: np.ndarray) -> np.ndarray:
        found = np.cumsum(self.length[ids])
        return found.astype(np.int32) if len(found) and found[-1] < 1 << 31 else found

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.flat, self.start[ids], self.length[ids])


def _may_cut(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is surely no white space: ASCII, or of a script that has none."""
    back = lambda at, k: np.where(at >= k, data[np.maximum(at - k, 0)], 0)
    one = back(at, 1)
    found, others = (one > 32) & (one < 127), np.flatnonzero(one >= 128)
    two, three, four = (back(at[others], k) for k in (2, 3, 4))
    found[others] = ((two >= 0xC3) & (two < 0xE0)) | ((three >= 0xE4) & (three < 0xF0)) | ((four >= 0xF0) & (four < 0xF5))
    return found


class TokenizerPair:
    """Whole texts as stretches with their ids by two tokenizers, each different stretch being encoded once a task.

    A stretch begins at a space after a character that is none, or at a mark of punctuation after an ASCII letter or digit.
    The first tokenizer never looks across such a place; nor does the second, if no piece of it holds the sign of a space
    after something else, or such a mark after a letter or digit, which is looked up (else those are no cuts). What comes
    out is compared with the bytes of the text, and texts that differ are encoded whole.
    """

    def __init__(self, byte_path: str, piece_path: str, most_stretches: int = 250_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first, self.second = Tokenizer.from_file(byte_path), sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.first.encode_special_tokens = True
        known, byte = self.first.get_vocab(with_added_tokens=True), _byte_of_character()
        names = [""] * (max(known.values()) + 1)
        for token, i in known.items():
            names[i] = token
        self.a = _Vocabulary([bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in names], b"|")
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if len(pieces) > _PIECES:
            raise ValueError(f"the second tokenizer may have {_PIECES} ids at most")
        self.b = _Vocabulary([bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], b";")
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.marks = self.cuts and not any(re.search(r"[A-Za-z0-9][.,;:!?]", p) for p in pieces)
        self.known, self.older = Known(2, "<u2"), Known(2, "<u2")  # the older ones haven't been asked for since
        self.most_stretches = most_stretches

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text that begins with a space, by either tokenizer; the second adds the space itself."""
        b = self.second.encode(text[1:], num_threads=1) if len(text) > 1 else [self.second.piece_to_id("▁")]
        return np.array(self.first.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64), np.array(b, np.int64)

    def _alone(self, stretch: bytes) -> list[np.ndarray]:
        if stretch[0] == 32:
            return list(self._whole(stretch.decode()))
        return [ids[np.searchsorted(np.cumsum(v.length[ids]), 2) + 1 :] for ids, v in zip(self._whole(" a" + stretch.decode()), (self.a, self.b), strict=True)]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Ids of new stretches. Those that end where it is safe to cut are encoded many at a time, as one text of them all."""
        safe = _may_cut(data, ends)
        alone, many, found = [np.flatnonzero(~safe)], np.flatnonzero(safe), []
        # One that begins with a mark gets a letter before it, the ids of which are taken off again.
        extra = np.where(data[starts[many]] == 32, 0, 2)
        stops = np.cumsum(ends[many] - starts[many] + extra)
        begins = stops - (ends[many] - starts[many])
        before = begins - extra
        text = np.empty(int(stops[-1]) if len(stops) else 0, np.uint8)
        text[before[extra > 0]], text[before[extra > 0] + 1] = ord(" "), ord("a")
        size = stops - begins
        text[np.repeat(begins - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = ragged(data, starts[many], size)
        i = 0
        while i < len(many):
            j = max(i + 1, int(np.searchsorted(stops, before[i] + 32_768)))
            part, sides = text[before[i] : stops[j - 1]].tobytes(), []
            for ids, v in zip(self._whole(part.decode()), (self.a, self.b), strict=True):
                at = before[i] + np.concatenate([[0], np.cumsum(v.length[ids])])
                start, stop = np.searchsorted(at, begins[i:j]), np.searchsorted(at, stops[i:j])
                if v.bytes_of(ids).tobytes() != part or not (np.array_equal(at[start], begins[i:j]) and np.array_equal(at[stop], stops[i:j])):
                    break
                sides.append((ragged(ids.astype("<u2"), start, stop - start), stop - start))
            if len(sides) == 2:
                found.append((many[i:j], *sides))
            else:
                alone.append(many[i:j])
            i = j
        for k in np.concatenate(alone).tolist():
            stretch = data[starts[k] : ends[k]].tobytes()
            both = self._alone(stretch)
            same = all(v.bytes_of(ids).tobytes() == stretch for ids, v in zip(both, (self.a, self.b), strict=True))
            found.append(([k], *((ids.astype("<u2"), [len(ids)]) for ids in (x if same else x[:0] for x in both))))
        if found:
            own, *sides = zip(*found, strict=True)
            self.known.add(hashes[np.concatenate(own)], [tuple(np.concatenate(x) for x in zip(*side, strict=True)) for side in sides])

    def stretches(self, data: np.ndarray, offsets: np.ndarray):
        """(ids, offsets of stretches among them) of either tokenizer for the different stretches of rows of bytes that begin with a space each; and row and stretch wherever one stands, in order.

        A row for which ids of stretches don't stand for their bytes is one stretch; it has none, as empty rows, if its ids don't either.
        """
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        if self.cuts:
            spaces = np.flatnonzero(data == 32)
            first[spaces[_may_cut(data, spaces)]] = True
        if self.marks:
            first[1:-1] |= _MARK[data[1:]] & _ALNUM[data[:-1]]
        starts = np.flatnonzero(first[:-1])
        ends = np.append(starts[1:], len(data))[: len(starts)]
        hashes = span_hashes(data, starts, ends)
        at, which = different(hashes)
        unique = hashes[at]
        if self.known.more_than(self.most_stretches // 2):
            self.known, self.older = Known(2, "<u2"), self.known
        fresh = at[self.known.lacks(unique, self.older)]
        self._learn(data, starts[fresh], ends[fresh], hashes[fresh])
        sides, right = [], np.ones(len(starts), bool)
        for (ids, size), v in zip(self.known.take(self.known.find(unique)), (self.a, self.b), strict=True):
            ids, bounds = ids.astype(np.int64), np.concatenate([[0], np.cumsum(size)])
            right &= np.diff(np.concatenate([[0], np.cumsum(v.length[ids])])[bounds])[which] == ends - starts
            sides.append((ids, bounds))
        row = row_of(offsets, starts)
        if not right.all():
            sides, row, which = self._whole_rows(sides, row, which, data, offsets, np.unique(row[~right]))
        return *sides, row, which

    def _whole_rows(self, sides, row: np.ndarray, which: np.ndarray, data: np.ndarray, offsets: np.ndarray, again: np.ndarray):
        """The same with the rows of ``again`` encoded whole, as one stretch each."""
        parts, n = [[ids] for ids, _ in sides], [[np.diff(bounds)] for _, bounds in sides]
        kept = []
        for r in again.tolist():
            part = data[offsets[r] : offsets[r + 1]].tobytes()
            both = self._whole(part.decode())
            if all(v.bytes_of(ids).tobytes() == part for ids, v in zip(both, (self.a, self.b), strict=True)):
                kept.append(r)
                for p, m, ids in zip(parts, n, both, strict=True):
                    p.append(ids)
                    m.append([len(ids)])
        before, others = len(sides[0][1]) - 1, ~np.isin(row, again)
        row, which = np.concatenate([row[others], np.array(kept, np.int64)]), np.concatenate([which[others], before + np.arange(len(kept))])
        order = np.argsort(row, kind="stable")
        return [(np.concatenate(p), np.concatenate([[0], np.cumsum(np.concatenate(m))])) for p, m in zip(parts, n, strict=True)], row[order], which[order]


def align(ends_a: np.ndarray, ends_b: np.ndarray, bounds_a: np.ndarray, bounds_b: np.ndarray) -> np.ndarray:
    """The groups of tokens between the places where tokens of both end: rows (from, to) in a and (from, to) in b, in order.

    Divide and conquer, all intervals of a level at once. An interval's tokens of a are looked up around its middle, each by
    bisection in the ends of b, at growing distance until one is an end there; the interval is parted at the nearest. One
    without any is a group. ``bounds`` part the tokens into texts, the first intervals.
    """
    todo = np.stack([bounds_a[:-1], bounds_a[1:], bounds_b[:-1], bounds_b[1:]])
    todo = todo[:, todo[1] > todo[0]]
    groups = []
    while todo.shape[1]:
        whole = (todo[1] - todo[0] == 1) | (todo[3] - todo[2] == 1)
        groups.append(todo[:, whole])
        todo = todo[:, ~whole]
        low, high = todo[0], todo[1] - 2  # the cut comes after one of these tokens
        middle = (low + high) // 2
        cut, place = np.full(len(low), -1), np.zeros(len(low), np.int64)
        end = ends_a[middle]
        found = np.searchsorted(ends_b, end)
        hit = ends_b[found] == end
        cut[hit], place[hit] = middle[hit], found[hit]
        left, near, width = np.flatnonzero(~hit & (high > low)), 1, 1
        while len(left):  # places from near to near + width - 1 away from the middle, on both sides
            away = np.arange(near, near + width)
            away = np.concatenate([away, -away])
            at_once = max(1, (1 << 20) // len(away))
            for i in range(0, len(left), at_once):
                part = left[i : i + at_once]
                tried = middle[part, None] + away
                inside = (tried >= low[part, None]) & (tried <= high[part, None])
                end = ends_a[np.where(inside, tried, 0)]
                found = np.searchsorted(ends_b, end)
                hit = inside & (ends_b[found] == end)
                k = np.argmin(np.where(hit, np.abs(away), near + width), axis=1)
                some, each = hit[np.arange(len(part)), k], np.arange(len(part))
                cut[part[some]], place[part[some]] = tried[each, k][some], found[each, k][some]
            near, width = near + width, min(2 * width, 1 << 16)
            left = left[(cut[left] < 0) & ((middle[left] - near >= low[left]) | (middle[left] + near <= high[left]))]
        none = cut < 0
        groups.append(todo[:, none])
        t, c, p = todo[:, ~none], cut[~none], place[~none]
        todo = np.concatenate([np.stack([t[0], c + 1, t[2], p + 1]), np.stack([c + 1, t[1], p + 1, t[3]])], axis=1)
    found = np.concatenate([np.zeros((4, 0), np.int64), *groups], axis=1)
    return found[:, np.argsort(found[0], kind="stable")].T


def _counted(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, and the sum of its ``n``; without those, how often it comes."""
    if n is None:
        key = np.sort(key)
        first = np.flatnonzero(changes(key))
        return key[first], np.diff(np.append(first, len(key)))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(changes(key))
    return key[first], np.add.reduceat(n[order], first) if len(first) else n


def _together(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    return _counted(*(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64),) * 2


def linked_pairs(groups: np.ndarray, rows: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, at_once: int = 1 << 21):
    """(row, pair of ids, links) of groups, each pair of a row once, in order of row and pair.

    Groups of many links go by their different ids and how often each comes, so a long stretch without a common cut never
    makes all its links.
    """
    size = (groups[:, 1] - groups[:, 0]) * (groups[:, 3] - groups[:, 2])
    small = size <= 4096
    parts = []
    g, r, s = groups[small], rows[small], size[small]
    upto = np.cumsum(s)
    i = 0
    while i < len(g):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + at_once, "right")))
        n, nb = s[i:j], g[i:j, 3] - g[i:j, 2]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(nb, n)
        pair = ids_a[np.repeat(g[i:j, 0], n) + k // wide] * _PIECES + ids_b[np.repeat(g[i:j, 2], n) + k % wide]
        parts.append(_counted(np.repeat(r[i:j], n) << 32 | pair))
        i = j
    for (a0, a1, b0, b1), row in zip(groups[~small].tolist(), rows[~small].tolist(), strict=True):
        (ua, na), (ub, nb) = np.unique(ids_a[a0:a1], return_counts=True), np.unique(ids_b[b0:b1], return_counts=True)
        step = max(1, at_once // len(ub))
        for i in range(0, len(ua), step):
            parts.append(_counted((row << 32 | (ua[i : i + step, None] * _PIECES + ub)).ravel(), (na[i : i + step, None] * nb).ravel()))
    key, n = _together(parts)
    return key >> 32, key & 0xFFFFFFFF, n


def pairs_of_rows(stretch: np.ndarray, pair: np.ndarray, links: np.ndarray, rows: np.ndarray, which: np.ndarray, at_once: int = 1 << 21):
    """(row, pair of ids, links) as of ``linked_pairs``, of rows that hold the stretches ``which``, from those of stretches."""
    both, times = _counted(rows << 32 | which)
    row, which = both >> 32, both & 0xFFFFFFFF
    bounds = np.searchsorted(stretch, np.arange(int(which.max(initial=-1)) + 2))
    first, stop = bounds[which], bounds[which + 1]
    upto = np.cumsum(stop - first)
    parts, i = [], 0
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + at_once, "right")))
        n = stop[i:j] - first[i:j]
        parts.append(_counted(np.repeat(row[i:j], n) << 32 | ragged(pair, first[i:j], n), np.repeat(times[i:j], n) * ragged(links, first[i:j], n)))
        i = j
    key, n = _together(parts)
    return key >> 32, key & 0xFFFFFFFF, n


def group_texts(groups: np.ndarray, ids_a: np.ndarray, bounds_a: np.ndarray, ids_b: np.ndarray, bounds_b: np.ndarray, a: _Vocabulary, b: _Vocabulary) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3;`` of each stretch; groups follow one another in the tokens of either side."""
    numbers = np.empty(len(ids_a) + len(ids_b), np.uint64)
    sides = ((ids_a, a, groups[:, 0], groups[:, 1], groups[:, 2]), (ids_b, b, groups[:, 2], groups[:, 3], groups[:, 1]))
    for ids, v, first, stop, others in sides:  # the tokens of the other side that come before a group's
        numbers[np.arange(len(ids)) + np.repeat(others, stop - first)] = v.digits[ids]
        numbers[stop - 1 + others] = v.last[ids[stop - 1]]
    flat = numbers.tobytes().translate(None, b"\0")
    ends = sum(np.concatenate([[0], np.cumsum(v.n_digits[ids] + 1)])[bounds] for ids, v, bounds in ((ids_a, a, bounds_a), (ids_b, b, bounds_b))).tolist()
    return [flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]


_COLUMNS = [("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32())), ("links", pa.list_(pa.int64()))]
_SCHEMA = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, links array<long>"


def _aligned_block(tokenizers: TokenizerPair, doc_ids: pa.Array, first: int, data: np.ndarray, offsets: np.ndarray, block: int) -> pa.RecordBatch:
    some = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][some], 32)
    offsets = offsets + np.concatenate([[0], np.cumsum(some)])
    n_rows = len(offsets) - 1
    (a, bounds_a), (b, bounds_b), rows, which = tokenizers.stretches(data, offsets)
    # What both tokenizers made of a stretch ends with it, so each different one is aligned once.
    groups = align(tokenizers.a.ends(a), tokenizers.b.ends(b), bounds_a, bounds_b)
    of = row_of(bounds_a, groups[:, 0])
    texts = group_texts(groups, a, bounds_a, b, bounds_b, tokenizers.a, tokenizers.b)
    row, pair, n = pairs_of_rows(*linked_pairs(groups, of, a, b), rows, which)
    at = np.searchsorted(rows, np.arange(n_rows + 1))
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[which])])[at])
    n_links = np.diff(np.concatenate([[0], np.cumsum((groups[:, 1] - groups[:, 0]) * (groups[:, 3] - groups[:, 2]))])[np.searchsorted(of, np.arange(len(bounds_a)))])
    places, at = which.tolist(), at.tolist()
    digests = [hashlib.sha256(b"".join([texts[k] for k in places[x:y]])[:-1]).hexdigest() if y > x else "" for x, y in zip(at[:-1], at[1:], strict=True)]
    cuts = pa.array(np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32))
    columns = [pa.array(np.full(n_rows, block)), doc_ids.slice(first, n_rows), total(np.diff(bounds_a)), total(np.diff(bounds_b)), total(np.bincount(of, minlength=len(bounds_a) - 1)), total(n_links), pa.array(digests, pa.string())]
    columns += [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (pair.astype(np.int32), n)]
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], pa.schema(_COLUMNS))


def _aligned(docs: DataFrame, byte_path: str, piece_path: str, block_bytes: int) -> DataFrame:
    """A row for each document, and for each block of documents rows (n_a null) of its different pairs and how many documents have each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizers, number = TokenizerPair(byte_path, piece_path), 0
        here = TaskContext.get().partitionId() << 32
        held, size, seen = np.zeros(0, np.int64), 0, []

        def totals():  # pair << 32 | documents, each pair once
            key = np.concatenate([held >> 32, *seen])
            n = np.concatenate([held & 0xFFFFFFFF, *[np.ones(len(s), np.int64) for s in seen]])
            unique, inverse = np.unique(key, return_inverse=True)
            return unique << 32 | np.bincount(inverse, n, len(unique)).astype(np.int64)

        def summary():
            for i in range(0, len(held), 1 << 16):
                part = held[i : i + (1 << 16)]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(x)) for x in ((part >> 32).astype(np.int32), part & 0xFFFFFFFF)]
                yield pa.record_batch([pa.array([here | number]), *[pa.nulls(1, t) for _, t in _COLUMNS[1:7]], *lists], pa.schema(_COLUMNS))

        for batch in batches:
            for first, data, offsets in text_blocks(batch.column("text")):
                out = _aligned_block(tokenizers, batch.column("doc_id"), first, data, offsets, here | number)
                yield out
                seen.append(out.column("pairs").flatten().to_numpy().astype(np.int64))
                size += len(data)
                if len(seen) >= 8:
                    held, seen = totals(), []
                if size >= block_bytes:
                    held = totals()
                    yield from summary()
                    held, size, seen, number = np.zeros(0, np.int64), 0, [], number + 1
        held = totals()
        yield from summary()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(work), _SCHEMA)


def _marked(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """The documents of a block with the sums over their links, from the counts of the block's pairs."""
    order = np.argsort(marks["pair"].to_numpy())
    pair, n, best = (marks[c].to_numpy()[order] for c in ("pair", "n", "best"))
    lists = docs["pairs"].combine_chunks()
    links = docs["links"].combine_chunks().flatten().to_numpy()
    at = np.searchsorted(pair, lists.flatten().to_numpy())
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])])
    sums = [total(links * best[at]), total(links * n[at])] if len(pair) else [np.zeros(docs.num_rows, np.int64)] * 2
    found = docs.drop_columns(["block", "pairs", "links"])
    for name, x in zip(("n_best", "count_sum"), sums, strict=True):
        found = found.append_column(name, pa.array(x.astype(np.int64)))
    return found


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, *, block_bytes: int = 24 << 20) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs`` (doc_id, text).

    A null or empty text, or one whose tokens don't stand for exactly its bytes behind a space, has no tokens: zeros and an
    empty digest. Rows count for themselves, also repeated ones and those of a null or repeated doc_id; ties for the highest
    count of an id are all best. An empty table gives no rows; other columns are ignored. Long texts are aligned whole.

    The documents' pairs stay in place: what is counted over the corpus are the different pairs of blocks of ``block_bytes``
    of text (or one longer text), and each block gets the counts of its own pairs back.
    """
    made = saved(_aligned(docs, byte_path, piece_path, block_bytes), "aligned")
    own = made.filter("n_a is null").select("block", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.links").alias("docs"))
    counts = own.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 15))
    counts = counts.join(counts.groupBy("a").agg(F.max("n").alias("most")), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    marks = own.select(F.col("block").alias("_block"), "pair").join(counts, "pair")
    kind = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    found = made.filter("n_a is not null").groupBy("block").cogroup(marks.groupBy("_block")).applyInArrow(_marked, kind)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents by byte_bpe_50k and piece_bpe_32k."""
    import public_tokenizers

    return align_tokenizers(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
