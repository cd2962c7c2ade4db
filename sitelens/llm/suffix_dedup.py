"""Exact removal of repeated byte strings: suffix arrays of shards by induced sorting, permuted common prefixes.

Shards are made so that equal strings meet: each ``span``-byte window belongs to the lowest hash of the 32-byte strings
inside it, which equal windows have in common. Only windows whose lowest hash occurs again go further, and of equal
stretches of windows one stands for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import _BASE, _BYTE, _INVERSE, _power, mix, row_of, saved, span_hashes, text_blocks, tidy

_GRAM = 32
_MOST = 256  # windows of a stretch


# ---- suffix arrays ---------------------------------------------------------------------------------------------------


def _induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, starts: np.ndarray, width: int = 512) -> np.ndarray:
    """Suffixes in the order that sorting by induction gives from ``lms``, leftmost-smaller suffixes in their order.

    ``smaller``: which suffixes are smaller than the next one. ``starts``: where the bucket of each symbol begins, and the
    end. A sweep takes as many buckets at once, up to about ``width`` suffixes, as induce nothing into one another; a bucket
    that induces into itself is taken alone, part by part.
    """
    n, letters = len(text), len(starts) - 1
    order = np.full(n, -1, np.int32)
    own = text[lms]
    groups = np.bincount(own, minlength=letters)
    place = starts[1:][own] - np.cumsum(groups)[own] + np.arange(len(lms))  # at the end of each bucket
    order[place] = lms
    heads, tails = starts[:-1].copy(), starts[1:] - 1

    def put(found: np.ndarray, at: np.ndarray, sign: int) -> None:
        if not len(found):
            return
        letter = text[found]
        by = letter.argsort(kind="stable")
        found, letter = found[by], letter[by]
        after = (letter[1:] != letter[:-1]).nonzero()[0] + 1
        if len(after) == len(found) - 1:  # one suffix a bucket
            order[at[letter]] = found
            at[letter] += sign
            return
        first = np.concatenate(([0], after))
        n_of = np.concatenate((after, [len(found)])) - first
        rank = np.arange(len(found)) - first.repeat(n_of)
        order[at[letter] + sign * rank] = found
        at[letter[first]] += sign * n_of

    def left(found: np.ndarray, wanted: bool) -> np.ndarray:
        found = found[found > 0] - 1
        return found[smaller[found] == wanted]

    c = 0
    while c < letters:
        e = max(c + 1, int(np.searchsorted(starts, starts[c] + width, "right")) - 1)
        found = left(order[starts[c] : starts[e]], False)
        source, target = text[found + 1].astype(np.int64), text[found].astype(np.int64)
        least = np.minimum.accumulate(target)
        bad = np.flatnonzero(least <= source)[:1]
        if len(bad):
            found, e = found[: bad[0]], min(e, int(source[bad[0]]))
        if len(found):
            e = min(e, int(least[len(found) - 1]))
        if e > c:
            put(found[source[: len(found)] < e], heads, 1)
            c = e
            continue
        done = starts[c]
        while done < heads[c]:
            part, done = order[done : heads[c]].copy(), heads[c]
            put(left(part, False), heads, 1)
        put(left(order[starts[c + 1] - groups[c] : starts[c + 1]].copy(), False), heads, 1)
        c += 1
    order[place] = -1
    order[0] = n - 1  # the end mark
    c = letters
    while c > 1:
        e = min(c - 1, max(1, int(np.searchsorted(starts, starts[c] - width))))
        found = left(order[starts[e] : starts[c]][::-1], True)
        source, target = text[found + 1].astype(np.int64), text[found].astype(np.int64)
        most = np.maximum.accumulate(target)
        bad = np.flatnonzero(most >= source)[:1]
        if len(bad):
            found, e = found[: bad[0]], max(e, int(source[bad[0]]) + 1)
        if len(found):
            e = max(e, int(most[len(found) - 1]) + 1)
        if e < c:
            put(found[source[: len(found)] >= e], tails, -1)
            c = e
            continue
        c -= 1
        done = starts[c + 1] - 1
        while done > tails[c]:
            part, done = order[tails[c] + 1 : done + 1][::-1].copy(), tails[c]
            put(left(part, True), tails, -1)
        put(left(order[starts[c] : heads[c]][::-1].copy(), True), tails, -1)
    return order


def suffix_array(text: np.ndarray, width: int = 512) -> np.ndarray:
    """Suffix array of small non-negative integers whose last one is a 0 that stands nowhere else.

    Suffixes are classified by whether the next one is larger; the leftmost of each smaller run start the substrings that
    are sorted and named; their string of names is sorted in the same way; from their order all others are induced.
    """
    n = len(text)
    if n <= 2:
        return np.arange(n, dtype=np.int32)[::-1].copy()
    letters = int(text.max()) + 1
    text = text.astype(np.uint16 if letters <= 1 << 16 else np.int32)  # a stable sort of short symbols takes linear time
    up, same = text[1:] > text[:-1], text[1:] == text[:-1]
    last = np.where(same, np.int32(n), np.arange(n - 1, dtype=np.int32))
    last = np.minimum.accumulate(last[::-1])[::-1]  # the next place where neighbours differ
    smaller = np.ones(n, bool)
    smaller[:-1] = up[last]
    del last, up, same
    marks = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=letters))])
    order = _induce(text, smaller, marks[np.argsort(text[marks], kind="stable")], starts, width)
    is_mark = np.zeros(n, bool)
    is_mark[marks] = True
    ranked = order[is_mark[order]]
    del order, is_mark
    # Name each substring from one mark up to and with the next; equal strings get one name.
    code = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(text.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=code[1:])
    following = np.append(marks, n - 1)[np.searchsorted(marks, ranked) + 1]
    code = (code[np.minimum(following + 1, n)] - code[ranked]) * _power(_INVERSE, n)[ranked] + mix((following - ranked).astype(np.uint64))
    name = np.concatenate([[0], np.cumsum(code[1:] != code[:-1])]).astype(np.int32)
    del code, following
    if name[-1] + 1 < len(marks):
        # A name of one substring decides every comparison that reaches it: of such names in a row the first is enough.
        at = np.searchsorted(marks, ranked)
        once = np.bincount(name)[name] == 1
        names, single = np.empty(len(marks), np.int32), np.empty(len(marks), bool)
        names[at], single[at] = name, once
        keep = ~single
        keep[1:] |= ~single[:-1]
        kept = np.flatnonzero(keep)
        letter, short = np.unique(names[kept], return_inverse=True)
        several = kept[suffix_array(np.append(short + 1, 0), width)[1:]]
        ranked[~once] = marks[several[~single[several]]]
    return _induce(text, smaller, ranked, starts, width)


def permuted_lcp(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix by place in the text, how many symbols it shares with the one before it in ``order``.

    Where the symbols to the left of both agree, it is one less than at the place to the left; only the others are
    compared, four symbols at a time.
    """
    n = len(text)
    before = np.empty(n, np.int32)
    before[order[0]], before[order[1:]] = -1, order[:-1]
    first = np.ones(n, bool)
    both = np.flatnonzero(before[1:] > 0).astype(np.int32) + 1
    first[both] = text[both - 1] != text[before[both] - 1]
    first[1:] |= before[:-1] < 0
    four = np.zeros(n + 4, np.uint64)
    for k in range(4):
        four[: max(0, n - k)] |= (text[k:].astype(np.uint64) + np.uint64(1)) << np.uint64(48 - 16 * k)
    i = np.flatnonzero(first & (before >= 0)).astype(np.int32)
    same, alive = np.zeros(len(i), np.int32), np.arange(len(i), dtype=np.int32)
    x, y = i.copy(), before[i]
    while len(alive):
        diff = four[x] ^ four[y]
        equal = diff == 0
        stop, d = alive[~equal], diff[~equal]
        same[stop] += (d < np.uint64(1 << 48)).astype(np.int32) + (d < np.uint64(1 << 32)) + (d < np.uint64(1 << 16))
        alive, x, y = alive[equal], x[equal] + 4, y[equal] + 4
        same[alive] += 4
        ended = (x >= n) | (y >= n)
        alive, x, y = alive[~ended], x[~ended], y[~ended]
    lcp = np.zeros(n, np.int32)
    lcp[i] = same
    source = np.maximum.accumulate(np.where(first, np.arange(n, dtype=np.int32), np.int32(0)))
    return np.maximum(lcp[source] - (np.arange(n, dtype=np.int32) - source), 0)


def repeated_windows(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) where a string of ``span`` bytes starts that also starts elsewhere in these texts, parts of ``data``, in their order."""
    size = np.diff(offsets)
    ends = np.cumsum(size + 1)
    joined = np.ones(int(ends[-1]) + 1, np.uint16)  # 0 ends all, 1 each text
    joined[-1] = 0
    inside = np.ones(int(ends[-1]), bool)
    inside[ends - 1] = False
    joined[:-1][inside] = data[offsets[0] : offsets[-1]].astype(np.uint16) + 2
    del inside
    order = suffix_array(joined)
    lcp = permuted_lcp(joined, order)
    hit = np.zeros(len(joined), bool)
    long = np.flatnonzero(lcp[order] >= span)
    hit[order[long]] = True
    hit[order[long - 1]] = True
    # Every string that counts lies inside one text, as text ends are symbols of their own: an equal one has no end inside.
    at = np.flatnonzero(hit)
    text = np.searchsorted(ends, at, "right")
    place = at - (ends - size - 1)[text]
    fits = place <= size[text] - span
    return text[fits], place[fits]


# ---- Spark jobs ------------------------------------------------------------------------------------------------------


def stretches(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, low, code, twice): stretches of windows that have one lowest hash.

    ``start`` is a place in ``data``; ``code`` is a hash of all bytes of the stretch's windows; ``twice`` tells whether
    the lowest hash comes more than once among these, as it does if two windows of one stretch are equal.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < span:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(bool)
    low, size = _BYTE[data], 1
    steps = mix(np.arange(64, dtype=np.uint64)) | np.uint64(1)
    while size < _GRAM:
        low = low[:-size] * steps[size] + low[size:]
        size *= 2
    gram = low = mix(low)
    width, reach = span - _GRAM + 1, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if width > reach:
        low = np.minimum(low[: reach - width], low[width - reach :])
    begins = np.zeros(len(low) + 1, bool)
    begins[1:-1] = low[1:] != low[:-1]
    begins[offsets[offsets <= len(low)]] = True
    lasts = offsets[1:] - span + 1  # one past the last window of each row
    begins[lasts[(lasts >= 0) & (lasts <= len(low))]] = True
    begins[0] = begins[-1] = True
    start = np.flatnonzero(begins)
    long = np.diff(start)
    if (long > _MOST).any():
        parts = -(-long // _MOST)
        start = np.append(np.repeat(start[:-1] - np.concatenate([[0], np.cumsum(parts)[:-1]]) * _MOST, parts) + np.arange(parts.sum()) * _MOST, start[-1])
        long = np.diff(start)
    start = start[:-1]
    row = row_of(offsets, start)
    good = start + span <= offsets[row + 1]
    start, long, row = start[good], long[good], row[good]
    own = low[start]
    # Where a lowest hash stands: as the lowest of all strings in some window over it.
    high, reach = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)]), 1
    while 2 * reach <= width:
        high = np.maximum(high[:-reach], high[reach:])
        reach *= 2
    if width > reach:
        high = np.maximum(high[: reach - width], high[width - reach :])
    at = np.flatnonzero(gram == high)
    names, name = np.unique(gram[at], return_inverse=True)
    keys = np.sort(name * n + at)
    base = np.searchsorted(names, own) * n + start
    twice = np.searchsorted(keys, base + long + width - 1) - np.searchsorted(keys, base) > 1
    return row, start, long, own, span_hashes(data, start, start + long + span - 1), twice


def _tag(text="text"):
    """20 bits of a text's hash: tells rows apart that have one doc_id."""
    return F.pmod(F.xxhash64(text), F.lit(1 << 20))


def _pack(start, windows, tag, twice):
    return (tag << 42) | (start << 10) | (twice.astype(np.int64) << 9) | windows


def repeated_spans(docs: DataFrame, *, span: int = 200, hot: int = 8_000, shard_bytes: int = 1 << 20, partitions: int | None = None) -> DataFrame:
    """(doc_id, tag, start, stop): byte ranges of ``docs`` (doc_id, text, tag) that together are what repeated strings of ``span`` bytes cover."""
    spark = docs.sparkSession

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column("doc_id"), np.asarray(batch.column("tag").to_numpy(zero_copy_only=False), np.int64)
            for first, data, offsets in text_blocks(batch.column("text"), 1 << 19):
                row, start, long, low, code, twice = stretches(data, offsets, span)
                for i in range(0, len(row), 50_000):
                    r = row[i : i + 50_000]
                    where = _pack(start[i : i + 50_000] - offsets[r], long[i : i + 50_000], tags[first + r], twice[i : i + 50_000])
                    yield pa.record_batch([pa.array(low[i : i + 50_000].view(np.int64)), pa.array(code[i : i + 50_000].view(np.int64)), ids.take(pa.array(first + r)), pa.array(where)], ["low", "code", "doc_id", "place"])

    found = saved(docs.select("doc_id", "text", "tag").mapInArrow(tidy(scan), "low long, code long, doc_id long, place long"), "stretches")
    twice = F.max(F.col("place").bitwiseAND(F.lit(512))) > 0
    again = found.groupBy("low").agg(F.count("*").alias("n"), twice.alias("twice")).filter("n > 1 or twice").select("low")
    rows = saved(found.join(again, "low", "left_semi"), "repeats")
    # Equal stretches: all their windows repeat. One of them stands for them among the others with the same lowest hash.
    kinds = saved(rows.groupBy("low", "code").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "place")).alias("one")).select("low", "code", "n", "one.doc_id", "one.place"), "kinds")
    whole = rows.join(kinds.filter("n > 1").select("low", "code"), ["low", "code"], "left_semi")
    varied = kinds.groupBy("low").agg(F.count("*").alias("kinds"), twice.alias("twice")).filter("kinds > 1 or twice").drop("twice")
    open_ = kinds.join(varied, "low").select("low", "n", "kinds", "doc_id", "place")
    wanted = open_.withColumn("tag", F.shiftright("place", 42)).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("place", "low", "n", "kinds")).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of each stretch that has to be compared."""
        for batch in batches:
            ids = batch.column("doc_id")
            for first, data, offsets in text_blocks(batch.column("text")):
                parts = batch.column("parts").slice(first, len(offsets) - 1)
                row, flat = pc.list_parent_indices(parts).to_numpy(), parts.flatten()
                place = flat.field("place").to_numpy()
                start = offsets[row] + ((place >> 10) & 0xFFFFFFFF)
                raw, at = data.tobytes(), start.tolist()
                cuts = [raw[a:z] for a, z in zip(at, (start + (place & 511) + span - 1).tolist(), strict=True)]
                yield pa.record_batch([*(flat.field(c) for c in ("low", "n", "kinds")), ids.take(pa.array(first + row)), flat.field("place"), pa.array(cuts, pa.binary())], ["low", "n", "kinds", "doc_id", "place", "bytes"])

    pieces = saved(docs.join(wanted, (docs.doc_id.eqNullSafe(wanted.doc_id)) & (docs.tag == wanted.tag)).select(docs.doc_id, docs.text, "parts").mapInArrow(tidy(cut), "low long, n long, kinds long, doc_id long, place long, bytes binary"), "pieces")
    columns = "doc_id long, tag long, start long, stop long"

    def ranges(doc_id: pa.Array, where: np.ndarray, text: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        """The runs of places of each text; ``doc_id`` and ``where`` are by text."""
        cut = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1))) if len(text) else np.zeros(0, np.int64)
        last = np.append(cut[1:], len(text)) - 1
        own = text[cut]
        start = (where[own] >> 10) & 0xFFFFFFFF
        return pa.record_batch([doc_id.take(pa.array(own)), pa.array(where[own] >> 42), pa.array(start + place[cut]), pa.array(start + place[last] + span)], ["doc_id", "tag", "start", "stop"])

    def sort_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of ``low``; a shard is as many whole groups as make about ``shard_bytes``."""
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                raw = rows["bytes"].combine_chunks().cast(pa.large_binary())
                raw = raw if isinstance(raw, pa.Array) else pa.concat_arrays(raw.chunks)
                offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
                text, place = repeated_windows(np.frombuffer(raw.buffers()[2], np.uint8), offsets, span)
                own = rows["n"].to_numpy()[text] == 1
                yield ranges(rows["doc_id"].combine_chunks(), rows["place"].to_numpy(), text[own], place[own])

        for batch in batches:
            if not batch.num_rows:
                continue
            low = batch.column("low").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1, [len(low)]])
            sizes = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy(zero_copy_only=False), dtype=np.int64)])
            first = 0
            for i in cuts[:-1].tolist():
                if size + sizes[i] - sizes[first] > shard_bytes and low[i] != (low[i - 1] if i else last):
                    if i > first:
                        held.append(batch.slice(first, i - first))
                    yield from flush()
                    first, size = i, 0
            held.append(batch.slice(first))
            size, last = size + sizes[-1] - sizes[first], low[-1]
        yield from flush()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two hashes of every window of stretches of a very frequent lowest hash."""
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["bytes"], np.uint8)
                at = np.arange(r["place"] & 511)
                a, b = span_hashes(data, at, at + span), span_hashes(data ^ np.uint8(0xA5), at, at + span)
                start = (r["place"] >> 10) & 0xFFFFFFFF
                k = len(at)
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([r["doc_id"]] * k, pa.int64()), pa.array(np.full(k, r["place"] >> 42)), pa.array(start + at)], ["a", "b", "doc_id", "tag", "start"])

    shards = pieces.filter(F.col("kinds") <= hot)
    shards = shards.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), "low").sortWithinPartitions("low")
    sorted_ = shards.mapInArrow(tidy(sort_shard), columns)
    each = pieces.filter(F.col("kinds") > hot).mapInArrow(tidy(windows), "a long, b long, doc_id long, tag long, start long")
    equal_ = each.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b")
    frequent = each.join(equal_, ["a", "b"], "left_semi").select("doc_id", "tag", "start", (F.col("start") + span).alias("stop"))
    start = F.shiftright("place", 10).bitwiseAND(F.lit(0xFFFFFFFF))
    equal = whole.select("doc_id", F.shiftright("place", 42).alias("tag"), start.alias("start"), (start + F.col("place").bitwiseAND(F.lit(511)) + (span - 1)).alias("stop"))
    return equal.unionByName(sorted_).unionByName(frequent)


def remove_repeats(docs: DataFrame, *, span: int = 200, hot: int = 8_000, shard_bytes: int = 1 << 20, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """(doc_id, kept binary, kept_text, n_bytes, n_removed, n_spans) of every row of ``docs`` (doc_id, text), and the columns ``carry``.

    ``kept_text`` is ``kept`` without the parts of characters that were cut. A byte goes if a string of ``span`` bytes covers it that also starts anywhere else in the texts, its own included.
    ``kept`` are the other bytes. A null text is empty; a text of fewer than ``span`` bytes keeps all. Of repeated rows
    every one loses what it shares with the others. An empty table gives no rows; other columns are ignored.
    Groups of more than ``hot`` different stretches with one lowest hash are compared window by window, by hash,
    instead of in one shard.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("rest")).withColumn("tag", _tag())
    spans = repeated_spans(docs, span=span, hot=hot, shard_bytes=shard_bytes).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"), "spans")
    joined = docs.join(spans, docs.doc_id.eqNullSafe(F.col("_doc")) & (docs.tag == F.col("_tag")), "left").select("doc_id", "text", "rest", "spans")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_blocks(batch.column("text")):
                n = len(offsets) - 1
                kept, gone, runs = [], [], []
                for i, spans in enumerate(batch.column("spans").slice(first, n)):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    parts, end, count, removed = [], 0, 0, 0
                    for a, z in sorted((s["start"], s["stop"]) for s in (spans.as_py() or ())):
                        if a > end or not count:  # a run of its own; ranges that touch are one run
                            parts.append(raw[end:a])
                            count += 1
                            removed += z - a
                            end = z
                        elif z > end:
                            removed += z - end
                            end = z
                    parts.append(raw[end:])
                    kept.append(b"".join(parts))
                    gone.append(removed)
                    runs.append(count)
                texts = [k.decode(errors="ignore") for k in kept]
                yield pa.record_batch([batch.column("doc_id").slice(first, n), pa.array(kept, pa.binary()), pa.array(texts, pa.string()), pa.array(np.diff(offsets)), *(pa.array(x, pa.int64()) for x in (gone, runs)), batch.column("rest").slice(first, n)], ["doc_id", "kept", "kept_text", "n_bytes", "n_removed", "n_spans", "rest"])

    rest = joined.schema["rest"].dataType.simpleString()
    return joined.mapInArrow(tidy(keep), f"doc_id long, kept binary, kept_text string, n_bytes long, n_removed long, n_spans long, rest {rest}").select("doc_id", "kept", "kept_text", "n_bytes", "n_removed", "n_spans", *(F.col("rest")[c].alias(c) for c in carry))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what stays of every document, for strings of 200 bytes."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
