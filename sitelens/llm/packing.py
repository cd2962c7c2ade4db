"""Packing token sequences: best fit inside partitions, then rounds that merge what is left underfull."""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Known, different, ragged, row_of, saved, span_hashes, text_blocks, tidy, word_spans

BLOCK = 1 << 19  # bytes of text that a task encodes at once
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?%$#&*")] = True
_ALNUM = np.zeros(256, bool)
_LETTER = np.arange(256) >= 128  # may be of a lower-case letter
_LETTER[97:123] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _plain(text: str) -> bool:
    """Whether a text is of lower-case letters alone."""
    return text.isalpha() and text == text.lower()


class WordTokenizer:
    """Token ids of whole texts from the ids of their words, each different word being encoded once a task.

    The vocabulary's rules never look across white space, nor from an ASCII letter or digit to the punctuation that ends
    a word, so the ids of a text are those of its words in order.
    """

    def __init__(self, path: str, most_words: int = 200_000):
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)  # one copy of the vocabulary, with and without its normalizer in turn
        self.normal, self.plain = self.tokenizer.normalizer, normalizers.Sequence([])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words, self.older = Known(1, "<u4"), Known(1, "<u4")  # the older ones not met since the newer ones were half of ``most_words``
        self.most_words = most_words

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        letter = _LETTER[data]
        letter[:-1] &= (data[:-1] != 0xC3) | (data[1:] >= 0x9F)  # capitals of Latin-1
        within = lambda kind: (lambda n: n[ends] - n[starts] == ends - starts)(np.concatenate([[0], np.cumsum(kind)]))
        may, ascii_ = within(letter), within(letter & (data < 128))
        found, left = [], [np.flatnonzero(~may)]

        def together(part: np.ndarray) -> bool:
            """Encodes words as one text, if none of them is changed by the normalizer or parted."""
            size = ends[part] - starts[part] + 1  # with a space, or what follows a word in its text
            raw = ragged(data, starts[part], size - 1)
            if not _plain(raw.tobytes().decode()):
                return False
            text = np.full(int(size.sum()), 32, np.uint8)
            text[np.arange(len(raw)) + np.repeat(np.arange(len(part)), size - 1)] = raw
            text = text.tobytes().decode()
            if not unicodedata.is_normalized("NFC", text):
                return False
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                return False
            found.append((part, ids, np.diff(np.concatenate([[0], stops]))))
            return True

        self.tokenizer.normalizer = self.plain
        many = np.concatenate([np.flatnonzero(ascii_), np.flatnonzero(may & ~ascii_)])
        for i in range(0, len(many), 512):
            part = many[i : i + 512]
            if not together(part):
                words = [data[a:b].tobytes().decode() for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
                simple = np.array([_plain(w) and unicodedata.is_normalized("NFC", w) for w in words], bool)
                left.append(part[~simple])
                if simple.any() and not together(part[simple]):
                    left.append(part[simple])
        self.tokenizer.normalizer = self.normal
        rest = np.concatenate(left)
        for i in range(0, len(rest), 512):
            part = rest[i : i + 512]
            words = [data[a:b].tobytes().decode() for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            found.append((part, np.array([k for x in ids for k in x], np.int64), np.array([len(x) for x in ids], np.int64)))
        if found:
            own, ids, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
            self.words.add(hashes[own], [(ids.astype("<u4"), sizes)])

    def encode(self, data: np.ndarray, offsets: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, each row's followed by ``last``; and the offsets of the rows among them."""
        rows = len(offsets) - 1
        if b"<|" not in data.tobytes():  # else it may hold the name of a special token, which lower case would change
            data = _LOWER[data]
        starts, ends = word_spans(data, offsets)
        cut, left = ends.copy(), np.arange(len(ends))
        for _ in range(8):
            left = left[_TAIL[data[cut[left] - 1]] & (cut[left] - 1 > starts[left])]
            cut[left] -= 1
        cut = np.where(_ALNUM[data[cut - 1]], cut, ends)
        tail = cut < ends
        order = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(tail)[:-1]]) if len(starts) else np.zeros(0, np.int64)
        first, stop = (np.zeros(len(starts) + int(tail.sum()), np.int64) for _ in range(2))
        first[order], stop[order] = starts, cut
        first[order[tail] + 1], stop[order[tail] + 1] = cut[tail], ends[tail]
        hashes = span_hashes(data, first, stop)
        at, which = different(hashes)
        unique = hashes[at]
        if self.words.more_than(self.most_words // 2):
            self.words, self.older = Known(1, "<u4"), self.words
        fresh = at[self.words.lacks(unique, self.older)]
        self._learn(data, first[fresh], stop[fresh], hashes[fresh])
        ((flat, size),) = self.words.take(self.words.find(unique))
        length = size[which]
        before = np.concatenate([[0], np.cumsum(length)])
        ids = ragged(flat, (np.cumsum(size) - size)[which], length)
        bounds = before[np.searchsorted(row_of(offsets, first), np.arange(1, rows + 1), "left")]  # ids up to the end of each row
        ids = np.insert(ids, bounds, np.uint32(last))
        return ids.astype("<u4"), np.concatenate([[0], bounds + np.arange(1, rows + 1)])


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row of ``docs``: its ids and ``end_id``, cut every ``capacity``."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        for batch in batches:
            ids_of = batch.column("doc_id")
            for first, data, offsets in text_blocks(batch.column("text"), BLOCK):
                ids, bounds = tokenizer.encode(data, offsets, end_id)
                raw = memoryview(ids.tobytes())
                row, piece, start, length, crc = [], [], [], [], []
                for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    for p, s in enumerate(range(a, b, capacity)):
                        e = min(b, s + capacity)
                        row.append(first + r)
                        piece.append(p)
                        start.append(s - a)
                        length.append(e - s)
                        crc.append(zlib.crc32(raw[4 * s : 4 * e]))
                yield pa.record_batch([ids_of.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return typed.mapInArrow(tidy(pieces), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each item: largest first, each into the bin with the least room that it fits."""
    order = np.argsort(-sizes, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by their room
    open_rooms, left = 0, []
    at, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = open_rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            r, b = capacity, len(left)
            left.append(capacity)
        at[i], place[i] = b, capacity - r
        left[b] = r - size
        if left[b]:
            room[left[b]].append(b)
            open_rooms |= 1 << left[b]
    return at, place


def pack(items: DataFrame, *, capacity: int = 4096, slack: int = 16, items_a_task: int = 50_000, progress: float = 0.02) -> DataFrame:
    """(item, sequence_id, offset) of each row of ``items`` (item long, length long; lengths from 1 to ``capacity``).

    Each round, every partition best-fits its items and emits the bins with at most ``slack`` room; of the other bins those
    that have room for the smallest of all become items of their size for the next round, dealt anew into as many partitions
    as hold ``items_a_task`` each, one in the end. It ends when no bin has a partner, or when a round over several
    partitions has made less than ``progress`` of the items into others, so that no task ever gets more than its share.
    """
    items = saved(items.select(F.col("item").alias("id"), F.col("length").alias("size")), "pack-items")
    rounds: list[DataFrame] = []
    n = items.count()
    while True:
        level = len(rounds)
        share = items_a_task - 4 * math.isqrt(items_a_task)  # dealt by hash, so not quite evenly
        partitions = 1 if n <= items_a_task else -(-n // max(1, share))

        def fit(batches: Iterator[pa.RecordBatch], level=level) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            table = pa.Table.from_batches(list(batches), pa.schema([("id", pa.int64()), ("size", pa.int64())]))
            order = np.argsort(table["id"].to_numpy(), kind="stable")  # the same bins if the task runs again
            ids, sizes = table["id"].to_numpy()[order], table["size"].to_numpy()[order]
            at, place = _best_fit(sizes, capacity)
            filled = np.bincount(at, sizes, minlength=int(at.max(initial=-1)) + 1).astype(np.int64)
            name = (np.int64(level + 1) << 56) | (np.int64(TaskContext.get().partitionId()) << 32) | at
            for i in range(0, len(ids), 50_000):
                cut = slice(i, i + 50_000)
                yield pa.record_batch([pa.array(ids[cut]), pa.array(name[cut]), pa.array(place[cut]), pa.array(filled[at[cut]])], ["id", "bin", "place", "filled"])

        dealt = items.repartition(partitions, F.xxhash64("id", F.lit(level))) if partitions > 1 else items.coalesce(1)
        done = saved(dealt.mapInArrow(tidy(fit), "id long, bin long, place long, filled long"), f"pack-{level}")
        rounds.append(done)
        if partitions == 1:
            break
        open_ = done.filter(F.col("filled") < capacity - slack).groupBy("bin").agg(F.first("filled").alias("size")).withColumnRenamed("bin", "id")
        least = open_.agg(F.min("size")).first()[0]
        items = open_.filter(F.col("size") <= capacity - (capacity if least is None else least))
        before, n = n, items.count()
        if n == 0 or level and n > (1 - progress) * before:
            break
    found = rounds[0].select(F.col("id").alias("item"), "bin", F.col("place").alias("offset"))
    for done in rounds[1:]:
        merged = done.select(F.col("id").alias("bin"), F.col("bin").alias("_bin"), F.col("place").alias("_place"))
        found = found.join(merged, "bin", "left").select("item", F.coalesce("_bin", "bin").alias("bin"), (F.col("offset") + F.coalesce("_place", F.lit(0))).alias("offset"))
    return found.select("item", F.col("bin").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every row of ``docs`` (doc_id, text) packed.

    A null or empty text is one piece of ``end_id`` alone. Repeated rows, also of one doc_id, are packed each for itself.
    Only texts of more than ``capacity`` ids are cut. An empty table gives no rows; other columns are ignored.
    """
    pieces = saved(token_pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id).withColumn("item", F.monotonically_increasing_id()), "pieces")
    full = pieces.filter(F.col("length") == capacity)
    packed = pack(pieces.filter(F.col("length") < capacity).select("item", "length"), capacity=capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    # A full piece is a sequence of its own; other numbers have their round in the upper bits, so that none is negative.
    return full.withColumns({"sequence_id": -1 - F.col("item"), "offset": F.lit(0).cast("long")}).select(columns).unionByName(pieces.join(packed, "item").select(columns))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens of word_bpe_49k."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
