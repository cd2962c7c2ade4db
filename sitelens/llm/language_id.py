"""Language identification with language-bitmask n-gram filters (a bit-sliced Bloom filter)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import mix, text_blocks

#: A byte of a letter (ASCII letters, and every byte of a longer UTF-8 sequence) stays; any other byte is a space.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_BREAK = _LETTER == 32


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether a document is kept out of every fit: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of the 3- and 4-byte windows of the letters of each text, and whether each window counts.

    A window counts if it stays inside its text and holds a letter next to its second byte: runs of other bytes and of
    white space give nothing.
    """
    clean = _LETTER[data].astype(np.uint32)
    gap = _BREAK[data]
    n = len(clean)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    inner = np.zeros(n, np.uint32)
    for size in (3, 4):
        if n < size:
            continue
        m = n - size + 1
        code = inner[:m].copy()
        bad = np.zeros(m, bool)
        for k in range(size):
            code = (code << np.uint32(8)) | clean[k : k + m]
            if k:
                bad |= cut[k : k + m]
        yield code, ~(bad | gap[1 : 1 + m])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each n-gram in each language: one table a task, whatever the task reads."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merge(parts):
        codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return [(codes, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64))]

    for batch in batches:
        table = pa.Table.from_batches([batch])
        for lang in table["lang"].unique().to_pylist():
            part = table.filter(pa.compute.equal(table["lang"], lang))
            for _, data, offsets in text_blocks(part["text"], lower=True):
                for code, keep in _grams(data, offsets):
                    held.setdefault(lang, []).append(np.unique(code[keep], return_counts=True))
            if len(held.get(lang, ())) > 32:
                held[lang] = merge(held[lang])
    for lang, parts in held.items():
        ((codes, counts),) = merge(parts)
        for i in range(0, len(codes), 50_000):
            c = codes[i : i + 50_000]
            yield pa.record_batch([pa.array([lang] * len(c)), pa.array(c.astype(np.int64)), pa.array(counts[i : i + 50_000])], ["lang", "gram", "n"])


class LanguageFilter:
    """For each slot the bits of the languages with an n-gram that hashes there; an n-gram has ``probes`` slots."""

    def __init__(self, langs: list[str], grams: np.ndarray, lang_of: np.ndarray, slot_bits: int = 22, probes: int = 3):
        self.langs, self.bits, self.probes = langs, slot_bits, probes
        words = max(1, -(-len(langs) // 64))
        width = np.uint8 if len(langs) <= 8 else np.uint16 if len(langs) <= 16 else np.uint32 if len(langs) <= 32 else np.uint64
        self.slots = [np.zeros(1 << slot_bits, width) for _ in range(words)]
        for slot in self._slots(grams.astype(np.uint64)):
            for k in range(len(langs)):
                np.bitwise_or.at(self.slots[k // 64], slot[lang_of == k], width(1 << (k % 64)))
        self.false = np.array([np.mean((self.slots[k // 64] >> width(k % 64)) & width(1)) ** probes for k in range(len(langs))])

    def _slots(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(grams + np.uint64(1))
        for i in range(self.probes):
            yield ((h >> np.uint64(i * (64 - self.bits) // max(1, self.probes - 1))) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def languages(self, grams: np.ndarray) -> list[np.ndarray]:
        """Bitmasks of all languages that (but for false positives) contain each n-gram, 64 languages a word."""
        found = None
        for slot in self._slots(grams.astype(np.uint64)):
            part = [s[slot] for s in self.slots]
            found = part if found is None else [a & b for a, b in zip(found, part, strict=True)]
        return found


def fit_filter(train: DataFrame, min_rate: float = 1e-4, slot_bits: int = 22, probes: int = 3) -> tuple[LanguageFilter, str]:
    """Filter over all texts of ``train`` (lang, text), and the commonest language.

    A language has every n-gram that makes at least ``min_rate`` of its n-grams, whatever other languages have it too: at
    most 1 / ``min_rate`` of them, so what the driver gets is bounded by the number of languages alone.
    """
    counts = train.select("lang", "text").mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    try:
        totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        langs = sorted(totals)
        if not langs:
            return LanguageFilter([], np.zeros(0, np.int64), np.zeros(0, np.int64), slot_bits, probes), "und"
        sizes = F.create_map(*[F.lit(x) for k in langs for x in (k, float(totals[k]))])
        rated = counts.select("lang", "gram", (F.col("n") / sizes[F.col("lang")]).alias("rate")).filter(F.col("rate") >= min_rate)
        table = rated.select("gram", "lang").toPandas()
    finally:
        counts.unpersist()
    index = {k: i for i, k in enumerate(langs)}
    found = LanguageFilter(langs, table["gram"].to_numpy(np.int64), table["lang"].map(index).to_numpy(np.int64), slot_bits, probes)
    return found, max(langs, key=lambda k: (totals[k], k))


def identify_language(docs: DataFrame, train: DataFrame, *, min_rate: float = 1e-4, slot_bits: int = 22, probes: int = 3) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text), learnt from ``train`` (lang, text).

    Each n-gram of a text adds one to every language whose filter has it. The count c of n n-grams is corrected to
    (c - n f) / (1 - f), f being that language's rate of false positives; the highest wins (ties: first by name), its
    share of the sum is the score. A null text or one without letters gives ``und`` and 0. Letters without any known
    n-gram give the commonest language and 0. Rows are neither merged nor dropped; nulls in other columns do not matter,
    and columns other than those named are ignored.
    """
    model, common = fit_filter(train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()), min_rate, slot_bits, probes)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.langs)
        names = np.array([*model.langs, common, "und"], object)
        for batch in batches:
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
            hits, total = np.zeros((batch.num_rows, k)), np.zeros(batch.num_rows)
            for first, data, offsets in text_blocks(batch.column("text"), lower=True):
                rows = len(offsets) - 1
                for code, keep in _grams(data, offsets):
                    at = np.flatnonzero(keep)
                    masks = model.languages(code[at]) if k else []
                    row = np.repeat(np.arange(rows), np.diff(np.searchsorted(at, offsets)))
                    total[first : first + rows] += np.bincount(row, minlength=rows)
                    for i in range(k):
                        bit = (masks[i // 64] >> masks[i // 64].dtype.type(i % 64)) & masks[i // 64].dtype.type(1)
                        hits[first : first + rows, i] += np.bincount(row, bit, minlength=rows)
            true = np.maximum((hits - total[:, None] * model.false) / np.maximum(1 - model.false, 1e-9), 0) if k else hits
            mass = true.sum(axis=1)
            pick = np.where(mass > 0, true.argmax(axis=1), k) if k else np.full(batch.num_rows, k)
            score = np.divide(true.max(axis=1), mass, out=np.zeros(batch.num_rows), where=mass > 0) if k else np.zeros(batch.num_rows)
            pick, score = np.where(lettered, pick, k + 1), np.where(lettered, score, 0.0)
            yield pa.record_batch([batch.column("doc_id"), pa.array(names[pick].tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return typed.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; documents held out are not learnt from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify_language(docs, docs.filter(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
