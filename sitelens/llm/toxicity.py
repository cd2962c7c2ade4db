"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import mix, row_of, shingle_block, span_hashes, text_blocks, tidy, word_spans
from .language_id import held_out

_BITS = 22
_STRIP = np.zeros(256, bool)
_STRIP[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _features(data: np.ndarray, offsets: np.ndarray, wanted=None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each whole word and of each window of five bytes inside a word, repeated as in the text.

    ``wanted``: a table by the low bits of a feature; others are left out early.
    """
    blank = np.where(_STRIP[data], np.uint8(32), data)
    starts, ends = word_spans(blank, offsets)
    found = [(row_of(offsets, starts), span_hashes(blank, starts, ends))]
    n = len(blank) - 4
    if n > 0 and len(starts):
        long = ends - starts >= 5
        edge = np.zeros(len(blank) + 1, np.int8)
        edge[starts[long]] = 1  # windows start from here
        edge[ends[long] - 4] -= 1  # and no more from here; a word may start where windows of the one before end
        at = np.flatnonzero(np.cumsum(edge[:n], dtype=np.int8))
        wide = blank.astype(np.uint64)
        code = wide[:n]
        for k in range(1, 5):
            code = (code << np.uint64(8)) | wide[k : k + n]
        found.append((at, mix(code[at] + np.uint64(1 << 50))))
    rows, codes = [], []
    for i, (at, code) in enumerate(found):
        if wanted is not None:
            keep = wanted[(code & np.uint64((1 << _BITS) - 1)).astype(np.int64)]
            at, code = at[keep], code[keep]
        rows.append(row_of(offsets, at) if i else at)
        codes.append(code)
    return np.concatenate(rows), np.concatenate(codes)


def _counts(data, offsets, wanted=None, known=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, occurrences); with ``known`` (sorted features), their positions there instead of features."""
    rows, codes = _features(data, offsets, wanted)
    if known is not None:
        where = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
        keep = known[where] == codes if len(known) else np.zeros(len(codes), bool)
        rows, codes = rows[keep], where[keep].astype(np.uint64)
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
    at = np.flatnonzero(first)
    return rows[at], codes[at], np.diff(np.append(at, len(rows)))


def _lowest_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest five-word shingle of each text by two hashes; texts without words give values of their own."""
    for batch in batches:
        low = np.stack([np.asarray(batch.column("doc_id").to_numpy(zero_copy_only=False), np.int64)] * 2).astype(np.uint64)
        for first, data, offsets in text_blocks(batch.column("text")):
            codes, rows = shingle_block(data, offsets, 5)
            at = np.flatnonzero(np.diff(rows, prepend=-1))
            if len(at):
                low[:, first + rows[at]] = [np.minimum.reduceat(x, at) for x in (codes, mix(codes))]
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(x.view(np.int64)) for x in low)], ["doc_id", "a", "b"])


class BlockMaxIndex:
    """Unit vectors of the examples by feature, in blocks of examples with the largest weight of each block."""

    def __init__(self, ids, labels, vectors, idf: np.ndarray, block: int = 64):
        self.ids, self.labels, self.idf, self.block = np.asarray(ids, np.int64), np.asarray(labels, float), idf, block
        postings: dict[int, list[tuple[int, float]]] = {}
        for i, (feature, weight) in enumerate(vectors):
            for f, w in zip(feature.tolist(), weight.tolist(), strict=True):
                postings.setdefault(f, []).append((i, w))
        self.postings = {}
        for f, pairs in postings.items():
            rows, weights = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
            cuts = np.flatnonzero(np.diff(rows // block, prepend=-1))
            self.postings[f] = (rows, weights, dict(zip((rows[cuts] // block).tolist(), zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)], strict=True), strict=True)), rows[cuts] // block, np.maximum.reduceat(weights, cuts))
        self.blocks = -(-len(self.ids) // block)

    def nearest(self, features: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of the highest cosine above 0 and their cosines. Blocks whose bound can't reach the k-th best are not opened."""
        bound = np.zeros(self.blocks)
        own = [(self.postings[f], w) for f, w in zip(features.tolist(), weights.tolist(), strict=True) if f in self.postings]
        for (_, _, _, blocks, most), w in own:
            bound[blocks] += w * most
        rows, scores, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or bound[b] < least:
                break
            part = np.zeros(self.block)
            for (ids, values, where, _, _), w in own:
                if (cut := where.get(int(b))) is not None:
                    part[ids[cut[0] : cut[1]] - b * self.block] += w * values[cut[0] : cut[1]]
            hit = np.flatnonzero(part)
            rows, scores = np.append(rows, hit + b * self.block), np.append(scores, part[hit])
            if len(rows) > k:
                best = np.lexsort((rows, -scores))[:k]
                rows, scores = rows[best], scores[best]
                least = scores[-1]
        best = np.lexsort((rows, -scores))[:k]
        return rows[best], scores[best]


def score_toxicity(docs: DataFrame, labels: DataFrame, *, max_examples: int = 6000, max_features: int = 20_000, min_z: float = 5.0, min_ratio: float = 8.0, min_count: int = 3, k: int = 15, doubt: float = 0.05, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """(doc_id, score, evidence) for every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, toxic), and the columns ``carry``.

    Examples: of each class the ``max_examples`` / 2 labelled documents of the smallest hash. Features are words and
    five-byte windows inside words whose share among toxic examples differs from that among others by ``min_z``
    standard errors and ``min_ratio`` times; their document frequencies come from all of ``docs``. A document's score is the vote of its
    ``k`` nearest examples by exact cosine, each weighted by its squared cosine and by how many labelled documents it
    stands for, with ``doubt`` votes at the overall rate; evidence lists those examples' ids. A text without any such
    feature, as an empty or null one, gets the toxic rate of examples without any. Without labels the score is 0.
    Several labels of one document count as the largest; null labels do not count. Rows are neither merged nor dropped.
    """
    spark = docs.sparkSession
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(F.lit(0).alias("_"), *carry).alias("rest"))
    docs = whole.select("doc_id", "text")
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = marks.filter("toxic = 1").orderBy(*order).limit(max_examples // 2).unionByName(marks.filter("toxic = 0").orderBy(*order).limit(max_examples // 2))
    chosen = dict(map(tuple, sample.select("doc_id", "toxic").collect()))

    def texts_of(ids) -> DataFrame:
        """The rows of at most max_examples ids: a bounded number, so it is sent to every task."""
        return docs.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id", "left_semi")

    # Near copies of one text would make its every word look like a sign: of those that share a lowest shingle, one stays.
    lowest = [set(), set()]
    for r in texts_of(chosen).mapInArrow(_lowest_shingles, "doc_id long, a long, b long").orderBy("doc_id").collect():
        if (r["a"] in lowest[0] or r["b"] in lowest[1]) and r["doc_id"] in chosen:
            del chosen[r["doc_id"]]
        lowest[0].add(r["a"])
        lowest[1].add(r["b"])
    known_labels = spark.sparkContext.broadcast(chosen)
    examples = texts_of(chosen)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, data, offsets in text_blocks(batch.column("text"), lower=True):
                rows, codes, _ = _counts(data, offsets)
                toxic = np.array([known_labels.value[i] for i in ids[first : first + len(offsets) - 1]], np.int64)[rows]
                codes, where = np.unique(codes, return_inverse=True)
                yield pa.record_batch([pa.array(codes.view(np.int64)), pa.array(np.bincount(where, toxic, len(codes)).astype(np.int64)), pa.array(np.bincount(where, 1 - toxic, len(codes)).astype(np.int64))], ["f", "t", "c"])

    n1 = max(1, sum(chosen.values()))
    n0 = max(1, len(chosen) - sum(chosen.values()))
    rate = (F.col("t") + F.col("c")) / (n1 + n0)
    z = F.try_divide(F.col("t") / n1 - F.col("c") / n0, F.sqrt(F.greatest(F.lit(0.0), rate * (1 - rate)) * (1 / n1 + 1 / n0)))
    ratio = (F.col("t") / n1 + 0.25 / n1) / (F.col("c") / n0 + 0.25 / n0)
    seen = examples.mapInArrow(presence, "f long, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).filter(F.col("t") + F.col("c") >= min_count)
    picked = seen.withColumn("z", z).filter((F.abs("z") >= min_z) & ((ratio >= min_ratio) | (ratio <= 1 / min_ratio))).orderBy(F.abs("z").desc(), "f").limit(max_features).select("f").toPandas()["f"] if chosen else []
    features = np.sort(np.asarray(picked, np.int64).view(np.uint64))
    wanted = np.zeros(1 << _BITS, bool)
    wanted[(features & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    table = spark.sparkContext.broadcast((features, np.packbits(wanted)))

    def vectors(batches):
        """The counts of the features in each block of texts, and how many rows it has."""
        features, packed = table.value
        wanted = np.unpackbits(packed).astype(bool)
        for batch in batches:
            for first, data, offsets in text_blocks(batch.column("text"), lower=True):
                yield batch, first, len(offsets) - 1, _counts(data, offsets, wanted, features)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(table.value[0]), np.int64), 0
        for _, _, rows, (_, f, _) in vectors(batches):
            total += np.bincount(f.astype(np.int64), minlength=len(total))
            n += rows
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["i", "n"])

    df = {r["i"]: r["n"] for r in docs.select("text").mapInArrow(frequencies, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    idf = np.log((1 + df.get(-1, 0)) / (1 + np.array([df.get(i, 0) for i in range(len(features))], float))) + 1 if len(features) else np.zeros(0)

    def example_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, rows, (row, f, n) in vectors(batches):
            cuts = np.searchsorted(row, np.arange(rows + 1))
            ids = batch.column("doc_id").slice(first, rows)
            yield pa.record_batch([ids, pa.array([f[a:b].astype(np.int64).tolist() for a, b in zip(cuts, cuts[1:])], pa.list_(pa.int64())), pa.array([n[a:b].tolist() for a, b in zip(cuts, cuts[1:])], pa.list_(pa.int64()))], ["doc_id", "f", "n"])

    own = examples.mapInArrow(example_vectors, "doc_id long, f array<long>, n array<long>").orderBy("doc_id").collect() if chosen else []
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    stands = {1: sizes.get(1, 0) / n1, 0: sizes.get(0, 0) / n0}
    none = [stands[chosen[r["doc_id"]]] * np.array([chosen[r["doc_id"]], 1]) for r in own if not r["f"]]
    blank = float((sum(x[0] for x in none) + doubt * prior) / (sum(x[1] for x in none) + doubt)) if own else 0.0

    def unit(f, n):
        w = np.asarray(n, float) * idf[f]
        return w / np.sqrt((w * w).sum())

    held = [r for r in own if r["f"]]
    index = BlockMaxIndex([r["doc_id"] for r in held], [chosen[r["doc_id"]] for r in held], [(np.array(r["f"]), unit(np.array(r["f"]), r["n"])) for r in held], idf)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, rows, (row, f, n) in vectors(batches):
            out, evidence = np.full(rows, blank), [[] for _ in range(rows)]
            f = f.astype(np.int64)
            cuts = np.searchsorted(row, np.arange(rows + 1))
            for r in np.unique(row).tolist():
                a, b = cuts[r], cuts[r + 1]
                w = n[a:b] * index.idf[f[a:b]]
                near, cosine = index.nearest(f[a:b], w / np.sqrt((w * w).sum()), k)
                if len(near):
                    y = index.labels[near]
                    vote = cosine**2 * np.where(y > 0, stands[1], stands[0])
                    out[r] = (np.sum(vote * y) + doubt * prior) / (np.sum(vote) + doubt)
                    evidence[r] = index.ids[near].tolist()
            yield pa.record_batch([batch.column("doc_id").slice(first, rows), pa.array(np.clip(out, 0, 1)), pa.array(evidence, pa.list_(pa.int64())), batch.column("rest").slice(first, rows)], ["doc_id", "score", "evidence", "rest"])

    rest = whole.schema["rest"].dataType.simpleString()
    return whole.mapInArrow(tidy(scores), f"doc_id long, score double, evidence array<long>, rest {rest}").select("doc_id", "score", "evidence", *(F.col("rest")[c].alias(c) for c in carry))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every document; labels of documents held out are not learnt from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    found = score_toxicity(docs, labels)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")
