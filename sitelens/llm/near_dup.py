"""Near duplicates: consistent weighted sampling of TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._text import mix, release, saved, shingle_block, text_blocks, tidy


def _bags(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, how often it comes there) without repeats, in the order of row and shingle."""
    code, row = shingle_block(data, offsets, size)
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    at = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (row[1:] != row[:-1]))) if len(code) else np.zeros(0, np.int64)
    return row[at], code[at], np.diff(np.append(at, len(code)))


def _weighted(data: np.ndarray, offsets: np.ndarray, size: int, seen: pa.ListArray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, TF-IDF weight); ``seen`` has the document frequencies of each row's shingles, in their order. Without ``total`` the weight is the count.

    A frequency of 1 marks a shingle that no other text has: how rare it is cannot be told, so it weighs as the row's others do on average.
    """
    row, code, count = _bags(data, offsets, size)
    if not total:
        return row, code, count.astype(float)
    df = seen.flatten().to_numpy()
    idf = 1 + np.log((1 + total) / (1 + df))
    known = np.where(df > 1, count, 0)
    n = len(offsets) - 1
    mean = np.bincount(row, known * idf, minlength=n) / np.maximum(np.bincount(row, known, minlength=n), 1)
    alone = (df <= 1) & (mean[row] > 0)
    idf[alone] = mean[row[alone]]
    return row, code, count * idf


class WeightedSampler:
    """Improved consistent weighted sampling: equal samples come with the probability of the weighted Jaccard similarity.

    For each shingle k and sample, r and c are Gamma(2, 1) and b is uniform, all from a hash of k; t = floor(ln w / r + b)
    and the lowest ln c - r (t - b) - r picks (k, t). The draws have 65 536 levels each, read from tables.
    """

    def __init__(self, samples: int):
        self.samples = samples
        x = np.concatenate([np.linspace(0, 1, 20_000), np.linspace(1, 20, 20_000)[1:]])
        draws = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + x) * np.exp(-x), x)
        self.gamma, self.log_gamma = draws.astype(np.float32), np.log(draws).astype(np.float32)

    def sample(self, code: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """For each sample, a 64-bit name of the (k, t) picked in each range that begins at ``starts``."""
        log_weight = np.log(weight).astype(np.float32)
        low = np.uint64(0xFFFF)
        for s in range(self.samples):
            h = mix(code + np.uint64((s + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1))
            r = self.gamma[(h & low).astype(np.uint16)]
            b = ((h >> np.uint64(16)) & low).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(log_weight / r + b)
            value = self.log_gamma[((h >> np.uint64(32)) & low).astype(np.uint16)] - r * (t - b) - r + np.float32(200)
            name = (h >> np.uint64(32)) ^ (t.astype(np.int64) * 0x9E3779B1).view(np.uint64)
            yield np.minimum.reduceat((value.view(np.uint32).astype(np.uint64) << np.uint64(32)) | (name & np.uint64(0xFFFFFFFF)), starts)


def _packed(x: np.ndarray) -> bytes:
    """The numbers byte by byte, all highest bytes first: sorted ones compress well so."""
    return np.ascontiguousarray(x[:, None].view(np.uint8)[:, ::-1].T).tobytes()


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1)[::-1].T).view(kind).ravel()


def document_frequencies(docs: DataFrame, *, size: int = 5, threshold: float = 0.0, block: int = 1 << 21, bucket: int = 500_000) -> DataFrame:
    """(t1, t2, df) of the texts of rows (t1, t2, text): in how many of all the rows each of a text's shingles is, in their order.

    A task sends the shingles of about ``block`` places in texts, each text's once, into buckets of about ``bucket`` by their upper
    bits; there every shingle is counted, and those of several rows go back to their blocks. Texts that cannot reach a
    similarity of ``threshold`` with another are left out: a shingle of one row alone is shared with none and weighs no less than the
    others do on average, so these may be no more than 1 - ``threshold`` of a text's. Texts without words are left out. A text may come several times.
    """
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, (int(bytes_ / 6 / bucket)).bit_length())

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        place = TaskContext.get().partitionId() << 32
        ids: list[pa.RecordBatch] = []
        codes: list[np.ndarray] = []
        kinds: list[np.ndarray] = []
        words: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            code = np.concatenate(codes)
            order = np.argsort(code, kind="stable")
            code, at = code[order], order.astype(np.uint32)
            cuts = np.concatenate([[0], np.searchsorted(code, bounds), [len(code)]]).tolist()
            used = [k for k in range(1 << bits) if cuts[k] < cuts[k + 1]]
            none = [None] * len(used)
            lists = [np.concatenate([x.column(c).to_numpy() for x in ids]) for c in ("t1", "t2")] + [np.concatenate(kinds), np.concatenate(words)]
            return pa.record_batch(
                [
                    pa.array([place] * (len(used) + 1), pa.int64()),
                    pa.array([*used, place % (1 << bits)], pa.int32()),
                    pa.array([*(_packed(code[cuts[k] : cuts[k + 1]]) for k in used), None], pa.binary()),
                    pa.array([*(_packed(at[cuts[k] : cuts[k + 1]]) for k in used), None], pa.binary()),
                    *(pa.array([*none, x], pa.list_(pa.int64())) for x in lists),
                ],
                ["block", "bucket", "code", "at", "t1", "t2", "kinds", "words"],
            )

        for b in batches:
            for first, data, offsets in text_blocks(b.column("text"), lower=True):
                n = len(offsets) - 1
                row, code, count = _bags(data, offsets, size)
                ids.append(pa.record_batch([b.column(c).slice(first, n) for c in ("t1", "t2")], ["t1", "t2"]))
                codes.append(code)
                kinds.append(np.bincount(row, minlength=n))
                words.append(np.bincount(row, count, minlength=n).astype(np.int64))
                if sum(map(len, codes)) >= block:
                    yield flush()
                    place += 1
                    ids, codes, kinds, words = [], [], [], []
        if ids:
            yield flush()

    lists = "t1 array<long>, t2 array<long>, kinds array<long>, words array<long>"

    def count(rows: pa.Table) -> pa.Table:
        """Of one bucket: the shingles of several rows, by block; lists of texts pass."""
        found = []
        table = rows.combine_chunks()
        own = np.flatnonzero(table["code"].is_valid().to_numpy())
        codes = [_unpacked(table["code"][i].as_py(), np.uint64) for i in own]
        if codes:
            code = np.concatenate(codes)
            order = np.argsort(code)
            starts = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))
            times = np.diff(np.append(starts, len(code)))
            seen = np.empty(len(code), np.uint32)
            seen[order] = np.repeat(times, times)
            ends = np.cumsum([len(x) for x in codes])
            for i, a, b in zip(own.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                often = seen[a:b] > 1
                if often.any():
                    found.append((table["block"][i].as_py(), _packed(_unpacked(table["at"][i].as_py(), np.uint32)[often]), _packed(seen[a:b][often])))
        passing = table.filter(table["code"].is_null()).select(["block", "t1", "t2", "kinds", "words"])
        kind = pa.schema([("block", pa.int64()), ("at", pa.binary()), ("df", pa.binary()), *((c, pa.list_(pa.int64())) for c in ("t1", "t2", "kinds", "words"))])
        out = pa.table({"block": [x[0] for x in found], "at": [x[1] for x in found], "df": [x[2] for x in found]} | {c: [None] * len(found) for c in kind.names[3:]}, schema=kind)
        others = pa.table({c: passing[c].cast(kind.field(c).type) if c in passing.column_names else pa.nulls(len(passing), pa.binary()) for c in kind.names}, schema=kind)
        release()
        return pa.concat_tables([out, others])

    def deal(rows: pa.Table) -> pa.Table:
        """Of one block: the frequencies of each text's shingles."""
        table = rows.combine_chunks()
        lists = table.filter(table["t1"].is_valid())
        t1, t2, kinds, words = (lists[c].combine_chunks().flatten().to_numpy() for c in ("t1", "t2", "kinds", "words"))
        ends = np.concatenate([[0], np.cumsum(kinds)])
        df = np.ones(ends[-1], np.int32)
        for at, seen in zip(table["at"].to_pylist(), table["df"].to_pylist(), strict=True):
            if at is not None:
                df[_unpacked(at, np.uint32)] = _unpacked(seen, np.uint32)
        alone = np.diff(np.concatenate([[0], np.cumsum(df == 1)])[ends])
        keep = (kinds > 0) & (alone <= (1 - threshold) * words + 1e-6)
        first = np.zeros(len(keep), bool)
        first[np.unique(np.stack([t1, t2], axis=1), axis=0, return_index=True)[1]] = True
        keep &= first
        values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kinds[keep])]).astype(np.int32)), pa.array(df[np.repeat(keep, kinds)]))
        release()
        return pa.table({"t1": pa.array(t1[keep]), "t2": pa.array(t2[keep]), "df": values})

    sent = docs.select("t1", "t2", "text").mapInArrow(tidy(occurrences), f"block long, bucket int, code binary, at binary, {lists}")
    counted = sent.groupBy("bucket").applyInArrow(count, f"block long, at binary, df binary, {lists}")
    return counted.groupBy("block").applyInArrow(deal, "t1 long, t2 long, df array<int>")


def _maybe_among(ids: DataFrame, column: str, bits_each: int = 16):
    """A condition on ``column``: true for every one of its values in ``ids`` (long), and for about one other in 3,000.

    A Bloom filter of four bits for each of ``ids``, so that a join moves few other rows; 2 bytes for each go to the tasks.
    """
    n = max(1 << 12, ids.count() * bits_each)
    marks = ids.select(F.explode(F.array(*(F.pmod(F.xxhash64(column, F.lit(k)), F.lit(n)) for k in range(4)))).alias("bit"))
    words = marks.groupBy((F.col("bit") / 32).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("mask")).toPandas()
    table = np.zeros(n // 32 + 1, np.uint32)
    table[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64)

    @F.arrow_udf("boolean")
    def held(*bits: pa.Array) -> pa.Array:
        found = np.ones(len(bits[0]), bool)
        for b in bits:
            x = b.to_numpy(zero_copy_only=False)
            found &= (table[x >> 5] >> (x & 31).astype(np.uint32)) & np.uint32(1) > 0
        return pa.array(found)

    return held(*(F.pmod(F.xxhash64(column, F.lit(k)), F.lit(n)) for k in range(4)))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component of ``edges`` (a, b); nodes without an edge are absent.

    Each round a node takes the least label around it, then the label of that label; labels stay in Spark.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        moved = saved(step.join(jump, "new", "left").select("node", F.least("new", "far").alias("label"), (F.least("new", "far") < F.col("label")).alias("moved")), "labels")
        labels = moved.select("node", "label")
        if moved.filter("moved").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, *, size: int = 5, threshold: float = 0.8, bands: int = 12, rows: int = 3, block: int = 200, idf: bool = True) -> DataFrame:
    """(doc_id, class_id, text_id) of every row of ``docs`` (doc_id, text).

    Texts are equal, or linked if the weighted Jaccard similarity of their TF-IDF weighted ``size``-word shingles is ``threshold``
    or more; a class is a connected component, named by its least doc_id, and text_id is the least doc_id of the same
    text. A shingle's weight is how often it comes times 1 + ln((1 + rows) / (1 + rows that have it)), counted over all rows: see
    ``document_frequencies``; of a shingle that no other text has, times the mean of these over the text's other shingles, or what
    a copy has of its own would outweigh what a large group of copies has in common. Without ``idf`` it is how often it comes.
    Candidates share one of ``bands`` bands of ``rows`` samples: a pair at 0.8 is missed with a probability of
    (1 - 0.8 ** 3) ** 12 = 0.0002. Each text of a bucket is compared with the bucket's center; then every pair of a bucket
    whose texts are still in two classes is compared, in pairs of blocks of about ``block`` texts. Words are runs of characters other than ASCII white space, in lower
    case; fewer than ``size`` make one shingle. Null counts as empty; empty texts are copies of one another. Repeated
    rows stay. Rows of one doc_id are one class. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Two hashes name a text. Copies fall together here, before anything is compared.
    named = docs.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64("text", F.lit(1))})
    texts = saved(named.groupBy("t1", "t2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "texts")
    seen = document_frequencies(named, size=size, threshold=threshold).dropDuplicates(["t1", "t2"])
    total = named.count() if idf else 0

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = WeightedSampler(bands * rows)
        for batch in batches:
            for first, data, offsets in text_blocks(batch.column("text"), 1 << 19, lower=True):
                n = len(offsets) - 1
                row, code, w = _weighted(data, offsets, size, batch.column("df").slice(first, n), total)
                at = np.flatnonzero(np.append(True, np.diff(row) != 0))  # each of these texts has a shingle
                keys = np.zeros((n, bands), np.uint64)
                for s, picked in enumerate(sampler.sample(code, w, at)):
                    keys[:, s // rows] = mix(keys[:, s // rows] + picked + np.uint64(s))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
                yield pa.record_batch([*(batch.column(c).slice(first, n) for c in ("doc_id", "text", "df")), lists], ["doc_id", "text", "df", "keys"])

    # Only texts that can reach the threshold are ever compared: these are taken out once, so that comparisons move no others.
    # The joins are merges at every size, also where the ids would fit into a broadcast.
    alone = F.transform("df", lambda x: F.when(x == F.col("copies"), 1).otherwise(x)).alias("df")  # equal texts are one
    able = saved(texts.hint("merge").join(seen, ["t1", "t2"]).select("t1", "t2", F.col("node").alias("doc_id"), alone), "able")
    near = named.filter(_maybe_among(able.select("t1"), "t1"))
    pool = near.hint("merge").join(able, ["doc_id", "t1", "t2"]).dropDuplicates(["doc_id", "t1", "t2"]).select("doc_id", "text", "df")
    pool = saved(pool.mapInArrow(tidy(signatures), "doc_id long, text string, df array<int>, keys array<long>"), "candidates")
    each = pool.select(F.col("doc_id").alias("node"), F.posexplode("keys").alias("band", "key"))
    # The center of a bucket is its text of the lowest hash; bands take turns in one of two hashes, so that a text meets two centers.
    turn = F.xxhash64("node", F.col("band") % 2)
    center = each.groupBy("band", "key").agg(F.min_by("node", F.struct(turn, F.col("node"))).alias("a"), F.count("*").alias("n")).filter("n > 1").select("band", "key", "a")
    inside = saved(each.join(center, ["band", "key"]), "buckets")
    tried = saved(inside.filter("node <> a").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct(), "pairs")
    links = saved(_verify(pool, tried, size, threshold, total, block), "links")
    # What is still apart in a bucket is compared pair by pair; texts of one class need no further link.
    dealt = saved(_dealt(inside, components(links), block), "dealt")
    if not dealt.isEmpty():
        links = links.unionByName(saved(_verify_blocks(pool, dealt, size, threshold, total), "links"))
    labels = components(links)
    classes = texts.join(labels, "node", "left").select("t1", "t2", F.col("node").alias("text_id"), F.coalesce("label", "node").alias("class_id"))
    return named.select("doc_id", "t1", "t2").join(classes, ["t1", "t2"]).select("doc_id", "class_id", "text_id")


def _similarity(a: np.ndarray, v: np.ndarray, a_mass: float, b: np.ndarray, w: np.ndarray, b_mass: float) -> float:
    """The weighted Jaccard similarity of shingles ``a`` and ``b`` of weights ``v`` and ``w``; neither is empty."""
    where = np.minimum(np.searchsorted(a, b), len(a) - 1)
    hit = a[where] == b
    shared = np.minimum(w[hit], v[where[hit]]).sum()
    return shared / (a_mass + b_mass - shared)


def _verify(docs: DataFrame, pairs: DataFrame, size: int, threshold: float, total: int, block: int) -> DataFrame:
    """(a, b, similarity) of those ``pairs`` (a, b) of doc_ids whose texts reach the threshold.

    The partners of one text are dealt into blocks of about ``block``, each with a copy of that text, so that a text with
    many partners makes many small groups.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).alias("parts"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    needs = dealt.select(F.col("b").alias("doc_id"), "a", "part", F.lit(1).alias("role")).unionByName(dealt.select(F.col("a").alias("doc_id"), "a", "part", F.lit(0).alias("role")).distinct())
    rows = docs.join(needs.hint("merge"), "doc_id").select("a", "part", "role", "doc_id", "text", "df")
    grouped = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role", "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = mine = None
        mass = 0.0
        for batch in batches:
            a, role, ids = (batch.column(c).to_pylist() for c in ("a", "role", "doc_id"))
            out = []
            for first, data, offsets in text_blocks(batch.column("text"), lower=True):
                row, code, w = _weighted(data, offsets, size, batch.column("df").slice(first, len(offsets) - 1), total)
                cut = np.searchsorted(row, np.arange(len(offsets)))
                for r in range(len(offsets) - 1):
                    c, v, i = code[cut[r] : cut[r + 1]], w[cut[r] : cut[r + 1]], first + r
                    if role[i] == 0:
                        own, mine, mass = c, v, v.sum()
                        continue
                    if not len(own) or not len(c):
                        continue
                    s = _similarity(own, mine, mass, c, v, v.sum())
                    if s >= threshold:
                        out.append((a[i], ids[i], float(s)))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], ["a", "b", "similarity"])

    return grouped.mapInArrow(tidy(compare), "a long, b long, similarity double")


def _dealt(inside: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """(node, label, band, key, i, j, side): the texts of each pair of blocks (i, j) of the buckets ``inside`` (band, key, node) that hold several classes.

    A class of ``block`` texts or more in a bucket has blocks of its own, which do not meet one another; all other texts
    share blocks. Buckets of the same texts count once, in their first band; one of two texts is a pair that met already.
    """
    seen = inside.select("band", "key", "node").distinct().join(labels, "node", "left").select("band", "key", "node", F.coalesce("label", "node").alias("label"))
    # Sums of hashes name a bucket's texts: partial sums, so no bucket has to be in one task.
    name = [F.sum(F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 << 31))).alias(f"s{k}") for k in (1, 2)]
    kinds = seen.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y"), *name).filter("n > 2 and x < y")
    open_ = kinds.groupBy("n", "s1", "s2").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key")
    apart = saved(seen.join(open_, ["band", "key"]), "apart")
    own = apart.groupBy("band", "key", "label").agg(F.count("*").alias("n"))
    own = own.withColumn("own", F.when(F.col("n") >= block, F.col("label")))
    groups = own.groupBy("band", "key", "own").agg(F.ceil(F.sum("n") / block).alias("parts"))
    # One row for each large class and one for the rest of a bucket: the blocks of a group follow those of the groups before.
    before = F.sum("parts").over(Window.partitionBy("band", "key").orderBy(F.col("own").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("first", F.coalesce(before, F.lit(0))).withColumn("blocks", F.sum("parts").over(Window.partitionBy("band", "key")))
    large = own.filter("own is not null").select("band", "key", "label", "own")
    placed = apart.join(large, ["band", "key", "label"], "left")
    same = (placed.band == groups.band) & (placed.key == groups.key) & placed.own.eqNullSafe(groups.own)
    placed = placed.join(groups, same).select(placed.band, placed.key, "node", "label", placed.own, "parts", "first", "blocks")
    placed = placed.withColumn("at", F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    inner = (F.col("other") >= F.col("first")) & (F.col("other") < F.col("first") + F.col("parts"))
    placed = placed.filter(F.col("own").isNull() | ~inner)
    return placed.select("node", "label", "band", "key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), (F.col("at") > F.col("other")).cast("int").alias("side"))


def _verify_blocks(pool: DataFrame, dealt: DataFrame, size: int, threshold: float, total: int) -> DataFrame:
    """(a, b, similarity) that join the classes of ``dealt`` as all pairs of texts at the threshold would.

    Each pair that shares a band is looked at in the first band it shares, in the one pair of blocks that holds it.
    """
    rows = pool.join(dealt.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id").filter(F.col("keys")[F.col("band")] == F.col("key"))
    place = ["band", "key", "i", "j"]
    grouped = rows.select(*place, "side", "doc_id", "label", "keys", "text", "df").repartition(*place).sortWithinPartitions(*place, "side", "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def flush() -> pa.RecordBatch:
            out = _links_of(pa.Table.from_batches(held).combine_chunks(), size, threshold, total) if held else []
            return pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], ["a", "b", "similarity"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy() for c in place], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, [len(at)]])
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if now is not None and tuple(at[x]) != now:
                    yield flush()
                    held = []
                now = tuple(at[x])
                held.append(batch.slice(x, y - x))
        yield flush()

    return grouped.mapInArrow(tidy(compare), "a long, b long, similarity double")


def _links_of(group: pa.Table, size: int, threshold: float, total: int, width: int = 4096) -> list[tuple[int, int, float]]:
    """Links between the texts of one pair of blocks; a pair of classes that links join already needs no other."""
    band, inner = group["band"][0].as_py(), group["i"][0].as_py() == group["j"][0].as_py()
    ids, labels, side = (group[c].to_numpy() for c in ("doc_id", "label", "side"))
    keys = np.array(group["keys"].to_pylist(), np.int64)
    want = labels[:, None] != labels[None, :]
    want &= np.triu(np.ones_like(want), 1) if inner else side[:, None] < side[None, :]
    for k in range(band):
        want &= keys[:, None, k] != keys[None, :, k]
    used = np.flatnonzero(want.any(axis=0) | want.any(axis=1))
    if not len(used):
        return []
    ids, labels, want = ids[used], labels[used], want[np.ix_(used, used)]
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    seen = group["df"].take(pa.array(used)).combine_chunks()
    for first, data, offsets in text_blocks(group["text"].take(pa.array(used)), lower=True):
        row, code, w = _weighted(data, offsets, size, seen.slice(first, len(offsets) - 1), total)
        cut = np.searchsorted(row, np.arange(len(offsets)))
        bags += [(code[x:y], w[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
    mass = np.array([w.sum() for _, w in bags])
    low, high = np.minimum(mass[:, None], mass[None, :]), np.maximum(mass[:, None], mass[None, :])
    want &= (low > 0) & (low >= threshold * high * (1 - 1e-9))
    # A product of roots is no less than the least of two weights, so products of matrices bound what texts share.
    row = np.repeat(np.arange(len(bags)), [len(c) for c, _ in bags])
    code, where, times = np.unique(np.concatenate([c for c, _ in bags]), return_inverse=True, return_counts=True)
    column = (np.cumsum(times > 1) - 1)[where]
    root = np.sqrt(np.concatenate([w for _, w in bags])).astype(np.float32)
    shared = times[where] > 1
    order = np.flatnonzero(shared)[np.argsort(column[shared], kind="stable")]
    row, column, root = row[order], column[order], root[order]
    bound = np.zeros(want.shape, np.float32)
    for first in range(0, int((times > 1).sum()) if want.any() else 0, width):
        x, y = np.searchsorted(column, [first, first + width])
        part = np.zeros((len(bags), width), np.float32)
        part[row[x:y], column[x:y] - first] = root[x:y]
        bound += part @ part.T
    want &= bound * (1 + 1e-4) >= threshold / (1 + threshold) * (mass[:, None] + mass[None, :])
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    out = []
    for p, q in np.argwhere(want).tolist():
        x, y = top(int(labels[p])), top(int(labels[q]))
        if x != y:
            s = _similarity(*bags[p], mass[p], *bags[q], mass[q])
            if s >= threshold:
                above[max(x, y)] = min(x, y)
                out.append((int(ids[p]), int(ids[q]), float(s)))
    return out


def op6_minhash_near_dup(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id and text_id of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
