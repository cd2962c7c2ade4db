"""Which sources speak unlike the rest of their language: exact term shares of (lang, source) groups and how they diverge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._text import row_of, saved, text_blocks, tidy

_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of letters and bytes beyond ASCII; none goes on into the next text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TERM[data]
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] |= inside[1:-1][cuts]
    stops[cuts - 1] |= inside[1:-1][cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows of 64-bit words, the first the most telling: by 16 bits at a time from the last, those that are all equal left out."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        differ = int(np.bitwise_or.reduce(word ^ word[0])) if len(word) else 0
        for shift in range(0, 64, 16):
            if differ >> shift & 0xFFFF:
                digit = (word >> np.uint64(shift)).astype(np.uint16)
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(changed: np.ndarray, group: np.ndarray, row: np.ndarray):
    """First places of the runs of one term and group, how long they are and over how many rows they go."""
    new = changed.copy()
    new[1:] |= group[1:] != group[:-1]
    fresh = new.copy()
    fresh[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new))), np.add.reduceat(fresh.astype(np.int64), first)


def count_terms(data: np.ndarray, offsets: np.ndarray, group_of_row: np.ndarray):
    """(groups, terms, occurrences, rows with it) of the lower-cased terms of a block of texts, by length.

    Terms of up to 8 bytes are one big-endian 64-bit word, those of up to 16 two; they are radix-sorted and runs counted.
    Longer ones are sorted as bytes, each length for itself. No term has a zero byte, so the padding tells nothing apart wrongly.
    """
    data = _LOWER[data]
    starts, ends = term_spans(data, offsets)
    row = row_of(offsets, starts)
    by_group = np.argsort(group_of_row[row], kind="stable")  # sorts keep this order among equal terms, so rows of a group stay together
    starts, row = starts[by_group], row[by_group]
    length, group = ends[by_group] - starts, group_of_row[row]
    windows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(16, np.uint8)), 8)

    def packed(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        rest = (8 * (8 - np.minimum(size, 8))).astype(np.uint64)
        return windows[at].view(">u8")[:, 0].astype(np.uint64) >> rest << rest

    for n_words in (1, 2):
        pick = np.flatnonzero((length > 8 * (n_words - 1)) & (length <= 8 * n_words))
        if len(pick):
            words = [packed(starts[pick] + 8 * k, length[pick] - 8 * k) for k in range(n_words)]
            order = radix_order(words)
            words, at = [w[order] for w in words], pick[order]
            changed = np.ones(len(at), bool)
            changed[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
            first, n, rows = _runs(changed, group[at], row[at])
            yield group[at[first]], _strings(data, starts[at[first]], length[at[first]]), n, rows
    long = np.flatnonzero(length > 16)
    for size in np.unique(length[long]).tolist():
        pick = long[length[long] == size]
        bucket = np.lib.stride_tricks.sliding_window_view(data, size)[starts[pick]].view(f"S{size}")[:, 0]
        order = np.argsort(bucket, kind="stable")
        at, kinds = pick[order], bucket[order]
        changed = np.ones(len(at), bool)
        changed[1:] = kinds[1:] != kinds[:-1]
        first, n, rows = _runs(changed, group[at], row[at])
        yield group[at[first]], _strings(data, starts[at[first]], length[at[first]]), n, rows


def _strings(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> pa.Array:
    before = np.cumsum(length) - length
    flat = data[np.repeat(starts - before, length) + np.arange(int(length.sum()))]
    offsets = np.append(before, int(length.sum())).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes()))


_SCHEMA = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame, block_bytes: int = 2 << 20) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and documents of the group with it, many rows of one term.

    Each group also has a row of the empty term and no occurrences.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.StructArray.from_arrays([batch.column("lang").cast(pa.large_string()), batch.column("source").cast(pa.large_string())], ["lang", "source"])
            keys: dict[tuple, int] = {}
            group_of_row = np.array([keys.setdefault((x["lang"], x["source"]), len(keys)) for x in names.to_pylist()], np.int64)
            langs, sources = (pa.array([k[i] for k in keys], pa.string()) for i in (0, 1))
            nothing = pa.array(np.zeros(len(keys), np.int64))
            yield pa.record_batch([langs, sources, pa.array([""] * len(keys), pa.string()), nothing, nothing], ["lang", "source", "term", "n", "docs"])
            for first, data, offsets in text_blocks(batch.column("text"), block_bytes):
                for group, terms, n, rows in count_terms(data, offsets, group_of_row[first : first + len(offsets) - 1]):
                    at = pa.array(group)
                    yield pa.record_batch([langs.take(at), sources.take(at), terms.cast(pa.string()), pa.array(n), pa.array(rows)], ["lang", "source", "term", "n", "docs"])

    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return read.mapInArrow(tidy(count), _SCHEMA).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kinds: str) -> Column:
    """1 + floor(10^9 (n + 1) / (total + kinds)), whole numbers throughout; beyond the range of a long by decimals."""
    wide = lambda x: f"CAST({x} AS DECIMAL(19, 0))"
    return F.expr(f"1 + CASE WHEN {n} < 9000000000 THEN (1000000000 * ({n} + 1)) div ({total} + {kinds}) ELSE (CAST(1000000000 AS DECIMAL(10, 0)) * ({wide(n)} + 1)) div ({wide(total)} + {kinds}) END")


def spread(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def source_divergence(docs: DataFrame, *, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source).

    A language keeps the terms in ``least_docs`` of its documents. Part ``pair`` sets every group against each other source
    of its language, over all kept terms, those that neither has too; part ``term`` gives its ``most_terms`` most telling
    terms. Null text, lang and source are ''. A group without terms has pairs, and terms if the language has kept any that it
    uses (it uses none). Repeated rows count as often as they come, ties go to the lesser item by its bytes, terms of any
    length are whole. An empty table gives no rows, and neither does part ``pair`` for a language of one source.

    Two groups are joined at the terms that both have; all other terms of a pair follow from how many terms of a group come
    how often, so no group is ever laid out over all terms.
    """
    counted = saved(term_counts(docs), "term-counts")
    kept = counted.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("df")).filter(F.col("df") >= least_docs).drop("df")
    own = saved(counted.filter("term <> ''").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all_n"), "term-kept")
    langs = own.groupBy("lang", "term").agg(F.first("all_n").alias("all_n")).groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("all_n").alias("all_total"))
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("has"))
    groups = counted.filter("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "has", "kinds", "all_total"])
    groups = saved(groups.withColumn("p0", F.when(F.col("kinds") > 0, share("0", "total", "kinds"))), "groups")

    shares = own.join(groups, ["lang", "source"]).withColumns({"p": share("n", "total", "kinds"), "q": share("all_n", "all_total", "kinds")})
    telling = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(spread("p", "q")).alias("value"))

    a = shares.select("lang", "term", F.col("source").alias("s"), F.col("p").alias("ps"), F.col("p0").alias("ps0"))
    b = shares.select("lang", "term", F.col("source").alias("t"), F.col("p").alias("pt"), F.col("p0").alias("pt0"))
    more = lambda x, y: f"{spread(f'p{x}', f'p{y}')} - {spread(f'p{x}', f'p{y}0')} - {spread(f'p{x}0', f'p{y}')} + {spread(f'p{x}0', f'p{y}0')}"
    both = a.join(b, ["lang", "term"]).filter("s < t").groupBy("lang", "s", "t").agg(F.sum(F.expr(more("s", "t"))).alias("st"), F.sum(F.expr(more("t", "s"))).alias("ts"))
    met = both.select("lang", F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item"), F.col("st").alias("value")), F.struct(F.col("t").alias("source"), F.col("s").alias("item"), F.col("ts").alias("value")))).alias("x")).select("lang", "x.*")

    often = own.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "kinds"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("o0"))
    met_not = often.join(other, "lang").filter("source <> other").select("lang", F.explode(F.array(
        F.struct("source", F.col("other").alias("item"), F.expr(f"terms * ({spread('p', 'o0')})").alias("value")),
        F.struct(F.col("other").alias("source"), F.col("source").alias("item"), F.expr(f"terms * ({spread('o0', 'p')})").alias("value")))).alias("x")).select("lang", "x.*")
    neither = groups.join(other.join(groups.select("lang", F.col("source").alias("other"), F.col("has").alias("o_has")), ["lang", "other"]), "lang").filter("source <> other")
    neither = neither.select("lang", "source", F.col("other").alias("item"), F.coalesce(F.expr(f"(kinds - has - o_has) * ({spread('p0', 'o0')})"), F.lit(0)).cast("long").alias("value"))
    pairs = met.unionByName(met_not).unionByName(neither).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    ranked = lambda x: x.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pairs).unionByName(ranked(telling).filter(F.col("rank") <= most_terms))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """All groups of all documents."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = {
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM k GROUP BY lang),
c AS (SELECT t.lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY t.lang, source, term),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (s.total + l.v) AS BIGINT) AS p, 1 + (1000000000 * (k.n + 1)) // (l.total + l.v) AS q
  FROM s JOIN k ON k.lang = s.lang JOIN l ON l.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY a.lang, a.source, b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
u AS (SELECT * FROM pair UNION ALL SELECT * FROM term)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) x WHERE part = 'pair' OR rank <= 200
"""
}
