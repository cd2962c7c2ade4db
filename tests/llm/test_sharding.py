"""The shuffle into shards: exact sizes, the law of the draws, and that every permutation is as likely."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import sharding as S


@pytest.mark.parametrize(("good", "bad", "n"), [(5, 7, 4), (1, 1, 1), (0, 9, 3), (9, 0, 3), (40, 3, 41), (200, 300, 60), (3, 1000, 500)])
def test_draws_follow_the_law(spark, good, bad, n):
    many = 20_000
    u = (F.col("id") + 0.5) / many  # inversion at a fine grid gives the law itself
    got = Counter(r[0] for r in spark.range(many).select(S.hypergeometric(F.lit(good).cast("long"), F.lit(bad).cast("long"), F.lit(n).cast("long"), u)).collect())
    want = {k: math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(max(0, n - bad), min(n, good) + 1)}
    assert set(got) <= set(want)
    assert max(abs(got[k] / many - p) for k, p in want.items()) < 3 / many


def test_large_draws(spark):
    big = [F.lit(x).cast("long") for x in (10**10, 7 * 10**10, 8 * 10**8)]
    # The draw goes up from the likeliest number first, then down from it: quarters of the law lie 0.674 deviations from the middle.
    got = [spark.range(1).select(S.hypergeometric(*big, F.lit(u))).first()[0] - 10**8 for u in (0.0, 0.25, 0.75, 1 - 2**-53)]
    sd = math.sqrt(8e8 * (1 / 8) * (7 / 8) * 0.99)
    assert abs(got[0]) <= 1 and abs(got[1] / sd - 0.674) < 0.01 and abs(got[2] / sd + 0.674) < 0.01 and -12 < got[3] / sd < -3


@pytest.mark.parametrize("sizes", [[7], [3, 0, 12], [1] * 9, [100, 1, 1, 50, 3, 3, 900]])
def test_matrix_has_both_sums(spark, sizes):
    total = sum(sizes)
    wanted = [total // 4 + (j < total % 4) for j in range(4)]
    table = spark.createDataFrame(list(enumerate(sizes)), "source long, rows long")
    m = {r.source: r.counts for r in S.communication_matrix(table, wanted, seed=3).collect()}
    assert [sum(m[i]) for i in range(len(sizes))] == sizes
    assert [sum(c) for c in zip(*m.values(), strict=True)] == wanted and min(min(c) for c in m.values()) >= 0


def check(rows, shards):
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts[j] for j in range(shards)) <= 1
    for j in range(shards):
        assert sorted(r.slot for r in rows if r.shard == j) == list(range(counts[j]))


def test_sizes_slots_and_repeats(spark):
    frame = spark.createDataFrame([(i % 40 or None, "same" if i % 3 else None, 5) for i in range(1003)], "doc_id long, text string, shard long").repartition(6)
    for part in (50_000, 10):  # with one part a shard and with many
        got = S.shuffle_into_shards(frame, 8, seed=1, rows_a_task=part).collect()
        check(got, 8)
        assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in frame.collect())


def test_same_rows_same_seed(spark):
    frame = spark.range(500).repartition(3)
    a, b, c = (sorted(tuple(r) for r in S.shuffle_into_shards(frame, 4, seed=s).collect()) for s in (1, 1, 2))
    assert a == b != c


def test_every_place_is_as_likely(spark):
    seen = np.zeros((6, 6))
    frame = spark.range(0, 6, 1, 3)
    numbered = [S.shuffle_into_shards(frame, 2, seed=s).withColumn("s", F.lit(s)) for s in range(4)]
    for f in numbered:
        for r in f.collect():
            seen[r.id, 3 * r.shard + r.slot] += 1
    assert (seen.sum(0) == 4).all() and (seen.sum(1) == 4).all()
    # The law of a row's shard and that of two rows together, over many rows at once.
    big = [r.shard for r in S.shuffle_into_shards(spark.range(0, 4000, 1, 8), 4, seed=9).orderBy("id").collect()]
    together = sum(a == b for a, b in zip(big, big[1:], strict=False)) / 3999
    assert abs(together - 0.25) < 0.03


def test_few_or_no_rows(spark):
    assert S.shuffle_into_shards(spark.range(0), 8).count() == 0
    check(S.shuffle_into_shards(spark.range(3), 8).collect(), 8)


def test_query_and_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "é"), (None, None), (1, "é"), (4, "")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = S.op11_hypergeometric_sharding(spark, str(tmp_path))
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in [(1, "é"), (None, None), (1, "é"), (4, "")])
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got.collect()) == want
    S.write_shards(got, str(tmp_path / "out"), rows_a_file=1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
