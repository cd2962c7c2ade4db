import collections

import numpy as np

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"word{i}" for i in range(400)]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def kept(found):
    return collections.Counter((r.doc_id, r.text) for r in found.collect())


def test_one_of_each_class_stays_whatever_its_id(spark):
    a, b, c, d, e = (prose(k, 60) for k in range(5))
    rows = [(None, a, "s"), (None, a, "t"), (None, b, "s"), (3, b, "s"), (5, c, "s"), (5, d, "s"), (5, d, "s"), (7, e, "u"), (7, e, "t"), (9, None, "s"), (None, None, "s")]
    found = corpus_pipeline.keep_one_of_each(spark, frame(spark, rows), "")
    assert kept(found) == {(None, a): 1, (3, b): 1, (5, c): 1, (5, d): 1, (7, e): 1, (9, None): 1}


def test_rows_are_rejected_whatever_their_id(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bad, good = "so alpha beta gamma delta epsilon zeta it is", prose(8, 30)
    found = corpus_pipeline.drop_contaminated(spark, frame(spark, [(None, bad, "s"), (None, good, "s"), (1, bad, "s"), (1, good, "s"), (2, None, "s")]), str(tmp_path))
    assert kept(found) == {(None, good): 1, (1, good): 1, (2, None): 1}

    rows = [(i, prose(i, 40) + (" vile foul rotten filth scum" if i % 2 else ""), "s") for i in range(240)]
    spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bad, good = prose(900, 40) + " vile foul rotten filth scum", prose(901, 40)
    found = kept(corpus_pipeline.drop_toxic(spark, frame(spark, [*rows, (None, bad, "s"), (None, good, "s"), (500, bad, "s"), (500, good, "s")]), str(tmp_path)))
    assert found[(None, bad)] == found[(500, bad)] == 0 and found[(None, good)] == found[(500, good)] == 1


def test_repeats_and_packing_keep_every_row(spark):
    long = prose(4, 60)
    rows = [(None, "first " + long, "s"), (None, "second " + long, "s"), (4, "third", "s"), (4, "fourth", "s"), (None, None, "s")]
    found = corpus_pipeline.remove_repeated_passages(spark, frame(spark, rows), "")
    got = kept(found)
    assert sum(got.values()) == 5 and got[(4, "third")] == got[(4, "fourth")] == 1 and sum(n for (i, _), n in got.items() if i is None) == 3
    assert corpus_pipeline.pack_sequences(spark, found, "").count() == 5
