"""Term shares and their divergence against a plain count and DuckDB."""

import random
import re
from collections import Counter

import duckdb
import numpy as np

from sitelens.llm import divergence as D

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def plain(docs, least=3, most=200):
    docs = [tuple(x or "" for x in d) for d in docs]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        words = [[re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", d[0])] for d in own]
        df = Counter(w for ws in words for w in set(ws))
        kept = {w for w in df if df[w] >= least}
        count = {s: Counter() for s in {d[2] for d in own}}
        for d, ws in zip(own, words, strict=True):
            count[d[2]].update(w for w in ws if w in kept)
        total = sum(count.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))  # noqa: E731, B023
        for s, c in count.items():
            pairs = [(-sum((p(c, w) - p(o, w)) ** 2 // p(o, w) for w in kept), t.encode(), t) for t, o in count.items() if t != s]
            terms = [(-((p(c, w) - p(total, w)) ** 2 // p(total, w)), w.encode(), w) for w in c if c[w] and p(c, w) > p(total, w)]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(rows)]
    return sorted(out)


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "The", "the", "Zoë", "naïve", "ÉTÉ", "été", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "x" * 300, "日本語", "Straße", "one", "two", "three", "four"]
    pick = lambda s: " ".join(rng.choice(words[(s * 3) % 7 :]) for _ in range(rng.randrange(0, 40))).replace(" t", rng.choice([" t", "-t", "1t"]))
    docs = [(pick(i % 5), ["en", "de", "", None][i % 4 if i % 3 else 0], [f"s{i % 5}", None, ""][0 if i % 7 else i % 2 + 1]) for i in range(n)]
    return docs + docs[:20] + [(None, "fr", "only"), ("zz zz", "fr", "two"), ("", "it", None)]


def test_matches_plain(spark):
    for seed in range(2):
        docs = texts(seed)
        frame = spark.createDataFrame(docs, "text string, lang string, source string")
        got = sorted(tuple(r) for r in D.source_divergence(frame.repartition(3)).select(COLUMNS).collect())
        assert got == plain(docs)


def test_short_report_and_ties(spark):
    docs = [("b a c", "en", s) for s in ("x", "y", "z")] * 2 + [("d d d", "en", "x")] * 3
    frame = spark.createDataFrame(docs, "text string, lang string, source string")
    assert sorted(tuple(r) for r in D.source_divergence(frame, most_terms=2).select(COLUMNS).collect()) == plain(docs, most=2)


def test_sql_matches_plain():
    docs = texts(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    assert sorted(con.execute(D.ORACLE_SQL["op12_source_divergence"]).fetchall()) == plain(docs)


def test_edges(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert D.source_divergence(empty).count() == 0
    clash = spark.createDataFrame([("a a", "en", "x", 1, "p")] * 3, "text string, lang string, source string, n int, term string")
    assert D.source_divergence(clash).columns == COLUMNS and D.source_divergence(clash).count() == 0


def test_large_counts_stay_exact(spark):
    n, total, kinds = 90_000_000_000_000, 123_456_789_012_345_678, 1_000_003
    frame = spark.createDataFrame([(n, total, kinds), (5, total, kinds)], "n long, total long, kinds long")
    assert [r[0] for r in frame.select(D.share("n", "total", "kinds")).collect()] == [1 + 10**9 * (x + 1) // (total + kinds) for x in (n, 5)]


def test_radix_order_is_stable():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 3, 500).astype(np.uint64) << np.uint64(48), rng.integers(0, 1 << 20, 500).astype(np.uint64) >> np.uint64(17)]
    assert D.radix_order(words).tolist() == sorted(range(500), key=lambda i: (int(words[0][i]), int(words[1][i]), i))


def test_counts_do_not_depend_on_blocks(spark):
    docs = texts(4)
    frame = spark.createDataFrame(docs, "text string, lang string, source string")
    whole, cut = (sorted(tuple(r) for r in D.term_counts(frame, block_bytes=b).collect()) for b in (2 << 20, 300))
    assert whole == cut
