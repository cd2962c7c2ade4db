import collections
import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitelens.llm import ann, decontaminate, html_extract, language_id, license_scan, near_dup, packing, suffix_dedup, toxicity, url_filter
from sitelens.llm._text import text_blocks

DOCS = "doc_id long, text string, extra string"
WORDS = [f"word{i}" for i in range(400)]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def odd_rows():
    """Null, empty, blank, repeated, very long, and rows without an id."""
    return [(1, None, "x"), (2, "", None), (3, "  \n ", "x"), (4, "a", "x"), (4, "a", "x"), (5, prose(9, 30_000), "x"), (None, "lost words", None)]


# ---- suffix arrays ---------------------------------------------------------------------------------------------------


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(0)
    for k in range(120):
        t = np.append(rng.integers(1, rng.integers(2, 6 if k % 2 else 400), rng.integers(1, 150)), 0)
        if k % 5 == 0:
            t = np.concatenate([t[:-1], t])
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        for width in (4096, 16, 1):
            assert suffix_dedup.suffix_array(t, width).tolist() == want
        lcp = suffix_dedup.permuted_lcp(t, np.array(want))
        for a, b in zip(want, want[1:], strict=False):
            n = 0
            while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            assert lcp[b] == n


def plain_repeats(texts, span):
    count = collections.Counter(x[i : i + span] for x in texts for i in range(len(x) - span + 1))
    out = []
    for x in texts:
        gone = bytearray(len(x))
        for i in range(len(x) - span + 1):
            if count[x[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        out.append((sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats_match_brute_force(spark, hot):
    base = prose(1, 300)
    texts = [base, base, base[:900] + " new " + base[900:], "ab" * 400, "é" * 300, prose(2, 200) + base[300:700], prose(3, 100), "", None, "short"]
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], DOCS), hot=hot).withColumn("h", F.sha2("kept", 256)).orderBy("doc_id").collect()
    assert [(r.n_removed, r.n_spans, r.h) for r in got] == plain_repeats([(t or "").encode() for t in texts], 200)


# ---- packing ---------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ["it's <|endoftext|> Fine!! 3,14%", "İstanbul É É́ naïve… «ok». foo). ...", prose(4, 9000), None, "", "<|STARTOFTEXT|> x"]
    rows = packing.pack_documents(spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], DOCS), path).toPandas()
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        own = rows[rows.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length[:-1] == 4096).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n in zip(own.start, own.length, strict=True)]
    placed = rows.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.sum() <= 4096).all()
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()


def test_packing_merges_partitions(spark):
    sizes = np.random.default_rng(3).integers(1, 100, 2000)
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "item long, length long")
    got = packing.pack(items, capacity=100, slack=2, items_a_task=300).toPandas().merge(items.toPandas(), on="item")
    assert len(got) == 2000 and (got.groupby("sequence_id").length.sum() <= 100).all()
    assert got.sequence_id.nunique() <= 1.03 * sizes.sum() / 100


def test_packing_holds_little_at_once(spark):
    """What a task holds of a batch of 3 MB while it encodes it; 13 MB, and 27 with blocks of 1 MB."""
    import tracemalloc

    import public_tokenizers

    class Work:
        def select(self, *columns):
            return self

        def mapInArrow(self, work, schema):
            return work

    work = packing.token_pieces(Work(), public_tokenizers.path("word_bpe_49k.json"))
    batch = pa.record_batch([pa.array(range(300)), pa.array([prose(i, 1500) for i in range(300)])], ["doc_id", "text"])
    list(work(iter([batch])))  # tables of powers stay
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in work(iter([batch]))) == 600
        assert tracemalloc.get_traced_memory()[1] < 20 << 20
    finally:
        tracemalloc.stop()


def test_packing_ends_where_nothing_fits(spark, monkeypatch):
    """Items of which no two fit stay as they are, and no task gets more of them than its share."""
    seen = []
    plain = packing.saved
    monkeypatch.setattr(packing, "saved", lambda frame, name: (lambda out: (name != "pack-items" and seen.append(out.groupBy(F.shiftright("bin", 32)).count().agg(F.max("count")).first()[0]), out)[1])(plain(frame, name)))
    items = spark.createDataFrame([(i, 2100) for i in range(4000)], "item long, length long")
    got = packing.pack(items, items_a_task=200).toPandas()
    assert got.sequence_id.nunique() == 4000 and (got.offset == 0).all()
    mixed = spark.createDataFrame([(i, 2100 if i % 3 else 300 + i % 1500) for i in range(3000)], "item long, length long")
    got = packing.pack(mixed, items_a_task=200).toPandas().merge(mixed.toPandas(), on="item")
    assert len(got) == 3000 and (got.groupby("sequence_id").length.sum() <= 4096).all() and got.sequence_id.nunique() <= 1.03 * max(2000, got.length.sum() / 4096)
    assert max(seen) <= 200
    assert packing.pack(items.limit(0)).collect() == []


def test_packing_learns_words_together():
    """20,000 words met for the first time take few calls of Python; 141,084 before."""
    import cProfile
    import pstats

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    syllables = ["an", "the", "ing", "ció", "é", "lly", "wh", "ou", "ß", "on"]
    words = sorted({"".join(x) for x in np.random.default_rng(2).choice(syllables, (40_000, 7))})[:20_000]
    text = " ".join(words)
    data = np.frombuffer(text.encode(), np.uint8)
    profile = cProfile.Profile()
    words_of = packing.WordTokenizer(path)
    ids, bounds = profile.runcall(words_of.encode, data, np.array([0, len(data)]), 1)
    assert len(words) == 20_000 and pstats.Stats(profile).total_calls < 5000
    assert ids.tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1] and bounds.tolist() == [0, len(ids)]


def test_packing_odd_words_among_others():
    """Words that the normalizer changes or parts, between others, also when known words are dropped all the time."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    odd = ["Éa", "éa", "e\u0301a", "İx", "ΟΔΟΣ", "οδος", "ﬁn", "a–b", "«ça»", "—", "naïve…", "x²", "Ⅷ", "日本語", "\u0301", "don't", "3,14%", "ab\u200bc", "中文。", "ǅ", "ª", "×", "ß", "a\u00a0b", "\x00", "!!!!!!!!!!!!", "ok!?..."]
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([*odd, *WORDS[:40], "thean", "über", "ció"], 60)) for _ in range(40)] + ["", "Σ", *odd]
    for most in (2, 50, 200_000):
        words = packing.WordTokenizer(path, most)
        for k in range(0, len(texts), 9):
            part = texts[k : k + 9]
            offsets = np.cumsum([0, *(len(t.encode()) for t in part)])
            ids, bounds = words.encode(np.frombuffer("".join(part).encode(), np.uint8), offsets, 1)
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in part]


# ---- near duplicates -------------------------------------------------------------------------------------------------


def test_near_duplicates_match_brute_force(spark):
    rows, i = [], 0
    for base in range(12):
        words = prose(100 + base, 120).split()
        for copy in range(4):
            own = list(words)
            for k in range(copy):
                own[(17 * (k + 1) + base) % 120] = f"new{base}x{copy}x{k}"
            rows.append((i, " ".join(own), "e"))
            i += 1
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t, _ in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[k] for k in range(len(rows))] == label


def shingle_counts(text):
    words = text.lower().split()
    return collections.Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else {}


def test_document_frequencies_count_every_row(spark):
    """Each shingle of each text, over all rows, copies and rare shingles too; blocks and buckets of few shingles."""
    base = [prose(700 + i, 60) for i in range(6)]
    texts = [*base, base[0], base[0], base[1] + " " + base[2], base[3][:150], "two words", "two words", "", " ", *(base[4] + f" end{i}" for i in range(9))]
    counts = [shingle_counts(t) for t in texts]
    every = collections.Counter(k for c in counts for k in c)
    docs = spark.createDataFrame([(i, i // 5, t) for i, t in enumerate(texts)], "t1 long, t2 long, text string").repartition(3)
    got = {r.t1: sorted(r.df) for r in near_dup.document_frequencies(docs, block=100, bucket=10).collect()}
    assert got == {i: sorted(every[k] for k in c) for i, c in enumerate(counts) if c}


def test_near_duplicates_weigh_by_frequencies_over_all_rows(spark):
    """What all texts share weighs little: against every pair by TF-IDF; by plain counts all 24 would be one class."""
    common = prose(801, 230)
    texts = [f"{common} {prose(810 + i // 2, 18)}" + (f" own{i}" if i % 2 else "") for i in range(24)]
    counts = [shingle_counts(t) for t in texts]
    every = collections.Counter(k for c in counts for k in c)
    idf = {k: 1 + np.log((1 + len(texts)) / (1 + n)) for k, n in every.items()}
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            x, y = counts[a], counts[b]
            low, high = (sum(f(x.get(k, 0), y.get(k, 0)) * idf[k] for k in x | y) for f in (min, max))
            if low >= 0.8 * high:
                label = [min(label[a], label[b]) if v in (label[a], label[b]) else v for v in label]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], DOCS)).collect()}
    assert [got[i] for i in range(len(texts))] == label and len(set(label)) == 12


def test_near_copies_of_a_large_group_stay_together(spark):
    """Copies of one text that each have two words of their own, among many other texts; some of them come twice."""
    base = prose(901, 200).split()
    rows = []
    for i in range(40):
        own = list(base)
        for k in (10 + 4 * i, (90 + 4 * i) % 180 + 8):
            own[k] = f"own{i}x{k}"
        rows += [(len(rows) + x, " ".join(own), "e") for x in range(2 if i % 5 == 0 else 1)]
    group = len(rows)
    rows += [(group + i, prose(2000 + i, 12), "e") for i in range(350)]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert {got[i] for i in range(group)} == {0}
    assert all(got[i] >= group for i in range(group, len(rows)))


@pytest.mark.parametrize("block", [200, 8])
def test_every_pair_of_a_bucket_is_compared(spark, block):
    """Dozens of texts of one template at plain similarities about the threshold: the classes are those of all pairs."""
    template, rows = prose(77, 400).split(), []
    rng = np.random.default_rng(5)
    for i in range(72):
        own = list(template)
        if i % 2:  # a near copy of the text before
            own = rows[-1][1].split()
        for k in rng.choice(400, 6 if i % 2 == 0 else 1 + i % 7, replace=False):
            own[k] = f"new{i}x{k}"
        rows.append((i, " ".join(own), "e"))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(396)} for _, t, _ in rows]
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in range(len(rows)) for a in range(b)}
    label = list(range(len(rows)))
    for (a, b), s in alike.items():
        if s >= 0.8:
            label = [min(label[a], label[b]) if v in (label[a], label[b]) else v for v in label]
    assert len(set(label)) > 20 and max(label.count(x) for x in label) > 1
    # Bands of one sample put most texts into large buckets; without frequencies the similarity is plain Jaccard.
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS), bands=16, rows=1, idf=False, block=block).collect()}
    assert [got[k] for k in range(len(rows))] == label


def test_weighted_samples_estimate_similarity():
    sampler = near_dup.WeightedSampler(1500)
    code = np.arange(1, 61, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = np.linspace(1, 3, 60), np.linspace(3, 1, 60)
    same = [x[0] == y[0] for x, y in zip(sampler.sample(code, a, np.array([0])), sampler.sample(code, b, np.array([0])), strict=True)]
    assert abs(np.mean(same) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 60)], "a long, b long")
    got = {r.node: r.label for r in near_dup.components(edges).collect()}
    assert set(got[i] for i in range(21)) == {0} and got[50] == got[60] == 40


# ---- searches and filters --------------------------------------------------------------------------------------------


def test_nearest_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((700, 16)), 5 + 0.05 * rng.standard_normal((500, 16))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0, None] * 8)]
    got = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 50 == 0, sample=64).toPandas()
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    hits = 0
    for q in range(0, len(x), 50):
        s = unit @ unit[q]
        s[q] = -9
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(own.score, s[own.vec_id], atol=1e-12)
        hits += len(set(np.argsort(-s, kind="stable")[:5]) & set(own.vec_id))
    assert hits / (5 * len(range(0, len(x), 50))) >= 0.9
    assert got.vec_id.max() < 5000


def test_url_rules_and_mined_rules(spark):
    rows = [(i, f"https://{h}.example.{z}/{lang}/{100 + i}", "h") for i, (h, z, lang) in enumerate((h, z, lang) for h in "abcd" for z in ("org", "com", "net") for lang in ("en", "de", "fr", "es") for _ in range(3))]
    rows += [(900, None, "h"), (901, "no scheme", "h"), (902, "HTTPS://A.Example.ORG?x", "h"), (903, "http://org/x", "h")]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), url_filter.RULES).collect()}
    assert len(got) == len(rows)
    for i, url, _ in rows[:-4]:
        host, _, path = url[8:].partition("/")
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and f"/{path}".startswith(p)]
        assert got[i].rule == (max(fits)[1] if fits else None)
        if fits:
            assert got[i].verdict == max(fits)[2]
    assert (got[900].host, got[900].path, got[900].verdict) == ("", "", "allow")
    assert (got[902].host, got[902].path, got[902].rule) == ("a.example.org", "", None)
    assert got[903].rule == "org/"


def plain_rules(rows, min_support, min_confidence):
    need = min_support * len(rows)
    sets, labelled = collections.Counter(), collections.Counter()
    for tokens, verdict in rows:
        for k in (1, 2, 3):
            for s in itertools.combinations(sorted(set(tokens)), k):
                sets[s] += 1
                labelled[s, verdict] += 1
    return {(s, v): n / sets[s] for (s, v), n in labelled.items() if n >= need - 1e-9 and n / sets[s] >= min_confidence - 1e-12}


@pytest.mark.parametrize("segments", [3, 20])
def test_mined_rules_match_brute_force(spark, segments):
    """Also where whole baskets have millions of frequent sets."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(200):
        x = rng.integers(0, 3 if segments == 3 else 2, segments) * (rng.random(segments) < 0.6)
        rows.append(([f"t{k}:{v}" for k, v in enumerate(x)] + ["host:a"], "block" if x[0] and x[-1] else "allow"))
    got = url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), min_support=0.05).collect()
    want = plain_rules(rows, 0.05, 0.8)
    assert len(got) == len(want)
    assert all(abs(want[tuple(sorted(r.antecedent)), r.verdict] - r.confidence) < 1e-9 for r in got)
    count = collections.Counter(t for tokens, _ in rows for t in set(tokens))
    assert all(count[r.rarest] == min(count[t] for t in r.antecedent) for r in got)


def test_url_verdicts_match_mined_rules(spark):
    """Verdicts of URLs without a given rule, by looking at every rule for every URL; long and repeated ones, and a null."""
    langs = ("en", "fr", "de", "it")
    urls = [f"https://s{i % 7}.example.{'com' if i % 3 else 'net'}/{langs[i % 4]}/a{i % 5}/{'x/' * (i % 12)}p{i}?q={i}" for i in range(600)]
    rows = [(i, u, "t", "h") for i, u in enumerate([*urls, *urls[:5], None, "no scheme", "https://s1.example.net/" + "z/" * 3000])]
    pages = spark.createDataFrame(rows, "page_id long, url string, token string, mined string")
    host, path = url_filter.host_and_path(F.col("url"))
    read = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("fit", url_filter.longest_rule(F.col("host"), F.col("path"), url_filter.RULES))
    read = read.withColumn("tokens", F.when(F.col("host") != "", url_filter.url_tokens(F.col("url"), F.col("host"), F.col("path")))).collect()
    rules = plain_rules([(r.tokens, r.fit.verdict) for r in read if r.fit], 0.005, 0.8)
    labelled = [r for r in read if r.fit]
    got = sorted(url_filter.filter_urls(pages, url_filter.RULES).collect(), key=lambda r: r.page_id)
    assert len(got) == len(rows)
    for r, one in zip(sorted(read, key=lambda r: r.page_id), got, strict=True):
        if r.fit:
            assert one.verdict == r.fit.verdict
            continue
        own = [(c, v) for (s, v), c in rules.items() if set(s) <= set(r.tokens or ())]
        best = max((c for c, _ in own), default=None)
        assert one.verdict in ({v for c, v in own if abs(c - best) < 1e-9} if own else {"allow"})
    assert labelled and url_filter.filter_urls(pages.limit(0), url_filter.RULES).collect() == []
    assert {r.verdict for r in url_filter.filter_urls(pages.filter("url like '%.net%'"), url_filter.RULES).collect()} == {"allow"}


def test_licences(spark):
    rows = [(1, prose(1, 50) + " Licensed under the Apache License, Version 2.0. " + prose(2, 50), "e"), (2, prose(3, 90), "e"), (3, "Released under the MIT License.", "e"), *odd_rows()]
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(1, "Apache-2.0"), (3, "MIT")}


def test_contamination_in_any_order(spark):
    item = prose(50, 24).split()
    mixed = " ".join(item[12:] + item[:12])
    rows = [(1, prose(1, 60) + " " + " ".join(item) + ".", "e"), (2, prose(2, 60) + " " + mixed, "e"), (3, prose(3, 200), "e"), *[(i and i + 10, t, e) for i, t, e in odd_rows()]]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "one two")], "item_id long, text string")
    got = decontaminate.find_contamination(spark.createDataFrame(rows, DOCS), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 7), (2, 7)}
    assert {r.doc_id: r.n_tiles for r in got} == {1: 1, 2: 2}


def test_greedy_tiles_take_the_longest_first():
    text, item = "x a b c d e y a b".split(), "a b c d e z a b".split()
    seeds = [(i, j) for i in range(len(text) - 1) for j in range(len(item) - 1) if text[i : i + 2] == item[j : j + 2]]
    assert sorted(decontaminate.greedy_tiles(np.array([s[0] for s in seeds]), np.array([s[1] for s in seeds]), 2)) == [(1, 0, 5), (7, 6, 2)]


def test_language(spark):
    en, de = "the quick brown fox jumps over the lazy dog and then the cat ", "der schnelle braune fuchs springt über den faulen hund und dann "
    train = spark.createDataFrame([("en", en * 20), ("de", de * 20), (None, "x"), ("fr", None)], "lang string, text string")
    rows = [(10, "the lazy cat and the fox", "e"), (11, "über den hund und der fuchs", "e"), (12, "123 !!", "e"), *odd_rows()]
    got = {r.doc_id: r.lang_pred for r in language_id.identify_language(spark.createDataFrame(rows, DOCS), train).collect()}
    assert (got[10], got[11], got[12], got[1], got[2], got[3]) == ("en", "de", "und", "und", "und", "und")
    assert language_id.identify_language(spark.createDataFrame(rows, DOCS), train.limit(0)).filter("lang_pred <> 'und'").count() == 0


def test_language_filter_returns_all_languages():
    grams = np.arange(5000)
    found = language_id.LanguageFilter([f"l{i:02}" for i in range(70)], np.repeat(grams, 2), np.tile([3, 69], 5000), slot_bits=16)
    low, high = found.languages(grams)
    assert ((low >> np.uint64(3)) & np.uint64(1)).all() and ((high >> np.uint64(5)) & np.uint64(1)).all()
    assert found.false[3] > 0 and found.false[10] == 0


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    rows = [(i, prose(1000 + i, 60) + (" you utter nincompoop " if i % 4 == 0 else " ") + prose(i, 30), "e") for i in range(240)]
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(200)] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows + [(1000 + k, t, e) for k, (_, t, e) in enumerate(odd_rows())], DOCS)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in range(240)) and all(0 <= s <= 1 for s in got.values())
    assert rng is not None and toxicity.score_toxicity(docs, labels.limit(0)).count() == docs.count()


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    dense = rng.random((300, 40)) * (rng.random((300, 40)) < 0.2)
    dense /= np.maximum(np.sqrt((dense**2).sum(1, keepdims=True)), 1e-9)
    index = toxicity.BlockMaxIndex(range(300), [0] * 300, [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in dense], np.ones(40))
    for q in dense[:40]:
        f = np.flatnonzero(q)
        near, cosine = index.nearest(f, q[f], 10)
        s = dense @ q
        assert np.allclose(cosine, np.sort(s[s > 0])[::-1][:10])


# ---- html ------------------------------------------------------------------------------------------------------------

PAGE = "<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body><header><a>Home</a></header><nav><ul><li>menu</ul></nav><div class='ad'>Buy</div><article><h1>T &amp; {0}</h1><p><b>One   {0}<br><p>two<p>un<em>bel</em>ievable</p></article><section class=comments><p>nice</p></section><aside>side</aside><form><input>go</form><footer>&copy; x</footer></body></html>"


def test_html(spark):
    rows = [(i, f"https://h{i % 2}.org/{i}", PAGE.format(f"x{i}"), "e") for i in range(20)] + [(50, None, None, "e"), (51, "https://h0.org/z", "", "e"), (52, "https://q.org", "plain text", "e"), (53, "https://h1.org/cut", PAGE.format("cut")[:250], "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    for most in (1 << 25, -1):
        got = {r.page_id: r for r in html_extract.extract_text(pages, broadcast_bytes=most).collect()}
        assert len(got) == len(rows)
        assert all(got[i].text == f"T & x{i}\nOne x{i}\ntwo\nunbelievable" for i in range(20))
        assert (got[50].text, got[51].text, got[52].text) == ("", "", "plain text")
        assert all(r.n_chars == len(r.text) for r in got.values())


def test_wrapper_has_slots_and_groups():
    text = html_extract.expression(html_extract.infer_wrapper([PAGE.format("a"), PAGE.format("b").replace("<div class='ad'>Buy</div>", "")]))
    assert "#SLOT" in text and ")+" in text and "(<div.ad>Buy)?" in text


def test_every_part_of_the_place_is_kept():
    def texts(shape):
        pages = [shape.format(f"a{i} is long enough", f"b{i} is long enough") for i in range(4)]
        return [html_extract.main_text(p, html_extract.infer_wrapper(pages)) for p in pages]

    both = [f"a{i} is long enough\nb{i} is long enough" for i in range(4)]
    assert texts("<html><body><main><article>{0}</article><article>{1}</article></main></body></html>") == both
    assert texts("<html><body><article>{0}</article><hr><article>{1}</article></body></html>") == both
    assert texts("<html><body><div>logo</div><nav>n</nav><div><p>{0}</p><p>{1}</p></div></body></html>") == both
    # Without a wrapper's place every article counts.
    assert html_extract.main_text("<body><article>x</article><hr><article>y</article></body>") == "x\ny"


@pytest.mark.parametrize("label", ["layout has-sidebar", "post no-comments", "story with-banner", "layout sidebar-right", "comments-off"])
def test_classes_that_only_mention_a_part(label):
    for inner in ("<article><p>the text</p></article>", "<p>the text of the page</p>"):
        page = f"<html><body><nav>menu</nav><div class='{label}'>{inner}</div><div class='cookie-banner'>ok</div><div class='related'>more</div></body></html>"
        for wrapper in (None, html_extract.infer_wrapper([page, page.replace("text", "word")])):
            assert html_extract.main_text(page, wrapper).startswith("the text")
            assert not {"ok", "more", "menu"} & set(html_extract.main_text(page, wrapper).split())


@pytest.mark.parametrize("label", ["class='related-work'", "class='menu-items'", "class='notice-period'", "id='comments-on-theory'"])
def test_an_article_keeps_blocks_whose_names_only_begin_like_a_part(label):
    pages = [f"<html><body><nav>menu</nav><article><h1>Title {i}</h1><p>the long text of page {i}</p><div {label}><p>and more of {i}</p></div></article></body></html>" for i in range(4)]
    wrapper = html_extract.infer_wrapper(pages)
    assert [html_extract.main_text(p, wrapper) for p in pages] == [f"Title {i}\nthe long text of page {i}\nand more of {i}" for i in range(4)]


def test_text_that_a_host_repeats_is_not_the_article():
    """No class says which block is the menu: the wrapper does, as its text is the same on every page."""
    shape = "<html><body><div><a href='/'>Home</a> <a href='/n'>News</a></div><h2>Page {0}</h2><p>words of page {0} go here</p><h3>Details</h3><p>and {0} more</p><div><a href='/x'>Imprint</a></div></body></html>"
    pages = [shape.format(i) for i in range(5)]
    wrapper = html_extract.infer_wrapper(pages)
    assert [html_extract.main_text(p, wrapper) for p in pages] == [f"Page {i}\nwords of page {i} go here\nDetails\nand {i} more" for i in range(5)]
    # Copies of one page say nothing about what is the site's: all is kept.
    same = html_extract.infer_wrapper(pages[:1] * 5)
    assert "words of page 0 go here" in html_extract.main_text(pages[0], same)


def test_deep_and_wide_pages():
    import time

    deep = "<html><body>" + "<div>" * 5000 + "<p>inmost</p>" + "</div>" * 5000 + "</body></html>"
    lines = "<html><body><article>" + "".join(f"line {i}<br>" for i in range(20_000)) + "</article></body></html>"
    pairs = "<html><body><dl>" + "".join(f"<dt>t{i}<dd>d{i}" for i in range(5000)) + "</dl></body></html>"
    mixed = "<html><body><article>" + "".join(f"<{'p h2 ul pre blockquote'.split()[(i * i + i // 7) % 5]}>part {i}" for i in range(5000)) + "</article></body></html>"
    for page, n in ((deep, 1), (lines, 20_000), (pairs, 10_000), (mixed, 5000)):
        started = time.time()
        wrapper = html_extract.infer_wrapper([page, page.replace("1", "2")])
        text = html_extract.main_text(page, wrapper)
        html_extract.expression(html_extract.Part.load(wrapper.dump()))
        assert time.time() - started < 30
        assert len(text.split()) >= n


def test_html_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "https://h.org/1", PAGE.format("x"), "a", "b")] * 2 + [(2, None, PAGE.format("y"), None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, wrapper string")
    got = html_extract.extract_text(pages).collect()
    assert sorted((r.page_id, r.text.split("\n")[0]) for r in got) == [(1, "T & x"), (1, "T & x"), (2, "T & y")]
    assert html_extract.extract_text(pages.limit(0)).collect() == []


# ---- cases that every operator takes ---------------------------------------------------------------------------------

EVERY = {
    "licences": lambda d, s: license_scan.scan_licenses(d),
    "packing": lambda d, s: packing.pack_documents(d, __import__("public_tokenizers").path("word_bpe_49k.json")),
    "repeats": lambda d, s: suffix_dedup.remove_repeats(d),
    "near": lambda d, s: near_dup.near_duplicates(d),
    "contamination": lambda d, s: decontaminate.find_contamination(d, s.createDataFrame([(1, "a b c d")], "item_id long, text string")),
    "language": lambda d, s: language_id.identify_language(d, d.select(F.lit("en").alias("lang"), "text")),
    "toxicity": lambda d, s: toxicity.score_toxicity(d, s.createDataFrame([(4, 1), (5, 0)], "doc_id long, toxic int")),
}


@pytest.mark.parametrize("name", EVERY)
def test_odd_rows_and_empty_tables(spark, name):
    schema = "doc_id long, text string, low long, code long, rest string, a long, label string, token string"
    rows = [(i, t, 1, 2, "r", 3, "l", "t") for i, t, _ in odd_rows()]
    docs = spark.createDataFrame(rows, schema)
    got = EVERY[name](docs, spark).collect()
    if name in ("repeats", "near", "language", "toxicity"):
        assert len(got) == len(rows)
    if name == "packing":
        assert len([r for r in got if r.doc_id != 5]) == len(rows) - 1
    assert EVERY[name](docs.limit(0), spark).collect() == []


def test_blocks_hold_every_text():
    texts = ["a" * 50, None, "", "b" * 3, "c" * 200]
    found = [bytes(d[o[i] : o[i + 1]]).decode() for _, d, o in text_blocks(pa.array(texts), 64) for i in range(len(o) - 1)]
    assert found == [t or "" for t in texts]
