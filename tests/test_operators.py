import itertools
from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sitelens.functions import text as X
from sitelens.operators import audit, graph, keywords, search, judgements
from sitelens.session import ensure_checkpoint


def shuffled(spark, frame):
    """How many records running ``frame`` writes into shuffles."""

    def written():
        gateway = spark.sparkContext._gateway
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    frame().write.format("noop").mode("overwrite").save()
    return written() - before


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_hops_in_a_cycle(spark):
    ensure_checkpoint(spark)
    edges = spark.createDataFrame([("s", "/", "/a"), ("s", "/a", "/b"), ("s", "/b", "/a")], "site string, src string, dst string")
    nodes = spark.createDataFrame([("s", p) for p in ("/", "/a", "/b", "/x")], "site string, path string")
    assert {r.path: r.hops for r in graph.hops_from_home(edges, nodes).collect()} == {"/": 0, "/a": 1, "/b": 2, "/x": -1}


def test_hops_of_a_long_chain(spark):
    ensure_checkpoint(spark)
    edges = spark.createDataFrame([("s", f"/{i}" if i else "/", f"/{i + 1}") for i in range(12)], "site string, src string, dst string")
    nodes = spark.createDataFrame([("s", f"/{i}" if i else "/") for i in range(13)], "site string, path string")
    got = {r.path: r.hops for r in graph.hops_from_home(edges, nodes, merge_after=3).collect()}
    assert got == {f"/{i}" if i else "/": i for i in range(13)}


def test_robots(spark):
    urls = spark.createDataFrame([("s", "/a/1"), ("s", "/b")], "site string, path string")
    rules = spark.createDataFrame([("s", "/a"), ("s", "/")], "site string, prefix string")
    assert [r.path for r in graph.robots_filter(urls, rules).collect()] == ["/b"]
    assert graph.robots_filter(urls, rules, honour_disallow_all=True).count() == 0


@pytest.mark.parametrize(("rival", "ours", "own"), list(itertools.product([0.2, 0.8], repeat=3)))
def test_gap_buckets(spark, rival, ours, own):
    got = [spark.range(1).select(judgements.gap_bucket(F.lit(rival), F.lit(ours), F.lit(own), F.lit(c)).alias("b")).first().b for c in (0.0, 3.0)]
    if rival < 0.5 and ours < 0.5:
        want = ["untapped"] * 2
    elif ours < 0.5:
        want = ["missing"] * 2
    elif rival >= 0.5:
        want = ["shared"] * 2
    else:
        want = ["unique"] * 2 if own >= 0.5 else ["weak", "strong"]
    assert got == want


def test_run_states_part_the_pages(spark):
    rows = [("r", f"/{i}", a, a and b, k, g) for i, (a, b, k, g) in enumerate(itertools.product([True, False], [True, False], ["x", "y"], [0, 1]))]
    schema = "root string, path string, reachable boolean, raised boolean, change_key string, band_rank int"
    now = spark.createDataFrame(rows, schema)
    before = spark.createDataFrame([(r, p, not a, False, "x", 0) if i % 3 else (r, p, a, x, "x", 0) for i, (r, p, a, x, _, _) in enumerate(rows)][2:], schema)
    states = audit.diff_runs(now, before)
    assert states.count() == len(rows) and states.filter("state is null").count() == 0


def test_quick_wins_need_position_and_impressions(spark):
    schema = "site string, date date, query string, page string, search_type string, clicks long, impressions long, position double"
    day = date(2024, 1, 10)
    rows = spark.createDataFrame([("s", day, "q", "/low", "web", 0, 100, 5.0), ("s", day, "q", "/top", "web", 0, 100, 2.0), ("s", day, "q", "/few", "web", 0, 9, 5.0)], schema)
    got = search.quick_wins(rows, date(2024, 1, 13)).collect()
    assert [(r.page, r.expected_clicks) for r in got] == [("/low", 6)]


def test_overlapping_pairs_match_brute_force(spark):
    titles = ["alpha beta gamma", "alpha beta delta", "beta gamma alpha omega", "zeta theta", "theta zeta iota kappa"]
    pages = spark.createDataFrame([("s", f"/{i}", t, "") for i, t in enumerate(titles)], "site string, path string, title string, h1 string")
    want = set()
    for (i, a), (j, b) in itertools.combinations(enumerate(titles), 2):
        x, y = ({w for w in t.split() if len(w) > 3} for t in (a, b))
        if len(x & y) / len(x | y) >= 0.4:
            want.add((f"/{i}", f"/{j}"))
    assert {(r.a, r.b) for r in keywords.overlapping_page_pairs(pages).collect()} == want


def test_equal_titles_and_terms_are_compared_once(spark):
    terms = spark.range(400).selectExpr("'s' AS site", "id AS item_id", "'red boiler repair' AS term")
    titles = spark.range(400).selectExpr("'s' AS site", "concat('https://r', 9 - id % 4, '.org/') AS rival", "id AS place", "if(id % 2 = 0, 'Boiler repair', 'Repair, boiler') AS title")
    match = lambda: judgements.match_rival(terms, titles)
    assert {(r.rival, r.title, r.strength) for r in match().collect()} == {("r6.org", "Repair, boiler", 0.6667)} and match().count() == 400
    assert shuffled(spark, match) < 10_000


def test_best_path_by_sets_of_words(spark):
    terms = spark.createDataFrame([("s", t) for t in ("red boiler repair", "boiler", "none here", "a b", " ".join(f"word{c}x" for c in "abcdefghijkl"))], "site string, term string")
    paths = [("s", p) for p in ("/boilers/a", "/boiler", "/repair/red", "/red/boiler/zz", "/wordax-wordbx", "/" + "-".join(f"word{c}x" for c in "cdefghijklm"))]
    got = {r.term[:10]: r.path for r in keywords.best_existing_path(terms, spark.createDataFrame(paths, "site string, path string")).collect()}
    assert got == {"red boiler": "/red/boiler/zz", "boiler": "/boiler", "none here": None, "a b": None, "wordax wor": paths[-1][1]}
    many = spark.range(400).selectExpr("'s' AS site", "concat('boiler ', id) AS term"), spark.range(400).selectExpr("'s' AS site", "concat('/boiler/', id) AS path")
    assert shuffled(spark, lambda: keywords.best_existing_path(*many)) < 10_000


def test_phrases_of_a_page_stay_where_it_is(spark):
    pages = spark.range(20).selectExpr("concat('s', id % 2) AS site", "concat('/', id) AS path", "'Boiler repair' AS title", "'Boiler' AS h1", "array(struct(1 AS level, 'Boiler' AS text)) AS outline", "array_join(transform(sequence(1, 500), x -> concat('word', x, 'x')), ' ') AS prose")
    topic = lambda: keywords.page_topic(pages)
    assert {(r.primary, r.title_h1_overlap) for r in topic().collect()} == {("boiler", 0.5)}
    assert shuffled(spark, topic) < 500


def test_rare_terms_are_not_moved(spark):
    prose = "array_join(transform(sequence(1, 300), x -> concat('word', id * 1000 + x, 'x')), ' ')"
    pages = spark.range(20).selectExpr("concat('s', id % 2) AS site", "concat('/', id) AS path", "concat('Boiler repair ', id % 4, 'a') AS title", "'Boiler' AS h1", "array('Boiler') AS headings", f"{prose} AS prose", "0.0D AS link_density")
    rows = lambda **more: [tuple(r) for r in keywords.mine_keywords(pages, limit=3, **more).orderBy("site", F.desc("weight"), "term").collect()]
    assert rows(buckets=64, first=1) == rows(buckets=1) and rows()[0][:2] == ("s0", "boiler repair")
    terms = spark.createDataFrame([("s0", "boiler repair"), ("s0", "the boiler"), ("s1", "Boiler repair")], "site string, term string")
    measure = lambda: keywords.measure_terms(pages, terms)
    assert {(r.site, r.term): r.title_hits for r in measure().collect()} == {("s0", "boiler repair"): 10, ("s0", "the boiler"): 0, ("s1", "Boiler repair"): 0}
    assert shuffled(spark, measure) < 500


def test_measured_runs_are_those_of_the_column_functions(spark):
    """Odd letters, dashes, figures, noise and empty texts; no row is made for a run that is no term."""
    texts = ["Big red dog, the big red-dog's 42 4x", "\u212aettle \u0130stanbul k\u00e9ttle a b", "", None, "the of 12", "x" * 300 + " dog", "dog\ndog dog\u2003dog", "kettle kettle"]
    pages = spark.createDataFrame([("s" if i % 3 else "t", f"/{i}", t) for i, t in enumerate(texts)], "site string, path string, prose string")
    pages = pages.selectExpr("site", "path", "'' AS title", "CAST(NULL AS STRING) AS h1", "array('') AS headings", "prose", "0.0D AS link_density")
    grams = F.explode(X.ngrams(X.keyword_tokens(F.col("prose")), 1, 9)).alias("term")
    every = pages.select("site", "path", grams).groupBy("site", "term").agg(F.count("*").alias("n"), F.count_distinct("path").alias("pages"))
    want = {(r.site, r.term): (r.n, r.pages) for r in every.collect()}
    terms = spark.createDataFrame([*want, ("s", "kettle red"), ("t", "cat")], "site string, term string")
    found = keywords.measure_terms(pages, terms)
    got = {(r.site, r.term): (r.prose_hits, r.page_count) for r in found.collect()}
    assert len(want) > 20 and ("s", "kettle") in want and got == want | {("s", "kettle red"): (0, 0), ("t", "cat"): (0, 0)}
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
