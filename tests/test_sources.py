"""Files beside pages: robots against the standard library's reader, sitemaps in circles, replies and structured data as literals."""

import random
import urllib.robotparser

from pyspark.sql import functions as F

from sitelens.operators import locales
from sitelens.sources import answers, robots, sitemaps, structured


def robots_text(rng):
    some = ["User-agent: *", "user-agent: GPTBot", "User-Agent : ccbot", "User-agent: bot", "Disallow: /", "Disallow:", "Disallow: /p", "Allow: /p/1", "Disallow: /p/1 # why", "", "", "# note", "  ", "Crawl-delay: 3", "Sitemap: https://x/y.xml", "nonsense", "Disallow: /q:1"]
    return "\n".join(rng.choice(some) for _ in range(rng.randrange(0, 14)))


def test_access_is_that_of_the_standard_reader(spark):
    rng = random.Random(11)
    texts = {f"s{i}": robots_text(rng) for i in range(150)}
    paths = ["/", "/p", "/p/1x", "/z", "/q:1"]
    files = spark.createDataFrame([*texts.items(), ("none", None)], "site string, text string")
    urls = spark.createDataFrame([(s, p) for s in [*texts, "none"] for p in paths], "site string, path string")
    agents = ["GPTBot", "CCBot", "Other"]
    got = {(r.site, r.path, r.agent): r.allowed for r in robots.ai_crawler_access(files, urls, agents).collect()}
    want = {}
    for site, text in [*texts.items(), ("none", "")]:
        reader = urllib.robotparser.RobotFileParser()
        reader.parse(text.splitlines())
        want |= {(site, p, a): reader.can_fetch(a, f"https://x{p}") for p in paths for a in agents}
    assert got == want
    seen = {r.verdict for r in robots.ai_visibility(files, robots.ai_crawler_access(files, urls, agents)).collect()}
    assert seen == {"open", "partial", "closed"}


def test_longest_rule_and_full_disallow(spark):
    files = spark.createDataFrame([("a", "User-agent: *\nDisallow: /p\nAllow: /p/1\nDisallow: /"), ("b", "User-agent: *\nDisallow: /x\nAllow: /x")], "site string, text string")
    urls = spark.createDataFrame([("a", "/p/1"), ("a", "/p/2"), ("a", "/z"), ("b", "/x")], "site string, path string")
    allowed = lambda **how: {(r.site, r.path) for r in robots.ai_crawler_access(files, urls, ["Any"], **how).collect() if r.allowed}
    assert allowed() == set()
    assert allowed(longest=True) == {("a", "/p/1"), ("b", "/x")}
    assert allowed(honour_disallow_all=False) == {("a", "/z")}


def test_rules_for_all_agents(spark):
    text = "Disallow: /early\nUser-agent: x\nDisallow: /x\nUser-agent: *\nDisallow: /a b # c\nDisallow:\nSitemap: https://h/s.xml\r\nUser-agent: y\nDisallow: /y"
    got = robots.read_robots(spark.createDataFrame([("s", text), ("n", None)], "site string, text string")).orderBy("line").collect()
    assert [(r.site, r.kind, r.value) for r in got] == [("s", "disallow", "/a b"), ("s", "sitemap", "https://h/s.xml")]


def test_sitemaps_in_circles(spark):
    index = lambda *names: "<sitemapindex>" + "".join(f"<sitemap><loc>{n}</loc></sitemap>" for n in names) + "</sitemapindex>"
    files = [("a", index("b", "a", "gone")), ("b", index("c", "a")), ("c", "<urlset><url><loc> u1 </loc></url><url><LOC>u2</LOC></url><url><loc>u1</loc></url></urlset>"), ("d", index("d")), ("e", None)]
    roots = [("one", "a"), ("two", "d"), ("three", "c"), ("four", "e"), ("five", None)]
    args = spark.createDataFrame(roots, "site string, url string"), spark.createDataFrame(files, "url string, body string")
    assert sorted(tuple(r) for r in sitemaps.read_sitemap_urls(*args).collect()) == [("one", "u1"), ("one", "u2"), ("three", "u1"), ("three", "u2")]
    assert sorted(tuple(r) for r in sitemaps.read_sitemap_urls(*args, most=1).collect()) == [("one", "u1"), ("three", "u1")]
    assert sitemaps.read_sitemap_urls(args[0].limit(0), args[1]).count() == 0


def test_answers_by_type_or_fields(spark):
    replies = [
        '{"a": {"type": "Choice", "choice": "x", "confidence": "0.7", "probabilities": {"x": 0.7, "y": 0.3}}, "b": {"score": 2}, "c": {"noul": 0.25}, "d": {"type": "score"}, "e": {"choice": 5}, "f": null, "g": 3}',
        '{"cut', "[]", None, "{}",
    ]
    good, bad = answers.read_answers(spark.createDataFrame([("p", "s", i, r) for i, r in enumerate(replies)], "scope string, site string, item_id long, reply string"))
    got = {r.question_id: (r.type, r.choice, r.score, r.noul, r.confidence, r.probabilities) for r in good.collect()}
    assert got == {"a": ("choice", "x", None, None, 0.7, {"x": 0.7, "y": 0.3}), "b": ("score", None, 2.0, None, 0.0, {}), "c": ("noul", None, None, 0.25, None, None), "d": ("score", None, 0.0, None, 0.0, {})}
    assert sorted((r.item_id, r.question_id or "", r.reason) for r in bad.collect()) == [(0, "e", "no type"), (0, "f", "not an object"), (0, "g", "not an object"), (1, "", "reply"), (2, "", "reply"), (3, "", "reply")]


def test_nodes_of_structured_data(spark):
    blocks = [(1, "https://h/blog/x", 0, '[{"@type": "Product", "name": "n"}, 7, null]'), (1, "https://h/blog/x", 1, "{broken"), (2, "https://h/", 0, None), (3, "https://h/faq", 0, '{"@graph": [{"@type": ["FAQPage", 3], "mainEntity": 1}]}')]
    frame = spark.createDataFrame(blocks, "page_id long, url string, place int, block string")
    nodes = structured.json_ld_nodes(frame)
    assert sorted((r.page_id, r.depth, r.types, r.fields) for r in nodes.collect()) == [(1, 0, ["Product"], ["@type", "name"]), (3, 0, [], ["@graph"]), (3, 1, ["FAQPage"], ["@type", "mainEntity"])]
    found = structured.schema_findings(nodes)
    got = {r.page_id: (r.nodes, r.invalid, r.recommended, r.verdict) for r in structured.schema_validate(frame.select("page_id", "url").distinct(), found).collect()}
    assert got == {1: (1, 1, ["BlogPosting"], "invalid_schemas"), 2: (0, 0, [], "missing_schemas"), 3: (1, 0, ["FAQPage"], "healthy")}
    assert [r.missing for r in found.filter("page_id = 1").collect()] == [["offers"]]


def test_language_alternatives(spark):
    pages = [("https://h/en", None, [("en", "https://h/en/"), ("de", "https://h/de"), ("x-default", "https://h/en")]), ("https://h/de", "", [("de", "https://h/de"), ("jp", "http://h/jp")]), ("https://h/none", None, None), ("https://h/fr", "https://h/x", [("fr-UK", "https://h/x/")])]
    frame = spark.createDataFrame(pages, "url string, canonical string, tags array<struct<lang:string,href:string>>")
    got = {r.url: (r.verdict, [i.issue for i in r.issues]) for r in locales.hreflang_audit(frame).collect()}
    assert got == {"https://h/en": ("valid", []), "https://h/de": ("issues_found", ["no_x_default", "use_ja", "mixed_protocols"]), "https://h/none": ("no_hreflang", []), "https://h/fr": ("issues_found", ["no_x_default", "use_gb"])}
    assert [(r.url, r.href) for r in locales.missing_return_tags(frame).collect()] == [("https://h/en", "https://h/de")]
    codes = {"en": [], "eng": ["three_letters"], "xx-1": ["unknown_language", "bad_region"], "zh-Hans": ["bad_region"], "x-default": [], "EN-gb": [], "": ["unknown_language"]}
    rows = spark.createDataFrame([(c,) for c in codes], "c string").select("c", locales.lang_code_issues(F.col("c")).alias("i")).collect()
    assert {r.c: r.i for r in rows} == codes
