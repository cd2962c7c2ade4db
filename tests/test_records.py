"""Audits, console files, provenance, history and payloads on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from sitelens.operators import decisions, judgements, keywords, page_audit, provenance
from sitelens.sources import console, history

RESPONSE = "page_id long, url string, status int, headers map<string,string>, title string, description string, robots string, canonical string, viewport string, lang string, blocked boolean, html string"


def test_technical_audit(spark):
    good = {"X-Frame-Options": "DENY", "x-content-type-options": "nosniff", "Referrer-Policy": "origin"}
    rows = [
        (1, "https://h/a/", 200, good, "t" * 40, "d" * 60, "", "https://h/a", "w", "en", False, ""),
        (2, "https://h/b", 302, None, None, None, "NOINDEX,nofollow", None, None, None, True, ""), (3, "https://h/c", 500, good, "", "", "", "", "", "", None, ""),
        (4, "https://h/d", 200, good, "short", "d" * 161, None, "https://x/d", "w", "en", None, ""),
    ]
    got = {r.page_id: r for r in page_audit.technical_audit(spark.createDataFrame(rows, RESPONSE)).collect()}
    assert (got[1].verdict, got[1].issues) == ("healthy", [])
    assert (got[3].verdict, got[3].issues, got[3].critical_count) == ("fetch_error", [], 0)
    assert {(i.severity, i.issue) for i in got[4].issues} == {("medium", "title_short"), ("low", "description_long"), ("high", "canonical_differs")}
    assert got[2].critical_count == 2 and {i.issue for i in got[2].issues} == {"redirect", "title_missing", "description_missing", "noindex", "nofollow", "canonical_missing", "viewport_missing", "lang_missing", "robots_blocked", *[f"no {h}" for h in page_audit.SECURITY_HEADERS]}


def test_preload_audit(spark):
    rules = '<script type="speculationrules">{"prefetch": [], "prerender": [1]}</script>'
    pages = [(1, 200, {"cache-control": "max-age=1"}, rules), (2, 200, {"Cache-Control": "NO-STORE"}, rules), (3, 200, {"Speculation-Rules": "x"}, "<link rel='prerender' href=x>"), (4, 200, None, '<link as="image" rel="preload" href="a">'), (5, 404, None, rules), (6, 200, None, None)]
    frame = spark.createDataFrame([(i, f"https://h/{i}", s, h, t) for i, s, h, t in pages], "page_id long, url string, status int, headers map<string,string>, html string")
    got = {r.page_id: r for r in page_audit.preload_audit(frame).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "optimised", 2: "improvements_available", 3: "improvements_available", 4: "not_implemented", 5: "fetch_error", 6: "not_implemented"}
    assert [[i.issue for i in got[k].issues] for k in (1, 2, 3, 4, 5)] == [[], ["no_store"], ["no_prefetch", "no_prerender", "prerender_link"], ["no_rules", "image_without_priority"], []]
    assert [tuple(p) for p in got[4].preloads] == [("image", "a", None)]


def test_performance_reports(spark):
    audits = {"b": (0.2, "opportunity"), "a": (0.2, "opportunity"), "c": (None, "opportunity"), "d": (0.95, "opportunity"), "e": (0.1, "table"), "f": (0.0, "opportunity"), "g": (0.5, "opportunity")}
    report = json.dumps({"lighthouseResult": {"categories": {"performance": {"score": 0.5}}, "audits": {k: {"score": s, "details": {"type": t}} for k, (s, t) in audits.items()} | {"interactive": {"numericValue": 3.5}}}})
    got = {r.page_id: r for r in page_audit.pagespeed_verdict(spark.createDataFrame([(1, report), (2, "no"), (3, None), (4, report.replace("0.5}}", "0.895}}"))], "page_id long, report string")).collect()}
    assert (got[1].performance, got[1].tti, got[1].fcp, got[1].opportunities, got[1].verdict) == (50, 3.5, None, ["f", "a", "b"], "needs_improvement")
    assert [got[i].verdict for i in (2, 3)] == ["fetch_error"] * 2 and got[2].opportunities == []
    assert got[4].verdict in ("good", "needs_improvement") and got[4].performance in (89, 90)


def test_properties(spark):
    listing = json.dumps({"siteEntry": [{"siteUrl": "https://www.h.example/", "permissionLevel": "siteFullUser"}, {"siteUrl": " "}, {"siteUrl": "sc-domain:h.example", "permissionLevel": "siteFullUser"}, {"siteUrl": "https://o.example/", "permissionLevel": "owner?"}]})
    known = console.read_properties(spark.createDataFrame([("a", listing), ("b", "bad"), ("c", None)], "account string, listing string"))
    assert sorted((r.place, r.permission) for r in known.collect()) == [(0, "siteFullUser"), (2, "siteFullUser"), (3, "unverified")]
    assert [(r.account, r.url) for r in console.best_property(known).collect()] == [("a", "https://www.h.example/")]
    sites = spark.createDataFrame([("a", "H.example/x"), ("a", "https://www.o.example"), ("a", "sc-domain:none"), ("b", "h.example")], "account string, url string")
    got = {(r.account, r.url): (r.property, r.permission, r.verified) for r in console.match_property(sites, known).collect()}
    assert got == {("a", "H.example/x"): ("sc-domain:h.example", "siteFullUser", True), ("a", "https://www.o.example"): ("https://o.example/", "unverified", True), ("a", "sc-domain:none"): ("sc-domain:none", None, False), ("b", "h.example"): ("sc-domain:h.example", None, False)}


def test_transcripts_take_the_last_totals(spark):
    step = lambda i, c: json.dumps({"sessionID": "s", "part": {"type": "step-finish", "tokens": {"input": i}, "cost": c}})
    lines = [step(5, 0.1), '{"part": {"type": "tool", "tool": "t", "state": {"status": "error", "error": "why"}}}', "plain", step(9, 0.3), '{"part": {"type": "text", "text": "abc"}}']
    calls, totals = console.read_transcript(spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "run_id string, line long, text string"))
    assert [tuple(r) for r in calls.collect()] == [("r", 1, "t", "error", False, "why")]
    assert [tuple(r) for r in totals.collect()] == [("r", "s", 9, 0, 0.3, 3)]


SOUND = {"business_name": "b", "business_summary": None, "market": "m", "competitors": [], "keyword_seeds": [{"term": "t", "intent": "unknown", "evidence_tool": " Search "}], "metrics": [{"key": "k", "label": "l", "number": {"value": 1200, "source_tool": "s", "raw": "1,200 visits", "unit": "x"}}], "notes": [""]}


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, set()), ({"extra": 1}, {("extra", "unknown_key")}), ({"market": ""}, {("market", "empty")}), ({"notes": "x"}, {("notes", "wrong_type")}), ({"keyword_seeds": [{"term": 5, "intent": "buy"}]}, {("keyword_seeds.0.term", "wrong_type"), ("keyword_seeds.0.intent", "not_allowed"), ("keyword_seeds.0.evidence_tool", "missing")}),
        ({"metrics": [{"key": "k", "label": "l", "number": {"value": "7", "source_tool": "s", "raw": "r"}, "unit": 1}]}, {("metrics.0.number.value", "wrong_type"), ("metrics.0.unit", "unknown_key")}), ({"competitors": [None]}, {("competitors.0", "wrong_type")}),
    ],
)
def test_schema_of_research(spark, change, want):
    frame = spark.createDataFrame([("r", 1, json.dumps(SOUND | change))], "run_id string, item_id long, output string")
    assert {(r.path, r.issue) for r in provenance.research_schema_check(frame).collect()} == want


def test_whole_outputs_that_are_wrong(spark):
    frame = spark.createDataFrame([("r", i, x) for i, x in enumerate(["{", "3", None, "{}"])], "run_id string, item_id long, output string")
    got = provenance.research_schema_check(frame).groupBy("item_id").agg(F.count("*").alias("n"), F.min("issue").alias("i")).orderBy("item_id").collect()
    assert [(r.item_id, r.n, r.i) for r in got] == [(0, 1, "not_json"), (1, 1, "not_an_object"), (2, 1, "not_json"), (3, 7, "missing")]


def test_flagged_evidence(spark):
    bad = SOUND | {"competitors": [{"name": "n", "url": "u", "why": "w", "evidence_tool": "crawl", "evidence_query": "q", "angle": "a"}], "metrics": [{"key": "k", "label": "l", "number": {"value": 1200, "source_tool": "s", "raw": "1.3k"}}]}
    outputs = spark.createDataFrame([("r", 1, json.dumps(SOUND)), ("r", 2, json.dumps(bad)), ("z", 3, json.dumps(SOUND))], "run_id string, item_id long, output string")
    calls = spark.createDataFrame([("r", "search")], "run_id string, tool string")
    assert sorted((r.item_id, r.kind, r.name) for r in provenance.flagged_evidence(outputs, calls).collect()) == [(2, "competitor", "n"), (2, "metric", "k"), (3, "keyword", "t")]


def test_ten_runs_of_a_root_are_kept(spark, tmp_path):
    path = f"file://{tmp_path}/history"
    rows = lambda root, k: spark.createDataFrame([(root, k, f"/p{i}") for i in range(k % 3 + 1)], "root string, run_no long, path string")
    schema = rows("x", 1).schema
    assert history.read_history(spark, path, schema).count() == 0
    history.write_history(rows("https://other.example", 1), path)
    for k in [*range(1, 5), 4, *range(5, 12)]:
        history.write_history(rows("https://h.example", k), path)
    got = history.read_history(spark, path, schema).groupBy("root", "run_no").count().collect()
    assert {(r.root, r.run_no, r["count"]) for r in got} == {("https://other.example", 1, 2)} | {("https://h.example", k, k % 3 + 1) for k in range(2, 12)}
    key = spark.range(1).select(history.root_key(F.lit("HTTPS://H.example/x?y"))).first()[0]
    assert sorted(int(p.name[7:]) for p in (tmp_path / "history" / f"root_key={key}").iterdir() if p.name.startswith("run_no=")) == list(range(2, 12))


def payload(spark, limit, text="x" * 300, question="title_question_answered"):
    page = "struct<title:string,h1:string,text:string,paragraphs:array<string>,words:int>"
    items = spark.createDataFrame([("s", 1, None, ("t", "", text, ["a" * 50, "b" * 50, "c" * 50], 7), ["one"])], f"site string, item_id long, business string, page {page}, titles array<string>")
    asked = spark.createDataFrame([("s", 1, question), ("s", 1, "unknown")], "site string, item_id long, question_id string")
    return judgements.judgement_payloads(items, asked, limit).first()


def test_payloads_are_cut_in_order(spark):
    whole = payload(spark, 1000)
    assert json.loads(whole.payload) == {"page": {"title": "t", "text": "x" * 300}} and whole.chars == len(whole.payload) and whole.unmapped == ["unknown"] and whole.trimmed == []
    cut = payload(spark, 250)
    assert json.loads(cut.payload)["page"]["text"] == "x" * 150 and cut.chars <= 250 and cut.trimmed == ["page.text"] and not cut.over_budget
    lists = payload(spark, 151, text='"\n' * 10, question="paragraph_citability")
    assert json.loads(lists.payload)["page"] == {"text": "", "paragraphs": ["a" * 50, "b" * 50], "words": 7} and lists.trimmed == ["page.text", "page.paragraphs"]
    assert payload(spark, 5).over_budget
    exact = payload(spark, len(whole.payload))
    assert exact.trimmed == [] and payload(spark, len(whole.payload) - 1).trimmed == ["page.text"]


def test_topics_have_other_phrases(spark):
    page = [("s", "/", "red boiler", "red boiler", [(2, "blue tap"), (3, "green roof")], "some words about water and roof water roof"), ("s", "/none", "", "", None, "")]
    rows = spark.createDataFrame(page, "site string, path string, title string, h1 string, outline array<struct<level:int,text:string>>, prose string")
    got = {r.path: r for r in keywords.page_topic(rows).collect()}
    assert (got["/"].primary, got["/"].secondary) == ("boiler", ["red", "blue", "blue tap"])
    assert (got["/none"].primary, got["/none"].secondary, got["/none"].concentration) == ("", [], 0.0)


def test_terms_of_any_length_are_measured(spark):
    pages = spark.createDataFrame([("s", "/a", "Big red dog big red dog", "Red", ["Red", "dog"], "a big red dog barks", 0.0), ("s", "/b", "dog", "", ["dog house"], "dog dog", 0.5)], "site string, path string, title string, h1 string, headings array<string>, prose string, link_density double")
    terms = spark.createDataFrame([("s", t) for t in ("dog", "big red dog", "red dog big red", "cat", None)], "site string, term string")
    got = {r.term: (r.title_hits, r.heading_hits, r.prose_hits, r.frequency, r.page_count) for r in keywords.measure_terms(pages, terms).collect()}
    assert got == {"dog": (3, 1, 1, 6, 2), "big red dog": (2, 0, 1, 3, 1), "red dog big red": (1, 0, 0, 1, 1), "cat": (0, 0, 0, 0, 0)}


def test_decisions_as_files(spark, tmp_path):
    decided = spark.createDataFrame([("s", 2, "=cmd()", 0.5), ("s", 1, 'say "a", b', 0.25), ("t", 3, "+1", 1.0)], "site string, item_id long, change string, priority double")
    states = spark.createDataFrame([("s", 2, "newly_raised")], "site string, item_id long, state string")
    decisions.write_decisions_csv(decisions.export_decisions_csv(decided, states), f"file://{tmp_path}/out")
    read = lambda site: [x for p in sorted((tmp_path / "out" / f"site={site}").glob("part-*")) for x in p.read_text().splitlines()]
    assert read("s") == ['"say ""a"", b",0.25,', "'=cmd(),0.5,newly_raised"] and read("t") == ["'+1,1.0,"]


def test_rivals_by_rare_words(spark):
    terms = spark.createDataFrame([("s", 1, "red boiler repair"), ("s", 2, "boiler"), ("s", 3, "of"), ("s", 4, "green tap fitting costs today")], "site string, item_id long, term string")
    titles = spark.createDataFrame([("s", "https://b.org/", 1, "Boiler repair"), ("s", "https://a.org/x", 2, "Repair of a boiler"), ("s", "https://a.org/x", 1, "Boilers"), ("s", "https://c.org", 1, "Tap")], "site string, rival string, place long, title string")
    cards = spark.createDataFrame([("s", "https://a.org/x", 70, 0.9)], "site string, rival string, score int, worth_copying double")
    got = {r.item_id: (r.rival, r.title, r.shared, r.strength, r.score) for r in judgements.match_rival(terms, titles, cards).collect()}
    assert got == {1: ("a.org", "Repair of a boiler", ["boiler", "repair"], 0.6667, 70), 2: ("a.org", "Repair of a boiler", ["boiler"], 1.0, 70)}
