"""The page-evidence job on literal pages."""

from sitelens.sources.html_job import extract_pages, meta_tags

PAGE = """<!DOCTYPE html><html lang="en"><head><title> A  title &amp; more </title><meta name="description" content="first"><meta name="Description" content="last"><meta property="article:published_time" content="2023-05-05">
<meta name="robots" content="noindex"><meta name="viewport" content="w"><link rel="canonical" href="https://h.example/a"><link rel="alternate" hreflang="de" href="/de">
<script type="application/ld+json">{"@graph": [{"@type": "BreadcrumbList", "itemListElement": [{"name": "Home"}, {"item": {"name": "Section"}}]}, {"@type": "Article", "author": {"name": "Ann"}, "dateModified": "2024-01-02"}]}</script><script>var x = "not text";</script></head>
<body><nav aria-label="Breadcrumbs"><ol><li><a href="/">Start</a></li><li><span itemprop="name">Here</span></ol></nav><header>Top</header>
<main><h1>The <b>head</b></h1><p>First words<p>second words<div>and <h3>small</h3> more</div><h2>Next</h2><p>Not the opening. Written May 3, 2021 and 4 June 2022, first on 2020-01-31.</p>
<ul><li>one<li>two</ul><img src="a"><img src="b" alt=""><a href="/x?y#z">x</a><a href="#no">no</a><a href="https://www.h.example/p">own</a><a href="https://o.example/">other</a><time datetime="2019-09-09">then</time></main><footer>Foot</footer></body></html>"""


def rows(spark, *pages):
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return extract_pages(frame)


def test_a_page(spark):
    r = rows(spark, ("https://h.example/a", PAGE)).first()
    assert (r.title, r.h1, r.lang, r.description) == ("A title & more", "The head", "en", "first")
    assert r.opening == "First words second words and small more"
    assert r.quality_text.startswith("A  title & more The head First words") and "Foot" not in r.quality_text and "Start" not in r.quality_text and "var x" not in r.quality_text
    assert [(h.level, h.text) for h in r.headings] == [(1, "The head"), (3, "small"), (2, "Next")]
    assert (r.breadcrumbs, r.breadcrumb_source) == (["Home", "Section"], "json-ld")
    assert (r.published, r.modified) == ("2023-05-05", "2024-01-02")
    assert r.stated_dates == ["2019-09-09", "May 3, 2021", "4 June 2022", "2020-01-31"]
    assert (r.internal_links, r.external_links, r.internal_targets) == (3, 1, ["/", "/x", "/p"])
    assert (r.images, r.images_missing_alt, r.alt_ratio, r.noindex, r.has_viewport, r.has_schema) == (2, 1, 0.5, True, True, True)
    assert r.authors == ["Ann"] and "var x" not in r.text and r.prose.startswith("The head First words") and "Foot" not in r.prose


def test_trails_in_markup(spark):
    got = rows(
        spark, ("https://h/1", PAGE.replace("ld+json", "json")), ("https://h/2", '<div class="Breadcrumb-list"><ul><li>A</li><li><a><span itemprop="name">B</span></a></li><li>C</ul></div><li>not</li>'),
        ("https://h/3", '<ol class="breadcrumb"><li>only</li></ol>'), ("https://h/4", '<div itemtype="https://schema.org/BreadcrumbList"></div>'),
    ).orderBy("page_id").collect()
    assert [(r.breadcrumbs, r.breadcrumb_source) for r in got] == [(["Start", "Here"], "markup"), (["A", "B", "C"], "markup"), ([], "none"), ([], "microdata")]


def test_tags_for_audits(spark):
    r = meta_tags(rows(spark, ("https://h.example/a", PAGE), (None, None))).orderBy("page_id").collect()
    assert (r[0].title, r[0].description, r[0].robots, r[0].canonical, [tuple(x) for x in r[0].hreflang]) == ("A  title & more", "last", "noindex", "https://h.example/a", [("de", "/de")])
    assert (r[1].title, r[1].description, r[1].canonical, r[1].viewport, r[1].lang, r[1].hreflang) == (None, None, None, None, None, [])


def test_pages_without_end_tags_or_h1(spark):
    got = rows(spark, ("https://h/", "<p>a<p>b<li>c<li>d"), ("https://h/", "<h1>Only head"), ("https://h/", "")).orderBy("page_id").collect()
    assert [r.opening for r in got] == ["a b c d", "Only head", ""]
    assert [r.text for r in got] == ["a b c d", "Only head", ""]


def test_pages_are_read_a_few_at_a_time(spark):
    import pyarrow as pa

    from sitelens.sources.html_job import _pieces

    batch = pa.RecordBatch.from_pydict({"page_id": [1, 2, 3, 4, 5], "html": ["x" * 60, None, "y" * 60, "z" * 500, ""]})
    assert [p.column("page_id").to_pylist() for p in _pieces(batch, 100)] == [[1, 2], [3], [4], [5]]
    assert list(_pieces(batch.slice(0, 0), 100)) == []
    pages = spark.createDataFrame([(i, "https://h.example/a", PAGE if i % 3 else None) for i in range(7)], "page_id long, url string, html string").coalesce(1)
    assert extract_pages(pages, at_once=1).collect() == extract_pages(pages).collect()
