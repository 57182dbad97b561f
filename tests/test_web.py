import pytest
from pyspark.sql import functions as F

from millrace.functions import html as h
from millrace.functions import licenses as lic
from millrace.operators import catalog as g
from millrace.operators import licenses as ol
from millrace.operators import web

URLS = [
    ("https://github.com/user/dataset", True), ("https://zenodo.org/record/123", True),
    ("https://example.com/data.csv", True), ("https://www.kaggle.com/datasets/x", True),
    ("https://site.org/download/thing", True), ("https://x.org/archive.tar.gz?v=1", True),
    ("https://medium.com/@u/article", False), ("https://myblog.com/post", False), ("https://youtube.com/watch?v=1", False),
    ("https://example.com/about", False), ("https://news.site.com/data", False), ("https://example.com/?q=data", False),
    ("https://notgithub.com/x", True), ("http://[bad/data", False), ("", False), ("https://x.org/a.csv;v=2", True),
]


def test_urls(spark):
    df = spark.createDataFrame(URLS, "url string, want boolean")
    assert web.classify_urls(df).filter("is_dataset_url <> want").collect() == []
    assert web.filter_urls(df).count() == sum(w for _, w in URLS)
    assert tuple(web.filter_urls_stats(df).first()) == (16, 8, 8)
    exact = {r.url: r.is_dataset_url for r in web.classify_urls(df, exact_domain=True).collect()}
    assert exact["https://github.com/user/dataset"] and not exact["https://notgithub.com/x"]


@pytest.mark.parametrize(
    "text, kind, confidence, source",
    [
        ("Released under the MIT License", "MIT", 0.9, "pattern_match"),
        ("Apache License, Version 2.0", "Apache-2.0", 0.9, "pattern_match"),
        ("apache license\n2.0", "Apache-2.0", 0.9, "pattern_match"),
        ("Creative Commons Zero dedication", "CC0-1.0", 0.9, "pattern_match"),
        ("CC BY 4.0", "CC-BY-4.0", 0.9, "pattern_match"),
        ("CC-BY-4.0", "CC-BY-4.0", 0.9, "pattern_match"),
        ("BSD 3-Clause", "BSD-3-Clause", 0.6, "keyword_match"),  # the hyphen is blanked before matching
        ("cc by-nc 4.0", "CC-BY-4.0", 0.6, "keyword_match"),  # "cc by" is tried before "cc by-nc"
        ("GNU General Public License v3", "GPL-3.0", 0.9, "pattern_match"),
        ("submit here", "MIT", 0.6, "keyword_match"),
        ("see the license file", "UNKNOWN", 0.3, "generic_mention"),
        ("a sublicense_x", "UNKNOWN", 0.1, "not_found"),
        ("nothing", "UNKNOWN", 0.1, "not_found"),
        ("", "UNKNOWN", 0.1, "empty_input"),
        (None, "UNKNOWN", 0.1, "empty_input"),
        ("Permission is hereby granted, says MIT", "MIT", 0.9, "pattern_match"),
        ("Permission is hereby granted\nMIT", "MIT", 0.6, "keyword_match"),  # a line feed ends the search
    ],
)
def test_licenses(spark, text, kind, confidence, source):
    row = ol.detect_license(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (row.license_type, row.confidence, row.source) == (kind, confidence, source)
    assert row.allows_commercial == (kind not in ("UNKNOWN", "CC-BY-NC-4.0"))


def test_word_boundary(spark):
    df = spark.createDataFrame([("submit here",), ("under MIT",)], "t string")
    assert [r.license_type for r in ol.detect_license(df, "t", word_boundary=True).collect()] == ["UNKNOWN", "MIT"]


def test_license_json(spark):
    values = ['{"license": "MIT License"}', '{"license_name": "CC0"}', '["Open Database License", "x"]', '{"a": "odbl"}', "MIT License"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, j string")
    got = [r.license_type for r in ol.detect_license_json(df, "j").orderBy("i").collect()]
    assert got == ["MIT", "CC0-1.0", "ODbL-1.0", "ODbL-1.0", "MIT"]


def test_ml_friendly(spark):
    df = spark.createDataFrame([("MIT",), ("UNKNOWN",), ("CC-BY-NC-4.0",), ("unknown",)], "t string")
    assert [r[0] for r in df.select(lic.ml_friendly(F.col("t"))).collect()] == [True, False, True, True]
    assert [r[0] for r in df.select(lic.ml_friendly(F.col("t"), strict=True)).collect()] == [True, False, False, False]


PAGE = """<html><head><title>Breast Cancer Wisconsin Dataset - UCI &amp; more</title><script>var a = "<a href='/s.csv'>";</script></head>
<body><p>Size: 25 KB</p><!-- <a href="/hidden.csv">no</a> --><a class="x" href="/download/cancer.csv"> Get <b>it</b></a>
<a href='/about'>About</a><a href="/data.JSON?x=1&amp;y=2">json</a> License: CC BY 4.0 """ + "text " * 30 + "</body></html>"


def test_page(spark):
    df = spark.createDataFrame([("https://archive.ics.uci.edu/ml/cancer", PAGE)], "url string, html string")
    page = web.extract_pages(df).first()
    assert page.title == "Breast Cancer Wisconsin Dataset - UCI & more"
    assert [tuple(x) for x in page.download_links] == [("/download/cancer.csv", "Getit"), ("/data.JSON?x=1&y=2", "json")]
    assert "var a" not in page.page_text and page.page_text.startswith("Breast Cancer") and "hidden" not in page.page_text
    meta = web.page_metadata(df).first()
    assert (meta.dataset_name, meta.file_size_mb, meta.file_format) == ("Breast Cancer Wisconsin Dataset", 25 / 1024, "csv")
    assert (meta.download_url, meta.license, meta.tags) == ("/download/cancer.csv", "unknown", [])
    assert web.valid_pages(df).count() == 1


def test_parser_agrees_and_reads_more(spark):
    df = spark.createDataFrame([("u", PAGE), ("u", "<a href=/x.csv>bare</a><title>T&eacute;</title>")], "url string, html string")
    fast, full = web.extract_pages(df).collect(), web.parse_pages(df).collect()
    assert fast[0].title == full[0].title and fast[0].page_text == full[0].page_text
    assert [x.href for x in full[0].download_links] == ["/s.csv"][:0] + [x.href for x in fast[0].download_links]
    assert full[1].title == "Té" and full[1].download_links[0].href == "/x.csv"


def test_invalid_pages(spark):
    long = "x" * 200
    rows = [("short",), (f"<title>404</title>{long}",), (f"<title>Not Found</title>{long}",), (long,), (f"<title>ok</title>{long}",), (None,)]
    df = spark.createDataFrame(rows, "html string")
    assert [r.html[:15] for r in web.valid_pages(df).collect()] == ["<title>ok</titl"]
    two = spark.createDataFrame([("bad", f"<title>ok</title>{long}"), ("bad", "bad")], "a string, b string")
    assert [r.html is not None for r in web.page_fallback(two, "a", "b").collect()] == [True, False]


def test_browser_links(spark):
    html = '<a href="/a.csv">1</a><a href="/a.csv">2</a><a href="https://github.com/x/blob/m/f.csv">3</a><a href="">e</a><a href="/raw">4</a>'
    df = spark.createDataFrame([("https://x.org", html)], "url string, html string")
    got = [(r.href, r.text) for r in web.extract_links_browser(df).orderBy("position").collect()]
    assert got == [("/a.csv", "1"), ("https://github.com/x/raw/m/f.csv", "3"), ("/raw", "4")]


def test_rank_links(spark):
    hrefs = ["/z", "b.zip", "/z", "c.json", "d.parquet", "e.CSV", "http://h/f.csv"]
    df = spark.createDataFrame([("https://h.org/p/q", [(x,) for x in hrefs])], "url string, links array<struct<href:string>>")
    assert [r.download_url for r in web.rank_links(df, 10).orderBy("choice").collect()] == [
        "d.parquet", "e.CSV", "http://h/f.csv", "c.json", "b.zip", "https://h.org/z",
    ]
    assert web.rank_links(df).count() == 3


def test_search_results(spark):
    answers = spark.createDataFrame(
        [(1, '{"organic_results":[{"link":"https://kaggle.com/x","title":"T"},{"title":"no link"}]}'), (2, "{}")], "q int, j string"
    )
    flat = web.flatten_search_results(answers, "j")
    assert [(r.q, r.link, r.title, r.snippet, r.source) for r in flat.collect()] == [
        (1, "https://kaggle.com/x", "T", "", "google"), (1, "", "no link", "", "google"),
    ]
    assert [tuple(r)[-3:] for r in web.filter_search_results(flat).collect()] == [("https://kaggle.com/x", "T", "")]


# --- catalogue ---

CANDIDATE = "source_id string, url string, source_type string, is_downloadable boolean, size_mb double, file_extension string, license string"


def test_scores(spark):
    rows = [
        ("perfect", "https://x/a", "kaggle", True, 10.5, "csv", "CC0-1.0", "Name", "About"),
        ("poor", "https://x/b", "web_scrape", False, 0.0, "unknown", None, None, None),
        ("plain", "https://x/c", "kaggle", True, 10.0, "csv", "MIT", None, None),
        ("odd", "https://x/d", "kaggle", True, 0.0, None, "UNKNOWN", "", ""),
    ]
    df = spark.createDataFrame(rows, CANDIDATE + ", dataset_name string, page_description string")
    assert {r.source_id: r.compliance_score for r in g.compliance_score(df).collect()} == {
        "perfect": 1.0, "poor": 0.0, "plain": 0.9, "odd": 0.35,
    }


def test_waterfall_per_search(spark):
    rows = (
        [("full", "huggingface", i) for i in range(5)] + [("full", "kaggle", 9), ("full", "web_scrape", 10)]
        + [("half", "huggingface", 0), ("half", "kaggle", 1), ("half", "kaggle", 2), ("half", "web_scrape", 3)]
        + [("few", "kaggle", 0), ("few", "web_scrape", 1), ("few", "web_scrape", 2)]
        + [("web", "web_scrape", 0)]
    )
    df = spark.createDataFrame(rows, "search string, source_type string, arrival int")
    got = sorted((r.search, r.arrival) for r in g.waterfall(df, 3, ["search"], ["arrival"]).collect())
    assert got == [("few", 0), ("few", 1), ("few", 2), ("full", 0), ("full", 1), ("full", 2), ("half", 0), ("half", 1), ("half", 2), ("web", 0)]


def test_accumulate_takes_every_variant_until_enough_have_come(spark):
    rows = [("few", v, v) for v in range(6)] + [("many", v, 10 * v + i) for v in range(6) for i in range(3)]
    df = spark.createDataFrame(rows, "search string, variant int, i int")
    got = g.accumulate(df, 3, ["search"], ["i"])
    assert sorted(r["variant"] for r in got.filter("search = 'few'").collect()) == list(range(6))
    assert sorted({r["variant"] for r in got.filter("search = 'many'").collect()}) == [0, 1]
    assert g.accumulate(df, 3, ["search"], ["i"], most=2).filter("search = 'few'").count() == 2


def test_accumulate(spark):
    rows = [("a", v, i) for v, n in ((0, 3), (1, 3), (2, 3), (3, 3)) for i in range(n)] + [("b", 0, 0), ("b", 1, 0), ("b", 2, 0), ("b", 3, 0)]
    df = spark.createDataFrame(rows, "search string, variant int, i int")
    got = g.accumulate(df, 2, ["search"], ["i"], most=3).groupBy("search").agg(F.max("variant").alias("v")).collect()
    assert {r.search: r.v for r in got} == {"a": 1, "b": 2}


def test_first_pick_limits_before_the_shuffle(spark):
    from plans import plan_of

    df = spark.createDataFrame([("x", 1, "u")], "source_id string, arrival int, url string")
    plan = plan_of(g.dedup(df, ["arrival"], []))
    assert plan.count("WindowGroupLimit") == 2  # before and after the exchange
    many = spark.createDataFrame([("q", "kaggle", 1)], "search string, source_type string, arrival int")
    assert plan_of(g.waterfall(many, 3, ["search"], ["arrival"])).count("WindowGroupLimit") >= 2


def test_validation_and_routes(spark):
    rows = [("a/b", "https://x.org", "kaggle", True, 0.5), (None, "x", "other", None, 1.5)]
    df = spark.createDataFrame(rows, "source_id string, url string, source_type string, is_downloadable boolean, compliance_score double")
    good, bad = g.validate_candidates(df).collect()
    assert good.is_valid and bad.reasons == [
        "missing source_id", "bad url", "bad source_type", "missing is_downloadable", "score out of range",
    ]
    ids = spark.createDataFrame([("u/d",), ("imdb",), ("http://a/b",)], "source_id string")
    assert [r.source_type for r in g.route_ids(ids).collect()] == ["kaggle", "huggingface", "huggingface"]


def test_unescape_order(spark):
    assert spark.range(1).select(h.unescape(F.lit("&amp;lt;"))).first()[0] == "&lt;"


def test_attributes_of_any_spelling(spark):
    html = (
        "<title lang=en>T</title><p title=\"a>b\">one</p><p title=it's>two</p><a class=k href=x.csv>first</a>"
        "<a data-href=no.csv title='>' HREF = 'y.csv'>second</a><a href=z.csv/>third</a>"
    )
    df = spark.createDataFrame([(1, html)], "i int, html string")
    row = web.extract_pages(df).first()
    assert row.title == "T" and row.page_text == "T one two first second third"
    assert [(l.href, l.text) for l in row.download_links] == [("x.csv", "first"), ("y.csv", "second"), ("z.csv/", "third")]


def test_pages_are_whole_unless_asked(spark):
    html = "".join(f"<a href='{i}.csv'>{'w' * 60}</a>" for i in range(300))
    df = spark.createDataFrame([(1, "u", html)], "i int, url string, html string")
    row = web.extract_pages(df).first()
    assert len(row.download_links) == 300 and len(row.page_text) == 300 * 61 - 1
    few = web.extract_pages(df, per_page=10, text_chars=5000).first()
    assert len(few.download_links) == 10 and len(few.page_text) == 5000
    assert web.extract_links(df).count() == 300 and web.extract_links_browser(df).count() == 300
    assert web.extract_links_browser(df, anchors=200).count() == 200


def test_character_references(spark):
    import html

    texts = ["&copy;&middot;&nbsp;x&ndash;", "&#8217;&#x1F600;&#150;&#x80;", "&amp;lt; & &&amp;", "and&amp", "&notit; &copyright &#39 &#x41g", "&nosuch; &#0; &#xD800; &#9999999;", "plain", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(h.unescape(F.col("t"))).collect()]
    want = [None if t is None else html.unescape(t) for t in texts]
    want[4] = "&notit; ©right ' Ag"  # an unknown name that ends in a semicolon stays whole
    assert got == want


def test_a_page_of_many_anchors(spark):
    import time

    n = 20_000
    html = "<html><body>" + "".join(f'<a href="/data/{i % 15_000}.csv">file {i}</a>' for i in range(n)) + "</body></html>"
    df = spark.createDataFrame([("https://x.org/", html)], "url string, html string")
    start = time.time()
    got = web.extract_links_browser(df).orderBy("position").collect()
    assert time.time() - start < 60
    assert [(r["href"], r["text"]) for r in got] == [(f"/data/{i}.csv", f"file {i}") for i in range(15_000)]
