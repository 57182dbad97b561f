import re

import pytest

from millrace.llm.html_text import extract_main_text, main_text
from millrace.llm.queries import op10_html_extraction

LINKS = "<ul>" + "".join(f"<li><a href=x{i}>another page {i}</a></li>" for i in range(12)) + "</ul>"


def paragraph(i, size=200):
    return (f"word{i} sentence with some text " * 30)[:size].strip()


def paragraphs(numbers):
    texts = [paragraph(i) for i in numbers]
    return "".join(f"<p>{t}</p>" for t in texts), "\n\n".join(texts)


FIRST, FIRST_TEXT = paragraphs(range(5))
SECOND, SECOND_TEXT = paragraphs(range(5, 9))


def test_a_form_around_the_page_is_no_form():
    page = f"<body><form id=aspnetForm><input type=hidden value=x>{LINKS}<div id=content><h1>T</h1>{FIRST}</div><footer>c</footer></form></body>"
    assert main_text(page) == f"T\n\n{FIRST_TEXT}"
    sign_up = f"<form><label>Your name, so that we can write to you about all that is new here</label><p>{paragraph(90)}</p></form>"
    assert main_text(f"<body><div>{FIRST}</div>{sign_up}</body>") == FIRST_TEXT
    assert main_text(f"<form><article>{FIRST}</article></form>") == FIRST_TEXT


def test_more_than_one_article_or_main():
    assert main_text(f"<body>{LINKS}<article>{FIRST}</article><article>{SECOND}</article>{LINKS}</body>") == f"{FIRST_TEXT}\n\n{SECOND_TEXT}"
    assert main_text(f"<body>{LINKS}<main>{FIRST}</main><section>{SECOND}</section></body>") == f"{FIRST_TEXT}\n\n{SECOND_TEXT}"


@pytest.mark.parametrize("name", "search-results login-guide social-history promo-code skip-lists modal-logic related-work".split())
def test_part_of_a_name_drops_no_running_text(name):
    assert main_text(f"<body>{LINKS}<div class={name}>{FIRST}</div><footer>c</footer></body>") == FIRST_TEXT
    assert main_text(f"<body>{LINKS}<div id=c>{FIRST}<div class={name}>{SECOND}</div></div></body>") == f"{FIRST_TEXT}\n\n{SECOND_TEXT}"
    assert main_text(f"<body><div id=c>{FIRST}</div><div class={name}>{LINKS}<p>short</p></div></body>") == FIRST_TEXT


@pytest.mark.parametrize("name", "overlay widget reply".split())
def test_names_drop_no_whole_page(name):
    assert main_text(f"<body>{LINKS}<div class={name}>{FIRST}</div><footer>c</footer></body>") == FIRST_TEXT


@pytest.mark.parametrize("name", "cookie-banner site-footer newsletter-signup comment-list commentBody related-posts ad-slot sidebar".split())
def test_names_drop_long_notices(name):
    notice = f"<div class={name}><p>{paragraph(77, 400)}</p></div>"
    assert main_text(f"<body>{LINKS}<div id=c>{FIRST}</div>{notice}</body>") == FIRST_TEXT
    assert main_text(f"<body>{LINKS}<article>{FIRST}</article>{notice}</body>") == FIRST_TEXT
    assert main_text(f"<body>{LINKS}<article><p>Short.</p></article>{notice}</body>") == "Short."


def test_comments_longer_than_the_article_go():
    comments = f"<div class=comments>{FIRST}{SECOND}</div>"
    assert main_text(f"<body>{LINKS}<div id=c><p>{paragraph(50, 700)}</p></div>{comments}</body>") == paragraph(50, 700)


def test_articles_are_found_without_their_tags(spark, sf):
    """Characters found and asked for on the given pages, the article element being the truth and taken out of the page."""
    found = wanted = both = 0
    for row in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect():
        whole = main_text(row["html"])
        article = re.search(r"<article[^>]*>(.*)</article>", row["html"] or "", re.S)
        if not article:
            continue
        bare = set(main_text(re.sub(r"</?(?:article|main)[^>]*>", "", row["html"])).split("\n\n"))
        truth = set(whole.split("\n\n"))
        found += sum(map(len, bare))
        wanted += sum(map(len, truth))
        both += sum(map(len, bare & truth))
    assert wanted and both / found >= 0.98 and both / wanted >= 0.98


def test_the_query_reads_every_page(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = {(r["page_id"], r["url"]): r for r in op10_html_extraction(spark, sf).collect()}
    for p in pages.collect():
        text = main_text(p["html"])
        assert rows[p["page_id"], p["url"]]["text"] == text and rows[p["page_id"], p["url"]]["n_chars"] == len(text)


def test_tables_of_any_shape(spark):
    long = "<article>" + "".join(f"<p>{paragraph(i)}</p>" for i in range(5000)) + "</article>"
    rows = [(1, "a", 7, long), (1, "a", 7, long), (2, "b", None, None), (None, "c", 1, ""), (3, "d", 1, "<p>a<p>a")]
    df = spark.createDataFrame(rows, "page_id long, Text string, `n.chars` int, html string")
    out = extract_main_text(df, into="text")
    assert out.columns == ["page_id", "n.chars", "html", "text"]
    got = sorted((r["page_id"] or 0, r["text"]) for r in out.collect())
    want = "\n\n".join(paragraph(i) for i in range(5000))
    assert got == [(0, ""), (1, want), (1, want), (2, ""), (3, "a\n\na")]
    assert extract_main_text(df.limit(0)).collect() == []
