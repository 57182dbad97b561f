"""Tables of URLs, search results and pages. All but ``parse_pages`` are projections and also run on streams."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed
from millrace.functions import html as h
from millrace.functions import urls as u
from millrace.functions.cells import strip

# --- URLs and search results ---


def classify_urls(df: DataFrame, url_col: str = "url", exact_domain: bool = False) -> DataFrame:
    """Add ``reason`` and ``is_dataset_url``."""
    reasoned = df.withColumn("reason", u.dataset_url_reason(F.col(url_col), exact_domain))
    return reasoned.withColumn("is_dataset_url", u.is_kept(F.col("reason")))


def filter_urls(df: DataFrame, url_col: str = "url", exact_domain: bool = False) -> DataFrame:
    return df.filter(u.is_kept(u.dataset_url_reason(F.col(url_col), exact_domain)))


def filter_urls_stats(df: DataFrame, url_col: str = "url", exact_domain: bool = False) -> DataFrame:
    """Total, kept and removed URLs; one scan."""
    kept = F.count_if(F.col("is_dataset_url"))
    return classify_urls(df, url_col, exact_domain).agg(
        F.count("*").alias("total"), kept.alias("kept"), (F.count("*") - kept).alias("removed")
    )


def flatten_search_results(df: DataFrame, json_col: str) -> DataFrame:
    """One row per entry of a response's ``organic_results``; missing fields are empty."""
    schema = "struct<organic_results:array<struct<link:string,title:string,snippet:string>>>"
    keep = [c for c in df.columns if c != json_col]
    rows = df.withColumn("_r", F.from_json(json_col, schema)["organic_results"]).select(*keep, F.posexplode("_r"))
    return rows.select(
        *keep,
        "pos",
        *[F.coalesce(F.col(f"col.{f}"), F.lit("")).alias(f) for f in ("link", "title", "snippet")],
        F.lit("google").alias("source"),
    )


def filter_search_results(df: DataFrame, link: str = "link", title: str = "title", snippet: str = "snippet") -> DataFrame:
    """Results with a link to a dataset page: url, title, snippet, with defaults for the missing."""
    kept = df.filter(F.coalesce(F.col(link), F.lit("")) != "").filter(u.is_kept(u.dataset_url_reason(F.col(link))))
    rest = [c for c in df.columns if c not in (link, title, snippet)]
    return kept.select(
        *rest,
        F.col(link).alias("url"),
        F.coalesce(F.col(title), F.lit("Unknown Dataset")).alias("title"),
        F.coalesce(F.col(snippet), F.lit("")).alias("snippet"),
    )


# --- pages ---


def extract_pages(
    df: DataFrame, html_col: str = "html", marks: list[str] = fixed.PAGE_LINK_MARKS, per_page: int | None = None,
    text_chars: int | None = None,
) -> DataFrame:
    """Add ``title``, ``download_links`` and ``page_text``, whole or the first ``per_page`` links and ``text_chars`` characters."""
    html = F.col(html_col)
    return df.withColumns(
        {
            "title": h.title(html),
            "download_links": h.marked_links(h.links(html), marks, per_page),
            "page_text": h.visible_text(html, text_chars),
        }
    )


def _rows_of(df: DataFrame, found: Column) -> DataFrame:
    keep = [c for c in df.columns if c != "html"]
    exploded = df.withColumn("_links", found).select(*keep, F.posexplode("_links").alias("position", "_link"))
    return exploded.select(*keep, "position", "_link.href", "_link.text")


def extract_links(
    df: DataFrame, marks: list[str] = fixed.PAGE_LINK_MARKS, per_page: int | None = None
) -> DataFrame:
    """One row per link whose href contains a mark, in page order: all, or the first ``per_page`` of each page."""
    return _rows_of(df, h.marked_links(h.links(F.col("html")), marks, per_page))


def extract_links_browser(
    df: DataFrame, marks: list[str] = fixed.BROWSER_LINK_MARKS, anchors: int | None = None
) -> DataFrame:
    """Among all or the first ``anchors`` anchors of a page: distinct hrefs (first one's text) that contain a mark.

    Links into a code repository's file view are rewritten to the raw file.
    """
    found = h.links(F.col("html"))
    found = found if anchors is None else F.slice(found, 1, anchors)
    kept = h.marked_links(_first_of_each(F.filter(found, lambda l: l["href"] != "")), marks)
    rewritten = F.transform(
        kept, lambda l: F.struct(rewrite_blob(F.col("url"), l["href"]).alias("href"), l["text"].alias("text"))
    )
    return _rows_of(df, rewritten)


def _first_of_each(links: Column) -> Column:
    """The first link of each href, in order: sorted by href and place, those that differ from the one before are kept and put back."""
    placed = F.transform(links, lambda l, i: F.struct(l["href"].alias("href"), i.alias("at"), l["text"].alias("text")))

    def firsts(in_order: Column) -> Column:
        kept = F.filter(in_order, lambda l, i: (i == 0) | (F.get(in_order, i - 1)["href"] != l["href"]))
        back = F.array_sort(F.transform(kept, lambda l: F.struct(l["at"].alias("at"), l["href"].alias("href"), l["text"].alias("text"))))
        return F.transform(back, lambda l: F.struct(l["href"].alias("href"), l["text"].alias("text")))

    # A one-element array makes the sorted links a variable, which is not worked out again for every link.
    return F.get(F.transform(F.array(F.array_sort(placed)), firsts), F.lit(0))


def rewrite_blob(page_url: Column, href: Column) -> Column:
    hosted = page_url.contains("github.com") | href.contains("github.com")
    return F.when(hosted, F.replace(href, F.lit("/blob/"), F.lit("/raw/"))).otherwise(href)


def rewrite_blob_links(df: DataFrame, href_col: str = "href", url_col: str = "url") -> DataFrame:
    return df.withColumn(href_col, rewrite_blob(F.col(url_col), F.col(href_col)))


def valid_pages(df: DataFrame, html_col: str = "html") -> DataFrame:
    html = F.col(html_col)
    return df.filter(h.is_valid_page(html, h.title(html)))


def page_fallback(df: DataFrame, first: str, second: str, out: str = "html") -> DataFrame:
    """The first of two fetched versions of a page if valid, else the second if valid, else null."""
    a, b = F.col(first), F.col(second)
    best = F.when(h.is_valid_page(a, h.title(a)), a).when(h.is_valid_page(b, h.title(b)), b)
    return df.withColumn(out, best)


def page_metadata(df: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Add dataset name, description, size, format, data link, licence and tags found by simple patterns.

    The licence words are matched with case and stay ``unknown`` otherwise; the name is the title before the first
    "-", else the last part of the URL.
    """
    staged = df.withColumn("_title", h.title(F.col(html_col)))
    size = F.regexp_extract(F.col(html_col), "(?i)" + fixed.FILE_SIZE_PATTERN, 1)
    unit = F.upper(F.regexp_extract(F.col(html_col), "(?i)" + fixed.FILE_SIZE_PATTERN, 2))
    value = size.try_cast("double")
    low_html, low_url = F.lower(html_col), F.lower(url_col)

    def first_of(words, hit, value_of):
        result = F.lit("unknown")
        for w in reversed(words):
            result = F.when(hit(w), F.lit(value_of(w))).otherwise(result)
        return result

    data_links = F.filter(h.links(F.col(html_col)), lambda l: l["href"].rlike(fixed.DATA_LINK_PATTERN))
    name = F.when(F.col("_title") != "", strip(F.split("_title", "-", 2)[0])).otherwise(
        F.element_at(F.split(url_col, "/", -1), -1)
    )
    return staged.withColumns(
        {
            "dataset_name": name,
            "description": F.concat(F.lit("Dataset from "), F.col(url_col)),
            "file_size_mb": F.when(unit == "KB", value / 1024)
            .when(unit == "GB", value * 1024)
            .otherwise(F.coalesce(value, F.lit(0.0))),
            "file_format": first_of(
                fixed.METADATA_FORMATS, lambda w: low_url.contains(w) | low_html.contains(w), lambda w: w[1:]
            ),
            "download_url": F.coalesce(F.get(data_links, F.lit(0))["href"], F.lit("")),
            "license": first_of(fixed.METADATA_LICENSES, lambda w: F.col(html_col).contains(w), lambda w: w),
            "tags": F.array().cast("array<string>"),
        }
    ).drop("_title")


def rank_links(df: DataFrame, k: int = fixed.LINK_TOP, links_col: str = "links", url_col: str = "url") -> DataFrame:
    """The best ``k`` links per page: by file suffix priority, then page order; root-relative ones made absolute."""

    def rank(l):
        result = F.lit(len(fixed.LINK_PRIORITY))
        for i, suffix in reversed(list(enumerate(fixed.LINK_PRIORITY))):
            result = F.when(F.lower(l["href"]).endswith(suffix), i).otherwise(result)
        return result

    rest = len(fixed.LINK_PRIORITY)
    # a repeated link counts once among those without a known suffix
    listed = F.filter(links_col, lambda l, i: (rank(l) < rest) | (F.array_position(links_col, l) == i + 1))
    keyed = F.transform(listed, lambda l, i: F.struct(rank(l).alias("rank"), i.alias("position"), l["href"].alias("href")))
    best = F.slice(F.array_sort(keyed), 1, k)
    rows = df.withColumn("_best", best).select(
        *[c for c in df.columns if c != links_col], F.posexplode("_best").alias("choice", "_link")
    )
    base = F.concat(u.scheme(F.col(url_col)), F.lit("://"), u.host(F.col(url_col)))
    target = F.when(F.col("_link.href").startswith("/"), F.concat(base, F.col("_link.href"))).otherwise(F.col("_link.href"))
    return rows.withColumn("download_url", target).drop("_link")


# --- any markup: the standard library's parser, batch-wise ---


class _PageReader(HTMLParser):
    """Collects title, anchors and visible text of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.titles: list[str] = []
        self.pieces: list[str] = []
        self.links: list[dict] = []
        self.hidden = 0
        self.in_title = False
        self.anchor: dict | None = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template"):
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
            self.titles.append("")
        elif tag == "a":
            href = dict(attrs).get("href")
            self.anchor = {"href": href or "", "text": ""} if href is not None else None
            if self.anchor:
                self.links.append(self.anchor)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template"):
            self.hidden = max(self.hidden - 1, 0)
        elif tag == "title":
            self.in_title = False
        elif tag == "a":
            self.anchor = None

    def handle_data(self, data):
        if self.hidden:
            return
        if self.in_title:
            self.titles[-1] += data
        if data.strip():
            self.pieces.append(data.strip())
            if self.anchor:
                self.anchor["text"] += data.strip()


def parse_pages(df: DataFrame, html_col: str = "html", marks: list[str] = fixed.PAGE_LINK_MARKS) -> DataFrame:
    """As ``extract_pages`` for markup the patterns do not cover (unquoted attributes, any entity)."""

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            rows = []
            for page in pages:
                reader = _PageReader()
                reader.feed(page or "")
                reader.close()
                kept = [l for l in reader.links if any(m in l["href"].lower() for m in marks)]
                rows.append(
                    {
                        "title": reader.titles[0] if reader.titles else "",
                        "download_links": kept,
                        "page_text": " ".join(reader.pieces),
                    }
                )
            yield pd.DataFrame(rows, columns=["title", "download_links", "page_text"])

    fields = "title string, download_links array<struct<href:string,text:string>>, page_text string"
    parsed = F.pandas_udf(read, fields)
    return df.withColumn("_page", parsed(F.col(html_col))).select(*df.columns, "_page.*")


