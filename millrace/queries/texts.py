"""Queries on URLs, texts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed
from millrace.functions import html as h
from millrace.functions import licenses as lic
from millrace.functions.cells import SPACE
from millrace.operators import licenses as ol
from millrace.operators import web
from millrace.queries.registry import query, table

# --- URLs ---

# page URLs, and the same with parts of documents' sources appended, so that every rule has cases
_URLS = """
select page_id, kind, case kind when 0 then url when 1 then url || '/dataset/' || page_id
  when 2 then 'https://www.github.com/' || page_id || '/news' when 3 then url || '/blog/data' when 4 then
  regexp_replace(url, '[?#].*$', '') || '/f' || page_id || '.CSV' when 5 then 'https://notkaggle.com/' || page_id
  else replace(url, 'http', 'ftp') || '/reports;v=1' end as url
from pages, (select unnest(range(7)) as kind)"""
_LOW = "lower(url)"
_DOMAIN = f"replace(regexp_extract({_LOW}, '^([a-z][a-z0-9+.-]*:)?//([^/?#]*)', 2), 'www.', '')"
_PATH = f"regexp_replace(regexp_extract({_LOW}, '^([a-z][a-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)', 3), ';[^/]*$', '')"
_REASON = (
    "case when "
    + " or ".join(f"contains({_DOMAIN}, '{d}')" for d in fixed.TRUSTED_DOMAINS)
    + " then 'trusted_domain' when "
    + " or ".join(f"ends_with({_PATH}, '{s}')" for s in fixed.DATASET_SUFFIXES)
    + f" then 'file_suffix' when regexp_matches({_LOW}, '" + "|".join(fixed.JUNK_PATTERNS) + "') then 'junk' when "
    + " or ".join(f"contains({_PATH}, '{k}')" for k in fixed.PATH_KEYWORDS)
    + " then 'path_keyword' else 'no_signal' end"
)
_KEPT = "reason in ('trusted_domain', 'file_suffix', 'path_keyword')"
_CLASSED = f"with u as ({_URLS}), k as (select *, {_REASON} as reason from u) "


def _urls(spark, sf):
    pages = table(spark, sf, "pages")
    url, page = F.col("url"), F.col("page_id").cast("string")
    variants = [
        url,
        F.concat(url, F.lit("/dataset/"), page),
        F.concat(F.lit("https://www.github.com/"), page, F.lit("/news")),
        F.concat(url, F.lit("/blog/data")),
        F.concat(F.regexp_replace(url, "[?#].*$", ""), F.lit("/f"), page, F.lit(".CSV")),
        F.concat(F.lit("https://notkaggle.com/"), page),
        F.concat(F.replace(url, F.lit("http"), F.lit("ftp")), F.lit("/reports;v=1")),
    ]
    return pages.select("page_id", F.posexplode(F.array(*variants)).alias("kind", "url"))


@query("classify_urls", _CLASSED + f"select page_id, kind::int as kind, url, reason, {_KEPT} as is_dataset_url from k")
def _(spark, sf):
    return web.classify_urls(_urls(spark, sf))


@query("filter_urls", _CLASSED + f"select page_id, kind::int as kind, url from k where {_KEPT}")
def _(spark, sf):
    return web.filter_urls(_urls(spark, sf))


@query(
    "filter_urls_stats",
    _CLASSED + f"select count(*) as total, count(*) filter (where {_KEPT}) as kept, count(*) filter (where not {_KEPT})"
    " as removed from k",
)
def _(spark, sf):
    return web.filter_urls_stats(_urls(spark, sf))


@query(
    "search_results_from_json",
    "select page_id, 0::int as pos, url as link, 'page ' || page_id as title, '' as snippet, 'google' as source from pages"
    " union all select page_id, 1, '', '', html, 'google' from pages",
)
def _(spark, sf):
    hits = F.array(
        F.struct(F.col("url").alias("link"), F.concat(F.lit("page "), F.col("page_id")).alias("title"),
                 F.lit(None).cast("string").alias("snippet")),
        F.struct(F.lit(None).cast("string").alias("link"), F.lit(None).cast("string").alias("title"),
                 F.col("html").alias("snippet")),
    )
    answers = table(spark, sf, "pages").select(
        "page_id", F.to_json(F.struct(F.lit(1).alias("took"), hits.alias("organic_results"))).alias("answer")
    )
    return web.flatten_search_results(answers, "answer")


@query(
    "filter_search_results",
    _CLASSED + ", r as (select page_id, case when kind = 6 and page_id % 2 = 0 then null else url end as url, reason,"
    " case when kind % 2 = 0 then 'page ' || page_id end as title, case when kind = 4 then 'file' end as snippet from k)"
    f" select page_id, url, coalesce(title, 'Unknown Dataset') as title, coalesce(snippet, '') as snippet from r"
    f" where url is not null and {_KEPT}",
)
def _(spark, sf):
    found = _urls(spark, sf).select(
        "page_id",
        F.when(~((F.col("kind") == 6) & (F.col("page_id") % 2 == 0)), F.col("url")).alias("link"),
        F.when(F.col("kind") % 2 == 0, F.concat(F.lit("page "), F.col("page_id"))).alias("title"),
        F.when(F.col("kind") == 4, "file").alias("snippet"),
    )
    return web.filter_search_results(found)


# --- licences ---


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BLANKED = "translate(text, '-_', '  ')"
_PATTERN = "case " + " ".join(
    f"when regexp_matches({_BLANKED}, {_quoted('(?i)' + '|'.join(p.replace(chr(92) + 's', SPACE) for p in ps))}) then '{i}'"
    for i, ps, _, _ in fixed.LICENSES
) + " end"
_KEYWORD = "case " + " ".join(
    "when " + " or ".join(f"contains(lower(text), '{k}')" for k in ks) + f" then '{i}'" for i, _, ks, _ in fixed.LICENSES
) + " end"
_MENTION = r"regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])license([^\p{L}\p{N}_]|\z)')"


def _detected(source: str) -> str:
    return (
        f"select *, coalesce(p, k, 'UNKNOWN') as license_type, (case when coalesce(text, '') = '' then 0.1 when p is not null"
        f" then 0.9 when k is not null then 0.6 when {_MENTION} then 0.3 else 0.1 end)::double as confidence,"
        " coalesce(coalesce(p, k) <> 'CC-BY-NC-4.0', false) as allows_commercial, case when coalesce(text, '') = ''"
        " then 'empty_input' when p is not null then 'pattern_match' when k is not null then 'keyword_match' when"
        f" {_MENTION} then 'generic_mention' else 'not_found' end as source from (select *, {_PATTERN} as p,"
        f" {_KEYWORD} as k from ({source}))"
    )


@query("license_pattern", f"select doc_id, {_PATTERN} as license_type from documents")
def _(spark, sf):
    return ol.license_by_pattern(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


@query("license_keyword", f"select doc_id, {_KEYWORD} as license_type from documents")
def _(spark, sf):
    return ol.license_by_keyword(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


@query(
    "license_detect",
    f"select doc_id, license_type, confidence, allows_commercial, source from ({_detected('select doc_id, text from documents')})",
)
def _(spark, sf):
    return ol.detect_license(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


@query(
    "license_summary",
    f"select license_type, source, count(*) as texts from ({_detected('select doc_id, text from documents')}) group by 1, 2",
)
def _(spark, sf):
    return ol.license_summary(ol.detect_license(table(spark, sf, "documents").select("doc_id", "text"), "text"))


_JSON_TEXT = (
    "select doc_id, form, case form when 0 then 'CC0' when 1 then text when 2 then 'Open Database License ' || source"
    " else 'no licence ' || lang end as text from documents, (select unnest(range(4)) as form)"
)


@query("license_from_json", f"select doc_id, form::int as form, license_type, confidence, source from ({_detected(_JSON_TEXT)})")
def _(spark, sf):
    forms = [
        F.to_json(F.struct(F.lit("x").alias("id"), F.lit("CC0").alias("license"), F.col("text"))),
        F.to_json(F.struct(F.col("text").alias("license_name"), F.lit("MIT").alias("licence"))),
        F.to_json(F.array(F.lit("Open Database License"), F.col("source"))),
        F.concat(F.lit("no licence "), F.col("lang")),
    ]
    texts = table(spark, sf, "documents").select("doc_id", F.posexplode(F.array(*forms)).alias("form", "json"))
    return ol.detect_license_json(texts, "json").select("doc_id", "form", "license_type", "confidence", "source")


_ML = "case doc_id % 4 when 0 then 'MIT' when 1 then 'UNKNOWN' when 2 then 'CC-BY-NC-4.0' else 'unknown' end"


@query(
    "license_ml_friendly",
    f"select doc_id, {_ML} <> 'UNKNOWN' as friendly, {_ML} = 'MIT' as strictly from documents",
)
def _(spark, sf):
    which = F.col("doc_id") % 4
    kind = F.when(which == 0, "MIT").when(which == 1, "UNKNOWN").when(which == 2, "CC-BY-NC-4.0").otherwise("unknown")
    return table(spark, sf, "documents").select(
        "doc_id", lic.ml_friendly(kind).alias("friendly"), lic.ml_friendly(kind, strict=True).alias("strictly")
    )


# --- pages ---


def _unescaped(x: str) -> str:
    """The references that the pages hold, "&amp;" last so that nothing is decoded twice."""
    for reference, code in (
        ("&lt;", 60), ("&gt;", 62), ("&quot;", 34), ("&#39;", 39), ("&apos;", 39), ("&nbsp;", 160), ("&copy;", 169),
        ("&middot;", 183), ("&ndash;", 8211), ("&#8217;", 8217), ("&amp;", 38), ("&amp", 38),
    ):
        x = f"replace({x}, '{reference.replace(chr(39), chr(39) * 2)}', chr({code}))"
    return x


_TITLE = _unescaped(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)")
_HIDDEN = r"(?is)<(script|style|template)\b[^>]*>.*?</(script|style|template)\s*>"
_VISIBLE = f"regexp_replace(regexp_replace(html, '{_HIDDEN}', '', 'g'), '(?s)<!--.*?-->|<![^>]*>', '', 'g')"
_HREFS = (
    f"list_transform(regexp_extract_all({_VISIBLE}, '(?is)<a\\s[^>]*?\\bhref\\s*=\\s*\"([^\"]*)\"', 1), lambda x: "
    + _unescaped("x") + ")"
)
_ANCHORS = (
    f"list_transform(regexp_extract_all({_VISIBLE}, '(?is)<a\\s[^>]*?\\bhref\\s*=\\s*\"[^\"]*\"[^>]*>(.*?)</a\\s*>', 1), lambda x: "
    + _unescaped("x") + ")"
)
MARKS = ["a", "t", ".csv"]  # page links here have no file suffixes, so short marks stand in for them


def _marked(x: str, marks) -> str:
    return "(" + " or ".join(f"contains(lower({x}), '{m}')" for m in marks) + ")"


@query("page_title", f"select page_id, {_TITLE} as title from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", h.title(F.col("html")).alias("title"))


_LINK_ROWS = (
    f"l as (select page_id, url, unnest({_HREFS}) as href, unnest({_ANCHORS}) as txt, unnest(range(len({_HREFS}))) as n from pages)"
)


@query(
    "page_links",
    f"with {_LINK_ROWS}, k as (select *, row_number() over (partition by page_id order by n) - 1 as position from l"
    f" where {_marked('href', MARKS)}) select page_id, position::int as position, href, txt as text from k",
)
def _(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    return web.extract_links(pages, MARKS)


@query(
    "page_links_browser",
    f"with {_LINK_ROWS}, d as (select * from l where href <> '' qualify row_number() over"
    f" (partition by page_id, href order by n) = 1) select page_id, url, (row_number() over (partition by page_id order by n) - 1)::int"
    f" as position, href, txt as text from d where {_marked('href', MARKS)}",
)
def _(spark, sf):
    return web.extract_links_browser(table(spark, sf, "pages").select("page_id", "url", "html"), MARKS)


@query(
    "rewrite_blob_links",
    f"with {_LINK_ROWS}, g as (select page_id, n, case when page_id % 2 = 0 then url else 'https://github.com/x' end as url,"
    " '/x/blob' || href as href from l) select page_id, n::int as position, url,"
    " case when contains(url, 'github.com') then replace(href, '/blob/', '/raw/') else href end as href from g",
)
def _(spark, sf):
    pages = table(spark, sf, "pages")
    links = pages.select("page_id", "url", F.posexplode(h.links(F.col("html"))).alias("position", "l")).select(
        "page_id", "position",
        F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("https://github.com/x").alias("url"),
        F.concat(F.lit("/x/blob"), F.col("l.href")).alias("href"),
    )
    return web.rewrite_blob_links(links)


_PIECES = (
    f"list_transform(string_split_regex({_VISIBLE}, '(?s)</?[A-Za-z][^>]*>'), lambda x: regexp_replace("
    + _unescaped("x") + f", '^{SPACE}+|{SPACE}+$', '', 'g'))"
)


@query("page_text", f"select page_id, array_to_string(list_filter({_PIECES}, lambda x: x <> ''), ' ') as page_text from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", h.visible_text(F.col("html")).alias("page_text"))


_VALID = f"length({{h}}) >= 100 and {_TITLE.replace('html', '{h}')} <> '' and lower({_TITLE.replace('html', '{h}')}) not in ('error', '404', 'not found')"
_BROKEN = "case page_id % 3 when 0 then substring(html, 1, 90) when 1 then regexp_replace(html, '(?is)<title>.*?</title>', '<title>Error</title>') else html end"


@query("valid_pages", f"select page_id from (select page_id, {_BROKEN} as html from pages) where {_VALID.format(h='html')}")
def _(spark, sf):
    return web.valid_pages(_broken(spark, sf).select("page_id", F.col("broken").alias("html"))).select("page_id")


def _broken(spark, sf):
    which = F.col("page_id") % 3
    bad = F.when(which == 0, F.substring("html", 1, 90)).when(
        which == 1, F.regexp_replace("html", "(?is)<title>.*?</title>", "<title>Error</title>")
    )
    return table(spark, sf, "pages").withColumn("broken", bad.otherwise(F.col("html")))


@query(
    "page_fallback",
    f"with b as (select page_id, {_BROKEN} as broken, case when page_id % 5 = 0 then '' else html end as html from pages)"
    f" select page_id, md5(case when {_VALID.format(h='broken')} then broken when {_VALID.format(h='html')} then html end) as page from b",
)
def _(spark, sf):
    pages = _broken(spark, sf).withColumn("second", F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("html")))
    return web.page_fallback(pages, "broken", "second", "best").select("page_id", F.md5("best").alias("page"))


_ENRICHED = (
    "select page_id, url, case page_id % 4 when 0 then html || '<p>About 25 KB</p><a href=\"/d/f' || page_id || '.csv\">get</a> CC-BY'"
    " when 1 then html || '<p>1.5 gb</p> GPL' when 2 then regexp_replace(html, '(?is)<title\\b[^>]*>.*?</title\\s*>', '') else html end as html from pages"
)
_SIZE = "try_cast(regexp_extract(html, '(?i)(\\d+\\.?\\d*)\\s*(MB|KB|GB)', 1) as double)"
_UNIT = "upper(regexp_extract(html, '(?i)(\\d+\\.?\\d*)\\s*(MB|KB|GB)', 2))"
_PAGE_FORMAT = "case " + " ".join(
    f"when contains(lower(url), '{x}') or contains(lower(html), '{x}') then '{x[1:]}'" for x in fixed.METADATA_FORMATS
) + " else 'unknown' end"
_PAGE_LICENSE = "case " + " ".join(f"when contains(html, '{x}') then '{x}'" for x in fixed.METADATA_LICENSES) + " else 'unknown' end"


@query(
    "page_metadata",
    f"with e as ({_ENRICHED}) select page_id, case when {_TITLE} <> '' then regexp_replace(string_split({_TITLE}, '-')[1],"
    f" '^{SPACE}+|{SPACE}+$', '', 'g') else string_split(url, '/')[-1] end as dataset_name, 'Dataset from ' || url as description,"
    f" round(case {_UNIT} when 'KB' then {_SIZE} / 1024 when 'GB' then {_SIZE} * 1024 else coalesce({_SIZE}, 0) end, 6) as file_size_mb,"
    f" {_PAGE_FORMAT} as file_format, coalesce(list_filter({_HREFS}, lambda x: regexp_matches(x, '\\.(csv|json|zip|parquet)'))[1], '')"
    f" as download_url, {_PAGE_LICENSE} as license from e",
)
def _(spark, sf):
    which, page = F.col("page_id") % 4, F.col("page_id").cast("string")
    html = (
        F.when(which == 0, F.concat("html", F.lit('<p>About 25 KB</p><a href="/d/f'), page, F.lit('.csv">get</a> CC-BY')))
        .when(which == 1, F.concat("html", F.lit("<p>1.5 gb</p> GPL")))
        .when(which == 2, F.regexp_replace("html", r"(?is)<title\b[^>]*>.*?</title\s*>", ""))
        .otherwise(F.col("html"))
    )
    pages = table(spark, sf, "pages").withColumn("html", html)
    return web.page_metadata(pages).select(
        "page_id", "dataset_name", "description", F.round("file_size_mb", 6).alias("file_size_mb"), "file_format",
        "download_url", "license",
    )


@query(
    "page_parse",
    f"with {_LINK_ROWS}, k as (select page_id, count(*) filter (where {_marked('href', MARKS)}) as links from l group by page_id)"
    f" select page_id, {_TITLE} as title, coalesce(links, 0)::int as links,"
    f" array_to_string(list_filter({_PIECES}, lambda x: x <> ''), ' ') as page_text from pages left join k using (page_id)",
)
def _(spark, sf):
    parsed = web.parse_pages(table(spark, sf, "pages"), marks=MARKS)
    return parsed.select("page_id", "title", F.size("download_links").alias("links"), "page_text")
