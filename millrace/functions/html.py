"""Titles, links and text of HTML pages by regular expression: array and string functions, no shuffle, no Python.

Attributes may be quoted or not and hold any sign when quoted, and all character references are decoded.
``millrace.operators.web.parse_pages`` uses a real parser for markup beyond that.
"""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed_values as fixed
from millrace.functions.cells import any_of, strip

# the rest of an opening tag, up to its end or, if lazy, an attribute: quotes only count after an equals sign
_ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+"""
_BEFORE = r"""(?:\s[^\s>"'=/]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']*+))?|/)*?"""
TITLE = rf"(?is)<title\b{_ATTRIBUTES}>(.*?)</title\s*>"
HIDDEN = rf"(?is)<(script|style|template)\b{_ATTRIBUTES}>.*?</(script|style|template)\s*>"
COMMENT = r"(?s)<!--.*?-->|<![^>]*>"
TAG = rf"(?s)</?[A-Za-z]{_ATTRIBUTES}>"
_VALUE = r"""("[^"]*"|'[^']*'|[^\s>"']+)"""
HREF = rf"(?is)<a{_BEFORE}\s+href\s*=\s*{_VALUE}"
# an anchor ends at its closing tag, at the next anchor, or with the page
ANCHOR = HREF + r".*?(?=</a|<a\s|\z)"

# names that browsers also decode without a semicolon, longer ones first
_BARE = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name)))
REFERENCE = rf"&(?:(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}});?|[A-Za-z][A-Za-z0-9]*;|(?:{_BARE}))"


@cache
def _references() -> str:
    """What named references stand for, and numbers 128 to 159, which mean Windows characters; as JSON."""
    windows = {f"#{n};": bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
    return json.dumps(html5 | windows)


def unescape(text: Column) -> Column:
    """All character references, decoded once; unknown names stay, numbers of no character are U+FFFD."""
    known = F.from_json(F.lit(_references()), "map<string,string>")

    def decoded(piece: Column) -> Column:
        name = F.substring(piece, F.lit(2), F.length(piece) - 1)
        digits = F.regexp_extract(name, "^#([0-9]+)", 1)
        hexed = F.lower(F.regexp_extract(name, "^#[xX]([0-9a-fA-F]+)", 1))
        code = F.when(digits != "", digits.cast("long")).when(hexed != "", F.conv(hexed, 16, 10).cast("long"))
        none = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        number = F.when(none, "\ufffd").otherwise(char)
        windows = F.concat(F.lit("#"), code.cast("string"), F.lit(";"))
        value = F.when(code.isNull(), F.try_element_at(known, name)).otherwise(F.coalesce(F.try_element_at(known, windows), number))
        return F.when(piece.rlike(f"^{REFERENCE}"), F.coalesce(value, piece)).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s){REFERENCE}|&|[^&]+"), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def title(html: Column) -> Column:
    """Text of the first title element, empty if there is none."""
    return unescape(F.regexp_extract(html, TITLE, 1))


def without_hidden(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), COMMENT, "")


def _href(anchor: Column) -> Column:
    value = F.regexp_extract(anchor, HREF, 1)
    return unescape(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2"))


def links(html: Column) -> Column:
    """(href, text) of all anchors outside scripts and comments, in page order."""
    anchors = F.regexp_extract_all(without_hidden(html), F.lit(ANCHOR), F.lit(0))
    return F.transform(anchors, lambda a: F.struct(_href(a).alias("href"), joined_text(a, "").alias("text")))


def marked_links(found: Column, marks: list[str], limit: int | None = None) -> Column:
    """Links whose href contains one of the marks, at most ``limit`` per page."""
    kept = F.filter(found, lambda l: any_of([F.lower(l["href"]).contains(m) for m in marks]))
    return kept if limit is None else F.slice(kept, 1, limit)


def joined_text(html: Column, separator: str) -> Column:
    """Text between tags: each piece stripped, empty ones left out, joined."""
    pieces = F.transform(F.split(html, TAG, -1), lambda p: strip(unescape(p)))
    return F.array_join(F.filter(pieces, lambda p: p != ""), separator)


def visible_text(html: Column, limit: int | None = None, drop_script: bool = True) -> Column:
    """Page text joined by blanks, or its first ``limit`` characters."""
    source = without_hidden(html) if drop_script else F.regexp_replace(html, COMMENT, "")
    text = joined_text(source, " ")
    return text if limit is None else F.substring(text, 1, limit)


def is_valid_page(html: Column, page_title: Column) -> Column:
    """Long enough, and with a title that is no error message."""
    good = (F.length(html) >= fixed.VALID_PAGE_CHARS) & (page_title != "")
    return F.coalesce(good & ~F.lower(page_title).isin(fixed.BAD_TITLES), F.lit(False))


