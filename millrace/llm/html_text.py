"""Main text of web pages by composite text density.

Every page becomes a small tree. Menus, adverts and the like are taken out by element, role and class name. A name of which
only a part says so, as in "login-guide", takes out what is short or mostly links; forms, roles and other names do not take out
what holds three quarters of the page's running text, and readers' comments go unless there is nothing beside them. For
each node left, density is characters per tag, corrected by how much of it is link text, and its sum is that of its
children's densities. The article or main element around the subtree of the largest sum, or else that subtree, and every other
that is not mostly links and whose density reaches the least one on the path from it to the body are the article, so that it may lie
in several containers. As density grows with length, it is compared as if all parts were as long as the page. Running text
lighter than that stays as well, and so do headings before, paragraphs without links beside, and text between, what stays.
"""

from __future__ import annotations

import html as entities
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import named

_ATTRS = r"""(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))?|=)*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)({_ATTRS})>", re.S
)
_ATTR = re.compile(r"""([^\s/>="']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noframes iframe noembed".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr "
    "caption ul option".split()
)
_CLOSES_P = _BLOCKS - {"tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "body", "html"}
#: A start tag ends these open elements, up to the nearest of the elements named last.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr"}, {"table"}), "tfoot": ({"tbody", "thead", "tr"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_SCOPE = {"td", "th", "table", "button", "object", "article", "section", "html"}
_DROPPED = frozenset(
    "nav aside footer script style noscript template iframe button select textarea svg math object embed canvas audio "
    "video dialog menu head title datalist input map noframes noembed".split()
)
_FORMS = frozenset("form fieldset label".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form tooltip".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adsense sponsor sponsors sponsored promo promos promotion "
    "promotions banner banners sidebar sidebars sidenav menu menus nav navbar navigation breadcrumb breadcrumbs footer footers masthead "
    "topbar cookie cookies consent gdpr notice notices popup popups modal modals overlay newsletter subscribe subscription signup share "
    "sharing social widget widgets toolbar pagination pager login search paywall disclaimer skip".split()
)
_READERS = frozenset("comment comments commentlist disqus respond reply replies related recommended recommendations".split())
_HEADER = frozenset("header headers".split())
#: Words that say where or what kind of box a name's other parts make.
_LAYOUT = frozenset(
    "site page main global top bottom left right upper lower primary secondary fixed sticky mobile desktop inner outer box bar block "
    "area section slot unit container wrapper wrap holder panel column col row item items list links link button buttons icon icons form "
    "text content body title head author message policy bubble thread tree media network bottombar articles posts post stories "
    "story topics news pages products reading reader readers user users blog entry card cards group widget module region zone".split()
)
_NOT = re.compile(r"^(?:has|with|no|without|is)[-_]", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Characters of a sentence, from which on text that is not mostly links counts as running text.
SENTENCE = 80
#: Characters, white space and links left out, from which on an element can be more than a notice.
RUNNING = 160
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: Kinds of elements: a part of a name says drop, a whole name, role or form does, readers' comments, never the article.
KEPT, HINTED, NAMED, COMMENTS, NEVER = range(5)


def _name_kind(name: str, inside: bool) -> int:
    """What one class name or id says; ``inside``: below an article or main element, where headers stay."""
    if _NOT.search(name):
        return KEPT
    parts = [x for x in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if x and not x.isdigit()]
    parts = [x.lower() for x in parts]
    words = _NAMES if inside else _NAMES | _HEADER
    readers = any(x in _READERS for x in parts)
    if not readers and not any(x in words for x in parts):
        return KEPT
    if any(x not in words and x not in _READERS and x not in _LAYOUT for x in parts):
        return HINTED
    return COMMENTS if readers else NAMED


def _marks(attrs: str, inside: bool) -> int:
    kind = KEPT
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            kind = max([kind, *(_name_kind(name, inside) for name in value.split())])
        elif key == "role" and value.lower() in _ROLES:
            kind = max(kind, NAMED)
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return NEVER
    return kind


class _Page:
    """Nodes in page order, so that a subtree is a range of numbers, and the text and breaks between them."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.last, self.drop = ["#root"], [0], [0], [0]
        self.events: list[tuple[int, str | None]] = []
        stack, inside, open_tags, at, n = [0], [False], {"#root": 1}, 0, len(source)

        def close(depth: int) -> None:
            while len(stack) > depth:
                node = stack.pop()
                inside.pop()
                self.last[node] = len(self.tag) - 1
                open_tags[self.tag[node]] -= 1
                if self.tag[node] in _BLOCKS:
                    self.events.append((node, None))

        def close_one(tags: set[str], until: set[str]) -> None:
            for depth in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[depth]]
                if tag in tags:
                    close(depth)
                    return
                if tag in until:
                    return

        while at < n:
            m = _TOKEN.search(source, at)
            cut = m.start() if m else n
            if cut > at:
                self.events.append((stack[-1], entities.unescape(source[at:cut])))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "br":
                    self.events.append((stack[-1], " "))
                elif open_tags.get(tag):
                    depth = len(stack) - 1
                    while self.tag[stack[depth]] != tag:
                        depth -= 1
                    close(depth)
                continue
            if tag == "br":
                self.events.append((stack[-1], " "))
                continue
            if tag in _CLOSES_P and open_tags.get("p"):
                close_one({"p"}, _SCOPE)
            if tag in _IMPLIED:
                close_one(*_IMPLIED[tag])
            node = len(self.tag)
            within = inside[-1] or tag in ("article", "main")
            drop = NEVER if tag in _DROPPED or tag == "header" and not inside[-1] else _marks(m[3], within) if m[3] else KEPT
            if tag in _FORMS:
                drop = max(drop, NAMED)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.last.append(node)
            self.drop.append(0 if tag in ("body", "html") else drop)
            if tag in _BLOCKS:
                self.events.append((node, None))
            elif tag in ("td", "th"):
                self.events.append((node, " "))
            if tag in _VOID:
                continue
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else n
                end = source.find(">", at)
                at = n if end < 0 else end + 1
                continue
            stack.append(node)
            inside.append(within)
            open_tags[tag] = open_tags.get(tag, 0) + 1
        close(0)
        self._settle()

    def _settle(self) -> None:
        """Which elements are dropped; what is below a dropped element is dropped."""
        n, drop, up = len(self.tag), self.drop, self.parent
        whole = [i for i, t in enumerate(self.tag) if t in ("article", "main") and not drop[i]]
        for i in whole:
            self._keep_around(i)
        linked = [False] * n
        for i in range(1, n):
            linked[i] = linked[up[i]] or self.tag[i] == "a"
        plain, links = [0] * n, [0] * n
        for node, text in self.events:
            size = len("".join(text.split())) if text else 0
            (links if linked[node] else plain)[node] += size
        for i in range(n - 1, 0, -1):
            if drop[i] == HINTED and plain[i] >= RUNNING and plain[i] >= links[i]:
                drop[i] = KEPT
            if drop[i] == KEPT:
                plain[up[i]] += plain[i]
                links[up[i]] += links[i]
        # What a hard drop holds counts nowhere; what is below it is no text of the page.
        shut = [False] * n
        held = dict.fromkeys((KEPT, HINTED, NAMED, COMMENTS), 0)
        held[KEPT] = plain[0]
        for i in range(1, n):
            shut[i] = shut[up[i]] or drop[i] == NEVER
            if not shut[i] and drop[i]:
                held[drop[i]] += plain[i]
        for i in range(1, n):
            if whole or shut[i] or plain[i] < RUNNING:
                continue
            named = drop[i] == NAMED and 4 * plain[i] >= 3 * (held[KEPT] + held[HINTED] + held[NAMED])
            if named or drop[i] == COMMENTS and 4 * plain[i] >= 3 * sum(held.values()):
                drop[i] = KEPT
                self._keep_around(i)
        for i in range(1, n):
            drop[i] = 1 if drop[i] or drop[up[i]] else 0

    def _keep_around(self, node: int) -> None:
        """Names do not drop what is around a kept element."""
        up = self.parent[node]
        while up and self.drop[up] < COMMENTS:
            self.drop[up] = KEPT
            up = self.parent[up]

    def chosen(self) -> list[int]:
        """For each event whether it is of the article."""
        n = len(self.tag)
        chars, tags, link_chars, links = [0] * n, [1] * n, [0] * n, [0] * n
        sizes = [len("".join(text.split())) if text and not self.drop[node] else 0 for node, text in self.events]
        for (node, _), size in zip(self.events, sizes, strict=True):
            chars[node] += size
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
            if in_link[i] and not self.drop[i]:
                link_chars[i] = chars[i]
                links[i] = int(self.tag[i] == "a")
        for i in range(n - 1, 0, -1):
            if not self.drop[i]:
                up = self.parent[i]
                chars[up] += chars[i]
                tags[up] += tags[i]
                link_chars[up] += link_chars[i]
                links[up] += links[i]
        share = link_chars[0] / max(chars[0], 1)

        def density(c: float, t: float, lc: float, ln: float) -> float:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            ratio = c / max(lc, 1) * t / max(ln, 1)
            return c / t * max(math.log(ratio), 0.0) / math.log(max(base, 2.0))

        def as_page(c: int, t: int, lc: int, ln: int) -> float:
            """The density of text of this kind that is as long as the page's."""
            times = chars[0] / c
            return density(chars[0], t * times, lc * times, ln * times)

        sums = [0.0] * n
        for i in range(n - 1, 0, -1):
            if chars[i] and not self.drop[i]:
                sums[self.parent[i]] += density(chars[i], tags[i], link_chars[i], links[i])
        best = max(range(n), key=lambda i: (chars[i] > 0 and 2 * link_chars[i] <= chars[i], sums[i], -i))
        path = [best]
        while path[-1]:
            path.append(self.parent[path[-1]])
        whole = next((i for i in reversed(path) if self.tag[i] in ("article", "main")), None)
        best = best if whole is None else whole
        if not chars[best]:
            return self._events_of({best})
        path = path[path.index(best) :]
        count = [(chars[i], tags[i], link_chars[i], links[i]) for i in range(n)]
        threshold = min(as_page(*count[i]) for i in path)
        return self._events_of(*self._grown(best, set(path), count, sizes, lambda c: 2 * c[2] <= c[0] and as_page(*c) >= threshold))

    def _grown(self, best: int, path: set[int], count: list, sizes: list[int], dense) -> tuple[set[int], set[int]]:
        """The nodes that stay as a whole and the events between them that do.

        The parts of a node are its blocks and the runs of text and inline elements between these.
        """
        n = len(self.tag)
        inline = [t not in _BLOCKS and t not in ("td", "th", "#root") for t in self.tag]
        for i in range(n - 1, 0, -1):
            if not inline[i]:
                inline[self.parent[i]] = False
        parts: list[list] = [[] for _ in range(n)]  # a block's number, or the events of a run with its counts
        runs: list[list | None] = [None] * n
        listed = [False] * n
        listed[0] = True
        counted = [False] * n
        for at, (node, text) in enumerate(self.events):
            if self.drop[node] or text is None and not inline[node] and listed[node]:
                continue
            while inline[node] and inline[self.parent[node]]:
                node = self.parent[node]
            home = self.parent[node] if inline[node] else node
            up = home
            while not listed[up]:
                listed[up] = True
                parts[self.parent[up]].append(up)
                runs[self.parent[up]] = None
                up = self.parent[up]
            if text is None:
                continue
            if runs[home] is None:
                runs[home] = [[], [0, 1, 0, 0]]
                parts[home].append(runs[home])
            run, held = runs[home]
            run.append(at)
            if not inline[node]:
                held[0] += sizes[at]
            elif not counted[node]:
                counted[node] = True
                held[:] = [a + b for a, b in zip(held, count[node], strict=True)]

        def counts(part) -> tuple:
            return count[part] if isinstance(part, int) else part[1]

        state = [0] * n  # 2: stays, 1: parts of it do
        stays: list[list[int]] = [[] for _ in range(n)]
        for i in range(n - 1, -1, -1):
            own = count[i]
            if self.drop[i] or not own[0] or inline[i] and i != best:
                continue
            if i == best or i not in path and dense(own):
                state[i] = 2
                continue
            if i not in path and 2 * own[2] > own[0]:
                continue
            found = [p for p in parts[i] if counts(p)[0]]
            kept = []
            for p in found:
                c = counts(p)
                if isinstance(p, int):
                    kept.append(state[p])
                else:
                    core = any(best <= self.events[at][0] <= self.last[best] for at in p[0])
                    kept.append(2 if core or dense(c) or c[0] >= SENTENCE and 2 * c[2] <= c[0] else 0)
            some = [k for k, x in enumerate(kept) if x]
            for k in range(some[-1] if some else 0, -1, -1):
                p, c = found[k], counts(found[k])
                between = k > (some[0] if some else n) and 2 * c[2] <= c[0] and not (isinstance(p, int) and p in path)
                before = isinstance(p, int) and (self.tag[p] in _HEADINGS or self.tag[p] == "p" and not c[2]) and any(kept[k + 1 : k + 2])
                if between or before:
                    kept[k] = 2
            for k in range(some[-1] + 1 if some else len(kept), len(kept)):
                p = found[k]
                if not isinstance(p, int) or self.tag[p] != "p" or counts(p)[2]:
                    break
                kept[k] = 2
            state[i] = 1 if any(kept) or i in path else 0
            stays[i] = list(zip(found, kept, strict=True))
        nodes, events, todo = set(), set(), [0]
        while todo:
            i = todo.pop()
            if state[i] == 2:
                nodes.add(i)
                continue
            for p, x in stays[i]:
                if isinstance(p, int):
                    if x == 2:
                        nodes.add(p)
                    elif x:
                        todo.append(p)
                elif x:
                    events.update(p[0])
        return nodes, events

    def _events_of(self, nodes: set[int], events: set[int] = frozenset()) -> list[int]:
        """Which events lie in these nodes or are these, as ones; the root holds all."""
        inside = [False] * len(self.tag)
        for i in range(len(self.tag)):
            inside[i] = i in nodes or bool(i) and inside[self.parent[i]]
        return [int(inside[node] or at in events) for at, (node, _) in enumerate(self.events)]

    def text(self) -> str:
        blocks, piece = [], []
        for (node, text), kept in zip(self.events, self.chosen(), strict=True):
            if self.drop[node]:
                continue
            if text is None:
                blocks.append(" ".join("".join(piece).split()))
                piece = []
            elif kept:
                piece.append(text)
        blocks.append(" ".join("".join(piece).split()))
        return "\n\n".join(b for b in blocks if b)


def main_text(source: str | None) -> str:
    """The article of one page: blocks joined by an empty line, empty for null and for pages without text."""
    return _Page(source).text() if source else ""


def extract_main_text(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of every page in ``into`` (replacing a column of that name).

    Null or empty html and pages without text give an empty string; whole pages of any length are read; other columns,
    repeated rows and order stay as they are. No shuffle.
    """

    @F.pandas_udf("string")
    def extract(source: pd.Series) -> pd.Series:
        return source.map(main_text, na_action=None)

    kept = [named(c) for c in pages.columns if c.lower() != into.lower()]
    return pages.select(*kept, extract(named(html_col)).alias(into))
