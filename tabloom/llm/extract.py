"""Main text of web pages by composite text density.

Every DOM node gets the characters per tag of its subtree, adjusted by the share of linked characters and tags. A node's
density sum adds up the densities of its children; the node with the largest sum holds the main text. The smallest
density on the path from there to the body is the threshold from which neighbours along that path, whatever their tag,
and bare text between them still count as part of the article; short parts also count by as many unlinked characters per
tag as the path has at least, since the density grows with a part's size. An enclosing article element wins over both. Elements that are never article text (menus, forms,
scripts, adverts, reader comments and so on, by tag, role or whole class names) are cut after reading, unless they hold the
page's article or main element or, where it has none and a name or a form is the reason, most of its unlinked text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from tabloom.llm.base import map_batches

# fixed values: element and class names of HTML pages
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select", "canvas", "video", "audio"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CUT = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "header", "fieldset"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
          "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
BLOCKS_END_P = {"address", "article", "aside", "blockquote", "center", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1",
                "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "thead": set(), "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "main", "body", "blockquote", "div"}
BAD_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
             "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
             "signup", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "header",
             "masthead", "topbar", "toolbar", "comment", "comments", "commentlist", "disqus", "discussion", "replies", "respond", "share",
             "sharing", "social", "related", "recommended", "recommendations", "widget", "hidden", "login", "search", "toc"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
GOOD_WORDS = {"article", "content", "main", "story", "entry", "body"}
NEVER = {"comment", "comments", "commentlist", "disqus", "ad", "ads", "advert", "advertisement", "sidebar", "share", "related"}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_WORD = re.compile(r"[a-z]+")


def _named(value: str, words: set[str]) -> bool:
    """True if one of the names of a class or id consists of such words alone."""
    return any(parts and words.issuperset(parts) for parts in map(_WORD.findall, value.split()))


def _unwanted(attributes: str) -> str:
    """Why an element is not article text: a hidden mark, a name (class, id or role), or nothing."""
    why = ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or "").lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "hidden"
        if name == "role" and value in BAD_ROLES:
            why = "name"
        elif name in ("class", "id") and (_named(value, NEVER) or _named(value, BAD_WORDS) and not GOOD_WORDS & set(value.split())):
            why = "name"
    return why


class Page:
    """Flat DOM of one page: parents, tags, and the runs of text with the place of each node's first and last run."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.first, self.last = ["#root"], [-1], [0], [0]
        self.runs: list[str] = []
        self.owner: list[int] = []
        self.doubtful: list[tuple[int, str]] = []
        self.open: Counter[str] = Counter()  # elements of each tag that are still open
        self._read(source)
        self._drop()

    def _open(self, tag: str, stack: list[int]) -> int:
        self.tag.append(tag)
        self.open[tag] += 1
        self.parent.append(stack[-1])
        self.first.append(len(self.runs))
        self.last.append(-1)
        return len(self.tag) - 1

    def _close(self, stack: list[int], depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            self.open[self.tag[node]] -= 1
            self.last[node] = len(self.runs)

    def _text(self, raw: str, node: int) -> None:
        if raw:
            self.runs.append(html.unescape(raw) if "&" in raw else raw)
            self.owner.append(node)

    def _read(self, source: str) -> None:
        """Every character is looked at a bounded number of times, however broken the markup is."""
        stack, cut, at, ends = [0], 0, 0, len(source)
        low, unclosed = None, set()
        last = source.rfind(">") + 1  # no tag ends behind it
        while at < ends:
            m = _TOKEN.search(source, at, last) if at < last else None
            if not m or m.end() == last and m[0].startswith("<!--") and not m[0].endswith("-->"):
                stop = source.find("<!--", at)  # a comment without an end takes the rest
                self._text(source[at : stop if stop >= 0 else ends], stack[-1])
                at = ends
                break
            self._text(source[at : m.start()], stack[-1])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
            if closing:
                depth = next((d for d in range(len(stack) - 1, 0, -1) if self.tag[stack[d]] == tag), 0) if self.open[tag] else 0
                if tag not in INLINE:
                    self._text(" ", stack[-1])
                if depth and not (cut and depth < cut - 1):
                    self._close(stack, depth)
                elif depth and tag in ("body", "html"):
                    self._close(stack, depth)
                if cut and len(stack) < cut:
                    cut = 0
                continue
            if tag in RAW:
                if attributes.endswith("/") and tag in ("svg", "math"):
                    continue
                if low is None:
                    low = source.lower()
                    if len(low) != ends:
                        low = source
                stop = low.find(f"</{tag}", at) if tag not in unclosed else -1
                if stop < 0:
                    unclosed.add(tag)
                    at = ends if tag in ("script", "style", "textarea", "template", "noscript") else at
                    continue
                close = source.find(">", stop)
                at = close + 1 if close >= 0 else ends
                self._text(" ", stack[-1])
                continue
            if tag not in INLINE:
                self._text(" ", stack[-1])
            if tag in VOID:
                continue
            if tag in BLOCKS_END_P and self.open["p"]:
                depth = len(stack) - 1
                while depth > 0 and self.tag[stack[depth]] in INLINE:
                    depth -= 1
                if depth > 0 and self.tag[stack[depth]] == "p":
                    self._close(stack, depth)
            elif tag in ENDS and any(self.open[t] for t in ENDS[tag]):
                depth = len(stack) - 1
                while depth > 0 and self.tag[stack[depth]] not in SCOPES and self.tag[stack[depth]] not in ENDS[tag]:
                    depth -= 1
                if depth > 0 and self.tag[stack[depth]] in ENDS[tag]:
                    self._close(stack, depth)
            if cut and len(stack) < cut:
                cut = 0
            stack.append(self._open(tag, stack))
            if tag not in ("html", "body", "article", "main"):
                why = attributes and _unwanted(attributes)
                if why == "hidden" or tag in CUT:
                    why = "name" if tag == "form" and why != "hidden" else "tag"
                if why:
                    self.doubtful.append((stack[-1], why))
                    cut = cut or len(stack)
        self._text(source[at:], stack[-1])
        self._close(stack, 0)

    def _drop(self) -> None:
        """Take out the text of elements that are not article text."""
        if not self.doubtful:
            return
        n = len(self.tag)
        inside, linked, holds = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            p = self.parent[i]
            linked[i] = self.tag[i] == "a" or linked[p]
            inside[i] = self.tag[i] in ("article", "main") or inside[p]
            if inside[i] and not inside[p]:
                while p >= 0 and not holds[p]:
                    holds[p], p = True, self.parent[p]
        plain = [0]
        for run, node in zip(self.runs, self.owner):
            plain.append(plain[-1] + (0 if linked[node] else len("".join(run.split()))))
        kept, upto = bytearray(b"\1") * len(self.runs), 0
        for i, why in self.doubtful:
            a, b = self.first[i], self.last[i]
            if b <= upto or holds[i] or why == "name" and not holds[0] and 2 * (plain[b] - plain[a]) > plain[-1]:
                continue
            kept[a:b], upto = bytes(b - a), b
        place = [0]
        for k in kept:
            place.append(place[-1] + k)
        self.first, self.last = [place[i] for i in self.first], [place[i] for i in self.last]
        self.runs = [r for r, k in zip(self.runs, kept) if k]
        self.owner = [o for o, k in zip(self.owner, kept) if k]

    def _beside(self, above: int, below: int, children: list[int]) -> list[tuple[int, int, list[int]]]:
        """First and last run and nodes of what `above` holds beside `below`: blocks, and bare text with its inline elements."""
        groups: list[list] = []
        bare, at = False, self.first[above]
        for i in [*children, -1]:
            a, b = (self.first[i], self.last[i]) if i >= 0 else (self.last[above], self.last[above])
            inline = i >= 0 and i != below and self.tag[i] in INLINE
            if (a > at or inline) and not bare:
                groups.append([at, a, []])
                bare = True
            if bare:
                groups[-1][1] = b if inline else a
            if inline:
                groups[-1][2].append(i)
            else:
                bare = False
                if i >= 0 and i != below:
                    groups.append([a, b, [i]])
            at = b
        return [tuple(g) for g in groups]

    def densities(self) -> tuple[list[float], list[float]]:
        """Link-adjusted density of every node, and the sum over its children (a leaf's own density)."""
        n = len(self.tag)
        chars, links, tags, anchors = [0] * n, [0] * n, [0] * n, [0] * n
        for run, node in zip(self.runs, self.owner):
            chars[node] += len("".join(run.split()))
        linked = [False] * n
        for i in range(1, n):
            linked[i] = self.tag[i] == "a" or linked[self.parent[i]]
        for i in range(n):
            links[i] = chars[i] if linked[i] else 0
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
            anchors[p] += anchors[i] + (self.tag[i] == "a")
        ratio = links[0] / max(chars[0], 1)
        self.counts = chars, links, tags
        density = [0.0] * n
        for i in range(n):
            c, t = chars[i], max(tags[i], 1)
            if not c:
                continue
            plain = c / t
            base = math.log(c / max(c - links[i], 1) * links[i] + ratio * c + math.exp(math.e))
            density[i] = max(0.0, plain * math.log(max(c / max(links[i], 1) * (t / max(anchors[i], 1)), 1.0)) / math.log(base))
        sums = [0.0] * n
        leaf = [True] * n
        for i in range(n - 1, 0, -1):
            sums[self.parent[i]] += density[i]
            leaf[self.parent[i]] = False
        return density, [density[i] if leaf[i] else sums[i] for i in range(n)]

    def text(self, first: int, last: int) -> str:
        return " ".join("".join(self.runs[first:last]).split())

    def main(self) -> str:
        density, sums = self.densities()
        best = max(range(len(sums)), key=lambda i: (sums[i], -i))
        if sums[best] <= 0:
            return self.text(0, len(self.runs))
        path = [best]
        while self.parent[path[-1]] >= 0 and self.tag[path[-1]] != "body":
            path.append(self.parent[path[-1]])
        article = next((i for i in path if self.tag[i] in ("article", "main")), None)
        if article is not None:
            return self.text(self.first[article], self.last[article])
        if not any(density[i] > 0 for i in path):
            return self.text(self.first[best], self.last[best])
        threshold = min(density[i] for i in path if density[i] > 0)
        first, last = self.first[best], self.last[best]
        spans = [(first, last)]
        chars, links, tags = self.counts
        least = min((chars[i] - links[i]) / max(tags[i], 1) for i in path if density[i] > 0)
        children: dict[int, list[int]] = {}
        for i in range(1, len(self.tag)):
            children.setdefault(self.parent[i], []).append(i)
        for above, below in zip(path[1:], path):
            for a, b, nodes in self._beside(above, below, children[above]):
                block = len(nodes) == 1 and self.tag[nodes[0]] not in INLINE
                plain = sum(len("".join(r.split())) for r in self.runs[a:b]) - sum(links[i] for i in nodes)
                dense = plain / max(sum(tags[i] + (not block) for i in nodes), 1) >= least
                if block:
                    i = nodes[0]
                    dense = self.tag[i] == "h1" or dense or density[i] >= threshold and sums[i] >= threshold
                if dense and (plain > 0 or block):
                    spans.append((a, b))
            if self.tag[above] == "body":
                break
        return " ".join(filter(None, (self.text(a, b) for a, b in sorted(spans))))


def main_text(source: str | None) -> str:
    return Page(source).main() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """Per row of `pages` (page_id, url, html): page_id, url, text, n_chars.

    Null and empty pages have the empty text. Broken markup is read to its end. Repeated rows give equal results, an
    empty table an empty one.
    """

    def run(batch: dict[str, list]) -> dict[str, list]:
        text = [main_text(h) for h in batch["html"]]
        return {"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]}

    kinds = dict(pages.dtypes)
    return map_batches(
        pages.select("page_id", "url", "html"), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long", run
    )
