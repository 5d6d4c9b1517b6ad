"""A page's block elements as a tree, and what its own markup says about them.

Only block elements become nodes; inline markup vanishes and its text belongs to the block around it. The text of a node between
two child blocks is a segment. Missing end tags follow the rules of HTML for paragraphs, list items and table cells. Elements whose text
is never shown (scripts, styles, templates and the like) are left out with all they hold; an unclosed one reaches to the end.
"""

from __future__ import annotations

import html
import re

# Fixed values of HTML: element kinds.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul button".split()
)
UNSHOWN = frozenset("script style title noscript template svg math iframe object textarea select audio video canvas noembed noframes xmp".split())
#: Opening the first closes an open one of the second kind, looked for up to the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead"}, {"table"}),
}
WALLS = {"table": {"table"}, "td": {"td", "th"}, "th": {"td", "th"}}

# What names of elements, roles, classes and ids say; the lists are this module's own.
ASIDE_TAGS = frozenset("nav footer aside form dialog menu button search fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager footer foot sidebar sidebars widget widgets related recommended recommendations "
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login search share sharing social comment comments "
    "commentlist reply replies respond disqus discussion masthead topbar toolbar banner copyright disclaimer skip".split()
)
HEAD_WORDS = frozenset("header topbar masthead head".split())
BODY_WORDS = frozenset("article post entry story content main body text".split())
MODIFIERS = frozenset("has with no without is".split())

TOKEN = re.compile(
    r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)"
    r"|(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)(?:>|\Z))",
    re.S,
)
ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("parent", "tag", "key", "aside", "named", "role", "flow", "level")

    def __init__(self, parent: int, tag: str, level: int, attrs: str = ""):
        self.parent, self.tag, self.level, self.flow = parent, tag, level, []
        self.key, self.aside, self.named, self.role = tag, tag in ASIDE_TAGS, False, ""
        if "=" in attrs or "hidden" in attrs:
            self._describe({m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(attrs)})

    def _describe(self, a: dict) -> None:
        names = " ".join(filter(None, (a.get("class"), a.get("id"))))
        self.role = a.get("role", "").lower()
        if names:
            self.key = f"{self.tag}.{DIGITS.sub('0', ' '.join(names.split()))}"
        self.aside |= self.role in ASIDE_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        if not self.aside and names and self.tag not in ("html", "body"):
            self.named = said_aside(names)
            self.aside = self.named


def said_aside(names: str) -> bool:
    """Whether class and id names say that an element stands beside the main text."""
    for name in names.split():
        words = [w.lower() for w in WORDS.findall(name)]
        found = [i for i, w in enumerate(words) if w in ASIDE_WORDS and not (i and words[i - 1] in MODIFIERS)]
        if found:
            return True
        if HEAD_WORDS & set(words) and not BODY_WORDS & set(words):
            return True
    return False


class Page:
    """``nodes`` in page order (the first is the root), ``segments`` as (node, text) in page order, entities decoded and white space single."""

    def __init__(self, source: str):
        self.nodes = [Node(-1, "#root", 0)]
        self.segments: list[tuple[int, str]] = []
        self._read(source)
        self._judge()

    # --- reading

    def _read(self, source: str) -> None:
        open_, text, at, unshown, beside = [0], [], 0, "", None
        counts: dict[str, int] = {}

        def flush():
            if text:
                words = " ".join("".join(text).split())
                if words:
                    self.nodes[open_[-1]].flow.append(~len(self.segments))
                    self.segments.append((open_[-1], words))
                text.clear()

        def close(places: int):
            flush()
            for i in open_[places:]:
                counts[self.nodes[i].tag] -= 1
            del open_[places:]

        def find(tags, walls) -> int | None:
            if not any(counts.get(t) for t in tags):
                return None
            for place in range(len(open_) - 1, 0, -1):
                tag = self.nodes[open_[place]].tag
                if tag in tags:
                    return place
                if tag in walls:
                    return None
            return None

        def said(piece: str):
            if piece and not beside:
                text.append(html.unescape(piece) if "&" in piece else piece)

        n = len(source)
        while at < n:
            m = TOKEN.search(source, at)
            if m is None:
                break
            said(source[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m["cdata"]:
                    said(m["cdata"].replace("&", "&amp;"))
                continue
            tag, ends = tag.lower(), m["end"]
            if tag in UNSHOWN:
                if not ends and not m["attrs"].endswith("/"):
                    stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                    at = stop.end() if stop else n
                continue
            if tag not in BLOCKS:
                if beside:
                    if tag == beside[0]:
                        beside[1] += -1 if ends else 1
                        if beside[1] <= 0:
                            beside = None
                elif tag == "br":
                    text.append(" ")
                elif not ends and ("class" in m["attrs"] or "hidden" in m["attrs"]) and tag not in ("img", "input", "link", "meta", "wbr", "area", "base", "col", "embed", "source", "track"):
                    if Node(0, tag, 0, m["attrs"]).aside:
                        beside = [tag, 1]
                continue
            beside = None
            if ends:
                place = find({tag}, WALLS.get(tag, {"table", "td", "th"} if tag not in ("tr", "tbody", "thead", "tfoot", "caption") else {"table"}) - {tag})
                if place is not None:
                    close(place)
                continue
            if tag in ("html", "body") and counts.get(tag):
                continue
            if counts.get("p") and self.nodes[open_[-1]].tag == "p":
                close(len(open_) - 1)
            elif tag in CLOSES and (place := find(*CLOSES[tag])) is not None:
                close(place)
            else:
                flush()
            if tag == "hr":
                continue
            parent = open_[-1]
            self.nodes[parent].flow.append(len(self.nodes))
            open_.append(len(self.nodes))
            counts[tag] = counts.get(tag, 0) + 1
            self.nodes.append(Node(parent, tag, self.nodes[parent].level + 1, m["attrs"]))
        if at < n:
            said(source[at:])
        flush()

    # --- what the markup itself says

    def _judge(self) -> None:
        """``aside`` becomes true of everything below an aside, and ``main`` the nodes of the main part: article elements, else main ones, else all."""
        nodes = self.nodes
        within = [False] * len(nodes)  # an article or main element, or inside of one
        for i, n in enumerate(nodes[1:], 1):
            within[i] = within[n.parent] or n.tag in ("article", "main") or n.role == "main"
            if n.tag == "header" and not within[i]:
                n.aside = True
        for i, n in enumerate(nodes):  # names of containers say nothing about the article that they hold
            if n.tag == "article" and not n.aside or n.tag == "main" or n.role == "main":
                up = n.parent
                while up > 0 and not (nodes[up].aside and not nodes[up].named):
                    nodes[up].aside = nodes[up].named = False
                    up = nodes[up].parent
        for n in nodes[1:]:
            n.aside |= nodes[n.parent].aside
        kind = lambda n, tags: not n.aside and (n.tag in tags or "main" in tags and n.role == "main")
        tags = ("article",) if any(kind(n, ("article",)) for n in nodes) else ("main",) if any(kind(n, ("main",)) for n in nodes) else None
        self.explicit = tags is not None
        self.main = [tags is None] * len(nodes)
        for i, n in enumerate(nodes[1:], 1):
            self.main[i] = self.main[n.parent] or tags is not None and kind(n, tags)
        if tags == ("article",) and not any(n.tag == "h1" and self.main[i] for i, n in enumerate(nodes)):
            for i, n in enumerate(nodes[1:], 1):
                self.main[i] |= n.tag == "h1" and within[i] and not n.aside

    def blocks(self, dropped=()) -> list[str]:
        """Texts of the main part's segments, without those at or below the ``dropped`` nodes."""
        gone = [False] * len(self.nodes)
        for i in dropped:
            gone[i] = True
        if dropped:
            for i, n in enumerate(self.nodes[1:], 1):
                gone[i] |= gone[n.parent]
        return [t for i, t in self.segments if self.main[i] and not self.nodes[i].aside and not gone[i]]
