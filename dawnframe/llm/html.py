"""Main text of web pages by tree scoring.

A page is read into a light tree.  Elements that never hold the article (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) are cut: by tag or role, or by a class or id name that is page
furniture (see ``_furniture``: ``site-footer`` is, ``no-sidebar`` and ``has-comments`` only say how a page is laid out),
unless another name of the same element speaks for the article.  Each remaining paragraph earns
points for its length and its commas and passes them to its ancestors: all to the parent, half to the next, less
beyond; a container's sum is discounted by the share of its text that stands in links.  A cut by name or a form is taken back where
the element holds most of the page's points and no article, main or article-named element outside it holds any, so a misleading name
can't empty a page.  From the best container the
way leads up to its article or main element, or else through parents that score alike.  What is reached is kept, with all
beside it that has less than half its text in links or scores well, however short.  Of what is kept every block but lists
of links is returned in page order (within an article element only lists of ``MENU`` links or more without a heading count as such): character references decoded, white space and line breaks inside a block made one space, blocks joined by one space; images, scripts and the like inside a
line leave no space behind.

Unclosed paragraphs, list items and cells are closed as browsers do; broken markup never fails.  A page is read in time
proportional to its length, however deep its tags nest: totals are summed from the leaves up, open tags are found by name.
Decisions: a name that says a notice (``legal-notice``) is cut wherever it stands, also around prose; a furniture word that leads a phrase
(``menu-of-the-day``) is no furniture; a paragraph within an article or main element whose name only may be furniture (``social``) stays if it holds
``PROSE`` characters outside links and more than within; text that stands wholly in links is no article.
Defined results: a null or empty page, or one without article text, gives an empty string; whole pages of any length are read; of containers that
score the same the one that starts first is taken; repeated rows are extracted one by one; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dawnframe.llm.arrow import add_columns

# Element names of HTML by role, and the class and id words of page furniture.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BREAKS = {"br", "hr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "colgroup", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "legend", "li", "listing",
    "main", "menu", "nav", "ol", "optgroup", "option", "p", "plaintext", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CUT_TAGS = RAW | {"nav", "header", "footer", "aside", "button", "select", "option", "input", "fieldset", "menu", "dialog", "svg", "canvas", "object", "audio", "video", "head"}
CUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
FURNITURE = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs sidebar header masthead topbar footer bottombar cookie cookies consent gdpr popup modal overlay newsletter pager pagination toolbar".split()
)
#: Names that mean furniture alone or with each other, or beside words that say nothing: ``social-share`` is, ``social-studies`` isn't.
LOOSE_FURNITURE = set(
    "promo promotion banner side aside rail foot notice notices notification notifications alert alerts disclaimer subscribe subscription "
    "signup login search share sharing social related recommended recommendations latest popular trending widget widgets tags form hidden legal copyright".split()
)
#: Those of them that an article's paragraph can be about.
SUBJECTS = set("side aside rail foot search share sharing social related recommended recommendations latest popular trending tags hidden".split())
PLAIN = set(
    "head box bar block list links link area section wrapper container inner left right top bottom secondary primary site global "
    "buttons icons posts articles stories news js".split()
)
READERS = set("comment comments commentlist disqus reply replies respond discussion".split())
#: What follows such a word only says how a page is laid out.
MODIFIERS = set("has have no not with without is hide show visible hidden on off".split())
#: What follows such a word only in a phrase.
PHRASE = {"of", "the"}
GOOD_WORDS = set("article articlebody body content entry main page post prose story text".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSE_LIMIT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "thead", "tbody", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>))", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_UNFINISHED = re.compile(r"<[A-Za-z/!?]")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END = {tag: re.compile(rf"</{tag}(?![\w-])[^>]*(?:>|\Z)", re.I) for tag in RAW}
_AGAIN = {tag: re.compile(rf"<{tag}(?![\w-])", re.I) for tag in RAW}
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/>=]|$)")
_STYLED_AWAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
PROSE, MENU = 80, 5
PARAGRAPHS = {"p", "pre", "td", "blockquote", "li", "dd", "figcaption", *HEADINGS}


class _Node:
    __slots__ = ("tag", "up", "cut", "soft", "reader", "subject", "headed", "weight", "score", "size", "linked", "links", "own", "commas", "block", "depth", "ended", "below")

    def __init__(self, tag, up, depth, cut=False, soft=False, reader=False, weight=0.0):
        self.tag, self.up, self.depth, self.weight = tag, up, depth, weight
        self.cut = cut  # never taken, with all below
        self.soft = soft  # cut by its name; may be taken back
        self.reader = reader  # cut as reader comments; never taken back
        self.headed = up is not None and (up.below[-1].tag in HEADINGS if up.below else up.headed)  # stands right below a heading
        self.subject = False  # a paragraph whose name may say what it is about
        self.score = 0.0  # points passed up by paragraphs
        self.size = self.linked = self.links = 0  # characters below, those in links, and links
        self.own = self.commas = 0  # of a block: its own characters and commas
        self.block = self if _encloses(tag) else up.block  # the block that its text belongs to
        self.ended = False  # a link whose end tag came while blocks inside it were open
        self.below = []


def _inline(tag: str) -> bool:
    """Whether an element stands within a line; those that pages define themselves (with a dash) count as blocks."""
    return tag not in BLOCKS and tag != "#" and "-" not in tag


def _encloses(tag: str) -> bool:
    """Whether what stands in an element belongs to it alone: blocks, and what is cut within a line (buttons, drawings)."""
    return tag in CUT_TAGS or not _inline(tag)


def _furniture(names: str) -> tuple[bool, bool, bool, bool]:
    """Whether class and id names say page furniture, reader comments, or article, and whether what says furniture may be a subject."""
    cut = reader = good = False
    subject = True
    for name in names.split():
        words = _WORDS.findall(_CAMEL.sub("-", name).lower())
        if any(w in PHRASE for w in words):
            at = next(i for i, w in enumerate(words) if w in PHRASE)
            if not set(words[at:]) & READERS:
                continue
        if len(words) > 1:
            words = words[: next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))]
        own = set(words)
        loose = own & LOOSE_FURNITURE
        if own & READERS:
            reader, subject = True, False
        elif own & FURNITURE or (loose and own <= LOOSE_FURNITURE | PLAIN | GOOD_WORDS):
            cut = True
            subject &= own <= SUBJECTS
        elif own & GOOD_WORDS and not loose:
            good = True
    return cut, reader, good, cut and subject


def _node(tag: str, rest: str, up: _Node, depth: int) -> _Node:
    cut, soft, reader, subject, weight = tag in CUT_TAGS, tag == "form", False, False, 25.0 * (tag in ("article", "main"))
    if "=" in rest or "hidden" in rest:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
        named, reader, good, subject = _furniture(f"{found.get('class', '')} {found.get('id', '')}")
        good |= found.get("role") in ("main", "article") or found.get("itemprop") == "articleBody"
        reader &= tag not in ("main", "body", "html") and not good
        if tag not in ("article", "main", "body", "html"):
            soft |= named and not good
            cut |= found.get("role", "").lower() in CUT_ROLES
            cut |= found.get("aria-hidden") == "true" or bool(_STYLED_AWAY.search(found.get("style", ""))) or bool(_HIDDEN.search(_ATTRIBUTE.sub(" ", rest)))
        weight += 25.0 * (good and not _inline(tag))
    node = _Node(tag, up, depth, cut, soft, reader, weight)
    node.subject = subject and soft and tag == "p"
    return node


def _read(page: str):
    """All nodes, parents first, and what stands in the page in its order: (block node, text, in a link, innermost node) or None for a break."""
    root = _Node("#", None, 0)
    nodes, stack, parts, at, link = [root], [root], [], 0, 0
    opened: dict[str, list[int]] = {}  # tag -> depths at which it is open
    stops: dict[str, re.Match | None] = {}  # tag -> its next end tag
    end = page.rfind(">") + 1

    def text(value):
        if value:
            parts.append((stack[-1].block, references.unescape(value) if "&" in value else value, link > 0, stack[-1]))

    def close_to(depth):
        nonlocal link
        for n in stack[depth:]:
            opened[n.tag].pop()
            link -= n.tag == "a" and not n.ended
            if not _inline(n.tag):
                parts.append(None)
        del stack[depth:]

    def deepest(tags):
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    while m := _TAG.search(page, at, end):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)  # a comment without an end hides the rest
                break
            continue
        if m[1]:
            depth = deepest((tag,))
            if depth and (_encloses(tag) or depth > stack[-1].block.depth):
                close_to(depth)
            elif depth and tag == "a" and not stack[depth].ended:
                stack[depth].ended, link = True, link - 1
            elif not _inline(tag):
                parts.append(None)
            continue
        if tag in VOID:
            if tag in BREAKS:
                parts.append(None)
            continue
        if tag in RAW:
            if tag not in stops or (stops[tag] is not None and stops[tag].start() < at):
                stops[tag] = _END[tag].search(page, at)
            stop = stops[tag]
            if m[0].endswith("/>") and (stop is None or _AGAIN[tag].search(page, at, stop.start())):
                continue  # written as an empty element, and without an end tag of its own
            at = stop.end() if stop else len(page)
            if at >= end:
                break
            continue
        if not _inline(tag):
            block = stack[-1].block  # an open paragraph or heading ends where the next block begins
            if tag in BLOCKS and (block.tag == "p" or (block.tag == tag and tag in HEADINGS)):
                close_to(block.depth)
            while tag in CLOSES and (depth := deepest(CLOSES[tag])) > deepest(CLOSE_LIMIT[tag]):
                close_to(depth)
            parts.append(None)
        if m[0].endswith("/>"):
            continue
        node = _node(tag, m[3], stack[-1], len(stack))
        stack[-1].below.append(node)
        if tag == "a":
            if before := opened.get("a"):  # links don't nest
                if not stack[before[-1]].ended:
                    stack[before[-1]].ended, link = True, link - 1
            link += 1
            node.links = 1
        opened.setdefault(tag, []).append(len(stack))
        stack.append(node)
        nodes.append(node)
    if at < len(page):
        text(_UNFINISHED.split(page[at:], maxsplit=1)[0])
    return nodes, parts


def _cut_below(nodes: list[_Node]) -> None:
    for n in nodes:  # parents come first
        n.cut |= n.soft or n.reader or (n.up is not None and n.up.cut)


def _points(n: _Node) -> float:
    return n.own / 100 if n.own < 25 else 1 + n.commas + min(n.own // 100, 3) + n.own / 1000


def _take_back(nodes: list[_Node], parts) -> None:
    """Undo cuts by name of elements that hold most of a page that has no article outside them."""
    for part in parts:
        if part is not None and part[2]:
            part[0].linked += len(part[1])
        elif part is not None:
            part[0].own += len(part[1])
            part[0].commas += _commas(part[1])
    within: set[_Node] = set()  # article and main elements and all below them
    for n in nodes:  # parents come first
        if n.tag in ("article", "main") or n.up in within:
            within.add(n)
            n.soft &= not (n.subject and n.own >= PROSE and n.own > n.linked)
    barred: dict[_Node, bool] = {}  # under a cut that stands whatever is below
    for n in nodes:  # parents come first
        barred[n] = n.reader or n.cut or (n.up is not None and barred[n.up])
    below = {n: _points(n) if n.own and not barred[n] else 0.0 for n in nodes}
    for n in reversed(nodes):
        if n.up is not None:
            below[n.up] += below[n]
    most = [n for n in nodes if n.soft and 2 * below[n] > below[nodes[0]]]  # each inside the one before
    inside: dict[_Node, int | None] = {}  # how many of ``most`` are around a node; None under another cut by name
    place = {n: i for i, n in enumerate(most, 1)}
    for n in nodes:
        around = inside[n.up] if n.up is not None else 0
        inside[n] = place.get(n, None if n.soft else around) if around is not None else None
    articles = [inside[n] for n in nodes if n.weight and below[n] and inside[n] is not None]
    for n in most[: min(articles, default=len(most))]:
        n.soft = False


def _commas(value: str) -> int:
    return value.count(",") + value.count("，") + value.count("、")


def _score(nodes: list[_Node], parts) -> list:
    """Sums sizes and scores of all nodes; returns the parts that aren't cut."""
    if any(n.soft for n in nodes):
        _take_back(nodes, parts)
        for n in nodes:
            n.own = n.commas = n.linked = 0
    _cut_below(nodes)
    parts = [p for p in parts if p is None or not p[3].cut]
    for part in parts:
        if part is not None:
            node, value, link, _ = part
            size = len(" ".join(value.split()))
            node.size += size
            node.linked += size * link
            node.own += size * (not link)
            node.commas += _commas(value)
    for n in reversed(nodes):
        if n.up is not None:
            n.up.size += n.size
            n.up.linked += n.linked
            n.up.links += n.links
    for n in nodes:
        if n.own:
            points = _points(n)
            up = n.up if n.tag in PARAGRAPHS and n.up is not None else n
            for share in (1.0, 0.5, 0.2, 0.1):
                if up is None:
                    break
                up.score += points * share
                up = up.up
    return parts


def _dense(n: _Node) -> float:
    return n.linked / n.size if n.size else 0.0


def _value(n: _Node) -> float:
    return (n.score + n.weight * (n.score > 0)) * (1 - _dense(n))


def _whole(best: _Node) -> _Node:
    """The nearest article or main element around a container, or the highest of its parents that score alike."""
    n = best
    while n is not None:
        if n.tag in ("article", "main"):
            return n
        n = n.up
    while best.up is not None and best.up.tag not in ("#", "html", "body") and 3 * _value(best.up) >= _value(best):
        best = best.up
    return best


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes, parts = _read(page)
    parts = _score(nodes, parts)
    kept, beside = set(), None
    if nodes[0].size:
        best = max((n for n in nodes if n.size and not _inline(n.tag)), key=_value)
        best_score = _value(best)
        if best_score <= 0:
            return ""
        if best.tag in PARAGRAPHS and best.up is not None:
            best = best.up
        best = _whole(best)
        beside, kept = best.up, {id(best)}
        for n in best.up.below if best.up is not None else ():
            if n is not best and not n.cut and n.size and (_dense(n) < 0.5 or _value(n) >= max(10, 0.2 * best_score)):
                kept.add(id(n))
    verdict: dict[int, bool] = {}
    article: dict[int, bool] = {}  # whether a node is an article element or below one

    def stays(node) -> bool:
        path, n = [], node
        while n is not None and id(n) not in verdict:
            path.append(n)
            n = n.up
        for n in reversed(path):
            inside = id(n) in kept or (n.up is not None and verdict[id(n.up)])
            article[id(n)] = n.tag == "article" or (n.up is not None and article[id(n.up)])
            menu = n.tag in ("ul", "ol", "div", "table", "section", "dl") and id(n) not in kept and n.links >= 3 and _dense(n) > 0.6
            menu &= not article[id(n)] or (n.links >= MENU and not n.headed)
            verdict[id(n)] = inside and not menu
        return verdict[id(node)]

    out = []
    for part in parts:
        out.append(" " if part is None else part[1] if stays(part[0]) or (part[0] is beside and not part[2]) else " ")
    return " ".join("".join(out).split())


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""

    def one(value):
        found = main_text(value)
        return found, len(found)

    return add_columns(pages.select("page_id", "url", "html"), "html", [("text", T.StringType(), pa.string()), ("n_chars", T.LongType(), pa.int64())], lambda: one)
