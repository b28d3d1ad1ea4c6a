"""Main text of HTML pages by tree scoring.

A page is read into a tree of elements; each paragraph passes points for its length and its
commas to its ancestors, the nearer the more. Containers are discounted by link density; the
best one and those siblings that read like it are kept. An article or main element around the
best container bounds the article, unless it is mostly links.

Menus, page headers and footers, asides, scripts and the like go by their element or role.
Class and id names only raise a suspicion, which the scores confirm or refute: a block named
after comments, adverts, sharing or notices stays if nearly all prose of the page is in it;
one named after a place in the layout (sidebar, related, discussion) goes from inside an article only
if it is links or has no prose, or holds readers' comments or a form. An id counts only if all of it is
such a name, and never on a heading or paragraph, as headings give ids to what they title.

Defined cases: null, empty and broken pages never fail; a page without text gives the empty
text; references are decoded as HTML5 does; white space inside a block is one space; blocks
are joined by one newline; nothing is cut off, and the work grows in proportion to the page;
repeated rows give repeated rows; an empty table gives no rows; other columns pass through,
and a column of the name of `out` is replaced.
"""

from __future__ import annotations

import html
import re
from array import array
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from attesta.llm.bpe import _add, _with

_TAG = re.compile(r"""<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_OPEN_QUOTE = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>)[^>]*>")
_NAME = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)")
#: Characters in which a pattern looks for the end of a tag; what it does not find there, TagEnds does.
TAG_CHARS = 1 << 12
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# HTML element names by what they mean for text.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = {"head", "nav", "header", "footer", "aside", "template", "button", "select", "svg", "math", "canvas", "object", "audio", "video", "dialog", "menu", "fieldset", "map", "datalist"} | RAW
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "nobr"} | VOID
PARAGRAPH = {"p", "pre", "blockquote", "td", "dd", "figcaption"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTED = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NEVER_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
#: Parts of class and id names by what they mark: readers' comments; adverts, sharing and notices; places in a layout.
COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond", "replies"}
INSERTS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "promoted", "outbrain", "taboola",
    "share", "sharing", "social", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
}
LAYOUT = {
    "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "header", "masthead", "topbar", "footer", "foot", "sidebar", "aside", "rail", "widget",
    "reply", "discussion", "alert", "related", "recommended", "recommendations", "copyright", "disclaimer", "legal",
}
#: Parts that say nothing by themselves, and parts that turn what they stand with around.
NEUTRAL = {
    "area", "article", "articles", "bar", "block", "body", "bottom", "box", "buttons", "card", "col", "column", "container", "content", "group", "hint", "holder", "inner", "item", "items", "js", "left",
    "link", "links", "list", "main", "message", "outer", "page", "panel", "post", "posts", "primary", "region", "right", "row", "secondary", "section", "site", "slot", "stories", "story", "text", "thread",
    "top", "unit", "wrap", "wrapper", "zone",
}
TURNED = {"has", "with", "no", "without", "and", "is", "not", "show", "hide"}

#: Characters from which a block reads as prose, and ancestors that a paragraph gives points to.
PROSE, REACH = 80, 6


class TagEnds:
    """Ends of tags of any length: the first > outside quotes, in time that grows with the page, not with its tags.

    Where quotes stand is noted once. A walk that ends in a quote that never closes remembers where it was
    outside quotes, for every later walk that comes there ends so too.
    """

    def __init__(self, page: str):
        self.places = {c: array("q", (m.start() for m in re.finditer(c, page))) for c in "\"'>"}
        self.failed: set[int] = set()

    def after(self, char: str, at: int) -> int | None:
        places = self.places[char]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else None

    def end(self, at: int) -> int | None:
        """Where the > is that ends a tag whose name ends at `at`; None if a quote stays open."""
        walked = []
        while at not in self.failed:
            walked.append(at)
            closing = self.after(">", at)
            opened = min(((p, q) for q in "\"'" if (p := self.after(q, at)) is not None), default=None)
            if closing is not None and (opened is None or closing < opened[0]):
                return closing
            quote = self.after(opened[1], opened[0] + 1) if opened else None
            if quote is None:
                break
            at = quote + 1
        self.failed.update(walked)
        return None


class Node:
    __slots__ = ("tag", "up", "never", "named", "unsure", "within", "evidence", "points", "own", "chars", "link_chars", "prose", "semantic", "kept", "holds")

    def __init__(self, tag: str, up: Node | None, never: bool, named: str):
        self.tag, self.up, self.never, self.named = tag, up, never, named
        self.semantic = tag in ("article", "main")
        self.within = up is not None and (up.within or up.semantic)
        self.unsure = self if named == "layout" else up.unsure if up else None  # the nearest block of a layout name
        self.evidence = self.kept = self.holds = False
        self.points = self.own = 0.0
        self.chars = self.link_chars = self.prose = 0

    @property
    def link_share(self) -> float:
        return self.link_chars / self.chars if self.chars else 1.0


def attributes(rest: str) -> dict[str, str]:
    """The attributes of a start tag, the first of each name; references are decoded."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(rest):
        value = value[1:-1] if value[:1] in ("'", '"') else value
        found.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return found


def meaning(name: str, whole: bool) -> str:
    """What a class or id name marks: "comments", "insert", "layout" or "" (nothing).

    whole: all parts must be known; else the first or the last part may say it alone.
    """
    parts = [p.lower() for p in _PART.findall(name)]
    if not parts or TURNED.intersection(parts):
        return ""
    known = all(p.isdigit() or p in NEUTRAL or p in COMMENTS or p in INSERTS or p in LAYOUT for p in parts)
    for marked, words in (("comments", COMMENTS), ("insert", INSERTS), ("layout", LAYOUT)):
        if known and words.intersection(parts) or not whole and marked != "layout" and words.intersection((parts[0], parts[-1])):
            return marked
    return ""


def judged(tag: str, rest: str) -> tuple[bool, str]:
    """Whether an element is never part of an article, and what its names mark it as."""
    if tag in NEVER:
        return True, ""
    named = "form" if tag == "form" else ""
    if not rest or rest == "/" or tag in ("html", "body"):
        return False, named
    found = attributes(rest)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in NEVER_ROLE or _UNSEEN.search(found.get("style", "").lower()):
        return True, ""
    if tag in ("article", "main") or named:
        return False, named
    text = tag in PARAGRAPH or tag in HEADING or tag == "li"
    marks = [meaning(c, whole=text) for c in found.get("class", "").split()]
    if not text:
        marks.append(meaning(found.get("id", ""), whole=True))
    for mark in ("comments", "insert", "layout"):
        if mark in marks and not (text and mark == "layout"):
            return False, mark
    return False, ""


def tree_of(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All elements, parents first, and (element, text, characters in links) of each block, in page order."""
    root = Node("#root", None, False, "")
    nodes, found = [root], []
    path, places, blocks = [root], {}, [0]  # open elements; where each tag is open; where blocks are open
    block, parts, linked = root, [], 0

    def flush(nxt: Node) -> None:
        nonlocal block, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((block, text, min(linked, len(text))))
            parts.clear()
        block, linked = nxt, 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not path[-1].never:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if places.get("a"):
                linked += len(text.strip())

    def close(place: int) -> None:
        """End the element at `place` of the path and all inside it."""
        broke = False
        while len(path) > place:
            tag = path.pop().tag
            places[tag].pop()
            if tag not in INLINE:
                blocks.pop()
                broke = True
        if broke:
            flush(path[blocks[-1]])

    at = seen = 0  # up to `seen` the page has been read
    last, ends = page.rfind(">"), None
    while (at := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), at):
            mark = "-->" if page.startswith("<!--", at) else ">"
            ended = page.find(mark, at + 2)
            if ended < 0 and mark == ">":
                at += 1
                if at > last:
                    break
                continue
            add(page[seen:at])
            at = seen = ended + len(mark) if ended >= 0 else len(page)
            continue
        match = _TAG.match(page, at, at + TAG_CHARS) if at < last else None
        stop = match.end() if match else None
        if match is None and at < last and (match := _NAME.match(page, at)):
            ends = ends or TagEnds(page)
            far = ends.end(match.end())
            if far is None:  # a quote stays open: quotes are not minded
                match = _OPEN_QUOTE.match(page, at)
                stop = match.end() if match else None
            else:
                stop = far + 1
        if stop is None:
            at += 1
            continue
        add(page[seen:at])
        at = seen = stop
        tag = match["tag"]
        whole = match["rest"] if "rest" in match.re.groupindex else page[match.end() : stop - 1]
        tag = tag.lower()
        if match["end"]:
            where = places.get(tag)
            if where and (tag not in INLINE or where[-1] > blocks[-1]):
                close(where[-1])
            continue
        rest = whole or ""
        if tag in RAW:
            ended = _ENDS[tag].search(page, at)
            at = seen = ended.end() if ended else len(page)
            if tag == "textarea" and path[-1].unsure:
                path[-1].unsure.evidence = True
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush(block)
            continue
        if tag not in INLINE:
            k = len(blocks) - 1  # an open paragraph, or item of the same list, ends here
            while k > 0:
                open_tag = path[blocks[k]].tag
                if open_tag == "p" or open_tag in HEADING and tag in HEADING or tag in LISTED and open_tag == tag:
                    close(blocks[k])
                    break
                if tag not in LISTED or open_tag in LISTED[tag] or open_tag not in LISTED:
                    break
                k -= 1
        if rest.endswith("/") and tag in ("svg", "math", "path", "g"):
            continue
        up = path[-1]
        never, named = (True, "") if up.never else judged(tag, rest)
        child = Node(tag, up, never, named)
        if named in ("comments", "form") and up.unsure:
            up.unsure.evidence = True
        if tag not in INLINE:
            flush(child)
            blocks.append(len(path))
        places.setdefault(tag, []).append(len(path))
        path.append(child)
        nodes.append(child)
    add(page[seen:])
    flush(root)
    return nodes, found


_ENDS = {tag: re.compile(f"</{tag}\\b[^>]*>", re.I) for tag in RAW}


def points_of(text: str, linked: int) -> float:
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))


def measure(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Sum up characters, links, prose and points of what each element holds."""
    for node in nodes:
        node.own, node.chars, node.link_chars, node.prose, node.holds = 0.0, 0, 0, 0, False
    for block, text, linked in blocks:
        block.chars += len(text)
        block.link_chars += linked
        block.own += points_of(text, linked)
        block.prose += len(text) if len(text) >= PROSE and 2 * linked < len(text) else 0
        block.holds = True
    for node in reversed(nodes):  # children stand after their parents
        if node.up is not None and node.holds:
            up = node.up
            up.chars, up.link_chars, up.prose, up.own, up.holds = up.chars + node.chars, up.link_chars + node.link_chars, up.prose + node.prose, up.own + node.own, True


def beside(node: Node, page: Node) -> bool:
    """Whether the scores agree with the name of `node` that it is no part of the article."""
    rest, rest_prose = page.own - node.own, page.prose - node.prose
    if node.named == "comments":
        return rest_prose > 0 or node.prose == 0
    if node.named == "layout" and node.within:
        return node.evidence or node.link_share >= 1 / 3 or node.prose == 0
    return 3 * rest >= node.own or rest_prose >= node.prose


def without_beside(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The blocks that stand in no element which is beside the article."""
    if not any(n.named and n.holds for n in nodes):
        return blocks
    for node in nodes:
        node.never = node.up is not None and node.up.never or bool(node.named) and node.holds and beside(node, nodes[0])
    return [b for b in blocks if not b[0].never]


def main_text(page: str | None) -> str:
    """The article of a page as blocks joined by newlines."""
    nodes, blocks = tree_of(page or "")
    measure(nodes, blocks)
    kept = without_beside(nodes, blocks)
    if not kept:
        return ""
    if len(kept) < len(blocks):
        blocks = kept
        measure(nodes, blocks)
    least = 25 if any(len(t) >= 25 and b.tag not in HEADING and b.tag != "li" for b, t, _ in blocks) else 1
    for block, text, linked in blocks:
        if len(text) < least or block.tag in HEADING or block.tag == "li":
            continue
        points, share = points_of(text, linked), 1.0
        up = block.up if block.tag in PARAGRAPH and block.up else block
        for distance in range(1, REACH + 1):
            up.points += points * share
            share = 1 / (2 * distance) if distance < 2 else 1 / (3 * distance)
            up = up.up
            if up is None:
                break
    holding = [n for n in nodes if n.holds]
    for node in holding:
        node.points *= (1 - node.link_share) * (1.25 if node.semantic else 1)
    best = max(holding, key=lambda n: n.points)
    up = best
    while up is not None:  # all of an article belongs together
        if up.semantic and up.link_share < 0.5:
            best = up
        up = up.up
    best.kept = True
    if not best.semantic and best.up is not None:
        limit = max(10.0, best.points * 0.2)
        for node in holding:
            if node.up is best.up and node is not best:
                reads = node.tag in PARAGRAPH | HEADING and node.link_share < 0.25
                node.kept = node.points >= limit or reads or node.semantic
    for node in holding:
        node.kept |= node.up is not None and node.up.kept
    return "\n".join(text for block, text, _ in blocks if block.kept)


def extract_main(df: DataFrame, html_column: str = "html", out: str = "text") -> DataFrame:
    """Add `out`: the main text of the page in html_column."""
    from pyspark.sql import types as T

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                yield _add(part, out, pa.array([main_text(p.as_py()) for p in part.column(html_column)], pa.string()))

    return df.mapInArrow(run, _with(df.schema, out, T.StringType()))
