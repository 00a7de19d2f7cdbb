"""Main text of HTML pages by tree scoring.

Tags become a light tree (unclosed paragraphs and items end where HTML ends them; an end tag without a start, or
of an inline element around a block, is ignored).  Subtrees that never
hold the article are cut: scripts, styles, menus, footers, side bars, forms, hidden parts, and blocks that a
class, id or role calls an advert, notice, comment list and the like.  Inline elements are part of a sentence and are only
cut if hidden; a header inside the article that holds a heading stays.  Every paragraph then passes points
(one, one for each comma, one for each 100 characters up to three) to its parent, half of them to the
grandparent, and fewer upwards; a block of prose without paragraph tags is a paragraph, and prose that stands beside blocks
counts for its own block.  An ancestor's points are discounted by the share of its text that is in
links.  The best container is kept, with siblings whose points come near its own, and siblings that are
paragraphs of prose.  Text is decoded, white space in a block becomes one space, and blocks are joined in
page order by one space.

Every tag is opened and closed once and each search for an open tag ends at the one it closes, so the time is linear in the page, however deep.

Cases: a null or empty page gives an empty text; a page without paragraphs gives the text of its
article, main or body part; text without any tag is itself the article; nothing is capped; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|xmp|noembed)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)
    |<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)(?:>|\Z)
    |(?P<text>[^<]+|<)""",
    re.I | re.S | re.X,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CUT = frozenset("head script style noscript template nav footer aside form iframe button select option textarea input svg math canvas object embed dialog menu title audio video map".split())
#: parts of class, id and role values that name what is no article
AWAY = re.compile(
    r"(?:^|[_-])(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login"
    r"|nav\w*|menu\w*|breadcrumbs?|footer|foot|sidebar|side|aside|rail|widget\w*|related|recommend\w*|share|sharing|social|comments?|disqus|replies|respond|pagination|pager|toolbar|skip|search|form|copyright|legal"
    r"|contentinfo|complementary|navigation|dialog)(?:$|[_-])",
    re.I,
)
#: the same for headers, which stay if they hold a heading of the article
HEADER = re.compile(r"(?:^|[_-])(?:header|masthead|banner)(?:$|[_-])", re.I)
#: names that tell of something elsewhere on the page
ABOUT = re.compile(r"(?:has|with|no|without|is|not)[_-]", re.I)
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: an open tag that ends at the start of another: by the tags that end it
ENDS = {"p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
#: what the end of an implied element does not reach over
FENCE = frozenset("table td th ul ol dl div article section main body blockquote aside header".split())
PARAGRAPH = frozenset(["p", "pre", "td", "blockquote"])
#: parts of a table or list, which is kept whole
PIECES = frozenset("tr td th tbody thead tfoot li dt dd".split())


#: the other way round: the open tags that a tag ends
ENDED = {tag: frozenset(o for o, by in ENDS.items() if tag in by) for tag in frozenset().union(*ENDS.values())}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: blocks whose own prose counts like a paragraph, and the characters that make prose
HOLDER, PROSE = frozenset("html div section article main center dd figure details font".split()), 25


#: the other way round: the open tags that a tag ends
ENDED = {tag: frozenset(o for o, by in ENDS.items() if tag in by) for tag in frozenset().union(*ENDS.values())}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: blocks whose own prose counts like a paragraph, and the characters that make prose
HOLDER, PROSE = frozenset("html div section article main center dd figure details font".split()), 25


class Node:
    __slots__ = ("block", "children", "cut", "fence", "inside", "length", "linked", "opened", "parent", "points", "tag")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.points = self.length = self.linked = 0
        self.cut = ""
        inline = tag in INLINE and parent is not None
        #: the nearest block, and the nearest element that implied ends don't reach over; they count the open tags below
        self.block = parent.block if inline else self
        self.fence = self if parent is None or tag in FENCE else parent.fence
        self.opened: dict[str, int] | None = None if inline else {}
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))


def unwanted(tag: str, attrs: str, inside: bool) -> str:
    """Why a subtree is cut: 'away', 'header' (it stays if it is the article's) or '' (it isn't)."""
    if tag in CUT:
        return "away"
    why = "header" if tag == "header" and not inside else ""
    if not attrs.strip(" /"):
        return why
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
        return "away"
    if tag in ("html", "body", "article", "main") or tag in INLINE:
        return why
    names = [x for k in ("class", "id", "role") for x in found.get(k, "").split() if not ABOUT.match(x)]
    if any(map(AWAY.search, names)):
        return "away"
    return "header" if any(map(HEADER.search, names)) else why


def tree(html: str) -> Node:
    root = at = Node("html", None)
    opened: dict[str, int] = {}

    def close(at: Node, tags) -> Node:
        """Closes the nearest open element of ``tags``, which is there, and all in it; returns its parent."""
        while True:
            opened[at.tag] -= 1
            if at.tag in INLINE:
                at.block.opened[at.tag] -= 1
            elif at.tag in ENDS:
                at.fence.opened[at.tag] -= 1
            at, last = at.parent, at.tag
            if last in tags:
                return at

    for m in TOKEN.finditer(html):
        if (text := m["text"]) is not None:
            at.children.append(text)
            continue
        if m["raw"] or not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag in ("html", "body"):
            continue
        if m["end"]:
            where = at.block.opened if tag in INLINE else at.fence.opened if tag in ENDS else opened
            if where.get(tag):
                at = close(at, (tag,))
            continue
        while ends := [o for o in ENDED.get(tag, ()) if at.fence.opened.get(o)]:
            at = close(at, ends)
        node = Node(tag, at)
        node.cut = unwanted(tag, m["attrs"], node.inside)
        at.children.append(node)
        if tag not in VOID:
            opened[tag] = opened.get(tag, 0) + 1
            where = node.block.opened if tag in INLINE else node.fence.opened if tag in ENDS else None
            if where is not None:
                where[tag] = where.get(tag, 0) + 1
            at = node
    return pruned(root)


def pruned(root: Node) -> Node:
    """Without the subtrees to cut."""
    order = list(walk(root))
    headed: set[int] = set()
    for x in reversed(order):
        if x.tag in HEADINGS or id(x) in headed:
            headed.add(id(x.parent))
    for x in order:
        x.children = [c for c in x.children if c.__class__ is str or not c.cut or c.cut == "header" and c.inside and id(c) in headed]
    return root


def measure(root: Node) -> list[Node]:
    """Lengths and linked lengths of all nodes, which are returned in page order; without recursion, for deep pages."""
    order = list(walk(root))
    for x in reversed(order):
        for c in x.children:
            if c.__class__ is Node:
                x.length += c.length
                x.linked += c.linked
            else:
                x.length += len(c.strip())
        if x.tag == "a":
            x.linked = x.length
    return order


def text_of(nodes: list) -> str:
    """Blocks in page order."""
    parts: list[str] = []
    todo = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x.__class__ is Node:
            if x.tag not in INLINE or x.tag == "wbr":
                parts.append(" " if x.tag != "wbr" else "")
                todo.append(" " if x.tag != "wbr" else "")
            todo += reversed(x.children)
        else:
            parts.append(x)
    return " ".join(unescape("".join(parts)).split())


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def own_text(node: Node) -> tuple[str, int, bool]:
    """A block's text outside the blocks in it, the length of it that is in links, and whether there are blocks in it."""
    parts, linked, blocks, todo = [], 0, False, list(reversed(node.children))
    while todo:
        x = todo.pop()
        if x.__class__ is str:
            parts.append(x)
        elif x.tag in INLINE:
            linked += x.length if x.tag == "a" else 0
            todo += reversed(x.children)
        else:
            blocks |= x.tag not in VOID
            parts.append(" ")
    return "".join(parts).strip(), linked, blocks


def passed(order: list[Node]) -> list[Node]:
    """Points go from paragraphs to what they stand in; returns the nodes that got some."""
    scored: dict[int, Node] = {}
    for x in order:
        if not x.length or x.tag not in PARAGRAPH and x.tag not in HOLDER:
            continue
        text, linked, blocks = own_text(x)
        if not text or x.tag not in PARAGRAPH and (len(text) < PROSE or 2 * linked > len(text)):
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        up = x if x.parent is None or x.tag not in PARAGRAPH and (blocks or x.tag in ("article", "main")) else x.parent
        for level in range(5):
            up.points += points * (1.0 if not level else 1 / 2 if level == 1 else 1 / (level * 3))
            scored[id(up)] = up
            up = up.parent
            if up is None:
                break
    return list(scored.values())


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = tree(html)
    order = measure(root)
    scored = passed(order)
    if not scored:
        for tag in ("article", "main"):
            if found := [x for x in order if x.tag == tag]:
                return text_of([max(found, key=lambda x: x.length)])
        return text_of([root])
    best = max(scored, key=lambda x: x.points * (1 - density(x)))
    while best.tag in INLINE | PIECES and best.parent is not None:
        best = best.parent
    # an article holds its own headings and lists, also where a part of it scores best
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    top = best.points * (1 - density(best))
    if best.parent is None:
        return text_of([best])
    kept: list = []
    for c in best.parent.children:
        if c is best:
            kept.append(c)
        elif c.__class__ is Node:
            near = c.points * (1 - density(c)) >= max(10, 0.2 * top)
            prose = c.tag in ("p", "div") and c.length > 80 and density(c) < 0.25 or c.tag == "p" and 0 < c.length <= 80 and not c.linked and re.search(r"[.!?](\s|$)", own_text(c)[0])
            if near or prose:
                kept.append(c)
    return text_of(kept)


def walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo += [c for c in reversed(x.children) if c.__class__ is Node]


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text, n_chars (code points): one row for each page."""
    kept = pages.select(*keep, F.col(html_col).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[: len(keep)]) + ", text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=[main_text(x) for x in batch["text"]])
        give_back()

    return kept.mapInPandas(run, schema).withColumn("n_chars", F.char_length("text").cast("long"))
