"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, halved at the grandparent and thinner beyond; a
container's points are discounted by the share of its text that stands in links. The best container, and siblings that are
nearly as good, make the article. Menus, forms, notices, adverts and comments never count, and are cut from the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|"
                   r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")
#: Fixed values of HTML: elements without content, elements whose content is no markup, and elements that break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table "
                  "tbody td tfoot th thead tr ul".split())
#: A start tag ends open elements of these kinds, up to a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body table ul ol dl article section main div aside nav header footer form".split())
#: Never part of an article, by element or by role.
DROPPED = frozenset("script style noscript iframe template svg canvas object embed nav footer aside form button select textarea "
                    "input dialog menu head title audio video map xmp noembed noframes label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Words of class and id names that mark what is not the article, and what may be it.
UNLIKELY = re.compile(r"(?:^|[-_\s])(?:ads?|advert[a-z]*|sponsor[a-z]*|promo[a-z]*|banner[a-z]*|cookie[a-z]*|consent[a-z]*|gdpr|"
                      r"notices?|noticebar|notification[a-z]*|popup[a-z]*|modal|overlay|comment[a-z]*|disqus[a-z]*|respond|replies|"
                      r"discussion|side-?bar[a-z]*|side|aside|widgets?|related[a-z]*|recommend[a-z]*|shar(?:e|ing)[a-z]*|social[a-z]*|"
                      r"newsletter[a-z]*|subscri[a-z]*|signup|login|menu[a-z]*|nav|navbar|navigation|breadcrumb[a-z]*|pagination|"
                      r"pager|footer[a-z]*|masthead|topbar|header[a-z]*|toolbar|skip|outbrain|taboola|tags|toc|copyright|legal|"
                      r"disclaimer)(?=$|[-_\s])", re.I)
NEVER = re.compile(r"(?:^|[-_\s])(?:ads?|advert[a-z]*|sponsor[a-z]*|promo[a-z]*|cookie[a-z]*|comment[a-z]*|side-?bar[a-z]*|"
                   r"related[a-z]*|teaser[a-z]*|newsletter[a-z]*)(?=$|[-_\s])", re.I)
LIKELY = re.compile(r"(?:^|[-_\s])(?:article|articlebody|article-?body|body|content|entry|main|post|story|text|page|prose)"
                    r"(?=$|[-_\s])", re.I)
HEAD = re.compile(r"(?:^|[-_\s])(?:article|post|entry|story|content)[-_]header(?=$|[-_\s])", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PARAGRAPH = frozenset("p pre td blockquote li dd h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "points", "chars", "link_chars")

    def __init__(self, tag: str, parent: "Node | None", dropped: bool, points: float) -> None:
        self.tag, self.parent, self.dropped, self.points = tag, parent, dropped, points
        self.children: list[Node | str] = []
        self.chars = self.link_chars = 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(text)} if text.strip() else {}


def _judge(tag: str, attrs: dict[str, str]) -> tuple[bool, float]:
    """Whether an element is never part of an article, and the points it starts with."""
    names = CAMEL.sub("-", f"{attrs.get('class', '')} {attrs.get('id', '')}".strip())
    if tag in DROPPED or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True, 0.0
    if re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return True, 0.0
    if names and tag not in ("html", "body", "main"):
        found = NEVER.search(names) if tag == "article" else UNLIKELY.search(names)
        # "article-header" is the head of the article, unlike "page-header"
        if found and not (HEAD.search(names) and not NEVER.search(names)):
            return True, 0.0
    points = {"article": 25.0, "main": 25.0, "section": 3.0, "div": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0}.get(tag, 0.0)
    return False, points + (25.0 if names and LIKELY.search(names) else 0.0)


def tree(page: str) -> Node:
    """Forgiving parse: unknown ends are skipped, open elements end with their parents, and text never gets lost."""
    root = node = Node("html", None, False, 0.0)
    at, n = 0, len(page)
    lower = None

    def text(piece: str) -> None:
        if piece:
            node.children.append(unescape(piece))

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            up = node
            while up is not None and up.tag != tag:
                # an end tag of an inline element does not reach out of its block; others reach up to the root
                up = None if tag not in BLOCK and up.tag in BLOCK else up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            elif tag == "p" and up is None:
                node.children.append(Node("p", node, False, 0.0))
            continue
        if tag in ("html", "body") and any(x == tag for x in _open(node)):
            continue
        if tag in BLOCK and (p := _nearest(node, "p")) is not None:
            node = p.parent
        if tag in CLOSES:
            up = node
            while up is not None and up.tag not in SCOPE:
                if up.tag in CLOSES[tag]:
                    node = up.parent
                up = up.parent
        dropped, points = _judge(tag, _attributes(m[3]))
        if tag == "header":
            dropped = dropped or not any(x in ("article", "main") for x in _open(node))
        if tag in ("article", "main") and not dropped:
            up = node  # what frames an article is no sidebar, whatever its name says
            while up is not None:
                up.dropped = up.dropped and up.tag not in ("div", "section", "form")
                up = up.parent
        child = Node(tag, node, dropped, points)
        node.children.append(child)
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            lower = lower if len(lower) == n else re.sub("[A-Z]+", lambda x: x[0].lower(), page)
            end = lower.find(f"</{tag}", at)
            child.dropped = True
            if end < 0:
                at = n
            else:
                close = page.find(">", end)
                at = n if close < 0 else close + 1
        elif tag not in VOID and not m[3].endswith("/"):
            node = child
    return root


def _open(node: Node | None) -> Iterator[str]:
    while node is not None:
        yield node.tag
        node = node.parent


def _nearest(node: Node | None, tag: str) -> Node | None:
    """The open element of that kind, unless a container of another kind stands between."""
    while node is not None and node.tag not in SCOPE:
        if node.tag == tag:
            return node
        node = node.parent
    return None


def blocks(node: Node, marks: list[tuple[Node, int]] | None = None) -> list[str]:
    """Text of the blocks below an element in page order; dropped elements and empty blocks are left out."""
    out: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        line = SPACE.sub(" ", "".join(inline)).strip()
        inline.clear()
        if line:
            out.append(line)

    stack: list[tuple[Node, Iterator]] = [(node, iter(node.children))]
    while stack:
        here, rest = stack[-1]
        for child in rest:
            if isinstance(child, str):
                inline.append(child)
            elif child.dropped:
                if child.tag in BLOCK:
                    flush()
            elif child.tag == "br":
                inline.append(" ")
            else:
                if child.tag in BLOCK:
                    flush()
                stack.append((child, iter(child.children)))
                break
        else:
            if here.tag in BLOCK:
                flush()
            stack.pop()
    flush()
    return out


def _measure(root: Node) -> list[Node]:
    """Every element that may count, children first, with the lengths of its text and of its links."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.dropped)
    order.reverse()
    for node in order:
        own = sum(len(SPACE.sub(" ", c)) for c in node.children if isinstance(c, str))
        inner = [c for c in node.children if isinstance(c, Node) and not c.dropped]
        node.chars = own + sum(c.chars for c in inner)
        node.link_chars = node.chars if node.tag == "a" else sum(c.link_chars for c in inner)
    return order


def main_text(page: str | None) -> str:
    """Blocks of the article, joined by an empty line; empty if there is none."""
    if not page:
        return ""
    root = tree(page)
    order = _measure(root)
    scored: dict[int, Node] = {}
    for node in order:
        direct = [c for c in node.children if isinstance(c, str)]
        holds = node.tag in PARAGRAPH or (node.tag in ("div", "section", "article", "main", "body", "html")
                                          and any(SPACE.sub("", c) for c in direct))
        if not holds or not node.chars:
            continue
        commas = sum(c.count(",") + c.count("，") + c.count("、") for c in _texts(node))
        points = 1 + commas + min(node.chars // 100, 3)
        up, level = (node.parent if node.tag in PARAGRAPH else node), 0
        while up is not None and level < 5:
            up.points += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            scored[id(up)] = up
            up, level = up.parent, level + 1
    if not scored:
        return "\n\n".join(blocks(root))
    value = {k: x.points * (1 - (x.link_chars / x.chars if x.chars else 0)) for k, x in scored.items() if x.chars}
    if not value:
        return ""
    ranked = [x for x in order if id(x) in value]
    best = max(ranked, key=lambda x: (value[id(x)], x.chars))
    framed = _framed(best)
    if framed is not None:
        return "\n\n".join(blocks(framed))
    chosen, limit = [], max(10.0, 0.2 * value[id(best)])
    for near in best.parent.children:
        if isinstance(near, str) or near.dropped:
            continue
        title = not chosen and near.chars < 300 and (near.tag == "h1" or _holds(near, "h1"))  # right above its article
        if title or near is best or value.get(id(near), 0.0) >= limit or _lone_paragraph(near):
            chosen.extend(blocks(near))
    return "\n\n".join(chosen)


def _framed(best: Node) -> Node | None:
    """The whole article that the page itself marks around the best container, or the root if that is the best."""
    for kind in ("article", "main"):
        up = best
        while up is not None:
            if up.tag == kind:
                return up
            up = up.parent
    return best if best.parent is None else None


def _texts(node: Node) -> Iterator[str]:
    stack = [node]
    while stack:
        x = stack.pop()
        for c in x.children:
            if isinstance(c, str):
                yield c
            elif not c.dropped:
                stack.append(c)


def _holds(node: Node, tag: str) -> bool:
    stack = [node]
    while stack:
        inner = [c for c in stack.pop().children if isinstance(c, Node) and not c.dropped]
        if any(c.tag == tag for c in inner):
            return True
        stack.extend(inner)
    return False


def _lone_paragraph(node: Node) -> bool:
    """A paragraph beside the best container that reads as text: long with few links, or a short sentence without any."""
    if node.tag != "p" or not node.chars:
        return False
    density = node.link_chars / node.chars
    text = " ".join(_texts(node)).strip()
    return density < 0.25 if node.chars > 80 else density == 0 and re.search(r"\.(?:\s|$)", text) is not None


def extract_main_text(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """`keep` and `text`, the article of every page.

    Null and empty pages have an empty text, as have pages of which nothing but menus and the like is left; markup that
    breaks off counts as it stands; repeated rows give equal texts, and an empty table no rows. Nothing depends on the
    length of a page. Columns beyond the named ones are ignored; a kept column may not be called `text`.
    """
    rows = pages.select(*[pages[f"`{k}`"] for k in keep], pages[f"`{html}`"].alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([main_text(x.as_py()) for x in b.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], [*keep, "text"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, text string")
