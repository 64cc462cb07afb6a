"""Main text of web pages by composite text density.

Every element has a density: its characters per tag, adjusted by how many of them are in links (as the page's body has it).
The element whose children's densities add up to most is the centre of the main text. The smallest density on the path from
the body to it is the threshold: what hangs off the path with a lower density is dropped, all below the centre stays. A centre
inside an article or main element stands for all of that element.
Parts that are not the article by their element, a whole class or their id (menus, forms, adverts, reader comments) never
count as text, unless a form or such a name is around most of the page's text.
"""
from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from wattlens.llm.arrow_text import add_columns

RAW = "script|style|textarea|title|noscript|iframe|template|svg|xmp"
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)"""
                   r"""|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)""",
                   re.S | re.I)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
             "strike strong sub sup time tt u var wbr".split())
NOT_ARTICLE = set("nav footer aside button select option menu dialog object audio video canvas head".split())
NOT_ARTICLE_NAMES = set("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
                        "disclaimer footer header login masthead menu nav navbar navigation newsletter notice notices pagination "
                        "popup promo promoted related replies reply share sharing sidebar signup social sponsor sponsored "
                        "subscribe toolbar widget".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dd": {"dd", "dt"},
          "dt": {"dd", "dt"}, "option": {"option"}}
CLOSES |= dict.fromkeys("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol "
                        "pre section table ul".split(), {"p"})


class Element:
    __slots__ = ("tag", "dropped", "named", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density")

    def __init__(self, tag: str, dropped: bool, named: bool, parent: "Element | None"):
        self.tag, self.dropped, self.named, self.parent, self.parts = tag, dropped, named, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0

    def children(self):
        return (x for x in self.parts if isinstance(x, Element))


def _boilerplate(tag: str, parent: Element) -> bool:
    if tag == "header":  # a page's header; the one of an article has its title
        while parent:
            if parent.tag in ("article", "main"):
                return False
            parent = parent.parent
        return True
    return tag in NOT_ARTICLE


def _named(tag: str, attributes: str) -> bool:
    """A form, or an element that a whole class, its id or its role calls boilerplate."""
    if tag == "form":
        return True
    if tag in HEADINGS or tag in ("body", "html", "article", "main") or "=" not in attributes:
        return False
    values = ((m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in ATTRIBUTE.finditer(attributes))
    return any(name in ("class", "id", "role") and not NOT_ARTICLE_NAMES.isdisjoint(value.split()) for name, value in values)


def parse(page: str) -> Element:
    """The page's elements as a tree; unclosed and misplaced tags are closed as browsers do in the common cases."""
    root = node = Element("html", False, False, None)
    done = 0
    for m in TOKEN.finditer(page):
        if m.start() > done:
            node.parts.append(page[done:m.start()])
        done = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            at = node
            while at and at.tag != tag:
                at = at.parent
            if at and at.parent:
                node = at.parent
            continue
        ends = CLOSES.get(tag)
        if ends:
            at = node
            while at and at.tag not in ends and (at.tag in INLINE or at.tag == "p"):
                at = at.parent
            if at and at.tag in ends and at.parent:
                node = at.parent
        child = Element(tag, node.dropped or _boilerplate(tag, node), _named(tag, m[4] or ""), node)
        node.parts.append(child)
        if tag not in VOID and not (m[4] or "").endswith("/"):
            node = child
    if done < len(page):
        node.parts.append(page[done:])
    return root


def _preorder(root: Element) -> list[Element]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(node.children())
    return out


def measure(nodes: list[Element]) -> None:
    """Characters, tags and their share in links, of every element; then its composite density."""
    for node in reversed(nodes):
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len("".join(part.split()))
            else:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    share = body.link_chars / max(1, body.chars)
    for n in nodes:
        if n.chars:
            base = math.log(n.chars / max(1, n.chars - n.link_chars) * n.link_chars + share * n.chars + math.e)
            value = (n.chars / max(1, n.link_chars)) * (max(1, n.tags) / max(1, n.link_tags))
            n.density = n.chars / max(1, n.tags) * math.log(max(value, 1.0)) / math.log(max(base, 1.0 + 1e-9))


def drop_named(nodes: list[Element]) -> None:
    """Drop forms and elements with a name of boilerplate, and all below them, unless they are a wrapper of the page: they hold
    most of the body's text, and the marked article if there is one."""
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    marked, around = False, set()
    for n in nodes:
        if n.tag in ("article", "main") and n.chars:
            marked, at = True, n.parent
            while at and id(at) not in around:
                around.add(id(at))
                at = at.parent
    for n in nodes:  # parents come first
        wrapper = 2 * n.chars > body.chars and (not marked or id(n) in around)
        n.dropped = n.dropped or bool(n.parent and n.parent.dropped) or (n.named and not wrapper)


def _blocks(parts: list, chosen, blocks: list[list[str]]) -> None:
    """Texts of the chosen elements, a list per block, in page order."""
    stack = [iter(parts)]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
        elif isinstance(part, str):
            blocks[-1].append(part)
        elif callable(part):
            part()
        elif chosen(part):
            if part.tag == "br":
                blocks[-1].append(" ")
            elif part.tag in INLINE:
                stack.append(iter(part.parts))
            else:
                blocks.append([])
                stack.append(iter([*part.parts, lambda: blocks.append([])]))


def main_text(page: str) -> str:
    nodes = _preorder(parse(page))
    measure(nodes)
    drop_named(nodes)
    kept = [n for n in nodes if not n.dropped]
    centre = max(kept, key=lambda n: sum(c.density for c in n.children() if not c.dropped and c.tag not in INLINE)
                 or (n.density if n.tag not in INLINE else 0.0))
    path, at = set(), centre
    while at and at.tag not in ("article", "main"):
        at = at.parent
    centre = at = at or centre  # a page that marks its article means all of it
    while at:
        path.add(id(at))
        at = at.parent
    threshold = min((n.density for n in nodes if id(n) in path and n.tag not in ("html", "head")), default=0.0)

    def chosen(node: Element) -> bool:
        if node.dropped:
            return False
        if id(node) in path or node.tag in INLINE:
            return True
        inside = node.parent is centre or id(node.parent) not in path  # below the centre, or below a part that was chosen
        return inside or node.density >= threshold

    blocks: list[list[str]] = [[]]
    _blocks(nodes[0].parts, chosen, blocks)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add `text`, the main text of the whole page, and `n_chars`, its code points.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one line break in page
    order. A null, empty or text-less page has an empty text; plain text without tags is one block. Columns named text or
    n_chars are replaced; equal pages get equal texts; an empty table stays empty. Memory is a multiple of the longest page.
    """
    def run(pages_: pa.Array) -> list:
        texts = [main_text(p) if p else "" for p in pages_.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return add_columns(pages, html_col, "text string, n_chars bigint", run, keep)


def op6_text_density(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])
