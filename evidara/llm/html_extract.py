"""Main text of web pages by tag-path ratios.

A tolerant reader turns a page into blocks of text, each with its root-to-leaf path of block
tags and class names.  For every path the text length and the punctuation of its blocks are
averaged; both ratios are smoothed over neighbouring blocks, fused with the share of text outside
links, and the paths whose fused ratio exceeds the threshold are content.

The core of the page is the deepest element that holds MOSTLY of the content text.  An article (or
else main) around it is the main text as the page itself names it, less the articles in it none of
whose paths are content (teasers) where others' are, and, in a main, less the elements outside the
core whose text is mostly links and no content.  Without either the core grows to its parent as
long as at least half of the text that this adds is content, too, or it adds nothing but headings.
All other blocks of the core are returned in page order, short ones too, except those inside
boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments), which is told by tag, role, class or id.  Classes and ids count whole (``sidebar``) or
as compounds of boilerplate, place and people words (``site-footer``, ``siteFooter``), not as
modifiers (``has-sidebar``); comments in the plural count in any compound (``nested-comments``)
without a modifying word (``comments-open``).  They never mark main, and an article only if other
text of an article or main isn't marked.  No such mark, but for reader comments and what is
hidden, stands on an element that holds most of the page's text outside links, WRAPPER characters
at least, with no article or main elsewhere: a form may wrap a whole page.

Formulas and the labels of drawings are text; what browsers don't show (scripts, templates,
fallbacks of players, annotations of formulas, descriptions of drawings) isn't.

Null and empty pages give an empty text, and so do pages of boilerplate alone.  Pages are read
whole, in time and memory in proportion to their length however deep their elements nest; each row
is its own page, so repeated rows give equal results and ties don't arise.  Extra columns pass
through; columns named like an output are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import defaultdict
from collections.abc import Iterator
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evidara.llm.common import ship_by_value, tidy

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:"[^"]*"|'[^']*'|[^'"<>])*+)>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: HTML element names by how they are treated.
RAW = frozenset("script style noscript template textarea title iframe select canvas audio video annotation annotation-xml desc metadata".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics "
    "svg circle clippath defs ellipse filter g image line lineargradient marker mask path pattern polygon polyline radialgradient rect stop symbol textpath tspan use view".split()
)
#: Inline elements that stand apart from what is before and after them.
APART = frozenset("mtd mtr text".split())
VOID = frozenset("area base br col embed hr img input link meta param source track".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form button menu dialog head fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in class names and ids that mark boilerplate.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay paywall "
    "sidebar sidebars aside rail widget widgets related recommended recommendations comment comments commentlist reply replies disqus discussion respond share sharing social menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer foot header masthead toolbar pagination pager login search hidden copyright alert toast".split()
)
#: Words that stand beside those in the names of boilerplate, not of what merely has some.
PLACE_WORDS = frozenset(
    "site page global main primary secondary top bottom list lists item items box boxes area block blocks container wrapper wrap inner outer section region slot slots unit units bar bars button buttons link links icon icons post posts entry "
    "article articles story stories form field module panel group zone holder tag tags text message policy count title heading body meta author".split()
)
#: Whole classes and ids of reader comments, which may outweigh the text that they are about.
COMMENT_WORDS = frozenset("comment comments commentlist reply replies disqus discussion respond".split())
#: Those of them that mark comments in any compound name, and the words that take that back.
COMMENT_PLURALS = frozenset("comments commentlist replies disqus".split())
MODIFIERS = frozenset("allow allows category closed disabled enabled format has hide hidden no non not off on open opened show status tag topic type with without".split())
#: Whose comments they are.
PEOPLE_WORDS = frozenset("blog byuser customer facebook guest member public reader readers user users visitor visitors wp".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
HOLDERS = frozenset("# html body article main section div td blockquote center form".split())
SMOOTH = [exp(-(d * d) / 2) for d in range(-2, 3)]
MOSTLY = 0.7  #: share of the content text that the core holds
WRAPPER = 200  #: characters of text outside links that clear an element of being boilerplate if they are most of the page's


class Element:
    __slots__ = ("tag", "parent", "at", "last", "depth", "path", "plain_label", "in_body", "cut", "named", "hidden", "comments", "off", "free", "chosen", "plain", "good", "all", "teaser")

    def __init__(self, tag: str, parent: Element | None, at: int, path: int, plain_label: bool = True):
        self.tag, self.parent, self.at, self.last, self.path = tag, parent, at, at, path  # elements at .. last are inside
        self.depth = parent.depth + 1 if parent else 0
        self.plain_label = plain_label  # no class or id in its label
        self.in_body = tag in ("article", "main") or bool(parent and parent.in_body)
        self.cut = self.named = self.hidden = self.comments = self.off = False  # boilerplate by tag or role, by class or id, ..., or by any element around
        self.free = self.chosen = self.plain = self.good = self.all = 0  # characters inside: outside links; of content; of neither boilerplate nor headings; of these of content; of all blocks
        self.teaser = False  # no content, by the scores


class Block:
    __slots__ = ("text", "owner", "links", "heading")

    def __init__(self, text: str, owner: Element, links: int, heading: bool):
        self.text, self.owner, self.links, self.heading = text, owner, links, heading


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(raw)} if "=" in raw else {}


def _words_of(attributes: dict[str, str]) -> set[str]:
    return {w for w in re.split(r"[^a-z]+", f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()) if w}


def _is_cut(tag: str, attributes: dict[str, str]) -> bool:
    return tag in BOILERPLATE_TAGS or attributes.get("role", "").lower() in BOILERPLATE_ROLES


def _is_hidden(raw: str, attributes: dict[str, str]) -> bool:
    if attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    return "hidden" in raw and bool(re.search(r"(^|\s)hidden(\s|=|/|$)", re.sub(r"""=\s*(?:"[^"]*"|'[^']*')""", "= ", raw)))


def _names(attributes: dict[str, str]) -> list[list[str]]:
    """The words of each class and id; ``siteFooter`` has two."""
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return [[w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", t)] for t in named.split()]


def _is_comments(tag: str, names: list[list[str]]) -> bool:
    if tag in ("html", "body", "main"):
        return False
    whole = lambda n: not COMMENT_WORDS.isdisjoint(n) and (len(n) == 1 or all(w in COMMENT_WORDS or w in PLACE_WORDS or w in PEOPLE_WORDS for w in n) and n[0] not in MODIFIERS)
    return any(whole(n) or not COMMENT_PLURALS.isdisjoint(n) and MODIFIERS.isdisjoint(n) for n in names)


def _is_named_boilerplate(tag: str, names: list[list[str]]) -> bool:
    if tag in ("html", "body", "main"):
        return False
    return any(not BOILERPLATE_WORDS.isdisjoint(n) and all(w in BOILERPLATE_WORDS or w in PLACE_WORDS or w in PEOPLE_WORDS for w in n) and not (tag == "article" and n[0] in MODIFIERS) for n in names)


def _add_up(elements: list[Element], name: str) -> None:
    """Add each element's figure to its parents'; children stand behind their parents."""
    for e in reversed(elements):
        if e.parent is not None:
            setattr(e.parent, name, getattr(e.parent, name) + getattr(e, name))


def _settle(blocks: list[Block], elements: list[Element]) -> None:
    """Mark what is boilerplate; what wraps most of the text isn't, if no article or main stands elsewhere."""
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.last = max(e.parent.last, e.last)
    for b in blocks:
        b.owner.free += len(b.text) - b.links
    _add_up(elements, "free")
    inside = lambda x, outer: outer.at <= x.at <= outer.last
    marked, own = [], 0  # outermost marked articles; text of articles and mains outside them
    last = -1
    for e in elements:
        if e.tag == "article" and e.named and e.at > last:
            marked.append(e)
            last = e.last
    for b in blocks:
        own += (len(b.text) - b.links) * b.owner.in_body
    if own == sum(e.free for e in marked):  # nothing else is named as the page's text
        for e in elements:
            if e.tag == "article":
                e.named = e.comments = False
    bodies = [e for e in elements if e.tag in ("article", "main") and e.free and not (e.tag == "article" and e.named)]
    for e in elements:
        if (e.named or e.cut) and not e.comments and e.free >= (0 if e.named and not e.cut else WRAPPER) and 2 * e.free > elements[0].free and all(inside(x, e) or inside(e, x) for x in bodies):
            # inside a body only boilerplate by class may be so large; around one nothing is boilerplate
            kept = e.tag != "article" and any(inside(e, x) for x in bodies)
            e.named, e.cut = e.named and kept, e.cut and kept
    for e in elements:
        e.off = e.cut or e.named or e.hidden or bool(e.parent and e.parent.off)


def read_blocks(page: str) -> tuple[list[Block], list[Element]]:
    """Blocks and elements of a page in page order."""
    top = Element("#", None, 0, 0)
    stack, elements, blocks = [top], [top], []
    paths: dict[tuple[int, str], int] = {}  # by the parent's path and the element's label
    open_tags: dict[str, int] = defaultdict(int)
    text: list[str] = []
    links = in_link = 0

    def flush() -> None:
        nonlocal links
        joined = " ".join(htmllib.unescape("".join(text)).split())
        text.clear()
        if joined:
            heading = any(e.tag in HEADINGS for e in stack[-3:])
            blocks.append(Block(joined, stack[-1], min(links, len(joined)), heading))
        links = 0

    def cut_to(i: int) -> None:
        for e in stack[i:]:
            open_tags[e.tag] -= 1
        del stack[i:]

    def close(names: tuple[str, ...], scopes: tuple[str, ...] = ()) -> None:
        """Pop to the nearest open element of these names, if none of the scopes is nearer."""
        if not any(open_tags[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                cut_to(i)
                return
            if stack[i].tag in scopes:
                return

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                text.append(piece)
                if in_link:
                    links += len(piece)
            continue
        tag, closing, raw = tag.lower(), m.group(1), m.group(3)
        if tag in RAW:
            if not closing and not raw.endswith("/"):
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag == "br":
            text.append(" ")
        elif tag in INLINE or tag in APART:
            if tag in APART:
                text.append(" ")
            if tag == "a":
                in_link = 0 if closing else 1
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif closing:
            flush()
            close((tag,))
            in_link = 0
        else:
            flush()
            close(("p", *HEADINGS), ("div", "article", "section", "main", "td", "li", "blockquote", "body"))
            if tag in CLOSES:
                close(CLOSES[tag], SCOPES[tag])
            if tag in ("article", "main"):  # these are never meant to be inside unclosed page furniture
                furniture = [i for i, e in enumerate(stack) if e.tag in BOILERPLATE_TAGS]
                if furniture:
                    cut_to(furniture[0])
            attributes = _attributes(raw)
            words = sorted(_words_of(attributes))[:3]
            key = (stack[-1].path, ".".join([tag, *words]))
            element = Element(tag, stack[-1], len(elements), paths.setdefault(key, len(paths) + 1), not words)
            names = _names(attributes)
            element.cut, element.hidden, element.named = _is_cut(tag, attributes), _is_hidden(raw, attributes), _is_named_boilerplate(tag, names)
            element.comments = _is_comments(tag, names)
            element.named = element.named or element.comments
            elements.append(element)
            if not raw.endswith("/"):
                stack.append(element)
                open_tags[tag] += 1
    flush()
    _settle(blocks, elements)
    return blocks, elements


def _usable(b: Block) -> bool:
    """Not boilerplate; a heading in the header of an article is the article's title."""
    if not b.owner.off:
        return True
    if not b.heading:
        return False
    e, header = b.owner, False
    while e is not None and e.off:
        if e.tag == "header" or e.tag in HEADINGS or e.tag == "hgroup":
            header = header or e.tag == "header"
        elif not e.plain_label or e.tag in BOILERPLATE_TAGS:
            return False
        e = e.parent
    return header and e is not None and e.in_body


def path_scores(blocks: list[Block]) -> list[float]:
    """Fused, smoothed tag-path ratio of every block."""
    sums: dict[int, list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    for b in blocks:
        s = sums[b.owner.path]
        s[0] += 1
        s[1] += len(b.text)
        s[2] += len(PUNCTUATION.findall(b.text))
        s[3] += b.links
    length = [sums[b.owner.path][1] / sums[b.owner.path][0] for b in blocks]
    points = [sums[b.owner.path][2] / sums[b.owner.path][0] for b in blocks]
    free = [1 - sums[b.owner.path][3] / max(1, sums[b.owner.path][1]) for b in blocks]

    def smooth(values: list[float]) -> list[float]:
        out = []
        for i in range(len(values)):
            near = [(SMOOTH[d + 2], values[i + d]) for d in range(-2, 3) if 0 <= i + d < len(values)]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    return [a * (0.1 + p) * f for a, p, f in zip(smooth(length), smooth(points), free, strict=True)]


def _drop_teasers(named: Element, core: Element, elements: list[Element]) -> None:
    """Mark what the scores reject inside the element that the page names as its text."""
    within = elements[named.at + 1 : named.last + 1]
    articles = [e for e in within if e.tag == "article" and e.all]
    some = any(e.good for e in articles)
    for e in within:
        rejected = e.tag == "article" and some and not e.good
        if not rejected and named.tag == "main" and e.all and not e.chosen and 3 * e.free < e.all:
            rejected = not core.at <= e.at <= core.last
        e.teaser = rejected or (e.parent is not named and e.parent.teaser)


def main_text(page: str | None) -> str:
    """The main text of a page: blocks joined by an empty line."""
    if not page:
        return ""
    blocks, elements = read_blocks(page)
    usable = [b for b in blocks if _usable(b)]
    if not usable:
        return ""
    scores = path_scores(usable)
    mean = sum(scores) / len(scores)
    spread = (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5
    best: dict[int, float] = defaultdict(float)
    for b, s in zip(usable, scores, strict=True):
        best[b.owner.path] = max(best[b.owner.path], s)
    content = {p for p, s in best.items() if s >= min(spread, mean)}
    for b in usable:
        size, good = len(b.text), b.owner.path in content
        b.owner.chosen += size * good
        b.owner.plain += size * (not b.heading)
        b.owner.good += size * (good and not b.heading)
        b.owner.all += size
    for name in ("chosen", "plain", "good", "all"):
        _add_up(elements, name)
    total = elements[0].chosen
    holders = [e for e in elements if e.tag in HOLDERS and e.chosen >= MOSTLY * total and not e.off]
    core = max(holders, key=lambda e: e.depth, default=elements[0])
    named = None
    for tag in ("article", "main"):
        up = core
        while named is None and up is not None:
            named = up if up.tag == tag else None
            up = up.parent
    if named is not None:
        _drop_teasers(named, core, elements)
        core = named
    else:
        while core.parent is not None and 2 * (core.parent.good - core.good) >= core.parent.plain - core.plain:
            core = core.parent
    return "\n\n".join(b.text for b in usable if core.at <= b.owner.at <= core.last and not b.owner.teaser)


def extract_main_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add text and n_chars (code points) to ``pages``; ``keep`` names the columns kept."""
    made = ["text", "n_chars"]
    kept = [c for c in (pages.columns if keep is None else keep) if c not in made]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(html)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, *made])

    return pages.select(*dict.fromkeys([*kept, html])).mapInArrow(tidy(run), schema)


ship_by_value(__name__)
