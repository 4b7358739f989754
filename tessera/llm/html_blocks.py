"""HTML into text blocks: a tolerant reader shared by main-text extraction and interleaved sequences.

A block is what stands between two block-level tags; inline markup and line breaks do not end it. Each block knows its
links, its tags, what kinds of element surround it, and the element that holds it. A head without end tag ends where
the first thing comes that has no place in it, and an element whose content is skipped is only entered if it is closed.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
SKIPPED = frozenset("head title noscript template select option optgroup textarea button iframe object canvas svg audio video datalist".split())
CONTROLS = frozenset("title select option optgroup textarea button datalist".split())
IN_HEAD = frozenset("head base link meta title style script noscript template".split())
RAW = "script|style|xmp|noembed|noframes"
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements and words in class, id and role that stand for boilerplate.
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BOILER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription share sharing social related recommended pagination pager toolbar widget login signup register search copyright legal complementary contentinfo dialog comment comments commentlist disqus reply replies respond discussion".split())
CONTENT_TAGS = frozenset("article main".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({RAW})\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")

ARTICLE, BOILER, MARKED, HEADER, LINK, HIDDEN = 1, 2, 4, 8, 16, 32


@dataclass
class Block:
    text: str
    tag: str
    flags: int
    parent: int
    order: int
    link_chars: int = 0
    holder: int = 0
    #: The figure that the block is a caption of; the block's text between the media elements within it.
    caption_of: int = 0
    pieces: tuple[str, ...] = ()


@dataclass
class Media:
    """A media element met on the page: its tag and attributes, the blocks before it, and whether it stands within the next one."""

    tag: str
    attributes: dict[str, str]
    order: int
    figure: int
    inside: bool


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    media: list[Media] = field(default_factory=list)
    #: For each figure, its caption.
    captions: dict[int, str] = field(default_factory=dict)
    #: For each block-level element, the one around it.
    around: dict[int, int] = field(default_factory=dict)

    def distance(self, a: Block, b: Block, most: int = 8) -> int:
        """Steps through the tree of block-level elements between those that hold a and b; above most: most + 1."""
        x, y = {a.holder: 0}, {b.holder: 0}
        i, j = a.holder, b.holder
        for n in range(most + 1):
            if i in y:
                return min(most + 1, x[i] + y[i])
            if j in x:
                return min(most + 1, x[j] + y[j])
            i, j = self.around.get(i, 0), self.around.get(j, 0)
            x.setdefault(i, n + 1)
            y.setdefault(j, n + 1)
        return most + 1


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def flags_of(tag: str, text: str) -> int:
    out = 0
    if tag in CONTENT_TAGS:
        out |= ARTICLE
    elif tag in BOILER_TAGS:
        out |= BOILER
    elif tag == "header":
        out |= HEADER
    elif tag == "a":
        out |= LINK
    if text and not text.isspace():
        found = attributes(text)
        style = found.get("style", "").replace(" ", "").lower()
        if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
            out |= HIDDEN
        if tag not in ("html", "body", "article", "main"):
            names = " ".join(found[k] for k in ("class", "id", "role") if k in found)
            if names and any(w.lower() in BOILER_WORDS for w in WORDS.findall(names)):
                out |= MARKED
    return out


def read(source: str) -> Page:
    """The blocks and media of a page, in page order. Any text is accepted."""
    page = Page()
    # Open elements: tag, flags with those of the elements around, number, skipped.
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
    made, at, buffer, links = 0, 0, [], 0
    figures: list[int] = []
    lower, last_end = "", {}
    cuts: list[int] = []

    def flush() -> None:
        nonlocal buffer, links
        if buffer:
            text = SPACE.sub(" ", "".join(buffer)).strip()
            if text:
                tag, flags, number = next(((t, f, n) for t, f, n, _ in reversed(stack) if t in BLOCK or not t), ("", 0, 0))
                figure = figures[-1] if figures and any(x[0] == "figcaption" for x in stack) else 0
                if figure:
                    page.captions[figure] = f"{page.captions[figure]} {text}" if figure in page.captions else text
                parent = next((n for t, _, n, _ in reversed(stack[:-1]) if t in BLOCK or not t), 0) if len(stack) > 1 else 0
                page.blocks.append(Block(text, tag, flags & ~LINK, parent, len(page.blocks), links, number, figure, pieces()))
            buffer, links = [], 0
            cuts.clear()

    def pieces() -> tuple[str, ...]:
        ends = [0, *cuts, len(buffer)]
        return tuple(SPACE.sub(" ", "".join(buffer[a:b])).strip() for a, b in zip(ends, ends[1:], strict=False)) if cuts else ()

    def closed(tag: str, at: int) -> bool:
        """Whether an element with skipped content that begins here has an end; a form control has it before the next one."""
        nonlocal lower
        lower = lower or source.lower()
        if tag not in last_end:
            last_end[tag] = lower.rfind(f"</{tag}")
        if last_end[tag] < at:
            return False
        return tag not in CONTROLS or lower.find(f"<{tag}", at, lower.find(f"</{tag}", at)) < 0

    def write(raw: str) -> None:
        nonlocal links
        if stack[-1][0] == "head" and raw and not raw.isspace():
            close({"head"}, set())
        if raw and not stack[-1][3]:
            text = html.unescape(raw)
            buffer.append(text)
            if stack[-1][1] & LINK:
                links += len(text.strip())

    def close(names: set[str], scope: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                if any(x[0] == "figure" for x in stack[i:]) and figures:
                    figures.pop()
                del stack[i:]
                return
            if stack[i][0] in scope:
                return

    for m in TOKEN.finditer(source):
        write(source[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, end, rest = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag in BLOCK or tag in SKIPPED:
            flush()
        if end:
            if tag in VOID:
                continue
            close({tag}, set() if tag in BLOCK else {"td", "th", "table", "article", "body"})
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                write(" ")
            continue
        if tag in ("img", "source", "video", "audio"):
            inside = any(not x.isspace() for x in buffer)
            page.media.append(Media(tag, attributes(rest), len(page.blocks), figures[-1] if figures else 0, inside))
            if inside:
                cuts.append(len(buffer))
        if tag in VOID or rest.endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK and tag not in ("html", "body"):
            close({"p"}, {"td", "th", "table", "article", "section", "div", "li", "figure", "blockquote", "button"})
        if tag in CLOSED_BY:
            close(CLOSED_BY[tag], SCOPES[tag])
        if tag not in IN_HEAD and any(x[0] == "head" for x in stack):
            close({"head"}, set())
        if tag in SKIPPED and tag != "head" and not closed(tag, at):
            continue
        made += 1
        _, flags, _, skipped = stack[-1]
        if tag in BLOCK:
            page.around[made] = next((n for t, _, n, _ in reversed(stack) if t in BLOCK or not t), 0)
        if tag == "article":
            flags &= ~HEADER
        stack.append((tag, flags | flags_of(tag, rest), made, skipped or tag in SKIPPED))
        if tag == "figure":
            figures.append(made)
    write(source[at:])
    flush()
    return page
