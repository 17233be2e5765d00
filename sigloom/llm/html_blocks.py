"""Web pages as rows of leaf blocks with the features that the extraction model reads. Tolerates broken markup."""

from __future__ import annotations

import html
import math
import re
from typing import NamedTuple

#: In a tag a quote counts only behind "=", and one that is never closed ends with its tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_NAME_PARTS = re.compile(r"[a-z]+")

#: Fixed values of HTML: elements without content, with raw text, and those that break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style noscript template head title svg iframe object canvas audio video select option datalist textarea button".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends these open elements, up to the nearest of the barriers.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Ancestors that features name.
_TAGS = frozenset("article main section nav header footer aside form table ul ol li td th p div blockquote pre figure figcaption h1 h2 h3 h4 h5 h6 dl dd dt a b i em strong span label button address details".split())
_ENDS_P = BLOCK - {"br"}

#: Words in class, id and role that tell what a part of a page is for.
CUES = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs toc pagination pager skip",
    "head": "header masthead banner topbar logo brand hero",
    "foot": "footer foot copyright colophon legal bottom",
    "side": "sidebar aside related recommended widget rail promo teaser more also popular trending tags tagcloud",
    "note": "cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe signup dialog paywall",
    "ad": "ad ads advert advertisement adsense sponsor sponsored sponsors dfp",
    "talk": "comment comments reply replies respond discussion disqus responses reader",
    "form": "form login search searchbox register contact",
    "share": "share social sharing follow facebook twitter byline author meta date",
    "text": "article content post entry story main body text page prose",
}
_CUE = {word: cue for cue, words in CUES.items() for word in words.split()}
#: Behind these a name tells what else a page has (has-sidebar, layout-with-comments), not what this element is.
_ABOUT = frozenset("has no not with without is".split())
#: Elements that are a part of a page by their tag.
PARTS = frozenset("nav header footer aside form".split())
#: Words that tell the same as part of a longer name (commentlist, mainmenu).
_INSIDE = re.compile("breadcrumb|navbar|menu|masthead|footer|sidebar|related|cookie|consent|newsletter|popup|advert|sponsor|comment|share|social")


def cues_of(names: str) -> set[str]:
    """What the words of a class, id or role tell."""
    found = set()
    for name in names.lower().split():
        for word in _NAME_PARTS.findall(name):
            if word in _ABOUT:
                break
            if word in _CUE:
                found.add(_CUE[word])
            else:
                found.update(_CUE[w] for w in _INSIDE.findall(word))
    return found


class Node:
    """An element. What its ancestors tell is kept as sets of few names, so a page may be nested at any depth."""

    __slots__ = ("up", "tag", "cues", "hidden", "box", "tags", "chars", "holds", "above", "inside", "anchored", "near")

    def __init__(self, up: Node | None, tag: str, cues: frozenset[str], hidden: bool):
        self.up, self.tag, self.cues, self.hidden = up, tag, cues, hidden or (up is not None and up.hidden)
        self.box: Node = self if tag in BLOCK or up is None else up.box
        tags = up.tags if up else frozenset()
        self.tags = tags | {tag} if tag in _TAGS and tag not in PARTS and tag not in tags else tags
        self.chars, self.holds = 0, "none"
        if not self.hidden and (tag == "h1" or self.anchor()):
            what, node = "title" if tag == "h1" else "text", up
            while node is not None and node.holds != what and node.holds != "title":
                node.holds, node = what, node.up

    def anchor(self) -> bool:
        """Is this where an article may begin?"""
        return self.tag in ("article", "main") and not self.cues - {"text"} or self.cues == {"text"} and self.tag not in ("body", "html")

    def settle(self, total: int) -> None:
        """What the element and its ancestors tell, when the sizes of all are known; ancestors are settled first.

        A cue counts with the share of the page's text that its element has and with what it holds: one around a title
        or an article says how the page is laid out, not that its text is a menu. The names on body and html say nothing.
        """
        up = self.up
        marks = () if self.tag in ("body", "html") else (*sorted(self.cues - {"text"}), *([self.tag] if self.tag in PARTS else []))
        own = frozenset(f"{m}/{self.holds}/{min(2, 3 * self.chars // total)}" for m in marks)
        anchor = self.anchor()
        inside = (up.inside if up else frozenset()) | own
        self.above = (up.above if up else frozenset()) | (inside if anchor else frozenset())
        self.inside = frozenset() if anchor else inside
        self.anchored = anchor or (up is not None and up.anchored)
        self.near = own or (frozenset(["text"]) if anchor else up.near if up else frozenset())


class Block(NamedTuple):
    text: str
    node: Node
    linked: int  # characters of the text inside links
    hidden: bool


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in page order; character references decoded, white space made one space, none empty."""
    out: list[Block] = []
    page = page or ""
    root = Node(None, "", frozenset(), False)
    nodes, stack = [root], []
    buf: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        if not buf:
            return
        text = _SPACE.sub(" ", "".join(t for t, _ in buf)).strip()
        if text:
            linked = sum(len(_SPACE.sub(" ", t).strip()) for t, a in buf if a)
            node = stack[-1] if stack else root
            out.append(Block(text, node, min(linked, len(text)), node.hidden))
            node.chars += 0 if node.hidden else len(text)
        buf.clear()

    def close(k: int) -> None:
        nonlocal links
        if any(x.tag in BLOCK or x.tag in HIDDEN or x.hidden for x in stack[k:]):
            flush()
        links -= sum(x.tag == "a" for x in stack[k:])
        del stack[k:]

    def last(names, barriers=()) -> int:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in names:
                return k
            if stack[k].tag in barriers:
                break
        return -1

    def add(text: str) -> None:
        if text:
            buf.append((html.unescape(text), links > 0))

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            k = last({name}, {"table", "td", "th"} - {name} if name not in {"table", "tbody", "tr", "body", "html", "article", "div"} else ())
            if k >= 0:
                close(k)
            elif name in BLOCK:
                flush()
            continue
        if name in BLOCK:
            flush()
        if name in _ENDS_P and (k := last({"p"}, {"div", "article", "td", "th", "li", "section", "body"})) >= 0:
            close(k)
        if name in CLOSES and (k := _outermost(stack, *CLOSES[name])) >= 0:
            close(k)
        if name in VOID:
            continue
        cues, hide = set(), name in HIDDEN
        if m[3]:
            for key, *values in _ATTR.findall(m[3]):
                key, value = key.lower(), "".join(values)
                if key in ("class", "id", "role", "itemprop", "data-role", "aria-label"):
                    cues |= cues_of(value)
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.lower().replace(" ", ""):
                    hide = True
        if hide:
            flush()
        if m[3].endswith("/") and name not in BLOCK:
            continue
        nodes.append(Node(stack[-1] if stack else root, name, frozenset(cues), hide))
        stack.append(nodes[-1])
        links += name == "a"
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I).search(page, at)
            if name in ("textarea", "title"):
                add(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            close(len(stack) - 1)
    add(page[at:])
    flush()
    for node in reversed(nodes[1:]):
        node.up.chars += node.chars
    for node in nodes:
        node.settle(max(1, root.chars))
    return out


def _outermost(stack: list, names: set[str], barriers: set[str]) -> int:
    found = -1
    for k in range(len(stack) - 1, -1, -1):
        if stack[k].tag in barriers:
            break
        if stack[k].tag in names:
            found = k
    return found


def features(row: list[Block]) -> list[list[str]]:
    """Names of the features of each block: its own tags and text, and its neighbours' size and tags."""
    own: list[list[str]] = []
    sizes = []
    total = sum(len(b.text) for b in row) or 1
    before = 0
    for k, b in enumerate(row):
        n = len(b.text)
        words = b.text.count(" ") + 1
        size = min(8, int(math.log2(words + 1)))
        sizes.append(f"{size}{'L' if b.linked * 2 > n else ''}")
        node = b.node
        f = ["bias", f"size={size}", f"inner={node.box.tag}", f"link={min(4, 4 * b.linked // n)}", f"end={_end(b.text)}", f"comma={min(3, b.text.count(','))}"]
        f += [f"in={t}" for t in node.tags]
        f += [f"cue={c}" for c in node.inside] + [f"near={c}" for c in node.near] + [f"above={c}" for c in node.above]
        own_cues = {c for c in node.inside if c.split("/")[1] == "none"}
        if node.anchored:
            f.append("in-text-but" if own_cues else "in-text")
        elif not own_cues:
            f.append(f"bare-size={size}")
        f.append(f"at={min(4, 5 * before // total)}")
        f.append("first" if k == 0 else "last" if k == len(row) - 1 else "inside")
        if "©" in b.text:
            f.append("copyright")
        before += n
        own.append(f)
    for k, f in enumerate(own):
        f.append(f"prev={sizes[k - 1] if k else '-'}")
        f.append(f"next={sizes[k + 1] if k + 1 < len(own) else '-'}")
        f.append("same-parent" if k and _parent(row[k]) is _parent(row[k - 1]) else "new-parent")
    return own


def _parent(b: Block) -> Node | None:
    up = b.node.box.up
    return up.box if up else None


def _end(text: str) -> str:
    c = text[-1]
    return "stop" if c in ".!?…。\"'”»)" else "colon" if c in ":;" else "digit" if c.isdigit() else "letter" if c.isalpha() else "other"
