"""Reading HTML: a forgiving parser to containers and blocks of text, and the scoring of containers."""

from __future__ import annotations

import html
from collections.abc import Iterable
from dataclasses import dataclass, field

import regex

_TOKEN = regex.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<loose>/?[a-zA-Z][^<>]*)>", regex.DOTALL)
_ATTR = regex.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Element kinds of the HTML standard, and words that name what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option legend search""".split())
CLOSES_P = BLOCK - frozenset("body head html td th tr tbody tfoot thead caption option legend dd dt li".split())
DROPPED = frozenset("""head nav header footer aside dialog menu script style noscript template svg math iframe object canvas audio video button select
 textarea title noembed noframes xmp search fieldset label input datalist""".split())
CONTAINERS = frozenset("article main section div body td blockquote center html details figure".split())
WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr
 notice notices alert popup modal overlay paywall sidebar sidebars sidenav rail widget widgets nav navbar navigation navi menu menus breadcrumb breadcrumbs pagination
 pager masthead topbar footer foot colophon copyright comment comments commentlist reply replies responses discussion disqus respond share sharing social
 related recommended recommendations newsletter subscribe subscription signup login toolbar skip""".split())
#: Of WORDS, those that parts of an article are named by as well.
OPEN_WORDS = frozenset("alert foot related recommended recommendations discussion responses rail widget widgets skip".split())
HEAD_WORDS = frozenset("header head heading top".split())
OWN_WORDS = frozenset("article entry post story content body main text".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
COMMENT_WORDS = frozenset("comment comments reply replies".split())
_ENDS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": ("option", ("select", "datalist")),
         "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr"))}
_LISTS = frozenset("ul ol dl table".split())
_KEEP = frozenset("html body main".split())
_PRIOR = {"article": 1.5, "main": 1.3, "body": 0.6, "html": 0.3}


def _words(value: str) -> list[list[str]]:
    return [[w for w in regex.split(r"[-_:]+|(?<=[a-z])(?=[A-Z])", token) if w] for token in value.split()]


#: What a node's names say: nothing, perhaps clutter, clutter.
PLAIN, OPEN, CLUTTER = 0, 1, 2
#: A form is kept if it holds at least this share of the page's text; a part that may be clutter, of the article's.
FORM_SHARE, PART_SHARE = 0.5, 0.03
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _names_clutter(value: str) -> int:
    found = PLAIN
    for words in _words(value):
        low = [w.lower().rstrip("0123456789") for w in words]
        if low[:1] in (["has"], ["with"], ["no"], ["is"], ["without"]):
            continue
        if named := WORDS.intersection(low):
            found = max(found, OPEN if named <= OPEN_WORDS else CLUTTER)
        if HEAD_WORDS.intersection(low) and "header" in low and not OWN_WORDS.intersection(low):
            found = CLUTTER
    return found


@dataclass
class Page:
    """Containers (parent, tag, path, whether dropped) and text pieces (block, node, text) of a page, in page order."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["html"])
    path: list[str] = field(default_factory=lambda: [""])
    dropped: list[bool] = field(default_factory=lambda: [False])
    named: list[int] = field(default_factory=lambda: [PLAIN])
    pieces: list[tuple[int, int, str]] = field(default_factory=list)

    def add(self, parent: int, tag: str, attrs: str) -> int:
        """A new node; its path is its parent's with the tag and its classes, digits made alike."""
        found = {}
        if attrs and not attrs.isspace():
            for name, a, b, c in _ATTR.findall(attrs):
                found.setdefault(name.lower(), html.unescape(a or b or c))
        classes = sorted({regex.sub(r"[0-9]+", "0", x) for x in found.get("class", "").split()})
        style = found.get("style", "").replace(" ", "").lower()
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
        names = f"{found.get('class', '')} {found.get('id', '')}"
        clutter = PLAIN
        if tag not in _KEEP:
            clutter = _names_clutter(names) if tag != "article" else CLUTTER * bool(COMMENT_WORDS.intersection(w.lower() for ws in _words(names) for w in ws))
            clutter = CLUTTER if found.get("role", "").lower() in ROLES else clutter
        self.parent.append(parent)
        self.tag.append(tag)
        step = tag + "".join(f".{x}" for x in classes)
        self.path.append(f"{self.path[parent]}>{step}" if self.path[parent] else step)
        self.dropped.append(self.dropped[parent] or tag in DROPPED or hidden)
        self.named.append(clutter)
        return len(self.parent) - 1

    def settle(self) -> None:
        """Drop what names call clutter, unless the article is inside it, and small forms; then pass that on to what is below.

        Inside an article, a part whose name may be clutter (OPEN_WORDS) is dropped
        only if it is links rather than text, or a mere scrap: no section, no heading
        and under PART_SHARE of the article's text. A form goes unless it holds FORM_SHARE of the page's text.
        """
        holds = set()
        for node, tag in enumerate(self.tag):
            if (tag == "main" or tag == "article" and not self.named[node]) and not self.dropped[node]:
                up = self.parent[node]
                while up >= 0 and up not in holds:
                    holds.add(up)
                    up = self.parent[up]
        article = [-1] * len(self.parent)
        for node in range(1, len(self.parent)):
            article[node] = node if self.tag[node] in ("article", "main") and not self.named[node] else article[self.parent[node]]
        sizes: tuple[list[float], list[float]] | None = None
        for node in range(1, len(self.parent)):
            drop = self.named[node] != PLAIN and node not in holds
            if self.tag[node] == "form" or drop and self.named[node] == OPEN and article[node] >= 0:
                text, links = sizes = sizes or _sums(self)
                if self.tag[node] == "form":
                    drop = drop or text[node] < FORM_SHARE * text[0]
                else:
                    drop = text[node] <= links[node] or not (self.tag[node] == "section" or text[node] >= PART_SHARE * text[article[node]] or self._has_heading(node))
            self.dropped[node] = self.dropped[node] or self.dropped[self.parent[node]] or drop

    def _has_heading(self, node: int) -> bool:
        inside = {node}
        for below in range(node + 1, len(self.parent)):
            if self.parent[below] in inside:
                inside.add(below)
                if self.tag[below] in _HEADINGS:
                    return True
        return False


def parse(source: str) -> Page:
    """Read ``source``; unclosed, misnested and cut-off markup is accepted."""
    page, stack, at, block = Page(), [0], 0, 0
    size = len(source)

    def close(upto: int) -> None:
        del stack[upto:]

    while at < size:
        match = _TOKEN.search(source, at)
        text = source[at:match.start()] if match else source[at:]
        if text:
            cut = regex.search(r"<[a-zA-Z/!?][^<>]*\Z", text) if not match else None
            text = text[:cut.start()] if cut else text  # a tag that the page's end cuts off
            page.pieces.append((block, stack[-1], html.unescape(text)))
        if not match:
            break
        at = match.end()
        name = match["tag"] or (match["loose"] or "").split(maxsplit=1)[0].lstrip("/") if match["tag"] or match["loose"] else None
        if not name:
            if match[0].startswith("<![CDATA["):
                page.pieces.append((block, stack[-1], regex.sub(r"\]\]>\Z", "", match[0][9:])))
            continue
        tag, ends = name.lower(), bool(match["end"]) or (match["loose"] or "").startswith("/")
        if tag in BLOCK:
            block += 1
        if tag == "br":
            page.pieces.append((block, stack[-1], " "))
        if ends:
            where = next((i for i in range(len(stack) - 1, 0, -1) if page.tag[stack[i]] == tag), 0)
            if where:
                if tag not in BLOCK and any(page.tag[stack[i]] in BLOCK for i in range(where + 1, len(stack))):
                    del stack[where]
                else:
                    close(where)
            continue
        if tag in ("html", "body") and any(page.tag[n] == tag for n in stack[1:]):
            continue
        if tag == "body" and page.tag[stack[-1]] != "html":
            close(next((i for i, n in enumerate(stack) if i and page.tag[n] == "head"), len(stack)))
        if tag in CLOSES_P:
            where = next((i for i in range(len(stack) - 1, 0, -1) if page.tag[stack[i]] in ("p", "td", "th", "button", "object")), 0)
            if where and page.tag[stack[where]] == "p":
                close(where)
        if tag in _ENDS:
            own, bounds = _ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if page.tag[stack[i]] in bounds:
                    break
                if page.tag[stack[i]] in own if isinstance(own, tuple) else page.tag[stack[i]] == own:
                    close(i)
                    if not isinstance(own, tuple) or tag != "tr":
                        break
        node = page.add(stack[-1], tag, match["attrs"] or "")
        if tag in VOID or (match["attrs"] or "").rstrip().endswith("/") and tag in ("svg", "path", "use", "g"):
            continue
        if tag in RAW:
            end = regex.compile(rf"</{tag}[\s/>]", regex.IGNORECASE).search(source, at)
            at = end.start() if end else size
            stop = source.find(">", at) if end else -1
            at = stop + 1 if stop >= 0 else size
            continue
        stack.append(node)
    page.settle()
    return page


def text_under(page: Page, roots: Iterable[int] | None = None) -> str:
    """Blocks of the text that isn't dropped below any of ``roots`` (None: anywhere), white space made single, joined by two line ends."""
    inside: list[bool] = [roots is None] * len(page.parent)
    for root in roots or ():
        inside[root] = True
    for node in range(1, len(page.parent)):
        inside[node] = inside[node] or inside[page.parent[node]]
    blocks: dict[int, list[str]] = {}
    for block, node, text in page.pieces:
        if inside[node] and not page.dropped[node]:
            blocks.setdefault(block, []).append(text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(x for x in joined if x)


def _block_values(page: Page) -> list[tuple[int, float]]:
    """(node, characters) of each block that isn't dropped, those in links taken off: below zero where links prevail."""
    blocks: dict[int, list[float]] = {}
    linked = [False] * len(page.parent)
    for node in range(1, len(page.parent)):
        linked[node] = linked[page.parent[node]] or page.tag[node] == "a"
    for block, node, text in page.pieces:
        if not page.dropped[node] and (n := len(text.strip())):
            entry = blocks.setdefault(block, [node, 0.0])
            entry[1] += -n if linked[node] else n
    return [(int(node), value) for node, value in blocks.values()]


def container_scores(page: Page) -> dict[int, float]:
    """How much article text each container holds.

    A block's characters, those in links taken off twice, count whole for the
    container nearest to it, half for the next, a third for the one above.
    """
    scores: dict[int, float] = {}
    for node, value in _block_values(page):
        up, step = node, 0
        while up >= 0 and step < 3:
            if page.tag[up] in CONTAINERS:
                step += 1
                scores[up] = scores.get(up, 0.0) + value / step
            up = page.parent[up]
    return {n: s * _PRIOR.get(page.tag[n], 1.0) for n, s in scores.items() if s > 0}


def _sums(page: Page) -> tuple[list[float], list[float]]:
    """Characters below each node, of the blocks that are text and of those that are links."""
    text, links = [0.0] * len(page.parent), [0.0] * len(page.parent)
    for at, value in _block_values(page):
        (text if value > 0 else links)[at] += abs(value)
    for at in range(len(page.parent) - 1, 0, -1):
        text[page.parent[at]] += text[at]
        links[page.parent[at]] += links[at]
    return text, links


def article_around(page: Page, node: int) -> int:
    """The widest container from ``node`` up whose text beyond the one before it is more text than links.

    So headlines, leads and parts in sibling containers belong to the article.
    Containers and lists beside ``node`` that are links rather than text are
    dropped from ``page``; what names or tags call clutter has been before.
    """
    around, up = {0}, node
    while up > 0:
        around.add(up)
        up = page.parent[up]
    text, links = _sums(page)
    inside = [False] * len(page.parent)
    for at in range(1, len(page.parent)):
        inside[at] = at == node or inside[page.parent[at]]
        beside = at not in around and not inside[at]
        page.dropped[at] = page.dropped[at] or beside and (page.dropped[page.parent[at]] or page.tag[at] in CONTAINERS | _LISTS and links[at] > text[at])
    text, links = _sums(page)
    best, up = node, page.parent[node]
    while up >= 0:
        if page.tag[up] in CONTAINERS and text[up] - text[best] > links[up] - links[best]:
            best = up
        up = page.parent[up]
    return best


def share_inside(page: Page, roots: Iterable[int], own: int) -> float:
    """Share of the text below ``own`` that is also below any of ``roots``; 1 without text."""
    inside, mine = [False] * len(page.parent), [False] * len(page.parent)
    for root in roots:
        inside[root] = True
    mine[own] = True
    for node in range(1, len(page.parent)):
        inside[node] = inside[node] or inside[page.parent[node]]
        mine[node] = mine[node] or mine[page.parent[node]]
    sizes = [(len(text.strip()), inside[node]) for _, node, text in page.pieces if mine[node] and not page.dropped[node]]
    whole = sum(n for n, _ in sizes)
    return sum(n for n, ok in sizes if ok) / whole if whole else 1.0
