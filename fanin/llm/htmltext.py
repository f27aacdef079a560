"""HTML extraction by tag-path ratios.

A page is read into text nodes with their root-to-leaf tag path (tags and classes).  Per path, unlinked text length
and punctuation are aggregated over its nodes and divided by their number; both ratios are smoothed along the page,
neighbours of other parents counting less, and fused into one score.  What element names, roles, classes and hidden
styles say of a path lowers its score: to nothing for menus, footers, adverts, comments and the like, in part for
names that only mention such a word.  Paths above the threshold are content.

The content's region is all article and main elements if they hold half of the score, else the deepest container that
holds all content.  Of the region's other nodes those stay that lie between title and content or in a container of some, such as
headings and short paragraphs, and all of marked articles, unless their path is mostly links or its score was lowered.
A form, or an element of a telling class, that wraps most of the page's text is a container like any other.

Reading and scoring are linear in the page: elements are numbered with their parents, no node holds its whole path.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from fanin.llm.common import documents, map_text, ship

BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot
th thead tr ul""".split())
RAW = frozenset("script style textarea xmp iframe noembed noframes noscript title template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SILENT = frozenset("head button select object audio video canvas map".split())      # hold no text of the page
APART = frozenset("nav aside footer dialog menu fieldset".split())
ROLES = frozenset("""navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar
tablist status""".split())
HINTS = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adbox adsense sponsor sponsored sponsors
promo promos promotion promoted banner cookie cookies cookiebar consent gdpr notice notices alert popup popover modal overlay
newsletter subscribe subscription signup login paywall nav navbar navigation menu menus submenu breadcrumb breadcrumbs
pagination pager toolbar topbar masthead footer copyright colophon sidebar aside widget widgets related recommended
recommendations trending popular share sharing social comment comments commentlist respond reply replies disqus discussion
search skip tags disclaimer""".split())
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())   # may outweigh the article
#: Words that say where or in what form a part stands, not what it is about: "left-menu", "share-buttons".
PLAIN = frozenset("""a area article articles bar block body bottom box btn button buttons center col column container content
cta entry fixed floating form global group head header icons inline inner item items js left link links list main media
mobile module my news outer overlay page panel post posts primary reader right row secondary section site slot small stack
sticky story text thread title top unit user view wp wrap wrapper""".split())
WRAPPERS = frozenset("has no with without".split())       # beside them a hint says what a wrapper holds, not what it is
OWN_HEADERS = frozenset("article entry post content story section title".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "tbody": {"table"}, "tfoot": {"table"}}
CONTAINERS = frozenset("body div section main article center form".split())     # may be the region; a paragraph, item or cell is part of one
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")

OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
ENDS = re.compile("""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TELLING = re.compile(r"class|id|role|style|hidden", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

SMOOTH = {0: 0.4, 1: 0.24, 2: 0.06}     # weights along the page by distance
OTHER_PARENT = 0.1        # of the weight, for a neighbour of another parent
MARK_CHARS = 40           # characters of prose to a punctuation mark
THRESHOLD = 0.5           # of the mean score of a character, for a path to be content
PROSE = 150               # a score at which a path is content beside any other: a few sentences a node
MARKED_SHARE = 0.5        # of the score, for the marked articles to be the region
MOST_LINKS = 0.6          # link share of the characters from which a path of the region is left out
MENTION = 0.5             # of the score of a path whose names mention a hint among other words
OWN_HEADER = 0.5          # of the score of text in an article's header that is no heading


@dataclass
class Element:
    tag: str
    parent: int            # number of the element around it, 0 for none
    path: int              # number of the tag path
    weight: float = 1.0    # what its own names leave of a score
    kind: str = ""         # why: "element", "comments", "name", "mention", "header"
    form: int = 0          # the nearest form around it, itself included
    inline: bool = False
    in_article: bool = False


@dataclass
class Node:
    element: int
    path: int
    block: int
    heading: bool
    parts: list = field(default_factory=list)
    linked: int = 0
    text: str = ""
    own: int = 0           # unlinked characters
    weight: float = 1.0


@dataclass
class Page:
    elements: list = field(default_factory=lambda: [Element("", 0, 0)])
    nodes: list = field(default_factory=list)
    regions: set = field(default_factory=set)        # numbers of article and main elements
    mains: set = field(default_factory=set)


def _said(attrs: str, tag: str, in_article: bool) -> tuple[float, str, str, str]:
    """(weight, kind, role, class) that an element's attributes give it."""
    weight, kind, role, label = 1.0, "", "", ""
    names = [tag] if "-" in tag else []
    for name, *values in ATTRIBUTE.findall(attrs) if attrs and TELLING.search(attrs) else ():
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "role":
            role = value.lower()
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            weight, kind = 0.0, "element"
        elif name in ("class", "id"):
            names += value.split()
            if name == "class":
                label = value
    for one in names:
        words = {w.lower() for w in WORDS.findall(one)}
        hits = words & HINTS
        if "header" in words and not in_article and not words & OWN_HEADERS:
            hits = hits | {"header"}
        if not hits or words & WRAPPERS or kind == "element":
            continue
        if all(w in HINTS or w in PLAIN or w.isdigit() for w in words):
            weight, kind = 0.0, "comments" if hits & COMMENTS or kind == "comments" else "name"
        elif weight:
            weight, kind = MENTION, "mention"
    if role in ROLES:
        weight, kind = 0.0, kind or "name"
    return weight, kind, role, label


def parse(html: str) -> Page:
    """The page's text nodes in order.  Every element is read as the HTML standard nests it as far as blocks go:
    a block ends an open paragraph, items and cells end their like, an unknown end tag is ignored.  Inline and unknown
    elements count where their attributes tell them apart from the text around them; hidden ones do."""
    page = Page()
    elements = page.elements
    stack: list[int] = []
    held: Counter = Counter()          # open elements by tag
    silent = 0                         # open elements without text
    paths: dict[tuple[int, str], int] = {}
    block = link = 0
    current: Node | None = None
    missing: set[str] = set()          # quotes that do not occur any more
    plain = False                      # quotes are out of step: a tag ends at the next >

    def text(raw: str) -> None:
        nonlocal current
        if silent or not raw:
            return
        raw = entities.unescape(raw) if "&" in raw else raw
        if current is None:
            if raw.isspace():
                return
            top = stack[-1] if stack else 0
            e = elements[top]
            heading = e.tag in HEADINGS or bool(top) and elements[e.parent].tag in HEADINGS
            current = Node(top, e.path, block, heading)
            page.nodes.append(current)
        current.parts.append(raw)
        if link:
            current.linked += len(raw.strip())

    def close(spot: int) -> None:
        nonlocal silent, current
        for n in stack[spot:]:
            held[elements[n].tag] -= 1
            silent -= elements[n].tag in SILENT
        del stack[spot:]
        current = None

    def tag_end(at: int) -> int:
        """The position of the > that ends a tag, past quoted values; the text's length if there is none."""
        nonlocal plain
        first = at
        while not plain:
            m = ENDS.search(html, at)
            if not m:
                plain = True
                break
            if m[0] == ">":
                return m.start()
            end = -1 if m[0] in missing else html.find(m[0], m.end())
            if end < 0:
                missing.add(m[0])
                at = m.end()
            else:
                at = end + 1
        end = html.find(">", first)
        return size if end < 0 else end

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        m = OPEN.match(html, lt)
        if not m:
            text(html[at:lt + 1])
            at = lt + 1
            continue
        text(html[at:lt])
        comment, other, slash, name = m.groups()
        if comment:
            end = html.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        end = html.find(">", lt) if other else tag_end(m.end())
        at = size if end < 0 else min(size, end + 1)
        if other:
            continue
        attrs = html[m.end():end]
        name = name.lower()
        outside = name in BLOCK or name in SILENT
        if slash:
            if name == "a":
                link = 0
            elif name == "br":
                text(" ")
            if held[name] > 0:
                spot = next((i for i in range(len(stack) - 1, -1, -1) if elements[stack[i]].tag == name), None)
                if outside or not any(not elements[n].inline for n in stack[spot:]):
                    close(spot)
                    if outside:
                        block += 1
                        link = 0
            continue
        if name in RAW:
            close_tag = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            end = html.find(">", close_tag.end()) if close_tag else -1
            at = size if end < 0 else end + 1
            continue
        if name == "a":
            link = 1
        if name in VOID:
            if name in ("br", "hr", "img"):
                text(" ")
            continue
        above = elements[stack[-1]] if stack else elements[0]
        if outside:
            if name == "body":
                while stack and elements[stack[-1]].tag != "html":
                    close(len(stack) - 1)
            elif name != "head" and (held["p"] or name in HEADINGS or any(held[t] for t in SIBLINGS.get(name, ()))):
                cut = len(stack)
                for i in range(len(stack) - 1, -1, -1):
                    e = elements[stack[i]]
                    tag = e.tag
                    if tag == "p" or tag in SIBLINGS.get(name, ()) or tag in HEADINGS and name in HEADINGS:
                        cut = i
                    elif e.inline:
                        continue
                    elif cut < len(stack) or name not in SIBLINGS or tag in SCOPE[name] or tag not in ("div", "address"):
                        break
                if cut < len(stack):
                    close(cut)
            above = elements[stack[-1]] if stack else elements[0]
        weight, kind, role, label = _said(attrs, name, above.in_article) if attrs or "-" in name else (1.0, "", "", "")
        if not outside and weight == 1 and not held[name]:
            continue                    # an inline element like the text around it
        if name in ("html", "body", "main"):        # never apart by a class
            weight, kind = 1.0, ""
        elif name in APART or name == "header" and not above.in_article:
            weight, kind = 0.0, "element"
        elif name == "header" and weight:
            weight, kind = OWN_HEADER, "header"
        number = len(elements)
        key = (above.path, f"{name}.{re.sub(r'[0-9]+', '', label)}" if label else name)
        e = Element(name, stack[-1] if stack else 0, paths.setdefault(key, len(paths) + 1), weight, kind,
                    number if name == "form" else above.form, not outside, above.in_article or name in ("article", "main"))
        elements.append(e)
        stack.append(number)
        held[name] += 1
        silent += name in SILENT
        if not silent:
            if name == "article" or role == "article":
                page.regions.add(number)
            elif name == "main" or role == "main":
                page.regions.add(number)
                page.mains.add(number)
        current = None
        if outside:
            block += 1
            link = 0
    for n in page.nodes:
        n.text = "".join(n.parts)
        n.own = max(0, len(n.text.strip()) - n.linked)
    return page


def weigh(page: Page) -> list[Node]:
    """The page's nodes with their weights, but those in forms that wrap neither an article or heading nor most of the
    page's text.  An element of a telling name that wraps main, or a heading or article with most of the text that is
    not of comments and every article of the page, is not apart; comments may hold any share."""
    elements = page.elements
    kind = [""] * len(elements)                  # whether an element or one around it is of comments or apart
    for i, e in enumerate(elements[1:], 1):
        kind[i] = e.kind if e.kind in ("comments", "element") else kind[e.parent]
    clean = [0.0] * len(elements)                # unlinked characters outside comments and apart elements
    holds = [False] * len(elements)              # main, or a heading or article that is not apart
    for n in page.nodes:
        if not kind[n.element]:
            clean[n.element] += n.own
    for i, e in enumerate(elements):
        holds[i] = not kind[i] and (e.tag in HEADINGS or i in page.regions)
    mains = [i in page.mains and not kind[i] for i in range(len(elements))]
    articles = [int(i in page.regions and not kind[i]) for i in range(len(elements))]
    for i in range(len(elements) - 1, 0, -1):
        p = elements[i].parent
        clean[p] += clean[i]
        holds[p] |= holds[i] and elements[i].kind != "name"
        mains[p] |= mains[i]
        articles[p] += articles[i]
    weight = [1.0] * len(elements)
    shut = [False] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        wraps = 2 * clean[i] > clean[0]
        whole = mains[i] or wraps and holds[i] and articles[i] == articles[0]
        own = 1.0 if e.kind in ("name", "mention") and whole else e.weight
        weight[i] = min(weight[e.parent], own)
        shut[i] = shut[e.parent] or e.tag == "form" and not holds[i] and not wraps
    for n in page.nodes:
        e = elements[n.element]
        n.weight = weight[n.element]
        if n.heading and n.weight == OWN_HEADER and (e.kind != "header"):
            n.weight = 1.0
    page.regions = {i for i in page.regions if weight[i] > 0}
    return [n for n in page.nodes if not shut[n.element]]


def ratios(page: Page, nodes: list[Node]) -> np.ndarray:
    """Per node, its path's score: unlinked length and punctuation per node of the path, smoothed along the page and fused."""
    at = np.unique([n.path for n in nodes], return_inverse=True)[1]
    count = np.bincount(at)
    own = np.array([n.own for n in nodes], dtype=float)
    marks = np.array([len(PUNCTUATION.findall(n.text)) if n.own else 0 for n in nodes], dtype=float)
    parent = np.array([page.elements[n.element].parent for n in nodes])
    length, punctuation = (np.bincount(at, x)[at] / count[at] for x in (own, marks))
    ends, smooth = np.zeros(len(nodes)), [np.zeros(len(nodes)), np.zeros(len(nodes))]
    for far, share in SMOOTH.items():
        for to, of in {(slice(far, None), slice(0, len(nodes) - far)), (slice(0, max(0, len(nodes) - far)), slice(far, None))} if far else [(slice(None),) * 2]:
            w = np.where(parent[to] == parent[of], share, share * OTHER_PARENT)
            ends[to] += w
            for s, x in zip(smooth, (length, punctuation), strict=True):
                s[to] += w * x[of]
    length, punctuation = (s / ends for s in smooth)
    fused = np.sqrt(length * (MARK_CHARS * punctuation) + length)
    return np.bincount(at, fused)[at] / count[at]


def scores(page: Page, nodes: list[Node]) -> np.ndarray:
    """Per node, its path's fused ratio, lowered by what names and roles say; as it is where they speak against all."""
    weight = np.array([n.weight for n in nodes])
    score = ratios(page, nodes)
    return score * weight if (weight > 0).any() else score


def _container(page: Page, number: int) -> int:
    """The nearest container at or above an element; 0 for the whole page."""
    while number and page.elements[number].tag not in CONTAINERS:
        number = page.elements[number].parent
    return number


def _shared(page: Page, numbers) -> int:
    """The deepest container above all of the elements ``numbers``, 0 for the whole page; linear in the elements."""
    numbers = set(numbers)
    below = [0] * len(page.elements)
    for n in numbers:
        below[n] += 1
    for i in range(len(below) - 1, 0, -1):
        if below[i] == len(numbers):         # the last number of those around all is the deepest
            return _container(page, i)
        below[page.elements[i].parent] += below[i]
    return 0


def _under(page: Page, roots) -> list[bool]:
    """Per element, whether it is one of ``roots`` or lies in one."""
    out = [False] * len(page.elements)
    for i, e in enumerate(page.elements):
        out[i] = i in roots or bool(i) and out[e.parent]
    return out


def content_nodes(page: Page) -> list[Node]:
    nodes = weigh(page)
    if not nodes:
        return []
    score = scores(page, nodes)
    size = np.array([n.own for n in nodes], dtype=float)
    mean = (score * size)[score > 0].sum() / max(1.0, size[score > 0].sum())
    content = (score >= min(THRESHOLD * mean, PROSE)) & (score > 0)
    if not content.any():                    # no unlinked text at all
        return [n for n, s in zip(nodes, score, strict=True) if n.weight]
    marked = _under(page, page.regions)
    marked = np.array([marked[n.element] for n in nodes])
    mass = np.where(content, score * size, 0)
    by_mark = marked.any() and mass[marked].sum() >= MARKED_SHARE * mass.sum()
    if by_mark:
        inside = marked
    else:
        under = _under(page, {_shared(page, [n.element for n, c in zip(nodes, content, strict=True) if c])})
        inside = np.array([under[n.element] for n in nodes])
    kept = content & inside
    # headings and short neighbours: all of a marked article; else what lies between content or in its container
    full = np.array([n.weight for n in nodes]) == np.max([n.weight for n, i in zip(nodes, inside, strict=True) if i])
    titled = np.array([n.heading and page.elements[n.element].tag == "h1" for n in nodes])
    spots = np.flatnonzero(kept | inside & full & titled)
    between = np.zeros(len(nodes), dtype=bool)
    between[spots[0]:spots[-1] + 1] = True
    home = np.array([_container(page, n.element) for n in nodes]) if not by_mark else np.zeros(len(nodes), dtype=int)
    around = np.array([_container(page, page.elements[h].parent) if h else 0 for h in home])
    near = np.isin(home, np.unique(home[kept])) | np.isin(around, np.unique(home[kept]))
    headed = np.array([n.heading for n in nodes])
    kept |= inside & full & (between | near | headed)
    at = np.unique([n.path for n in nodes], return_inverse=True)[1]
    linked = np.bincount(at, [n.linked * k for n, k in zip(nodes, kept, strict=True)])
    whole = np.bincount(at, [len(n.text.strip()) * k for n, k in zip(nodes, kept, strict=True)])
    kept &= headed | (linked <= MOST_LINKS * whole)[at]
    return [n for n, k in zip(nodes, kept, strict=True) if k]


def extract(html: str | None) -> str:
    """The main text: blocks in page order joined by newlines, white space in a block as one space."""
    blocks: dict[int, list[str]] = {}
    for n in content_nodes(parse(html or "")):
        blocks.setdefault(n.block, []).append(n.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def with_main_text(pages: DataFrame, html_col: str = "html", keep=None) -> DataFrame:
    """Adds text and n_chars.  A null or empty page, or one without article text, has an empty text; pages are read
    one by one, so null ids, ties, repeated rows and empty tables need no rule; columns named like a new one are
    replaced."""
    def make():
        def run(texts):
            out = [extract(t) for t in texts]
            return None, [out, [len(t) for t in out]]
        return run
    return map_text(pages, html_col, make, "text string, n_chars long", keep)


def op3_html_extraction(spark, sf_dir):
    return with_main_text(documents(spark, sf_dir, "pages"), keep=["page_id", "url"])


ship(__name__)
