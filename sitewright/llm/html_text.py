"""Main text of web pages by composite text density.

A page becomes a tree of elements. Elements that are boilerplate by kind (menus, scripts, footers ...) are left out, then forms
that consist of controls, then what its class, id or role marks as boilerplate (adverts, comments ...), unless a first choice by
density falls into it or most of the page's text stands in it: that is a frame around the article. Every other node gets a density: characters per tag, adjusted by the share of link characters and link tags. The node
whose children's densities sum highest holds the article; the least density on its path up to the body is the threshold for
further blocks.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import free_name, others, quoted

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {k: re.compile(rf"</{k}(?=[\s/>])", re.I) for k in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements that are never article text
DROPPED = frozenset(
    "head script style textarea title iframe noembed noframes noscript template svg canvas embed audio video map "
    "nav footer aside button select option optgroup datalist input menu annotation annotation-xml".split()
)
#: elements that are left out where they are forms indeed, or windows that are not part of the article
FORMS = frozenset("form fieldset dialog".split())
CONTROLS = frozenset("input textarea select button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup "
    "time tt u var wbr nobr label math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow "
    "ms mspace msqrt mstyle msub msubsup msup mtext munder munderover none semantics annotation annotation-xml".split()
)
#: what a start tag closes: these open elements, up to the scope they end at
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section summary table ul li dd dt".split()
)
SIBLINGS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])), "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
SCOPES = frozenset("table td th button caption object html body template".split())
#: words of class, id or role that mark boilerplate
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner nav navbar navigation menu menubar topbar breadcrumb "
    "breadcrumbs sidebar aside rail widget widgets footer foot masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup login signin comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations "
    "pagination pager search searchbox skip toolbar copyright disclaimer form contentinfo complementary dialog".split()
)
#: marks of what readers wrote
TALK = frozenset("comment comments commentlist disqus reply replies respond".split())
HEADERS = frozenset("header head topheader pageheader siteheader".split())
#: words that may stand beside a mark in one name ("site-footer", "related-posts"); any other word makes it another thing ("has-sidebar", "related-work")
BESIDE = frozenset(
    "site page global main primary secondary left right top bottom upper lower first second container wrapper wrap holder box area section block panel module component "
    "list lists item items inner outer bar link links button buttons btn btns icon icons post posts entry article articles story stories thread body title heading text "
    "message msg policy blog js wp el mobile desktop sticky fixed floating group column col row slot unit space zone region placeholder google single default big small "
    "media".split()
)
#: elements that an id names as a part of the page rather than of a text
PARTS = frozenset("div ul ol table td".split())
SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
ARTICLE = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTROL_CHARS = 100  # characters of prose that a form's control outweighs
LEAST_ARTICLE = 100  # characters beside comments that are an article for sure


def _names(value: str) -> Iterator[set[str]]:
    """Words of each name in a class, id or role."""
    for name in value.split():
        yield {w.lower() for w in SPLIT.split(name) if w}


def _marked(tag: str, attributes: str) -> tuple[bool, str, bool]:
    """Whether the element is hidden; by which kind of name it is marked as boilerplate; whether it is a header.

    Kinds: ``talk`` (what readers wrote), ``name``, ``id`` and ``id talk`` (marked by its id only), or none.
    """
    header = tag == "header"
    if not attributes or tag in ("html", "body"):
        return False, "", header
    low = attributes.lower()
    if not ("class" in low or "id" in low or "role" in low or "hidden" in low or "style" in low):
        return False, "", header
    kind = ""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for words in _names(value):
                if words & MARKS and words <= MARKS | BESIDE and tag not in ARTICLE:
                    talk = bool(words & TALK)
                    if name != "id":
                        kind = "talk" if talk or kind == "talk" else "name"
                    elif not kind:
                        kind = "id talk" if talk else "id"
                elif words & HEADERS and words <= HEADERS | BESIDE:
                    header = True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, kind, header
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, kind, header
    return False, kind, header


class Node:
    __slots__ = (
        "attributes", "chars", "children", "controls", "density", "header", "items", "labels", "link", "link_chars", "link_tags", "longest", "mark", "parent", "plain", "prose",
        "sum", "tag", "tags", "dropped",
    )

    def __init__(self, tag: str, parent: Node | None, attributes: str = "") -> None:
        self.tag, self.parent, self.attributes, self.mark = tag, parent, attributes, ""
        self.children: list[Node] = []
        self.items: list = []  # text pieces and child nodes in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.link = self.dropped = self.header = False


def parse(page: str) -> Node:
    """The page's elements below a root. End tags that match nothing are ignored, open elements end with their parent."""
    root = Node("#root", None)
    stack, at, n = [root], 0, len(page)
    places: dict[str, list[int]] = {}  # per tag where it stands in the stack, so that no step walks the stack
    blocks: list[int] = []  # where elements other than inline ones stand
    scopes: list[int] = []
    body_seen = False

    def push(node: Node) -> None:
        k = len(stack)
        stack.append(node)
        places.setdefault(node.tag, []).append(k)
        if node.tag not in INLINE:
            blocks.append(k)
        if node.tag in SCOPES:
            scopes.append(k)

    def cut(k: int) -> None:
        while len(stack) > k:
            tag = stack.pop().tag
            places[tag].pop()
            for marks in (blocks, scopes):
                if marks and marks[-1] == len(stack):
                    marks.pop()

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def text(piece: str) -> None:
        if piece:
            stack[-1].items.append(html.unescape(piece) if "&" in piece else piece)

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            k = last(tag)
            if tag in ("body", "html") or not k:
                continue
            if tag in INLINE and blocks and blocks[-1] > k:
                continue  # an inline end does not close blocks opened since
            cut(k)
            continue
        if tag in ("html", "body"):
            if tag == "body" and not body_seen:  # head ends
                body_seen = True
                cut(1)
                if root.children and root.children[0].tag == "html":
                    push(root.children[0])
            elif last(tag) or tag == "body":
                continue
        elif stack[-1].tag == "head" and tag not in ("meta", "link", "base", "title", "style", "script", "noscript", "template"):
            cut(len(stack) - 1)
        if tag in CLOSES_P and last("p") > (scopes[-1] if scopes else 0):
            cut(last("p"))
        if tag in SIBLINGS:
            ends, scope = SIBLINGS[tag]
            if last(*ends) > last(*scope):
                cut(last(*ends))
        parent, attributes = stack[-1], m[3] if m[2] else m[6]
        node = Node(tag, parent, attributes)
        hidden, node.mark, node.header = _marked(tag, attributes)
        node.dropped = tag in DROPPED or hidden
        node.link = parent.link or tag == "a"
        parent.children.append(node)
        parent.items.append(node)
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = n if end is None else end.start()
            if end is not None:
                close = page.find(">", at)
                at = n if close < 0 else close + 1
        elif tag not in VOID:
            push(node)
    return root


def _order(root: Node) -> list[Node]:
    """Nodes that are not left out, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.dropped:
            out.append(node)
            todo.extend(reversed(node.children))
    return out


def _attribute(node: Node, name: str) -> str | None:
    return next((m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(node.attributes) if m[1].lower() == name), None)


def _weigh(nodes: list[Node]) -> None:
    """Per subtree: characters outside links, those of prose and of labels, the longest block of prose, controls.

    Text beside a control in one block is a label.
    """
    for node in reversed(nodes):
        node.plain = node.prose = node.labels = node.longest = node.controls = 0
        text, here = 0, False
        for x in node.items:
            if isinstance(x, str):
                text += 0 if node.link else len("".join(x.split()))
            elif x.tag in CONTROLS:
                if x.tag != "input" or (_attribute(x, "type") or "").lower() != "hidden":
                    node.controls += 1
                    here = True
            elif not x.dropped:
                node.plain += x.plain
                node.controls += x.controls
                node.labels += x.labels
                if x.tag in INLINE:
                    text += x.prose
                    here = here or x.controls > 0
                else:
                    node.prose += x.prose
                    node.longest = max(node.longest, x.longest)
        node.plain += sum(len("".join(x.split())) for x in node.items if isinstance(x, str)) if not node.link else 0
        if node.tag == "label" or (here and node.tag not in INLINE):
            node.labels += text
        else:
            node.prose += text
            node.longest = max(node.longest, text)


def _is_form(node: Node, body: Node) -> bool:
    """Whether a form, or a label, is one: mostly controls and labels, and not a frame around the page's text."""
    if node.tag == "label":
        up = node.parent
        return node.controls > 0 or (up.controls > 0 and 2 * up.labels > up.labels + up.prose)
    if not node.controls or node.prose > node.labels + CONTROL_CHARS * min(node.controls, 4):
        return False
    return not (node.longest >= CONTROL_CHARS and node.prose > node.labels and 2 * node.prose > body.prose)


def _body(nodes: list[Node]) -> Node:
    return next((x for x in nodes if x.tag == "body"), nodes[0])


def _below(nodes: list[Node], body: Node) -> list[Node]:
    inside, below = {id(body)}, [body]
    for x in nodes:
        if x.parent is not None and id(x.parent) in inside and x is not body:
            inside.add(id(x))
            below.append(x)
    return below


def _above(node: Node) -> Iterator[Node]:
    """The node and what it stands in."""
    while node is not None:
        yield node
        node = node.parent


def _titled(node: Node) -> bool:
    """Whether the node's id is made from the heading it begins with."""
    first = next((x for x in node.items if not isinstance(x, str) or x.strip()), None)
    if isinstance(first, str) or first is None or first.tag not in HEADINGS:
        return False
    words = set().union(*_names(_attribute(node, "id") or ""))
    todo, text = [first], []
    while todo and len(text) < 100:  # a title, not what an open heading swallows
        x = todo.pop()
        if isinstance(x, str):
            text.append(x.lower())
        elif not x.dropped:
            todo.extend(reversed(x.items))
    return bool(words) and words <= set(SPLIT.split(" ".join(text)))


def _leave_out(root: Node) -> list[Node]:
    """Drop forms and what is marked as boilerplate, but no frame around the article; returns the nodes that stay."""
    nodes = _order(root)
    if not any(x.mark or x.header or x.tag in FORMS or x.tag == "label" for x in nodes):
        return nodes
    body = _body(nodes)
    _weigh(nodes)
    forms = [x for x in nodes if x.tag in FORMS or x.tag == "label"]
    for x in forms:
        x.dropped = _is_form(x, body)
    if forms:
        nodes = _order(root)
        _weigh(nodes)

    # what readers wrote counts as the article only where there is nothing else
    talk = {id(x) for x in nodes if x.mark == "talk" or (x.mark == "id talk" and x.tag in PARTS)}
    if talk:
        holders: set[int] = set()
        for x in nodes:
            if x.tag in ("h1", "main"):
                for y in _above(x):
                    if id(y) in holders:
                        break
                    holders.add(id(y))
        outer, within, said, heads = [], set(), 0, 0
        for x in nodes:
            if x.parent is not None and id(x.parent) in within:
                within.add(id(x))
            elif id(x) in talk and id(x) not in holders:
                within.add(id(x))
                outer.append(x)
                said += x.plain
            elif x.tag in HEADINGS:
                heads += x.plain
        rest = body.plain - said - heads
        if rest > 0 and (rest >= LEAST_ARTICLE or 20 * rest >= said):
            for x in outer:
                x.dropped = True
            nodes = _order(root)
            _weigh(nodes)

    measure(nodes, body)
    best = max(_below(nodes, body), key=lambda x: x.sum)
    if not best.sum:
        best = body
    path = {id(x) for x in _above(best)}
    home = next((x for x in reversed(list(_above(best))) if x.tag in ARTICLE), best)
    while home.tag == "section" and home is not body:
        home = home.parent
    starts = {id(x): i for i, x in enumerate(nodes)}
    ends = dict(starts)
    for x in reversed(nodes):
        ends[id(x)] = max(ends[id(x)], starts[id(x)] + 1)
        if x.parent is not None:
            ends[id(x.parent)] = max(ends[id(x.parent)], ends[id(x)])
    articles = [x for x in nodes if x.tag in ARTICLE]
    before = sorted((ends[id(a)], a.plain) for a in articles)
    after = sorted((-starts[id(a)], a.plain) for a in articles)
    most_before = list(accumulate((n for _, n in before), max, initial=0))
    most_after = list(accumulate((n for _, n in after), max, initial=0))

    def frame(x: Node) -> bool:
        if id(x) not in path and 2 * x.plain <= body.plain:
            return False
        other = max(most_before[bisect_right(before, (starts[id(x)], math.inf))], most_after[bisect_right(after, (-ends[id(x)], math.inf))])
        return not other or 4 * other < x.plain  # else the author marked another place

    todo = [(root, False, False)]
    while todo:
        x, in_article, in_home = todo.pop()
        if x.dropped:
            continue
        mark = x.mark
        if mark.startswith("id"):
            section = x.tag not in PARTS or "section" in (_attribute(x, "class") or "").split()
            if x.tag in HEADINGS:
                mark = ""
            elif in_home or in_article:
                if section or (mark == "id" and _titled(x)):
                    mark = ""
            elif mark == "id" and _titled(x):
                mark = ""
        away = mark or (x.header and not in_article) or (x.tag in FORMS and not (in_home or in_article or (home is body and x.tag != "dialog")))
        if away and x is not body and not frame(x):
            x.dropped = True
            continue
        in_article = in_article or x.tag in ARTICLE
        in_home = in_home or (x is home and x is not body)
        todo.extend((c, in_article, in_home) for c in reversed(x.children))
    return _order(root)


def measure(nodes: list[Node], body: Node) -> None:
    """Composite text densities and the sums of the children's."""
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = node.sum = 0.0
        for x in node.items:
            if isinstance(x, str):
                c = len("".join(x.split()))
                node.chars += c
                if node.link:
                    node.link_chars += c
        for c in node.children:
            if not c.dropped:
                node.chars += c.chars
                node.tags += c.tags + (c.tag == "a" or c.tag not in INLINE)  # formatting is not structure
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(nodes):
        if node.chars:
            c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
            plain = max(c - node.link_chars, 1)
            base = math.log(c / plain * node.link_chars + share * c + math.e)
            node.density = c / t * math.log(max(c / lc * t / lt, 1.0)) / max(1.0, math.log(base))
        node.sum = sum(x.density for x in node.children if not x.dropped) if node.tag not in INLINE else 0.0


def _blocks(nodes: list[Node], chosen: set[int]) -> str:
    """Text of the chosen nodes in page order: one line per block, white space as one blank."""
    lines: list[str] = []
    pieces: list[str] = []

    def close() -> None:
        if pieces and (line := " ".join("".join(pieces).split())):
            lines.append(line)
        pieces.clear()

    todo: list = [(nodes[0], False)]
    while todo:
        x, inside = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            if inside:
                pieces.append(x)
        elif x.dropped:
            if x.tag not in INLINE:
                close()
        elif x.tag in ("br", "wbr"):
            pieces.append(" " if x.tag == "br" else "")
        else:
            here = inside or id(x) in chosen
            block = x.tag not in INLINE or here != inside
            if block:
                close()
                todo.append((None, False))
            todo.extend((y, here) for y in reversed(x.items))
    close()
    return "\n".join(lines)


def main_text(page: str | None) -> str:
    """The page's main text: blocks joined by a newline; empty where there is none."""
    if not page:
        return ""
    root = parse(page)
    nodes = _leave_out(root)
    body = _body(nodes)
    measure(nodes, body)
    below = _below(nodes, body)
    best = max(below, key=lambda x: x.sum)  # the first of equals is the outermost
    if not best.sum:
        best = body
    least, x, path = best.density, best, {id(best)}
    while x is not body and x.parent is not None:
        x = x.parent
        least = min(least, x.density)
        path.add(id(x))
        if x.tag in ARTICLE:
            best = x  # the author marked where the article ends
    top: dict[int, Node] = {}
    for x in reversed(below):  # node with the highest sum below each, children first
        own = x
        for c in x.children:
            if id(c) in top and top[id(c)].sum > own.sum:
                own = top[id(c)]
        top[id(x)] = own
    chosen = {id(top[id(x)]) for x in below if x.density >= least and x.chars} | {id(best)}
    chosen |= {id(x) for x in below if x.tag in HEADINGS and id(x.parent) in path}  # titles are short, so never dense
    return _blocks(nodes, chosen)


def extract(pages: DataFrame, page: str = "html", keep: tuple[str, ...] | None = None, name: str = "main_text") -> DataFrame:
    """Adds string column ``name``: main text of the whole page.

    Null and empty pages and pages without text give the empty string; broken markup is read as far as it goes; repeated rows
    stay. ``keep`` names the columns to return (all but the page); an older column ``name`` is replaced. One row is one unit of work, nothing is shuffled.
    """
    keep = others(pages, tuple(c for c in pages.columns if c != page) if keep is None else keep, name)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array([main_text(x.as_py()) for x in part.column(n)], pa.string())], [*keep, name])

    schema = ", ".join([*(f"{quoted(c)} {pages.schema[c].dataType.simpleString()}" for c in keep), f"{quoted(name)} string"])
    return pages.select(*map(quoted, keep), F.col(page).alias(free_name(pages, "__page"))).mapInArrow(run, schema)
