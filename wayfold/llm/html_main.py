"""Main text of web pages by tree scoring.

A tolerant tokenizer builds the page's tree. Every paragraph gives points for its length and its
commas to its parent, half of them to its grandparent, and by two thirds less at each step further
up, to all its ancestors; a container's points are discounted by its link density and raised by
names such as "article". Where the best container lies in an article, the outermost one is kept
whole, with what lies beside it in a main around it and with the articles beside these; in a main
alone, that is kept whole. Else the branches beside the best container are kept, and those beside
each ancestor up to the last that holds ``NOTABLE`` characters of further text; above it, only
headings, p and text right in the ancestor. A branch beside the kept container, or text beside it,
counts unless over a quarter of it is links and it scores low: such are taken for menus and teasers.
The blocks kept are returned in page order.

Elements that are never article text (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments) are left out: by tag, role or ``hidden`` at once, by class or id
after the tree is known. A name counts as a whole ("comments") or by its parts ("post-comments"),
but not where a part says it is only a state ("has-sidebar", "comments-open"). An element named so
is kept all the same if it holds an article or main that is not, or a top heading with most of the
page's paragraph points; one named by a part only (and a form) also if hardly any text would be left
without it.
Nothing else is dropped or capped, at any length. All steps take time linear in the page.

Null or empty html, and pages without text: empty text. A page cut off in the middle of a tag loses
that tag only. Very deep nesting needs no recursion. Null page_id and repeated rows each return
their row. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrowtools import map_rows

TOKEN = re.compile(r"""<!--(?:.*?)(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*?)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][^\s=/>"']*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
HIDDEN = re.compile(r"""\b(?<![-="'])hidden\b(?!=)""")
SPACE = re.compile(r"[\s]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre blockquote td th li dt dd h1 h2 h3 h4 h5 h6 figcaption caption summary".split())
#: An open element of the key is closed by the start of one of the values.
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"}}
#: A start tag looks for something to close no further up than these.
SCOPE = frozenset("html body table ul ol dl div section article main aside nav header footer form blockquote fieldset figure".split())
NEVER = frozenset("head title script style noscript template svg math canvas object embed iframe audio video nav header footer aside button select textarea input dialog menu menuitem noembed noframes".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_NAMES = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adbox adslot banner sponsor sponsored sponsors promo promoted promotion
    comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead footer sidebar aside widget widgets related recommended recommendations
    share sharing social newsletter subscribe subscription signup login toolbar skip outbrain taboola""".split())
#: What follows one of the first, or stands before one of the second, says in what state an element is, not what it is.
STATE_FIRST = frozenset("has have no not without with is enable disable allow hide show".split())
STATE_LAST = frozenset("open opened closed enabled disabled allowed off on visible hidden".split())
#: Names that an article or main of its own may not have as a part.
BESIDE = frozenset("comment comments reply replies discussion respond ad ads advert sponsored promo related recommended".split())
GOOD_NAMES = frozenset("article articlebody body content contents entry main mainbody page post postbody story text hentry".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
STRONG = {"article": 25.0, "main": 20.0}
HEADINGS_P = frozenset("p h1 h2 h3 h4 h5 h6".split())
NOTABLE = 80
#: Share of a paragraph's points for the parent's parent, and what each step further up leaves of it.
GRANDPARENT, FADE = 0.5, 2 / 3
PLAIN, BY_PART, BY_NAME, OUT = range(4)


class Node:
    """An element: ``first`` and ``last`` bound its blocks, ``block`` is the block element that text in it belongs to."""

    __slots__ = ("tag", "parent", "noise", "good", "text", "link", "points", "first", "last", "hidden", "block")

    def __init__(self, tag: str, parent: Node | None, noise: int, good: bool, first: int):
        self.tag, self.parent, self.noise, self.good = tag, parent, noise, good
        self.text = self.link = 0
        self.points = 0.0
        self.first = self.last = first
        self.hidden = noise == OUT or (parent is not None and parent.hidden)
        self.block: Node = self if parent is None or tag in BLOCKS else parent.block


def _name_noise(token: str, strong: bool = False) -> int:
    """Does a class or id token name something that is no article text: as a whole, by a part, or not.

    The header of a post or entry holds its title; an article or main is judged by fewer names.
    """
    if token.lower() in NOISE_NAMES:
        return BY_NAME
    parts = ["", *(m.lower() for m in NAME.findall(token)), ""]
    good = any(x in GOOD_NAMES for x in parts)
    for before, x, after in zip(parts, parts[1:], parts[2:], strict=False):
        if x in NOISE_NAMES and before not in STATE_FIRST and after not in STATE_LAST and not (good and x == "header") and (x in BESIDE or not strong):
            return BY_PART
    return PLAIN


def _marks(tag: str, attributes: str) -> tuple[int, bool]:
    """How surely an element is no article text by its tag, role, class or id; is it likely the article by its names."""
    if tag in NEVER:
        return OUT, False
    noise = BY_PART if tag == "form" else PLAIN
    if not attributes or tag in ("html", "body"):
        return noise, False
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    if HIDDEN.search(ATTRIBUTE.sub(" ", attributes)) or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return OUT, False
    if found.get("role", "").lower() in NOISE_ROLES:
        return OUT, False
    tokens = SPACE.split((found.get("class", "") + " " + found.get("id", "")).strip())
    good = any(m.lower() in GOOD_NAMES for t in tokens for m in NAME.findall(t))
    return max([noise, *(_name_noise(t, tag in STRONG) for t in tokens)]), good


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The elements, and the blocks of text (the element they stand in, their text), in page order."""
    root = Node("#root", None, PLAIN, False, 0)
    nodes, stack = [root], [root]
    blocks: list[tuple[Node, str]] = []
    pending: list[str] = []
    owner = root
    at, end = 0, len(page)
    opened: Counter = Counter()  # open elements by tag
    inline: list[Counter] = [Counter()]  # open inline elements by tag, since each open block
    scopes: list[Counter] = [Counter()]  # open elements that a start tag may close, since each open scope

    def flush() -> None:
        nonlocal pending
        if pending:
            text = SPACE.sub(" ", html.unescape("".join(pending))).strip()
            pending = []
            if text:
                blocks.append((owner, text))

    def text(piece: str) -> None:
        nonlocal owner
        here = stack[-1]
        if here.hidden:
            return
        if not pending:
            if not piece.strip():
                return
            owner = here.block
        pending.append(piece)
        if opened["a"]:
            here.link += len(piece.strip())

    def push(node: Node) -> None:
        stack.append(node)
        opened[node.tag] += 1
        if node.tag in CLOSED_BY:
            scopes[-1][node.tag] += 1
        if node.tag in BLOCKS:
            inline.append(Counter())
            if node.tag in SCOPE:
                scopes.append(Counter())
        else:
            inline[-1][node.tag] += 1

    def pop() -> str:
        node = stack.pop()
        node.last = len(blocks)
        opened[node.tag] -= 1
        if node.tag in BLOCKS:
            inline.pop()
            if node.tag in SCOPE:
                scopes.pop()
        else:
            inline[-1][node.tag] -= 1
        if node.tag in CLOSED_BY:
            scopes[-1][node.tag] -= 1
        return node.tag

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        m = TOKEN.match(page, lt)
        if m is None:
            if lt + 1 >= end or page[lt + 1] == "/" and lt + 2 >= end:
                break
            text("<")
            at = lt + 1
            continue
        at = m.end()
        name = m[2]
        if name is None or not m[0].endswith(">"):
            continue
        tag = name.lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            if (opened if tag in BLOCKS else inline[-1])[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in BLOCKS:
            flush()
            while any(n and tag in CLOSED_BY[x] for x, n in scopes[-1].items()):
                while tag not in CLOSED_BY.get(pop(), ()):
                    pass
        elif tag == "br":
            text(" ")
        if tag in VOID:
            continue
        noise, good = _marks(tag, m[3])
        node = Node(tag, stack[-1], noise, good, len(blocks))
        nodes.append(node)
        if tag in RAW:
            stop = RAW_END[tag].search(page, at)
            at = (page.find(">", stop.start()) + 1 or end) if stop else end
            continue
        if m[0].endswith("/>") and tag in ("svg", "path", "iframe"):
            continue
        push(node)
    flush()
    while len(stack) > 1:
        pop()
    root.last = len(blocks)
    return nodes, blocks


def paragraph_points(piece: str) -> float:
    return (1.0 if len(piece) >= 25 else 0.2) + piece.count(",") + min(len(piece) / 100, 3.0)


def _receiver(node: Node) -> Node | None:
    return node.parent if node.tag in PARAGRAPHS else node


def settle(nodes: list[Node], blocks: list[tuple[Node, str]]) -> list[tuple[Node, str]]:
    """Decide on the elements that only a name marks as noise; the blocks that are left, with ``first`` and ``last`` told anew."""
    if any(n.noise in (BY_PART, BY_NAME) for n in nodes):
        points, size = dict.fromkeys(nodes, 0.0), dict.fromkeys(nodes, 0)
        strong, top = dict.fromkeys(nodes, False), dict.fromkeys(nodes, False)
        for n, piece in blocks:
            points[n] += paragraph_points(piece)
            size[n] += len(piece)
        for n in reversed(nodes):
            strong[n] |= n.tag in STRONG and n.noise == PLAIN and not n.hidden and n.last > n.first
            top[n] |= n.tag == "h1" and not n.hidden and n.last > n.first
            up = n.parent
            if up is not None:
                points[up] += points[n]
                size[up] += size[n]
                strong[up] |= strong[n]
                top[up] |= top[n]
        root = nodes[0]
        lost = 0
        for n in nodes:  # the text below the outermost elements named by a part or as a whole
            marked = n.noise in (BY_PART, BY_NAME)
            if marked and not (n.parent and n.parent.hidden):
                if strong[n] or top[n] and 2 * points[n] > points[root]:
                    n.noise = PLAIN
                else:
                    lost += size[n]
                    n.hidden = True
            elif n.parent and n.parent.hidden:
                n.hidden = True
        left = size[root] - lost
        if not strong[root] and left < NOTABLE and 4 * left < size[root]:  # names by a part were no good guide here
            for n in nodes:
                if n.noise == BY_PART and size[n] >= NOTABLE:
                    n.noise = PLAIN
        for n in nodes:
            n.hidden = n.noise != PLAIN or n.parent is not None and n.parent.hidden
    before = [0]
    for n, _ in blocks:
        before.append(before[-1] + (not n.hidden))
    for n in nodes:
        n.first, n.last = before[n.first], before[n.last]
    return [b for b in blocks if not b[0].hidden]


def score(nodes: list[Node], blocks: list[tuple[Node, str]]) -> None:
    """Points, text and link sizes of every element, in one pass up the tree."""
    direct, above = dict.fromkeys(nodes, 0.0), dict.fromkeys(nodes, 0.0)
    for node, piece in blocks:
        node.text += len(piece)
        up = _receiver(node)
        if up is not None:
            direct[up] += paragraph_points(piece)
    for node in reversed(nodes):
        up = node.parent
        if node.hidden:
            node.link = 0
        if up is not None:
            up.text += node.text
            up.link += node.link
            above[up] += GRANDPARENT * direct[node] + FADE * above[node]
        node.points = direct[node] + (0.0 if node.tag in ("#root", "html") else above[node])
        if node.points:
            node.points += STRONG.get(node.tag, 0.0) + (10.0 if node.good else 0.0)
            node.points *= 1 - min(1.0, node.link / max(1, node.text))


def _up(node: Node) -> list[Node]:
    """An element and its ancestors."""
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


def _calm(text: int, link: int) -> bool:
    return link <= 0.25 * max(1, text)


def _beside(nodes: list[Node], blocks: list[tuple[Node, str]], start: Node, top: Node, bar: float, whole: bool) -> list[tuple[int, int]]:
    """The block ranges to keep beside ``start`` below its ancestors up to ``top``: all branches at every level if ``whole``."""
    path = _up(start)
    path = path[: path.index(top) + 1]
    level = {n: k for k, n in enumerate(path[1:])}
    branches: list[list[Node]] = [[] for _ in level]
    direct: list[list[int]] = [[] for _ in level]
    text, link = [0] * len(level), [n.link for n in level]
    for n in nodes:
        k = level.get(n.parent)
        if k is not None and n.text:
            link[k] -= n.link
            if n is not path[k] and not n.hidden and (n.points >= bar or _calm(n.text, n.link)):
                branches[k].append(n)
    for i, (owner, piece) in enumerate(blocks):
        k = level.get(owner)
        if k is not None:
            direct[k].append(i)
            text[k] += len(piece)
    keep, last = [], len(level) - 1 if whole else 0
    for k in range(len(level)):
        if not _calm(text[k], link[k]):
            direct[k] = []
        if sum(n.text - n.link for n in branches[k]) + (text[k] - link[k] if direct[k] else 0) >= NOTABLE:
            last = max(last, k)
    for k in range(len(level)):
        keep += [(n.first, n.last) for n in branches[k] if k <= last or n.tag in HEADINGS_P and _calm(n.text, n.link)]
        keep += [(i, i + 1) for i in direct[k]]
    return keep


def extract(page: str | None) -> str:
    """The article's text: its blocks in page order, two line feeds between them."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    blocks = settle(nodes, blocks)
    if not blocks:
        return ""
    score(nodes, blocks)
    scored = [n for n in nodes if n.points > 0 and not n.hidden]
    if not scored:
        return "\n\n".join(piece for _, piece in blocks)
    best = max(scored, key=lambda n: (n.points, -n.first))
    around = _up(best)
    strong = [n for n in around if n.tag in STRONG]
    start = ([n for n in strong if n.tag == "article"] or strong or [best])[-1]
    top = strong[-1] if strong else around[-1]
    wanted = [(start.first, start.last)]
    if start is not top:
        wanted += _beside(nodes, blocks, start, top, max(5.0, 0.2 * best.points), bool(strong))
    if strong:
        alike = [n for n in nodes if n.parent is top.parent and n is not top and n.tag == top.tag and n.text and not n.hidden]
        wanted += [(n.first, n.last) for n in alike if n.points > 0 and n.points >= 0.2 * top.points or _calm(n.text, n.link)]
    wanted.sort()
    out, done = [], 0
    for first, last in wanted:
        out += [piece for _, piece in blocks[max(first, done) : last]]
        done = max(done, last)
    return "\n\n".join(out)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [extract(x) for x in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return one

    return map_rows(pages, [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")], make, "page_id long, url string, text string, n_chars long")
