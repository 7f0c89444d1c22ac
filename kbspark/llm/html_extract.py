"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks: runs of text between block-level tags, with their place in the tree. A
classifier gives each block a cost for being content or boilerplate; its costs are the capacities to the
two terminals. Smoothness edges join neighbouring blocks, heavier under one parent and inside one main element,
lightest between a side container and what is not in it, and blocks two apart under one parent. A maximum
flow separates the sides; blocks that the source still reaches are the content. So a list or a lone link
between an article's paragraphs stays though its look speaks against it, while a long run of links does not.

The classifier is a logistic model of a block's own look (length, links, punctuation, tag), fitted on the
blocks of at most SAMPLE_PAGES pages, where semantic containers (article and main against nav, aside,
footer, form and the like) give the labels. The nearest containers' own evidence is added as bounded log
odds: a class or id name weighs less than an element's meaning, and an article or main element clears what the
names of its wrappers told. Names that tell of other elements or of a state (no-sidebar, comments-open) tell
nothing; an element named both ways (a post with share-buttons-top) is left to looks and
neighbours. A form that holds a page's own parts (an article, a navigation, a first heading) is the page's
wrapper, not a form.

A block whose terminal capacity exceeds all its edges together must take its own side in every minimum
cut, so such blocks are settled first; the flow (by blocking flows, in whole millionths) runs over the rest.
Edges reach two blocks at most; where a very long page needs more than PHASES blocking flows, the same cut
is found by a pass over the labels of two neighbours, in linear time.

Cases: null, empty and tag-only pages give the empty text; unclosed and stray tags are repaired as the
reader goes (controls and embedded objects, which are not read, end with their parent, and without an
end tag at the next block); very long pages take time in proportion to their length; a page without semantic containers is judged by looks and neighbours; ties go to
boilerplate; repeated rows give equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import map_arrow, texts

SAMPLE_PAGES = 300  #: pages that the classifier is fitted on, at most
SAMPLE_CHARS = 50_000  #: longer pages do not teach

# HTML element names by their role.
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noembed", "noframes"))
UNREAD = frozenset(("noscript", "template", "svg", "math", "object", "select", "button", "canvas", "audio", "video"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
ITEM = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",)}
MAIN = frozenset(("article", "main"))
SIDE = frozenset(("nav", "aside", "footer", "menu", "dialog", "fieldset", "head"))
PAGE_PARTS = frozenset(("article", "main", "nav", "aside", "header", "footer", "h1"))  # a form that holds one is the page's wrapper
SIDE_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"))
SIDE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promos comment comments commentlist reply replies respond disqus discussion sidebar sidenav aside rail menu menus nav navbar navigation
    breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended
    recommendations widget widgets toolbar pagination pager copyright disclaimer skip paywall""".split()
)
#: side names in which an article is a comment or a teaser, not the page's own
SIDE_ARTICLES = frozenset("comment comments commentlist reply replies respond disqus discussion related recommended recommendations".split())
MAIN_NAMES = frozenset(("article", "content", "story", "post", "entry", "body", "main", "text"))
OWN_NAMES = frozenset(("article", "story", "post", "entry", "main"))  # beside a side name in one class list, the element is named both ways
# Log odds of containers.
IN_MAIN, IN_SIDE, NAMED_SIDE, NAMED_MAIN, HEADER_IN_MAIN = 3.0, -7.0, -5.0, 1.0, -1.0
LOOK = 4.0  #: what a block's look can tell, at most
#: edge capacities: one parent, one main element, other parents, a side container's border, two apart
NEAR, TOGETHER, FAR, BORDER, SECOND = 1.5, 2.0, 0.4, 0.2, 0.3
SCALE = 1_000_000  #: costs and capacities are cut in whole millionths
PHASES = 64  #: blocking flows on one part of a page before the linear pass

_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PART = re.compile(r"[a-z]+")
_LAYOUT = re.compile(r"(?<!\S)(?:\S*[-_])?(?:no|has|have|with|without|and|hide|non|free|open|opened|closed|enabled|disabled|layout)(?:[-_]\S*)?(?!\S)")  # names of other elements or of a state
_UNREAD = re.compile(rf"<(/?)({'|'.join(sorted(UNREAD))})(?=[\s/>])([^<>]*)>", re.I)


@dataclass
class Node:
    tag: str
    side: bool
    firm: bool  # side by more than a class or id name that an article clears
    main: bool
    hint: float
    key: int
    parent: Node | None
    form: Node | None = None  # the innermost form, itself included
    wraps: bool = False  # a form around the page's own parts
    top: Node | None = None  # the outermost main (or so named) element around it, itself included
    block: Node | None = None  # the innermost block element, itself included


@dataclass
class Part:
    """A block: its text, the characters inside links, its innermost element and that element's block ancestor."""

    text: str
    linked: int
    node: Node
    tag: str


def _element(tag: str, attributes: str, parent: Node | None, key: int) -> Node:
    side, main, hint = bool(parent and parent.side), bool(parent and parent.main), parent.hint if parent else 0.0
    firm = bool(parent and parent.firm)
    body, form = False, parent.form if parent else None
    if form and tag in PAGE_PARTS:
        form.wraps = True
    if tag in MAIN:
        side = firm or side and main and tag == "article"
        main = True
    elif tag in SIDE:
        firm = True
    elif tag == "header":
        if main:
            hint += HEADER_IN_MAIN
        else:
            firm = True
    if attributes and tag not in ("html", "body"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                tokens = [set(_PART.findall(x)) for x in _LAYOUT.sub(" ", value).split()]
                named = [x for x in tokens if not x.isdisjoint(SIDE_NAMES)]
                own = any(not x.isdisjoint(OWN_NAMES) for x in tokens if x not in named)
                if named and not own and tag not in MAIN:
                    side = True
                    firm = firm or any(not x.isdisjoint(SIDE_ARTICLES) for x in named)
                elif not named and any(not x.isdisjoint(MAIN_NAMES) for x in tokens):
                    hint += NAMED_MAIN
                    body = True
            elif name == "role":
                firm = firm or value in SIDE_ROLES
                main = main or value in ("main", "article")
            elif name == "style":
                firm = firm or "display:none" in value.replace(" ", "") or "visibility:hidden" in value.replace(" ", "")
            elif name == "hidden" or value == "true":
                firm = True
    node = Node(tag, side or firm, firm, main, hint, key, parent, form)
    if tag == "form":
        node.form = node
    node.top = parent.top if parent and parent.top else node if main or body else None
    node.block = node if tag in BLOCK or not parent else parent.block
    return node


def _tag_end(html: str, at: int) -> int:
    """The place after a tag's '>', past quoted attribute values; -1 without one."""
    end = html.find(">", at)
    if end < 0:
        return -1
    inner = html[at:end]
    if '"' not in inner and "'" not in inner:
        return end + 1
    k, quote = at, ""
    while k < len(html):
        c = html[k]
        if quote:
            if c == quote:
                quote = ""
        elif c in "\"'" and html[k - 1] in "= \t\n\r":
            quote = c
        elif c == ">":
            return k + 1
        k += 1
    return end + 1  # an unclosed quote: the first '>' ends the tag


def closed_unread(html: str) -> set[int]:
    """The places of the UNREAD start tags that have an end tag of their own."""
    out, open_at = set(), {}
    for m in _UNREAD.finditer(html):
        at = open_at.setdefault(m[2].lower(), [])
        if not m[1]:
            if not m[3].endswith("/"):
                at.append(m.start())
        elif at:
            out.add(at.pop())
    return out


def blocks(html: str) -> list[Part]:
    """The blocks of a page, in page order."""
    keys = 0
    stack = [_element("#", "", None, 0)]
    out: list[Part] = []
    held: list[str] = []
    linked, in_link, unread, opened = 0, 0, 0, Counter()
    closed, loose = closed_unread(html), None  # loose: the open UNREAD element that has no end tag

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                top = next(n for n, x in enumerate(stack) if x.tag in UNREAD) - 1 if unread else -1
                node = stack[top].block
                out.append(Part(text, linked, node, node.tag))
            held.clear()
        linked = 0

    def pop_at(n: int) -> None:
        nonlocal in_link, unread, loose
        if unread and stack[n].tag in BLOCK and any(x.tag in UNREAD for x in stack[n:]):
            flush()  # blocks inside an unread element end no text; its parent's end does
        for x in stack[n:]:
            opened[x.tag] -= 1
            in_link -= x.tag == "a"
            unread -= x.tag in UNREAD
            if x is loose:
                loose = None
        del stack[n:]

    def pop_to(tag: str, within: tuple[str, ...] = ()) -> bool:
        if not opened[tag]:
            return False
        for n in range(len(stack) - 1, 0, -1):
            if stack[n].tag == tag:
                pop_at(n)
                return True
            if stack[n].tag in within:
                return False
        return False

    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        if lt > at and not unread:
            piece = unescape(html[at:lt])
            held.append(piece)
            if in_link > 0:
                linked += len(piece.strip())
        if lt >= size:
            break
        nxt = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            short = next((x for x in ("<!-->", "<!--->") if html.startswith(x, lt)), None)
            end = lt + len(short) - 3 if short else html.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if nxt in ("!", "?"):
            end = html.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        closing = nxt == "/"
        m = _NAME.match(html, lt + 1 + closing)
        if not m:
            if closing:  # a bogus comment
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                if not unread:
                    held.append("<")
                at = lt + 1
            continue
        tag, end = m[0].lower(), _tag_end(html, m.end())
        if end < 0:  # the page ends inside a tag
            break
        at = end
        if loose and tag in BLOCK:
            pop_at(next(n for n, x in enumerate(stack) if x is loose))
        if closing:
            if tag in BLOCK and not unread:
                flush()
            if tag == "a" and in_link <= 0:
                continue
            pop_to(tag, () if tag in BLOCK else ("td", "th"))
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCK:
            if not unread:
                flush()
            if tag in ENDS_P:
                pop_to("p", ("td", "th", "div", "article", "section", *UNREAD))
            if tag in ITEM:
                pop_to(tag, (*ITEM[tag], "template", "object"))
        if tag in VOID or html[end - 2 : end] == "/>" and tag not in BLOCK:
            continue
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, end)
            if close is None:
                break
            after = html.find(">", close.end())
            at = size if after < 0 else after + 1
            continue
        keys += 1
        stack.append(_element(tag, html[m.end() : end - 1], stack[-1], keys))
        opened[tag] += 1
        in_link += tag == "a"
        if tag in UNREAD:
            unread += 1
            if lt not in closed and not loose:
                loose = stack[-1]
    flush()
    return out


LOOKS = 9


def looks(p: Part) -> list[float]:
    words = p.text.count(" ") + 1
    link = min(1.0, p.linked / len(p.text))
    return [1.0, min(6.0, np.log1p(len(p.text))) - 3, link, float(p.text[-1] in ".!?:;\"'»”"), float(p.tag == "p"), float(p.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(p.tag == "li") * link, float(words < 4), float(words > 15)]


def fit(pages: list[str]) -> np.ndarray:
    """Weights of a block's looks, from blocks in containers of known role; no such blocks, no evidence (all 0)."""
    x, y = [], []
    for page in pages:
        for p in blocks(page):
            if in_side(p.node) or p.node.main:
                x.append(looks(p))
                y.append(float(not in_side(p.node)))
    w = np.zeros(LOOKS)
    if not y or min(y) == max(y):
        return w
    x, y = np.array(x), np.array(y)
    for _ in range(25):
        mean = 1 / (1 + np.exp(-x @ w))
        h = (x * (mean * (1 - mean))[:, None]).T @ x + np.eye(LOOKS)
        w -= np.linalg.solve(h, x.T @ (mean - y) + w)
    return np.clip(w, -3, 3)


def in_form(n: Node) -> bool:
    return bool(n.form and not n.form.wraps)


def in_side(n: Node) -> bool:
    return n.side or in_form(n)


def costs(parts: list[Part], weights: np.ndarray) -> list[float]:
    """Log odds of content of every block: its look, within bounds, and what its containers tell."""
    look = np.clip(np.array([looks(p) for p in parts]) @ weights, -LOOK, LOOK)
    held = lambda n: IN_SIDE if n.firm or in_form(n) else NAMED_SIDE if n.side else (IN_MAIN if n.main else 0.0) + n.hint
    return [float(v) + held(p.node) for v, p in zip(look, parts, strict=True)]


def edges(parts: list[Part]) -> list[tuple[int, int, float]]:
    out = []
    for n in range(1, len(parts)):
        a, b = parts[n - 1].node, parts[n].node
        near = (a.parent or a) is (b.parent or b) or a is b
        if in_side(a) != in_side(b):
            out.append((n - 1, n, BORDER))
        else:
            out.append((n - 1, n, TOGETHER if a.top and a.top is b.top else NEAR if near else FAR))
        if n > 1 and (parts[n - 2].node.parent or parts[n - 2].node) is (b.parent or b) and in_side(parts[n - 2].node) == in_side(b):
            out.append((n - 2, n, SECOND))
    return out


def min_cut(cost: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of the minimum cut with the fewest of them; cost is log odds of content."""
    n = len(cost)
    around: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in links:
        around[i][j] = around[j][i] = around[i].get(j, 0) + round(c * SCALE)
    label: list[bool | None] = [None] * n
    rest = [round(c * SCALE) for c in cost]
    queue = deque(range(n))
    while queue:  # settled nodes hand their edges to their neighbours' terminals
        i = queue.popleft()
        if label[i] is None and abs(rest[i]) > sum(c for j, c in around[i].items() if label[j] is None):
            label[i] = rest[i] > 0
            for j, c in around[i].items():
                if label[j] is None:
                    rest[j] += c if label[i] else -c
                    queue.append(j)
    seen: set[int] = set()
    for start in range(n):
        if label[start] is None and start not in seen:  # one connected part of what is left
            part, queue = [], deque([start])
            seen.add(start)
            while queue:
                i = queue.popleft()
                part.append(i)
                for j in around[i]:
                    if label[j] is None and j not in seen:
                        seen.add(j)
                        queue.append(j)
            held = {i: {j: c for j, c in around[i].items() if label[j] is None} for i in part}
            narrow = all(abs(i - j) <= 2 for i in part for j in held[i])
            content = source_side(part, rest, held, PHASES if narrow else None)
            if content is None:
                content = narrow_side(part, rest, held)
            for i in part:
                label[i] = i in content
    return [bool(x) for x in label]


def source_side(part: list[int], rest: list[int], held: dict[int, dict[int, int]], phases: int | None = None) -> set[int] | None:
    """What the source still reaches after a maximum flow by blocking flows; None if it takes more than `phases` of them."""
    s, t = -1, -2
    cap = {i: dict(c) for i, c in held.items()}
    cap[s], cap[t] = {i: rest[i] for i in part if rest[i] > 0}, {}
    for i in part:
        cap[i][t] = max(0, -rest[i])
        cap[i][s] = 0
        cap[t][i] = 0
    done = 0
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if t not in level:
            return set(level)
        if phases is not None and done >= phases:
            return None
        done += 1
        arcs = {i: iter(cap[i]) for i in level}
        path = [s]
        while path:
            i = path[-1]
            if i == t:
                flow = min(cap[a][b] for a, b in zip(path, path[1:]))  # noqa: B905
                cut = 0
                for n, (a, b) in enumerate(zip(path, path[1:])):  # noqa: B905
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0) + flow
                    if not cap[a][b] and not cut:
                        cut = n + 1
                del path[cut:]  # on from the first place that is full
                continue
            step = next((j for j in arcs[i] if cap[i][j] and level.get(j) == level[i] + 1), None)
            if step is None:
                path.pop()
            else:
                path.append(step)


def narrow_side(part: list[int], rest: list[int], held: dict[int, dict[int, int]]) -> set[int]:
    """The same nodes where edges reach two places at most: least cut value, then fewest nodes, over the labels of two neighbours."""
    lo, inside = min(part), set(part)
    best, back = {(0, 0): (0, 0)}, []
    for i in range(lo, max(part) + 1):
        one, two, new, came = held.get(i, {}).get(i - 1, 0), held.get(i, {}).get(i - 2, 0), {}, {}
        for (a, b), (value, size) in best.items():
            for x in (0, 1) if i in inside else (0,):
                pays = max(0, -rest[i] if x else rest[i]) if i in inside else 0
                total = (value + pays + one * (x != b) + two * (x != a), size + x)
                if (b, x) not in new or total < new[b, x]:
                    new[b, x], came[b, x] = total, a
        best = new
        back.append(came)
    a, b = min(best, key=best.__getitem__)
    out = set()
    for n in range(len(back) - 1, -1, -1):
        if b:
            out.add(lo + n)
        a, b = back[n][a, b], a
    return out


def main_text(html: str, weights: np.ndarray) -> str:
    parts = blocks(html)
    if not parts:
        return ""
    return "\n".join(p.text for p, keep in zip(parts, min_cut(costs(parts, weights), edges(parts)), strict=True) if keep)


def extract(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""
    chosen = pages.where(F.length("html") <= SAMPLE_CHARS).select("page_id", F.xxhash64("page_id").alias("h")).orderBy("h", "page_id").limit(sample_pages)
    rows = pages.join(F.broadcast(chosen.select("page_id").distinct()), "page_id").where(F.length("html") <= SAMPLE_CHARS).select("html").limit(sample_pages).collect()
    weights = fit(sorted(r["html"] for r in rows))

    def run(b: pa.RecordBatch) -> dict:
        found = [main_text(t, weights) for t in texts(b, "html")]
        return {"page_id": b.column("page_id"), "url": b.column("url"), "text": found, "n_chars": [len(t) for t in found]}

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long", rows=256)


def op5_html(spark, sf_dir: str) -> DataFrame:
    """Contract op5 over whole pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
