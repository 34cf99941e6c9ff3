"""HTML main text by composite text density.

1. A page is read into a tree of elements; comments, scripts, styles and markup go.  Menus, headers, footers,
   sidebars, notices, adverts, forms and reader comments are cut by element, role and class.  A name that may as well
   be that of a paragraph (``related``, ``share``) cuts a block of plain text inside an article only if it is mostly links.
   No name and no form cuts what holds an article, or half of the page's plain text.
2. Every node gets its composite text density: characters per tag, adjusted by how much of the text and how
   many of the tags are links, and by the page's own share of link text (Sun, Song and Liao, "DOM based content
   extraction via text density", SIGIR 2011).  Text that stands directly in a node counts as a child.
3. The densities of a node's children are summed.  On the path from the node with the greatest sum to the body,
   the least density is the threshold.  Of each branch whose density reaches the threshold, the subtree with the
   greatest sum is content.  This decides in every page.
4. What density selects inside an ``article`` is widened to that element, and so are the articles beside it (unless they are
   mostly links); where it selects half of a ``main`` outside any article, to the ``main``: headings and short
   paragraphs have a low density of their own.
5. The blocks of the content are given in page order, white space inside a block as one blank, joined by a newline.

Defined results: null and empty pages, and pages without text, give the empty text; repeated rows are read one
by one; of equal sums the innermost block counts; very long and deeply nested pages are read in linear time, without
recursion; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import pick, ship_code

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas noembed noframes xmp".split())
CUT = frozenset("head nav footer aside form button select menu dialog audio video map fieldset input".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CELL = frozenset("td th".split())
#: Elements that a start tag ends, and those that bound the search for them.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead"}, "tfoot": {"tbody", "thead"}}
P_ENDERS = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BOUNDS = frozenset("article aside blockquote body button div dl fieldset figure footer form header html li main nav ol section table td th ul".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())
CUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|"
    r"nav|navbar|navigation|menu|menus|breadcrumbs?|sidebar|side|widgets?|related|recommend\w*|share|sharing|social|comments?|disqus|repl(?:y|ies)|respond|"
    r"footer|header|masthead|topbar|pagination|pager|login|signup|search|toolbar|skip|teaser|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
#: Names among these that a paragraph or heading of the article itself may have.
_MILD = re.compile(r"(?:^|[\s_-])(?:related|recommend\w*|share|sharing|social|teaser|header|side|search|skip|widgets?|alert|subscription|repl(?:y|ies))(?:$|[\s_-])", re.I)
TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt li td th figcaption em strong span b i".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[a-zA-Z/!?][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "kids", "up", "attrs", "chars", "tags", "link_chars", "link_tags", "density", "total", "cut")

    def __init__(self, name: str, up: Node | None, attrs: dict[str, str]):
        self.name, self.up, self.attrs, self.kids = name, up, attrs, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.cut = False


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(raw)} if raw and not raw.isspace() else {}


def parse(page: str) -> Node:
    """The tree of a page: elements with their children and texts (character references decoded) in order."""
    root = cur = Node("html", None, {})
    at, n, low = 0, len(page), None
    opened: Counter[str] = Counter()  # elements on the path to ``cur``, by name

    def leave(found: Node) -> Node:
        """Closes everything down to and with ``found``."""
        x = cur
        while x is not found.up:
            opened[x.name] -= 1
            x = x.up
        return x

    while at < n:
        m = _TOKEN.search(page, at)
        upto = m.start() if m else n
        if upto > at:
            cur.kids.append(html.unescape(page[at:upto]))
        if not m:
            break
        at, name = m.end(), m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            found = cur if opened[name] else None
            while found is not None and found.name != name:
                found = None if found.name in ("td", "th", "table") and name not in BLOCK | CELL else found.up
            if found is not None and found.up is not None:
                cur = leave(found)
            elif name == "p" or name == "br":
                cur.kids.append(Node("br", cur, {}))
            continue
        if name == "html":
            continue
        for enders in (ENDS.get(name), {"p"} if name in P_ENDERS else None):
            found = cur if enders and any(opened[x] for x in enders) else None
            while found is not None and found.name not in enders:
                found = None if found.name in BOUNDS else found.up
            if found is not None and found.up is not None:
                cur = leave(found)
        raw = m.group(3)
        node = Node(name, cur, _attributes(raw))
        cur.kids.append(node)
        if name in RAW:
            node.cut = True
            low = page.lower() if low is None else low
            end = low.find(f"</{name}", at) if len(low) == n else -1
            if end < 0:  # none left, or lower case has another length
                again = re.compile(f"</{name}", re.I).search(page, at) if len(low) != n else None
                end = again.start() if again else n
            close = page.find(">", end)
            at = n if close < 0 else close + 1
        elif name not in VOID:
            cur = node
            opened[name] += 1
    return root


def _walk(root: Node) -> list[Node]:
    """Every node, parents first (no recursion: pages nest as deep as they like)."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(k for k in reversed(node.kids) if not isinstance(k, str))
    return out


def _holders(nodes: list[Node]) -> dict[int, Node]:
    """The innermost article (else main) around each node that has one, by identity; ``nodes`` come parents first."""
    out: dict[int, Node] = {}
    for x in nodes:
        above = out.get(id(x.up)) if x.up is not None else None
        if x.name == "article" or x.name == "main" and (above is None or above.name == "main"):
            out[id(x)] = x
        elif above is not None:
            out[id(x)] = above
    return out


def _measure(nodes: list[Node]) -> None:
    """Characters, tags, link characters and link tags below each node, without what is cut."""
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        if node.cut:
            continue
        for k in node.kids:
            if isinstance(k, str):
                node.chars += len(_SPACE.sub(" ", k).strip())
            elif not k.cut:
                node.chars += k.chars
                node.tags += k.tags + 1
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags + (k.name == "a")
        if node.name == "a":
            node.link_chars = node.chars


def _cut(nodes: list[Node]) -> None:
    """Marks what isn't article by element, role and class.  Neither a class nor a form cuts what holds an article
    or half of the page's plain text."""
    inside = _holders(nodes)
    for node in nodes:
        a = node.attrs
        if node.name in CUT and node.name != "form" or node.name == "header" and id(node) not in inside:
            node.cut = True
        elif a and (a.get("role", "").lower() in CUT_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I)):
            node.cut = node.name not in ("html", "body", "main")
    _measure(nodes)
    plain = nodes[0].chars - nodes[0].link_chars
    holders = set()
    for node in nodes:
        if node.name in ("article", "main") and not node.cut:
            up = node.up
            while up is not None and id(up) not in holders:
                holders.add(id(up))
                up = up.up
    for node in nodes:
        a = node.attrs
        if node.cut or node.name in ("html", "body", "main") or id(node) in holders:
            continue
        own = node.chars - node.link_chars
        if node.name == "form":
            node.cut = 2 * own <= plain or not own
        elif a:
            named = f"{a.get('class', '')} {a.get('id', '')}"
            if CUT_NAMES.search(named) and (2 * own <= plain or _is_comment(named)):
                if node.name in TEXT_BLOCK and id(node) in inside and 2 * node.link_chars < node.chars and not CUT_NAMES.search(_MILD.sub("  ", named)):
                    continue
                if node.name != "article" or _is_comment(named):
                    node.cut = True
    for node in nodes:  # parents first: what is below a cut node is cut
        node.cut = node.cut or node.up is not None and node.up.cut
    _measure(nodes)


def _is_comment(named: str) -> bool:
    return bool(re.search(r"(?:^|[\s_-])(?:comments?|disqus|repl(?:y|ies)|ads?|advert\w*)(?:$|[\s_-])", named, re.I))


def _density(chars: int, tags: int, link_chars: int, link_tags: int, page_share: float) -> float:
    if not chars:
        return 0.0
    c, t = chars, max(tags, 1)
    lc, lt, rest = max(link_chars, 1), max(link_tags, 1), max(chars - link_chars, 1)
    base = 1 + math.log(c / rest * link_chars + page_share * c + math.e)  # 1 more, for pages without links
    return c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(base)


def _weigh(nodes: list[Node]) -> None:
    """Composite text density of every node and the sum of its children's."""
    body = nodes[0]
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(nodes):
        node.density = 0.0 if node.cut else _density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        node.total = 0.0
        if node.cut:
            continue
        for k in node.kids:
            if isinstance(k, str):
                own = len(_SPACE.sub(" ", k).strip())
                node.total += _density(own, 1, own if node.name == "a" else 0, 0, share)
            elif not k.cut:
                node.total += k.density


def content(root: Node) -> list[Node]:
    """The content subtrees of a page, in page order."""
    nodes = _walk(root)
    _cut(nodes)
    if not root.chars:
        return []
    _weigh(nodes)
    best = root
    for x in nodes:  # of equal sums the innermost block, which leaves out what adds nothing
        if not x.cut and x.chars and (x.total > best.total or x.total == best.total and x.up is not None and x.name in BLOCK):
            best = x
    threshold, up = best.density, best.up
    while up is not None:
        threshold = min(threshold, up.density)
        up = up.up
    # of each branch that reaches the threshold, the subtree with the greatest sum
    best_below: dict[int, Node] = {}
    for x in reversed(nodes):
        top = x
        for k in x.kids:
            if not isinstance(k, str) and not k.cut:
                low = best_below[id(k)]
                if low.total > top.total or low.total == top.total and top is x and low.chars and low.name in BLOCK:
                    top = low
        best_below[id(x)] = top
    chosen: dict[int, Node] = {}
    stack = [root]
    while stack:
        x = stack.pop()
        if x.cut or not x.chars or x.density < threshold:
            continue
        top = best_below[id(x)]
        chosen[id(top)] = top
        if top is not x:
            stack.extend(k for k in x.kids if not isinstance(k, str))
    _widen(nodes, chosen)
    # a subtree inside another chosen one is part of it
    out, covered = [], set()
    for x in nodes:
        if x.up is not None and id(x.up) in covered:
            covered.add(id(x))
        elif id(x) in chosen:
            covered.add(id(x))
            out.append(x)
    return out


def _widen(nodes: list[Node], chosen: dict[int, Node]) -> None:
    """Adds the articles around and beside what was chosen, and each main of which half was."""
    inside = _holders(nodes)
    beside: set[int] = set()
    half: Counter[int] = Counter()
    for x in list(chosen.values()):
        holder = inside.get(id(x))
        if holder is None or holder.cut:
            continue
        if holder.name == "main":
            half[id(holder)] += x.chars
            if 2 * half[id(holder)] >= holder.chars:
                chosen[id(holder)] = holder
            continue
        while (outer := inside.get(id(holder.up))) is not None and outer.name == "article":
            holder = outer
        chosen[id(holder)] = holder
        beside.add(id(holder.up))
    for x in nodes:
        if x.name == "article" and not x.cut and id(x.up) in beside and 2 * x.link_chars < x.chars:
            chosen[id(x)] = x


def blocks(tops: list[Node]) -> list[str]:
    """The texts of the blocks below the given nodes, in page order."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    for top in tops:
        stack: list[Node | str | None] = [top]
        while stack:
            x = stack.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                run.append(x)
            elif not x.cut:
                if x.name in BLOCK:
                    close()
                    stack.append(None)
                elif x.name in CELL:
                    run.append(" ")
                stack.extend(reversed(x.kids))
        close()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(content(parse(page)))) if page else ""


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py()) for x in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    ship_code(pages.sparkSession)
    d = pick(pages, "page_id", "url", "html").withColumn("html", F.col("html").cast("string")).withColumn("url", F.col("url").cast("string"))
    return d.mapInArrow(_rows, f"page_id {d.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
