"""Main text of web pages by composite text density.

The page becomes a light DOM. For every node the characters C, tags T, link
characters and link tags give the link-adjusted density (characters per tag,
lowered where links prevail); a node's density sum adds up its children's. The
node of the largest sum is the core of the article; the smallest density on its
path from the body is the threshold that other subtrees have to reach to belong to
it, in composite density or in plain characters per tag; what stands between two
parts that belong to it and is not mostly links, and titles before them, belong to
it too. The outermost article or main around the core is taken whole, and
so is every other article that reaches the threshold. Elements that are never article
text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments; by tag, role, or by words of class and id) take no part in the counts
and the text. Headings are not judged by class or id; paragraphs, list items and, inside
article or main, containers are by whole class names, elements in line as adverts only.
What is named as reader comments, an article too, goes however much text it holds.
"""

from __future__ import annotations

import bisect
import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names by the way they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg canvas audio video".split())
OUT = frozenset("nav footer aside form head button select dialog menu fieldset label annotation annotation-xml".split()) | RAW
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
 footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - {"body", "caption", "html", "tbody", "td", "tfoot", "th", "thead", "tr"}
OPTIONAL = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset("""ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar navigation
 menu footer sidebar aside cookie cookies consent gdpr notice notification alert comment comments disqus respond share sharing social
 related newsletter subscribe subscription signup login breadcrumb breadcrumbs popup modal overlay widget toolbar pagination pager
 copyright recommended trending""".split())
# Noise words that are also common topics: an id has to be made of nothing else but these, noise words and PLACE_WORDS.
TOPICS = frozenset("""sponsor promo promotion menu consent notice notification alert comment comments respond share sharing social related
 subscription popup overlay copyright recommended trending cookie cookies gdpr login signup banner""".split())
PLACE_WORDS = frozenset("""area bar block blocks box btn button buttons column container content group icon icons inner item items left link links list outer
 panel post posts right row section slot the unit wrap wrapper articles form main top bottom""".split())
# Elements that are judged by class (inside article or main only if the whole class is noise) and by id.
CONTAINERS = frozenset("div section ul ol dl table header iframe center details".split())
TEXTS = frozenset("h1 h2 h3 h4 h5 h6 hgroup blockquote pre".split())
ITEMS = frozenset("p li figure".split())
INLINE = frozenset("span a b i em strong small ins font".split())
HEAD_WORDS = frozenset("header masthead topbar".split())
AD_WORDS = frozenset("ad ads advert advertisement advertisements adverts advertising sponsored".split())
# Names of reader comments, and the words that may stand beside them.
COMMENT_WORDS = frozenset("comment comments commentlist commentthread commentarea commentsection commentbox disqus".split())
COMMENT_PLACES = frozenset(("thread threads user users reader readers visitor visitors body text form respond reply replies nested children child depth "
                            "odd even page site view feed entry stream holder").split())
# Words that name the page around an advert (article-ad, in-page-ad).
OWN_WORDS = frozenset("article entry story page in inline mid end".split())
CORE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "children", "noise", "marked", "chars", "tags", "link_chars", "link_tags", "head_chars", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: bool, marked: bool):
        self.tag, self.parent, self.children = tag, parent, []
        self.noise, self.marked = noise, marked      # surely not text; not text by its class or id
        self.chars = self.tags = self.link_chars = self.link_tags = self.head_chars = 0
        self.density = self.total = 0.0


def _words(name: str) -> set[str]:
    return {w.lower() for w in _WORDS.findall(name)}


def _whole(name: str, noise: frozenset = NOISE_WORDS) -> bool:
    """Whether a class or id is made of noise words and words of places; of block__element names, also the element alone."""
    words = _words(name)
    if words & noise and words <= noise | NOISE_WORDS | PLACE_WORDS | (OWN_WORDS if words & AD_WORDS else frozenset()):
        return True
    return "__" in name and _whole(name.rsplit("__", 1)[1].split("--")[0], noise)


def _comments(name: str) -> bool:
    """Whether a class or id names reader comments."""
    words = {w for w in _words(name) if not w.isdigit()}
    return bool(words & COMMENT_WORDS) and words <= COMMENT_WORDS | COMMENT_PLACES | PLACE_WORDS


def _judge(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """(never text, not text by its class or id) of an element; ``inside`` an article or main."""
    if tag in OUT or (tag == "header" and not inside):
        return True, False
    if not attributes or tag in ("main", "html", "body"):
        return False, False
    names = {}
    for m in _ATTRIBUTE.finditer(attributes):
        names.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    classes, ident = names.get("class", "").split(), names.get("id", "")
    if (tag in CONTAINERS or tag in ("article", "li")) and any(_comments(x) for x in (*classes, ident)):
        return True, False
    if tag == "article":
        return False, False
    if names.get("role", "").lower() in ROLES or "hidden" in names or names.get("aria-hidden") == "true":
        return False, True
    if tag in TEXTS:
        return False, False
    if tag in ITEMS:
        return False, any(_whole(x) for x in classes)
    if tag in INLINE:
        return False, any(_whole(x, AD_WORDS) for x in classes)
    if inside and tag not in CONTAINERS:
        return False, False
    if tag == "section":                             # section ids are made from headings
        ident = ""
    if inside:
        return False, any(_whole(x) for x in (*classes, ident))
    words, own = set().union(*map(_words, classes)), _words(ident)
    return False, bool((words | own) & HEAD_WORDS or words & NOISE_WORDS or own & (NOISE_WORDS - TOPICS) or _whole(ident))


class _Open:
    """The open elements, with the places of each tag, so that no start or end tag looks through all of them."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def first_after(self, tags, place: int) -> int:
        """Place of the outermost of these tags opened after ``place``; 0 if there is none."""
        found = []
        for t in tags:
            at = self.places.get(t, [])
            i = bisect.bisect_right(at, place)
            found += at[i:i + 1]
        return min(found, default=0)

    def close(self, place: int) -> None:
        """Closes the element at ``place`` and all in it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()


def parse(page: str) -> Node:
    """Light DOM of a page: nodes and strings (character references decoded), tolerant of missing end tags."""
    root = Node("#root", None, False, False)
    now, at, n = _Open(root), 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at:m.start() if m else n]
        if text:
            now.nodes[-1].children.append(html.unescape(text))
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            place = now.last((tag,))
            if place:
                now.close(place)
            continue
        attributes = m[3] or m[6] or ""
        if tag in CLOSES_P:
            place = now.last(("p",))
            if place > now.last(("table", "td", "th", "button")):
                now.close(place)
        if tag in OPTIONAL:
            ends, scope = OPTIONAL[tag]
            place = now.first_after(ends, now.last(scope - ends))
            if place:
                now.close(place)
        node = Node(tag, now.nodes[-1], *_judge(tag, attributes, now.last(CORE) > 0))
        now.nodes[-1].children.append(node)
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            now.push(node)
    return root


def _order(root: Node) -> list[Node]:
    """Nodes, parents first, without those that are never text."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.noise)
    return out


def _ancestors(node: Node):
    while node.parent is not None:
        node = node.parent
        yield node


def _count(nodes: list[Node]) -> None:
    for node in nodes:
        node.chars = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.tags = node.link_tags = 0
        node.link_chars = node.head_chars = 0
    for node in reversed(nodes):
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.tag in HEADINGS:
            node.head_chars = node.chars
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
            up.head_chars += node.head_chars


def composite(c: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Composite text density of these counts, ratio being the body's share of link characters."""
    if not c:
        return 0.0
    t, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(c / max(c - link_chars, 1) * link_chars + ratio * c + math.e)
    return max(c / t * math.log(max(c / lc * t / lt, 1.0) + 1e-9, max(base, 1.0 + 1e-9) if base > 1 else math.e), 0.0)


def densities(nodes: list[Node], body: Node) -> None:
    """Composite text density of every node and the sum over its children."""
    ratio = body.link_chars / max(body.chars, 1)
    for node in nodes:
        node.density = composite(node.chars, node.tags, node.link_chars, node.link_tags, ratio)
    for node in nodes:
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.noise)


def _parts(node: Node, path: set[int]) -> list[list]:
    """The children of a node: every block, and every node of the path, by itself; what is in line between them together."""
    out, line = [], None
    for c in node.children:
        if isinstance(c, Node) and c.noise:
            continue
        if isinstance(c, Node) and (c.tag in BLOCK or id(c) in path):
            out.append([c])
            line = None
        elif line is None:
            line = [c]
            out.append(line)
        else:
            line.append(c)
    return out


def _counts(part: list) -> tuple[int, int, int, int]:
    """Characters, tags, link characters and link tags of a part; of one node, those inside it."""
    if len(part) == 1 and isinstance(part[0], Node):
        x = part[0]
        return x.chars, x.tags, x.link_chars, x.link_tags
    inner = [x for x in part if isinstance(x, Node)]
    return (sum(x.chars for x in inner) + sum(len(x.strip()) for x in part if isinstance(x, str)), sum(x.tags + 1 for x in inner),
            sum(x.link_chars for x in inner), sum(x.link_tags for x in inner))


def _is_title(part: list) -> bool:
    """Whether half of the text, or more, stands in headings."""
    chars = sum(x.head_chars for x in part if isinstance(x, Node))
    return chars > 0 and 2 * chars >= _counts(part)[0]


def _select(nodes: list[Node], body: Node) -> list:
    """The nodes and strings of the article in their order, None between blocks."""
    core = max(nodes, key=lambda x: x.total)
    if core.total <= 0:
        return [body]
    path = [core, *(up for up in _ancestors(core))]
    path = path[:next((i for i, up in enumerate(path) if up is body), len(path) - 1) + 1]
    ratio = body.link_chars / max(body.chars, 1)
    threshold, plain = min(x.density for x in path), min((x.chars - x.link_chars) / max(x.tags, 1) for x in path)
    on_path = {id(x) for x in path}

    def reaches(c, tags, link_chars, link_tags):
        return c > 0 and (composite(c, tags, link_chars, link_tags, ratio) >= threshold or (c - link_chars) / max(tags, 1) >= plain)

    outer = [up for up in path if up.tag in CORE]
    if outer:
        taken, out = set(), []
        for x in nodes:                              # parents first, in page order
            if id(x.parent) in taken:
                taken.add(id(x))
            elif x is outer[-1] or (x.tag in CORE and id(x) not in on_path and reaches(x.chars, x.tags, x.link_chars, x.link_tags)):
                taken.add(id(x))
                out += [None, x]
        return out
    out, todo = [], [body] if core is not body else [[body]]
    while todo:
        at = todo.pop()
        if isinstance(at, list):
            out += [None, *at]
            continue
        parts = _parts(at, on_path)
        counts = [_counts(x) for x in parts]
        keep = [x[0] is core or not (isinstance(x[0], Node) and id(x[0]) in on_path) and reaches(*n) for x, n in zip(parts, counts, strict=True)]
        sure = [i for i, x in enumerate(parts) if keep[i] or (isinstance(x[0], Node) and id(x[0]) in on_path)]
        if sure:
            titles = True                            # headings right before the text, and an h1 anywhere before it
            for i in range(sure[0] - 1, -1, -1):
                if counts[i][0] and _is_title(parts[i]):
                    keep[i] = titles or (isinstance(parts[i][0], Node) and parts[i][0].tag == "h1")
                elif counts[i][0]:
                    titles = False
            for i in range(sure[0] + 1, sure[-1]):
                keep[i] = keep[i] or (i not in sure and 0 < counts[i][0] >= 2 * counts[i][2])
        for i in range(len(parts) - 1, -1, -1):
            if keep[i]:
                todo.append(parts[i])
            else:
                todo.extend(x for x in reversed(parts[i]) if isinstance(x, Node) and x.chars and x.tag != "a")
    return out


def blocks(parts: list) -> list[str]:
    """Text of subtrees and strings: one string per block, white space as one blank."""
    out, now = [], []

    def flush():
        text = " ".join("".join(now).split())
        if text:
            out.append(text)
        now.clear()

    todo: list = list(reversed(parts))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif not x.noise:
            if x.tag == "br":
                now.append(" ")
            block = x.tag in BLOCK
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(x.children))
    flush()
    return out


def main_text(page: str) -> str:
    """Article text of one page ('' if there is none)."""
    root = parse(page)
    nodes = _order(root)
    _count(nodes)
    whole = root.chars - root.link_chars
    cores = set()
    for x in reversed(nodes):
        if x.parent is not None and (x.tag in CORE or id(x) in cores):
            cores.add(id(x.parent))
    for node in nodes:
        # a marked element that holds most of the page, and its article if there is one, is a wrapper, not noise
        if node.marked and not ((id(node) in cores or not cores) and 2 * (node.chars - node.link_chars) > whole):
            node.noise = True
    nodes = _order(root)
    _count(nodes)
    body = next((x for x in nodes if x.tag == "body"), root)
    nodes = _order(body)
    densities(nodes, body)
    return "\n".join(blocks(_select(nodes, body)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (main text, blocks joined by one newline), n_chars (code points) of every row.

    Null and empty pages, and pages without text, give ''. Rows with null or
    repeated ids are treated like any other. Other columns are not read.
    """
    def run(batches):
        for batch in batches:
            texts = [main_text(x) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return p.mapInArrow(run, "page_id long, url string, text string, n_chars long")
