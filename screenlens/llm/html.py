"""HTML extraction by tree scoring.

A page is parsed into a tree of elements with HTML's implied end tags. Subtrees that are never main
text (scripts, navigation, forms, adverts, comments by readers, ...) are cut by tag, role, or class
and id words. Each paragraph then gives points to its ancestors: one, one for each comma, one for
each hundred characters (three at most); the parent gets them whole, the grandparent half, and
further ancestors a share that shrinks with the distance. Class words raise or lower a container's
score, and a container's score is discounted by its link density. The best container is the main text, with
those siblings whose own score or text is good enough and the text blocks (short paragraphs, lists, tables) between
or next to them. An article is taken whole, with all articles beside it in the same main part that are no teasers.
Blocks are returned one a line.

Defined results: a null or empty page, and one without text, gives an empty text; broken markup is
parsed as far as it goes (an open element ends with its parent); pages are read whole, in one pass,
with a stack instead of recursion; of containers with equal scores the first one wins; an empty table gives an empty one; repeated rows are extracted alike; other columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tune

#: HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption html summary tbody td tfoot th thead tr".split())
#: An element of the first name ends open ones of the others, up to a border.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
#: Subtrees that are never main text.
CUT = frozenset("script style noscript template svg math iframe object embed nav aside footer form button select option input textarea label fieldset dialog menu audio video canvas map head title noembed noframes xmp".split())
CUT_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split())
#: Words of a class or id, between hyphens, underscores and spaces.
CUT_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion recommended related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
#: Those that leave no doubt, and words that turn the meaning of what follows.
CERTAIN = frozenset("comment comments commentlist disqus advert adverts advertisement advertising sponsored promo cookie cookies gdpr newsletter".split())
NEGATION = frozenset("has with no without not is".split())
GOOD_WORDS = frozenset("article body content entry hentry main page post story text blog".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
KEEP_TAGS = frozenset("html body article main".split())
SCORED = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption".split())
#: Blocks of text that go with a container beside them, and lines that do not.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
NOTICE = re.compile(r"©|\(c\)|copyright|all rights reserved", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts", "score", "hidden")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list = []
        self.score = 0.0
        self.hidden = False


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""))
    return out


def names(attrs: dict[str, str]) -> list[list[str]]:
    """Words of each class and of the id."""
    every = [*attrs.get("class", "").split(), attrs.get("id", "")]
    return [w for w in ([x.lower() for x in WORD.findall(v)] for v in every) if w]


def unwanted(attrs: dict[str, str]) -> bool:
    """Whether a class or the id says that this is no main text. `content-footer` does, `footer-content` and `with-sidebar` don't."""
    for w in names(attrs):
        if w[0] in NEGATION:
            continue
        if w[-1] in CUT_WORDS or CERTAIN.intersection(w) or CUT_WORDS.intersection(w) and not GOOD_WORDS.intersection(w):
            return True
    return False


def parse(page: str) -> Node:
    root = node = Node("html", "", None)
    at, find = 0, TOKEN.search
    while True:
        m = find(page, at)
        if m is None:
            if at < len(page):
                node.parts.append(html.unescape(page[at:]))
            return root
        if m.start() > at:
            node.parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            up = node
            while up is not None and up.tag != tag:
                # A stray end tag of an inline element must not close blocks, nor a cell's leave its table.
                if up.tag in BLOCK and tag not in BLOCK or up.tag == "table" and tag not in ("table", "html", "body"):
                    up = None
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            continue
        if tag in CLOSES_P:
            up = node
            while up is not None and up.tag != "p" and (up.tag not in BLOCK):
                up = up.parent
            if up is not None and up.tag == "p" and up.parent is not None:
                node = up.parent
        if tag in IMPLIED:
            closes, border = IMPLIED[tag]
            up, last = node, None
            while up is not None and up.tag not in border:
                if up.tag in closes:
                    last = up
                up = up.parent
            if last is not None and last.parent is not None:
                node = last.parent
        elif tag in BLOCK and node.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and tag[0] == "h" and tag[1:].isdigit() and node.parent is not None:
            node = node.parent
        elif tag == "body":
            while node.parent is not None:
                node = node.parent
        child = Node(tag, m[3], node)
        node.parts.append(child)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        node = child


def walk(root: Node):
    """Nodes in page order, without cut subtrees."""
    todo = [root]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in reversed(n.parts) if isinstance(c, Node) and not c.hidden]


def inside(node: Node, tags: tuple[str, ...]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def cut(root: Node) -> None:
    """Mark the subtrees that are never main text."""
    todo = [root]
    while todo:
        n = todo.pop()
        if n.tag in CUT:
            n.hidden = True
            continue
        if n.tag == "header" and not inside(n, ("article", "main")):
            n.hidden = True
            continue
        if n.attrs and n.attrs != "/" and n.tag not in KEEP_TAGS:
            a = attributes(n.attrs)
            style = a.get("style", "").replace(" ", "").lower()
            if a.get("role", "").lower() in CUT_ROLE or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style or unwanted(a):
                n.hidden = True
                continue
        todo += [c for c in n.parts if isinstance(c, Node)]


def blocks(root: Node) -> list[str]:
    """The visible text of a subtree: one string a block, white space collapsed."""
    out: list[str] = []
    current: list[str] = []

    def flush():
        text = SPACE.sub(" ", "".join(current)).strip()
        if text:
            out.append(text)
        current.clear()

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            current.append(x)
        elif not x.hidden:
            if x.tag == "br":
                current.append(" ")
            elif x.tag in BLOCK:
                flush()
                todo.append(None)
                todo += reversed(x.parts)
            else:
                todo += reversed(x.parts)
    flush()
    return out


def lengths(root: Node) -> dict[int, tuple[int, int]]:
    """Characters of each visible node's text, and those of them in links."""
    order = list(walk(root))
    total = {}
    for n in reversed(order):
        size = link = 0
        for c in n.parts:
            if isinstance(c, str):
                size += len(c.strip())
            elif not c.hidden:
                a, b = total[id(c)]
                size, link = size + a, link + b
        total[id(n)] = (size, size if n.tag == "a" else link)
    return total


def bonus(n: Node) -> float:
    base = {"article": 10.0, "main": 10.0, "section": 3.0, "div": 5.0, "blockquote": 3.0, "td": 3.0, "pre": 3.0}.get(n.tag, 0.0)
    if n.tag in ("ol", "ul", "dl", "li", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "th"):
        base -= 3.0
    if n.attrs and n.attrs != "/":
        base += 25.0 * any(GOOD_WORDS.intersection(w) for w in names(attributes(n.attrs)))
    return base


def own_text(n: Node) -> str:
    """Text of a node without that of blocks below it."""
    out, todo = [], list(reversed(n.parts))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.hidden and x.tag not in BLOCK:
            todo += reversed(x.parts)
    return "".join(out).strip()


def best(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it."""
    size = lengths(root)
    points: dict[int, float] = {}
    node_of: dict[int, Node] = {}
    for n in walk(root):
        if n.tag not in SCORED and n.tag not in ("div", "section", "article", "main", "body", "html", "center"):
            continue
        text = own_text(n)
        if not text or n.tag not in SCORED and len(text) < 25:
            continue
        worth = 1.0 + text.count(",") + min(len(text) // 100, 3)
        a, b = size[id(n)]
        worth *= 1 - b / a if a else 1.0
        up, level = (n.parent if n.tag in SCORED else n), 0
        while up is not None and level < 6:
            if id(up) not in points:
                points[id(up)], node_of[id(up)] = bonus(up), up
            points[id(up)] += worth if level == 0 else worth / 2 if level == 1 else worth / (level * 3)
            up, level = up.parent, level + 1
    if not points:
        return [root]
    for k, n in node_of.items():
        a, b = size[k]
        points[k] *= 1 - b / a if a else 1.0
    top = max(node_of, key=lambda k: points[k])
    n = node_of[top]
    # What stands in an article is the article's: its head and other sections belong to it.
    article = nearest(n, "article")
    if article is None:
        return [n] if n.parent is None else siblings(n, points, size, max(10.0, points[top] * 0.2))
    main = nearest(article, "main")
    if main is None:
        return [c for c in article.parent.parts if c is article or isinstance(c, Node) and c.tag == "article" and worthy(c, article, points, size)] if article.parent is not None else [article]
    # Articles of one main part are all its text, but for teasers; they come in page order.
    return [c for c in walk(main) if c.tag == "article" and nearest(c.parent, "article") is None and (c is article or worthy(c, article, points, size))]


def nearest(n: Node | None, tag: str) -> Node | None:
    """The outermost element of that tag around a node, or the node itself."""
    found = None
    while n is not None:
        if n.tag == tag:
            found = n
        n = n.parent
    return found


def density(n: Node, size: dict) -> float:
    a, b = size[id(n)]
    return b / a if a else 0.0


def worthy(c: Node, best_one: Node, points: dict, size: dict) -> bool:
    """Whether an article beside the best one is text and no teaser: few links, and paragraphs of its own."""
    return not c.hidden and size[id(c)][0] > 0 and density(c, size) < 0.25 and points.get(id(c), 0.0) >= min(12.0, 0.2 * points.get(id(best_one), 0.0))


def siblings(n: Node, points: dict, size: dict, limit: float) -> list[Node]:
    """The best container, siblings whose score or text is good enough, and the text blocks that stand between or next to them."""
    beside = [c for c in n.parent.parts if isinstance(c, Node) and not c.hidden and size.get(id(c), (0, 0))[0]]
    own = []
    for c in beside:
        a, d = size[id(c)][0], density(c, size)
        sentence = c.tag == "p" and (a > 80 and d < 0.25 or not d and re.search(r"\.(\s|$)", own_text(c)))
        own.append(c is n or points.get(id(c), 0.0) >= limit or bool(sentence) or c.tag in ("h1", "h2") and not d)
    first, last = own.index(True), len(own) - 1 - own[::-1].index(True)
    block = [c.tag in TEXT_BLOCKS and density(c, size) < 0.25 and not NOTICE.search(own_text(c)) for c in beside]
    while first and block[first - 1]:
        first -= 1
    while last + 1 < len(beside) and block[last + 1]:
        last += 1
    return [c for k, c in enumerate(beside) if own[k] or first <= k <= last and block[k]]


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    cut(root)
    return "\n".join(x for n in best(root) for x in blocks(n))


def extract_udf():
    @F.arrow_udf("string")
    def run(page: pa.Array) -> pa.Array:
        return pa.array(map(extract, page.to_pylist()), pa.string())

    return run.asNondeterministic()


def extract_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    tune(spark)
    return pages.select("page_id", "url", extract_udf()("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
