"""Main text of web pages by tree scoring.

A tolerant parser builds the tree of a page. Every paragraph gives points for its length and its commas to its
ancestors, half to each farther one; a container's points are discounted by its link density and raised or lowered by what
its name says it is. Points are summed from the leaves up, so a page costs what its length is, however deep it is. The best container is kept with those of its siblings that score well enough or read as prose;
out of it go menus, headers, footers, sidebars, notices, adverts, forms and reader comments. Every block of what is
left is one line: character references decoded, white space as one space, trimmed.

A page is a pure function of its html, so the operator is one Arrow pass without a shuffle. Defined results: null and
empty pages, and pages without text, have an empty text; unclosed and stray tags are closed or skipped; repeated rows
pass one by one; columns of the input that clash with names here don't matter, as only id, url and html are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed by HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A tag on the left ends an open one on the right.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
ENDS_P = BLOCK - {"body", "html", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
SCOPE = frozenset("table ul ol dl td th body html article section main div blockquote".split())

#: Never part of the main text.
DROPPED = frozenset("head nav footer aside form button select input textarea script style noscript template iframe object embed svg math canvas audio video dialog menu label fieldset".split())
#: Words in names (class, id) that say what an element is, by the kinds that are not main text.
KINDS = {
    "menu": "menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar",
    "header": "masthead",
    "footer": "footer footers copyright",
    "sidebar": "sidebar sidebars",
    "notice": "notice notices cookie cookies consent gdpr popup modal overlay notification notifications disclaimer",
    "advert": "ad ads advert adverts advertisement advertisements advertising promo promos promotion sponsor sponsored sponsors",
    "form": "form forms login signin signup subscribe subscription newsletter searchbox",
    "comment": "comment comments commentary reply replies respond discussion",
    "other": "share sharing social related recommended widget widgets",
}
UNLIKELY = frozenset(" ".join(KINDS.values()).split())
#: The same as whole names, or with one of ``SITE`` only: parts of an article are named so too.
UNLIKELY_WHOLE = frozenset("header banner alert alerts search aside tags".split())
SITE = frozenset("site page top global main web app".split())
LIKELY = frozenset("article body content entry main post story text".split())
#: The word after one of these says what an element has, not what it is.
HAS = frozenset("has with without no is by".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[^\x00-\x7f]+")
ROLES = frozenset("menu menubar complementary navigation alert alertdialog dialog banner contentinfo search form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p pre td blockquote li dd".split())
LISTS = frozenset("ul ol dl table div section".split())
#: Quotes delimit a value after its equals sign only; the second form of a tag is for a quote that never ends.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|(?![\"'])))*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
COMMAS = re.compile("[,،、，]")
BLANK = re.compile(r"\s+")
#: Points of a paragraph: one a comma and one for so many characters; a container named as content, or an article, has some to begin with.
POINT_CHARS, NAMED, ARTICLE = 80, 20, 10
#: What an ancestor gets of the points of the one below.
PASSED = 0.5


class Node:
    __slots__ = ("tag", "parent", "children", "name", "gone", "score", "points", "commas", "own", "chars", "link_chars")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent = tag, parent
        self.children: list = []
        self.name, self.gone, self.score, self.points = "", tag in DROPPED, 0.0, 0.0
        self.commas = self.own = self.chars = self.link_chars = 0
        if attributes and "=" in attributes or "hidden" in attributes:
            found = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in ATTRIBUTE.findall(attributes)}
            self.name = f"{found.get('class', '')} {found.get('id', '')}".strip()
            bare = ATTRIBUTE.sub("", attributes).lower().split()
            if "hidden" in bare or "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES or HIDDEN.search(found.get("style", "")):
                self.gone = True


def parse(page: str) -> Node:
    root = Node("#root", None)
    at, end, here = 0, len(page), root
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            here.children.append(page[at:])
            break
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                here.children.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        if m[1] or m[4]:
            here = _closed(here, tag)
            continue
        here = _opened(here, tag)
        attributes = m[3] if m[2] else m[6]
        node = Node(tag, here, attributes or "")
        here.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            node.gone = True
        elif tag not in VOID and not (attributes or "").endswith("/"):
            here = node
    return root


def _opened(here: Node, tag: str) -> Node:
    """Where a new tag goes: paragraphs and list items end before what can't stand in them."""
    if tag in ENDS_P:
        x = here
        while x.parent is not None and x.tag not in SCOPE:
            if x.tag == "p":
                here = x.parent
                break
            x = x.parent
    if tag in ENDS:
        x = here
        while x.parent is not None:
            if x.tag in ENDS[tag]:
                here = x.parent
                if tag not in ("tr", "tbody", "tfoot", "thead") or here.tag not in ENDS[tag]:
                    break
                x = here
                continue
            if x.tag in SCOPE:
                break
            x = x.parent
    return here


def _closed(here: Node, tag: str) -> Node:
    x = here
    while x.parent is not None:
        if x.tag == tag:
            return x.parent
        if x.tag in SCOPE and tag not in BLOCK:
            return here  # a stray inline end doesn't reach out of its container
        x = x.parent
    return here


def _named(name: str) -> tuple[bool, bool]:
    """(a name of content, a name of something else). A name with both kinds of words (post-comments, main-nav) is of something else."""
    likely = unlikely = False
    for one in name.split():
        words = [w.lower() for w in WORD.findall(one)]
        own = [w for k, w in enumerate(words) if not k or words[k - 1] not in HAS]
        if any(w in UNLIKELY for w in own) or len(own) < 3 and own and own[-1] in UNLIKELY_WHOLE and (len(own) == 1 or own[0] in SITE):
            unlikely = True
        elif any(w in LIKELY for w in own):
            likely = True
    return likely, unlikely


def _prepared(root: Node) -> None:
    """Marks what goes, counts characters, inside links and in all, and sums points from the leaves up."""
    stack: list[tuple[Node, bool, bool, bool]] = [(root, False, False, False)]
    while stack:
        x, in_link, in_article, done = stack.pop()
        if done:
            _scored(x)
            continue
        likely, unlikely = _named(x.name) if x.name else (False, False)
        x.score = NAMED * likely - NAMED * unlikely + (ARTICLE if x.tag in ("article", "main") else 0)
        if unlikely and not likely and x.tag not in ("body", "html", "article", "main") or x.tag == "header" and not in_article:
            x.gone = True
        if x.gone:
            continue
        in_link, in_article = in_link or x.tag == "a", in_article or x.tag in ("article", "main")
        stack.append((x, in_link, in_article, True))
        for c in x.children:
            if isinstance(c, str):
                n = len(c.strip())
                x.chars += n
                x.link_chars += n * in_link
            else:
                stack.append((c, in_link, in_article, False))


def _scored(x: Node) -> None:
    """Adds to a node, whose children are done, its own points and passes on what its parent gets."""
    own = [c for c in x.children if isinstance(c, str) and c.strip()]
    x.own += sum(len(c.strip()) for c in own)
    if x.tag in PARAGRAPHS:
        points = (x.commas + sum(len(COMMAS.findall(c)) for c in own) + x.chars / POINT_CHARS) * (1 - _density(x))
        given, x.commas = points, 0
    else:
        x.commas += sum(len(COMMAS.findall(c)) for c in own)
        given = 0.0
        if x.tag in BLOCK or x.tag == "#root":
            if x.own >= 25 or x.tag in ("body", "#root", "article") and own:
                x.points += (x.commas + x.own / POINT_CHARS) * (1 - _density(x))
            x.commas = 0
    if x.parent is None:
        return
    up = x.parent
    up.chars += x.chars
    up.link_chars += x.link_chars
    up.points += given + x.points * PASSED
    if x.tag not in BLOCK:
        up.commas += x.commas
        up.own += x.chars


def _density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def _each(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        if x.gone:
            continue
        yield x
        stack.extend(c for c in reversed(x.children) if not isinstance(c, str))


def _words(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.gone:
            stack.extend(reversed(x.children))
    return "".join(out)


def _value(x: Node) -> float:
    return (x.points + x.score) * (1 - _density(x)) if x.points else 0.0


def best(root: Node) -> Node | None:
    """The container with the most points after the discount for links."""
    top, most = None, 0.0
    for x in _each(root):
        if x.points > 0 and x.tag not in PARAGRAPHS | {"ul", "ol", "tr", "html"} and (top is None or _value(x) > most):
            top, most = x, _value(x)
    return top


def _menu(x: Node, before: Node | None) -> bool:
    """Mostly links, and neither with a heading of its own nor right after one, as a list of references is."""
    if x.tag not in LISTS or not x.chars or _density(x) <= 0.5:
        return False
    return (before is None or before.tag not in HEADINGS) and not any(y.tag in HEADINGS for y in _each(x))


def _whole(top: Node) -> Node:
    """The article (or else the main part) that ``top`` lies in; ``top`` itself if there is none."""
    for tag in ("article", "main"):
        x: Node | None = top
        while x is not None:
            if x.tag == tag:
                return x
            x = x.parent
    return top


def _kept(root: Node, top: Node) -> list[Node]:
    """The best container, with the whole article that it lies in, and the siblings that belong to it, in page order."""
    least = max(10.0, 0.2 * _value(top))
    top = _whole(top) if top.tag != "body" else top
    if top.parent is None or top.tag in ("body", "main"):
        return [top]
    out = []
    for x in top.parent.children:
        if x is top:
            out.append(x)
        elif isinstance(x, Node) and not x.gone:
            same = 0.2 * _value(top) if x.name and x.name == top.name else 0.0
            if _value(x) + same >= least:
                out.append(x)
            elif x.tag == "p":
                text = _words(x).strip()
                if len(text) > 80 and _density(x) < 0.25 or 0 < len(text) <= 80 and _density(x) == 0 and re.search(r"[.!?。](\s|$)", text):
                    out.append(x)
            elif x.tag in HEADINGS and top.tag != "article":
                out.append(x)
    return out


def blocks(nodes: list[Node]) -> list[str]:
    lines: list[str] = []
    run: list[str] = []

    def end():
        if run:
            line = BLANK.sub(" ", html.unescape("".join(run))).strip()
            if line:
                lines.append(line)
            run.clear()

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.gone:
            continue
        elif x.tag == "br":
            run.append(" ")
        elif x.tag in BLOCK:
            end()
            stack.append(None)
            before, parts = None, []
            for c in x.children:
                if isinstance(c, str):
                    parts.append(c)
                elif not c.gone:
                    if not _menu(c, before):
                        parts.append(c)
                    before = c
            stack.extend(reversed(parts))
        else:
            stack.extend(reversed(x.children))
    end()
    return lines


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _prepared(root)
    top = best(root)
    if top is None:
        return ""
    return "\n".join(blocks(_kept(root, top)))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``."""

    def rows(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(body).cast("string").alias("html")).mapInArrow(rows, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
