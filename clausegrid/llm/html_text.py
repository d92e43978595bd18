"""HTML main text by tree scoring: paragraphs pass points to ancestors, the best container and its siblings stay."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.llm.common import table

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Fixed values of HTML: what has no content, what holds raw text, what is no reading text, what ends a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
HIDDEN = frozenset("script style textarea title noscript template iframe noembed noframes head select input svg canvas object video audio".split())
#: Controls whose text is read where it stands in a paragraph, as a label in a sentence, and nowhere else.
CONTROLS = frozenset("button label".split())
#: What may stand in a head; anything else ends it, as its end tag and the start tag of the body may be left out.
IN_HEAD = frozenset("head title base basefont bgsound link meta style script noscript template".split())
AROUND = frozenset("nav header footer aside form dialog menu".split())
BLOCK = frozenset("html body address article aside blockquote br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption dt".split())
#: A start tag on the left ends an open element on the right, but for those beyond a container of it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("ul ol dl table menu select body html article section div main".split())
UNLIKELY = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|breadcrumbs?|comments?|consent|cookies?|disqus|footer|legal|login|masthead|menu|modal|nav\w*|newsletter|notice|paywall|popup|promo\w*|recommend\w*|replies|reply|respond|share|sharing|sidebar|signup|social|sponsor\w*|subscri\w*|toolbar|widget)(?:$|[-_\s\d])", re.I)
#: These words may as well name a part of the article: the text decides.
DOUBTFUL = re.compile(r"(?:^|[-_\s])(?:banner|header|related|tags?)(?:$|[-_\s\d])", re.I)
REPLIES = re.compile(r"(?:^|[-_\s])(?:comments?|disqus|replies|reply|respond)(?:$|[-_\s\d])", re.I)
LIKELY = re.compile(r"(?:^|[-_\s])(?:article|body|content|entry|main|page|post|story|text)(?:$|[-_\s\d])", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "hint", "score", "length", "linked", "own", "commas", "prose", "gone")

    def __init__(self, tag: str, parent: Node | None, hint: str = ""):
        self.tag, self.parent, self.hint = tag, parent, hint
        self.children: list[Node | str] = []
        self.score = 0.0
        self.length = self.linked = self.own = self.commas = self.prose = 0
        self.gone = False


def parse(source: str) -> Node:
    """A forgiving tree: unclosed elements end with their container, stray end tags are dropped."""
    root = Node("#root", None)
    at, here = 0, root
    open_tags: Counter[str] = Counter()  # so that no search goes up in vain

    def close(node: Node) -> None:
        nonlocal here
        while here is not node:
            open_tags[here.tag] -= 1
            here = here.parent
        open_tags[node.tag] -= 1
        here = node.parent

    while at < len(source):
        found = TAG.search(source, at)
        text = source[at : found.start() if found else len(source)]
        if text:
            if here.tag == "head" and text.strip():
                close(here)
            here.children.append(html.unescape(text))
        if not found:
            break
        at = found.end()
        name = found[2].lower() if found[2] else ""
        if not name:
            continue
        if found[1]:
            if open_tags[name]:
                node = here
                while node.tag != name:
                    node = node.parent
                close(node)
            elif name == "p":  # a lone </p> is an empty paragraph
                here.children.append(Node("p", here))
            continue
        if open_tags["head"] and name not in IN_HEAD:
            node = here
            while node.tag != "head":
                node = node.parent
            close(node)
        if name in BLOCK and name != "br" and open_tags["p"]:  # a block ends an open paragraph, with whatever inline elements are open in it
            node = here
            while node.parent and node.tag not in BLOCK:
                node = node.parent
            if node.tag == "p":
                close(node)
        if name in CLOSES and any(open_tags[t] for t in CLOSES[name]):
            node = here
            while node.parent and node.tag not in CLOSES[name] and node.tag not in CONTAINERS:
                node = node.parent
            if node.parent and node.tag in CLOSES[name]:
                close(node)
        hint = ""
        if found[3] and ("class" in found[3] or "id" in found[3] or "role" in found[3] or "hidden" in found[3]):
            pairs = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(found[3])}
            hint = " ".join([pairs.get("class", ""), pairs.get("id", ""), pairs.get("role", ""), "popup" if "hidden" in pairs else ""]).strip()
        node = Node(name, here, hint)
        here.children.append(node)
        node.gone = name in CONTROLS and not any(open_tags[t] for t in PARAGRAPH)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            if name == "xmp":  # text as it stands, without character references
                node.children.append(source[at : end.start() if end else len(source)])
            at = end.end() if end else len(source)
        elif name not in VOID and not found[3].endswith("/"):
            here = node
            open_tags[name] += 1
    return root


def _suspect(node: Node) -> bool:
    """Elements that rarely hold article text, by tag or by class, id or role; measure() first."""
    if node.tag in AROUND:
        return True
    if node.tag in ("html", "body", "article", "main") or not node.hint:
        return False
    if LIKELY.search(node.hint) and node.tag in ("div", "section") and node.hint.split()[0].lower() in ("article", "content", "main", "post", "entry", "story"):
        return False
    if UNLIKELY.search(node.hint):
        return True
    return bool(DOUBTFUL.search(node.hint)) and (node.length < 140 or density(node) >= 0.25)


def _tree(root: Node) -> list[Node]:
    """All elements that can be seen, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node) and c.tag not in HIDDEN and not c.gone)
    return order


def _sum_up(order: list[Node]) -> None:
    """Sets characters, linked characters, own text and commas (without paragraphs below) and characters of unlinked prose, leaves first."""
    in_link: dict[int, bool] = {}
    for node in order:
        in_link[id(node)] = node.tag == "a" or (node.parent is not None and in_link.get(id(node.parent), False))
        node.length = node.linked = node.own = node.commas = node.prose = 0
    for node in reversed(order):
        for child in node.children:
            if isinstance(child, str):
                size = len(" ".join(child.split()))
                node.length += size
                node.own += size
                node.linked += size if in_link[id(node)] else 0
                node.commas += child.count(",") + child.count("、") + child.count("，")
            elif id(child) in in_link:
                node.length += child.length
                node.linked += child.linked
                node.prose += child.prose
                if child.tag not in PARAGRAPH:
                    node.own += child.own
                    node.commas += child.commas
        if node.tag in PARAGRAPH and node.tag not in ("li", "dt", "figcaption") and node.length - node.linked >= 80:
            node.prose = max(node.prose, node.length - node.linked)


def measure(root: Node) -> list[Node]:
    """Marks what is no part of an article as gone, and measures the rest; returns the elements that stay, parents first.

    A suspect element goes, unless the page hangs below it: it has an article or a main part
    with most of its text, or it has four times the text of all that is not suspect and does
    not call itself comments. Then the same is asked of what is below it.
    """
    order = _tree(root)
    _sum_up(order)
    marked: dict[int, int] = {}  # unlinked characters in article, main or likely content below
    for node in reversed(order):
        inner = sum(marked.get(id(c), 0) for c in node.children if isinstance(c, Node))
        marked[id(node)] = node.length - node.linked if node.tag in ("article", "main") else inner
    suspects = {id(n) for n in order if n is not root and _suspect(n)}
    outside = 0
    stack = [root]
    tops: list[Node] = []
    while stack:  # text that is not below a suspect
        node = stack.pop()
        linked = node.tag == "a"
        for child in node.children:
            if isinstance(child, str):
                outside += 0 if linked else len(" ".join(child.split()))
            elif id(child) in suspects:
                tops.append(child)
            elif child.tag not in HIDDEN:
                stack.append(child)
    while tops:
        node = tops.pop()
        free = node.length - node.linked
        holds_article = free > 0 and marked[id(node)] * 2 > free
        is_page = free >= 200 and free > 4 * outside and density(node) < 0.5 and not REPLIES.search(node.hint)
        if not (holds_article or is_page):
            node.gone = True
            continue
        stack = [node]
        while stack:
            for child in stack.pop().children:
                if isinstance(child, Node) and child.tag not in HIDDEN:
                    (tops if id(child) in suspects else stack).append(child)
    order = _tree(root)
    _sum_up(order)
    return order


def dropped(node: Node) -> bool:
    return node.gone or node.tag in HIDDEN


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _prior(node: Node) -> float:
    prior = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0}.get(node.tag, 0.0)
    return prior + (25.0 if node.hint and LIKELY.search(node.hint) else 0.0)


def best_containers(root: Node) -> list[Node]:
    """The best container, or the article that holds it, what reads like it beside it and, where no article is marked, beside its ancestors; in page order."""
    kept = measure(root)
    scored: dict[int, Node] = {}
    for node in kept:
        if node.tag not in PARAGRAPH and not (node.tag in ("div", "section", "article", "main", "body", "#root") and any(isinstance(c, str) and c.strip() for c in node.children)):
            continue
        size, commas = node.own, node.commas
        if size < 1:
            continue
        points = (1.0 if size >= 25 else 0.1) + commas + min(size / 100, 3.0)
        share, above = 1.0, node if node.tag not in PARAGRAPH else node.parent
        for level in range(4):
            if above is None:
                break
            if id(above) not in scored:
                scored[id(above)] = above
                above.score += _prior(above)
            above.score += points * share
            share = 0.5 if level == 0 else share * 2 / 3
            above = above.parent
    if not scored:
        return []
    for node in scored.values():
        node.score *= 1 - density(node)
    top = _whole_article(max(scored.values(), key=lambda n: n.score))
    before: list[Node] = []
    after: list[Node] = []
    node, nearest = top, True
    while node.parent is not None:
        beside = node.parent.children
        at = next(k for k, c in enumerate(beside) if c is node)
        left, right = ([c for c in part if isinstance(c, Node) and not dropped(c) and (_reads(c) if nearest else _is_prose(c))] for part in (beside[:at], beside[at + 1 :]))
        before, after = left + before, after + right
        if node.tag in ("article", "main", "body"):
            break
        node, nearest = node.parent, False
    return [*before, top, *after]


def _reads(node: Node) -> bool:
    """Whether a sibling of the best container belongs to it."""
    if node.tag in PARAGRAPH and node.length > 0 and (density(node) < 0.25 if node.length >= 80 else node.linked == 0 and node.tag != "li"):
        return True
    return node.tag in BLOCK and node.tag not in PARAGRAPH and node.length > 0 and density(node) < 0.3


def _is_prose(node: Node) -> bool:
    """Whether an element farther off has paragraphs of its own and few links."""
    return node.tag in BLOCK and node.prose > 0 and density(node) < 0.25


def _whole_article(top: Node) -> Node:
    """The outermost article around a container; without one the part of the innermost main that holds it, else the container itself."""
    whole, node, main = None, top, None
    while node is not None:
        if node.tag == "article":
            whole = node
        if main is None and node is not top and node.parent is not None and node.parent.tag == "main":
            main = node
        node = node.parent
    return whole or main or top


def blocks(node: Node) -> list[str]:
    """The element's blocks of text: white space as one space, trimmed, empty ones left out."""
    out: list[str] = []
    parts: list[str] = []

    def end() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [node]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            parts.append(item)
        elif not dropped(item):
            if item.tag in BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(item.children))
    end()
    return out


def main_text(source: str | None) -> str:
    """The article of a page: its blocks in page order, joined by one space; empty if there is none."""
    if not source:
        return ""
    return " ".join(text for node in best_containers(parse(source)) for text in blocks(node))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([main_text(h.as_py()) for h in batch.column(batch.num_columns - 1)], pa.string())], [*batch.schema.names[:-1], "_main"])


def extract_main_text(df: DataFrame, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in `carry` and `text`, the main text of each page's whole html.

    Null, empty and text-free html give an empty text; plain text without markup is all
    article. Every row is worked on alone, so repeated rows and null ids just stay; other
    columns, whatever their names, are left alone.
    """
    names = [f"_c{i}" for i in range(len(carry))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)], F.col(html_col).cast("string").alias("_html"))
    schema = ", ".join([*(f"{n} {t}" for n, t in rows.dtypes[:-1]), "_main string"])
    return rows.mapInArrow(_extract, schema).select(*[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], F.col("_main").alias("text"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, url, text (the article) and n_chars."""
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
