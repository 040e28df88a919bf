"""Main text of web pages by consensus paths of their host.

Each page's containers are scored by the text that they hold against their links and
boilerplate. Every page votes with its scores for generalised tag-class paths, votes are added
up per host in Spark, and each page is extracted again by its host's winning path, or by its
own best container where that path is missing.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small, text_groups

SMALL_ROWS = 500_000  # hosts whose winners may be broadcast; more are shuffled

# Element names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript textarea title iframe".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = set("article body div main section td".split())
DROPPED = set("nav header footer aside form script style noscript template textarea title iframe svg canvas object head button select dialog menu".split())
CLOSES_P = BLOCK - {"body", "html"}
CLOSES = {"li": {"li"}, "option": {"option"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
# Words that a class or an id of boilerplate is made of. Those of the first two lists tell
# it for a container beside any words but those of a state, for other elements beside listed words only;
# those of the third beside words of the first four only.
COMMENTS = set("comment comments disqus replies respond".split())
STRONG = COMMENTS | set(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion popup modal cookie cookies consent gdpr "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended newsletter subscribe subscription "
    "signup login pagination pager toolbar".split()
)
WEAK = set("alert banner notice notices alert side header footer masthead reply form widget skip".split())
PLACES = set(
    "left right top bottom upper lower main site page global primary secondary fixed sticky mobile desktop bar box block container wrapper wrap inner outer slot unit area "
    "section list item items link links button buttons panel group policy tools icons icon card cards label title text message holder row col column grid strip badge count content body".split()
)
CONTENT = set("post posts article articles entry story blog news user reader thread".split())
STATES = set("has is no with without not open opened closed enabled disabled free hide show on off".split())
LENIENT = set("div section ul ol dl table details fieldset".split())  # containers, which a single word may tell
ROLES = set("navigation banner contentinfo complementary search dialog alert".split())  # fixed values: roles of boilerplate

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTR = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)?))?")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
ROOT = "html"


class Node:
    """An element. path: a number for the generalised tags and classes from the root down to it.
    dropped: by its name or marks; doubtful: by a word of its class or id, which its size may outweigh."""

    __slots__ = ("tag", "path", "children", "dropped", "doubtful", "links", "size", "best")

    def __init__(self, tag: str, path: int, dropped: bool = False, doubtful: bool = False):
        self.tag, self.path, self.dropped, self.doubtful = tag, path, dropped, doubtful
        self.children: list = []  # nodes and texts in page order


def step(path: int, general: str) -> int:
    """The path that goes on from path with a generalised tag: 64 bits, whatever the depth."""
    return xxhash.xxh3_64_intdigest(general.encode("utf-8", "surrogatepass"), path) - (1 << 63)


def path_key(path: str) -> int:
    """The number of a path written as `html>body>div.main.post-#`: classes sorted, digits as #."""
    key = 0
    for general in path.split(">"):
        key = step(key % (1 << 64), general)
    return key


def _boilerplate(name: str, lenient: bool) -> set[str]:
    """The words that make one class or id boilerplate; none if it isn't."""
    words = set(re.findall("[a-z]+", name))
    strong, weak = words & STRONG, words & WEAK
    if strong and not (words & STATES if lenient else words - STRONG - WEAK - PLACES - CONTENT):
        return strong
    return weak if weak and not words - STRONG - WEAK - PLACES else set()


def _general(tag: str, attrs: dict[str, str]) -> tuple[str, bool, set[str]]:
    """tag with its classes, digits generalised; whether its marks hide it; the words that tell boilerplate."""
    if not attrs:
        return tag, False, set()
    value = lambda name: html_lib.unescape(attrs.get(name, "")).lower()
    classes = value("class").split()
    told = set().union(*(_boilerplate(name, tag in LENIENT) for name in [*classes, *value("id").split()]))
    hidden = "hidden" in attrs or value("aria-hidden") == "true" or bool(ROLES.intersection(value("role").split()))
    return ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in classes})]), hidden, told


def _tag(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes from at on, whether the tag closes itself, and where it ends: after its >, or with the page.

    A value's quote that never ends counts as none. Of attributes with one name the first counts.
    """
    attrs: dict[str, str] = {}
    if page.startswith(">", at):
        return attrs, False, at + 1
    while m := _ATTR.match(page, at):
        name = m[1].lower()
        if name in ("class", "id", "role", "hidden", "aria-hidden"):
            attrs.setdefault(name, m[2] or m[3] or m[4] or "")
        at = m.end()
    end = page.find(">", at)
    return attrs, end > 0 and "/" in page[at:end], len(page) if end < 0 else end + 1


class _Tree:
    """The open elements while a page is read; where each name is open, so that nothing is searched."""

    def __init__(self):
        self.root = Node(ROOT, path_key(ROOT))
        self.stack, self.blocks = [self.root], [0]
        self.open: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.open.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        """Close all elements from depth on."""
        while len(self.stack) > depth:
            self.open[self.stack.pop().tag].pop()
        while self.blocks[-1] >= depth:
            self.blocks.pop()

    def innermost(self, tags: set[str]) -> bool:
        """Close the innermost block if it is one of tags."""
        at = self.blocks[-1]
        if at and self.stack[at].tag in tags:
            self.cut(at)
            return True
        return False

    def close(self, tag: str) -> None:
        at = self.open.get(tag)
        if not at:
            if tag == "p":
                self.stack[-1].children.append(Node("p", 0))
        elif tag in BLOCK or at[-1] > self.blocks[-1]:  # an inline mark doesn't close the block around it
            self.cut(at[-1])


def parse(page: str) -> Node:
    """A forgiving tree of a page: unclosed paragraphs and inline marks close with their block.

    Time and memory are in proportion to the page, whatever it holds.
    """
    tree, at, n = _Tree(), 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            tree.stack[-1].children.append(page[at:])
            break
        if start > at:
            tree.stack[-1].children.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2)
            at = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", start):
            end = page.find("]]>", start)
            tree.stack[-1].children.append(page[start + 9 : n if end < 0 else end].replace("&", "&amp;"))
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        closing = page.startswith("</", start)
        name = _NAME.match(page, start + 1 + closing)
        if not name and closing:
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        if not name:
            tree.stack[-1].children.append("<")
            at = start + 1
            continue
        tag = name[0].lower()
        attrs, alone, at = _tag(page, name.end())
        if at == n and not page.endswith(">"):
            break  # the page ends inside a tag
        if closing:
            tree.close(tag)
            continue
        if tag in CLOSES_P:
            tree.innermost({"p"})
        while tag in CLOSES and tree.innermost(CLOSES[tag]):
            pass
        if tag == ROOT:
            continue
        general, hidden, told = _general(tag, attrs)
        doubtful = bool(told) and tag != "body" and (tag in ("article", "main") or not told & COMMENTS)
        dropped = tag in DROPPED or tag not in ("body", "main", "article") and (hidden or bool(told) and not doubtful)
        child = Node(tag, step(tree.stack[-1].path % (1 << 64), general), dropped, doubtful)
        tree.stack[-1].children.append(child)
        if tag in RAW:
            if not alone:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                end = page.find(">", end.end()) if end else -1
                at = n if end < 0 else end + 1
        elif tag not in VOID and not alone:
            tree.push(child)
    _settle(tree.root)
    return tree.root


def _below(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node) and not c.dropped]


def _preorder(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += _below(node)
    return order


def _settle(root: Node) -> None:
    """Drop the doubtful elements, but those that hold over half of the page's text and look like an article."""
    order = _preorder(root)
    for node in reversed(order):
        below = _below(node)
        node.size = sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(c.size for c in below)
        node.best = {"article": 3, "main": 3, "h1": 3, "p": 1}.get(node.tag, 0) + sum(c.best for c in below)
    for node in order:
        if node.doubtful:
            node.dropped = 2 * node.size <= root.size or node.best < 3


def _walk(node: Node, out: list) -> None:
    """Text pieces of node in page order; None between blocks."""
    stack = [iter(node.children)]
    closes = [True]
    while stack:
        for child in stack[-1]:
            if isinstance(child, str):
                out.append(child)
                continue
            if child.tag in ("br", "wbr"):
                out.append(" " if child.tag == "br" else "")
                continue
            if child.dropped:
                if child.tag in BLOCK:
                    out.append(None)
                continue
            block = child.tag in BLOCK
            if block:
                out.append(None)
            stack.append(iter(child.children))
            closes.append(block)
            break
        else:
            stack.pop()
            if closes.pop():
                out.append(None)


def text_of(nodes: list[Node]) -> str:
    """Decoded text of nodes, a block's white space as single spaces, blocks joined by one space."""
    out: list = []
    for node in nodes:
        out.append(None)
        _walk(node, out)
    blocks, part = [], []
    for piece in [*out, None]:
        if piece is None:
            if part:
                text = " ".join("".join(map(html_lib.unescape, part)).split())
                if text:
                    blocks.append(text)
                part = []
        else:
            part.append(piece)
    return " ".join(blocks)


def _scores(root: Node) -> list[tuple[float, Node]]:
    """Score of every container outside boilerplate: its kept text less its links' text, weighed
    down where most of it lies in one container below, so that the tightest whole one wins."""
    found = []
    for node in reversed(_preorder(root)):
        below = _below(node)
        node.size = sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(c.size for c in below)
        node.links = node.size if node.tag == "a" else sum(c.links for c in below)
        node.best = max((c.best if c.tag not in CONTAINER else max(c.best, c.size) for c in below), default=0)
        if node.tag in CONTAINER or node is root:
            score = (node.size - node.links) * {"article": 1.5, "main": 1.3, "body": 0.8, ROOT: 0.6}.get(node.tag, 1.0)
            if node.best > 0.9 * node.size:
                score *= 0.9  # nothing of weight is outside one inner container
            if node.size:
                found.append((score, node))
    return found


def candidates(page: str) -> dict[int, float]:
    """The paths of a page's containers with a positive score, each with its share of the page's best."""
    scored: dict[int, float] = {}
    for score, node in _scores(parse(page)):
        scored[node.path] = scored.get(node.path, 0.0) + score
    best = max(scored.values(), default=0)
    return {p: s / best for p, s in scored.items() if s > 0}


def extract(page: str, path: int | None) -> str:
    """Main text by path; by the page's own best container if path is missing or holds nothing."""
    root = parse(page)
    if path is not None:
        chosen, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.path == path:
                chosen.append(node)
            else:
                stack += reversed(_below(node))
        text = text_of(chosen)
        if text:
            return text
    best = max(_scores(root), key=lambda x: x[0], default=None)
    return text_of([best[1]]) if best else ""


def extract_main(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html).

    Votes of a host are added up before their shuffle. The winners, a row a host, are broadcast
    while they are few, so that pages stay where they are; else pages are shuffled by host, and
    adaptive execution splits a hot one. A null html is an empty page with an empty text; pages
    without a host vote for nobody and go by their own best container; equal votes go to the
    path with the smaller number; repeated rows each come back; other columns are not read; no
    rows give no rows.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", F.lower(F.nullif(F.regexp_extract("url", _HOST, 1), F.lit(""))).alias("host"))

    def vote(batches):
        for batch, texts in text_groups(batches, "html"):
            votes: dict[tuple[str, int], int] = {}
            for host, page in zip(batch.column("host").to_pylist(), texts):
                for path, share in candidates(page.decode("utf-8", "surrogatepass")).items():
                    votes[host, path] = votes.get((host, path), 0) + int(1e6 * share)
            if votes:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes]), pa.array([k[1] for k in votes], pa.int64()), pa.array(list(votes.values()), pa.int64())], ["host", "path", "votes"])

    votes = pages.where("host is not null").select("host", "html").mapInArrow(vote, "host string, path long, votes long")
    total = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    winners = total.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path")).alias("w"))
    winners = small(checkpointed(winners.select("host", F.col("w.path").alias("path")), narrow=True), SMALL_ROWS)

    def cut(batches):
        for batch, texts in text_groups(batches, "html"):
            found = [extract(t.decode("utf-8", "surrogatepass"), p) for t, p in zip(texts, batch.column("path").to_pylist())]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(cut, "page_id long, url string, text string, n_chars long")
