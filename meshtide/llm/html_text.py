"""Main text of web pages: element subtrees that recur across a host's pages are its template and go.

A first pass parses every page and hashes its element subtrees, from the leaves up; Spark counts on
how many pages of a host each subtree stands. A second pass deletes the subtrees found on many pages of
their host, together with elements that are no article by their tag or role (menus, headers,
footers, forms, scripts and the like), and writes the text of what is left in blocks.

Recurrence decides inside articles too. Two things are kept against it: a single paragraph or heading
that stands directly in the changing part of an ``article`` or ``main`` (a common sentence is no
template), and a page of which nothing would be left (an article that a site publishes many times).

Elements with a class or id such as ``ad`` often change their text from page to page. For these the place
is counted instead of the text: the tag with its class and id. Such a name counts only as a whole, only for an
element that holds no article and less than half of the page's text, and only where the host's pages show the place
again and again, or are too few to show anything. Reader comments go by their name wherever other text is left.

Subtrees are counted in each slice before they are shuffled, so the template of a host with
a third of all pages is a row per slice. The recurring subtrees are broadcast up to a checked
size; beyond it they are joined to the pages' subtrees, dealt by page, not by host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.llm.arrowtext import slices
from meshtide.llm.shared import saved

#: A subtree is template where it stands on so many pages of its host and on such a share of them; a place, on so many pages.
MIN_PAGES, MIN_SHARE = 10, 0.25
BROADCAST_ROWS = 2_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption".split())
NO_ARTICLE = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea dialog menu head title object canvas audio video map search".split())
NO_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
COMMENTS = frozenset("comment comments comment-list commentlist comments-area disqus disqus_thread replies".split())
NOISE = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar share sharing social related popup modal overlay pager pagination login".split())
KEPT = frozenset("#root html head body main article".split())

# kinds of elements of which an open one is closed when another opens, and the elements that part them
KIND = {"p": "p", "li": "li", "dt": "term", "dd": "term", "tr": "row", "td": "cell", "th": "cell", "option": "option", "thead": "group", "tbody": "group", "tfoot": "group"}
PARTED = {
    "p": frozenset("td th table li div article section body button".split()), "li": frozenset("ul ol menu".split()), "term": frozenset(["dl"]),
    "row": frozenset(["table"]), "cell": frozenset("tr table".split()), "option": frozenset(["select"]), "group": frozenset(["table"]),
}
P_CLOSERS = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
UNQUOTED = re.compile(r"""[^>"']*""")
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node:
    """An element. near: the open element of each kind that another of its kind would close."""

    __slots__ = ("article", "children", "digest", "inside", "length", "markup", "names", "near", "parent", "role", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.markup = tag, parent, attributes
        self.children: list[Node | str] = []
        self.names: frozenset[str] = frozenset()
        self.role = ""
        self.near: dict[str, Node] = parent.near if parent else {}
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        if attributes and "=" in attributes:
            found: set[str] = set()
            for kind, a, b, c in ATTRIBUTE.findall(attributes):
                value = (a or b or c).lower()
                if kind.lower() == "role":
                    self.role = value.strip()
                else:
                    found.update(value.split())
            self.names = frozenset(found)

    def opened(self) -> None:
        """Note that this element is open: what it parts is no longer near, its own kind is."""
        tag = self.tag
        parted = [k for k in self.near if tag in PARTED[k]]
        if parted or tag in KIND:
            self.near = {k: v for k, v in self.near.items() if k not in parted}
            if tag in KIND:
                self.near[KIND[tag]] = self

    @property
    def no_article(self) -> bool:
        return self.tag in NO_ARTICLE or self.role in NO_ARTICLE_ROLES


def parse(page: str) -> list[Node]:
    """Elements in the order they open, the root first; what is not closed is closed by what holds it.

    Every character is looked at a bounded number of times, whatever is nested or left open: end tags
    without a start are known by counts of open elements, and a search for a character that the rest of
    the page does not have is not made again.
    """
    root = Node("#root", None)
    nodes, node, at, pos, size = [root], root, 0, 0, len(page)
    last = {c: page.rfind(c) for c in ">\"'"}
    open_: dict[str, int] = {}

    def close(to: Node) -> None:
        nonlocal node
        while node is not to:
            open_[node.tag] -= 1
            node = node.parent

    def end_of_tag(begin: int) -> int:
        k = UNQUOTED.match(page, begin).end()
        while k < size and page[k] != ">":
            quoted = page.find(page[k], k + 1) if k < last[page[k]] else -1
            if quoted < 0:  # a quote that nothing closes
                return page.find(">", begin)
            k = UNQUOTED.match(page, quoted + 1).end()
        return k if k < size else page.find(">", begin)

    while (i := page.find("<", pos)) >= 0:
        mark = page[i + 1 : i + 2]
        closing = mark == "/"
        m = NAME.match(page, i + 1 + closing)
        if not m and mark not in ("!", "?", "/"):
            pos = i + 1  # a plain character
            continue
        if i > at:
            node.children.append(page[at:i])
        if page.startswith("<!--", i):
            if page.startswith((">", "->"), i + 4):
                end = page.find(">", i)
            else:
                end = page.find("-->", i + 4)
                end = end + 2 if end >= 0 else size
        elif i > last[">"]:
            end = size  # the page ends within a tag
        else:
            end = end_of_tag(m.end()) if m and not closing else page.find(">", i)
        at = pos = min(size, end + 1)
        if not m or end >= size:
            continue
        name = m[0].lower()
        if closing:
            if open_.get(name):
                up = node
                while up.tag != name:
                    up = up.parent
                close(up.parent)
            elif name in ("br", "p"):
                nodes.append(Node(name, node))
                node.children.append(nodes[-1])
            continue
        if name in P_CLOSERS and "p" in node.near:
            close(node.near["p"].parent)
        if name in KIND and KIND[name] in node.near:
            close(node.near[KIND[name]].parent)
        made = Node(name, node, page[m.end() : end])
        nodes.append(made)
        node.children.append(made)
        if name in RAW:
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            at = pos = found.end() if found else size
        elif name not in VOID:
            node = made
            open_[name] = open_.get(name, 0) + 1
            made.opened()
    if at < size:
        node.children.append(page[at:])
    # from the leaves up: hash of the subtree, length of its text, whether it holds an article that is no comment
    for x in reversed(nodes):
        parts, x.length = [x.tag.encode(errors="replace"), x.markup.encode(errors="replace")], 0
        x.article = x.tag == "main" or (x.tag == "article" and not x.names & COMMENTS)
        for y in x.children:
            if isinstance(y, str):
                parts.append(y.encode(errors="replace"))
                x.length += len(y.strip())
            else:
                parts.append(y.digest)
                x.length += 0 if y.no_article else y.length
                x.article |= y.article
        x.digest = xxhash.xxh3_128_digest(b"\0".join(parts))
    return nodes


def candidates(nodes: list[Node]) -> list[tuple[Node, int, int]]:
    """(element, kind, hash): subtrees that may be template (kind 1), and places of elements named like noise (kind 2)."""
    made = []
    for x in nodes:
        if x.tag in BLOCKS and x.tag not in KEPT and not x.no_article:
            if not (x.inside and x.tag in PROSE):
                made.append((x, 1, int.from_bytes(x.digest[:8], "little")))
            if x.names & NOISE and not x.article:
                made.append((x, 2, xxhash.xxh3_64_intdigest(" ".join([x.tag, *sorted(x.names)]).encode(errors="replace"))))
    return made


def _blocks(root: Node, gone: set[int]) -> list[str]:
    blocks: list[list[str]] = [[]]
    todo: list[Node | str | None] = [root]
    while todo:
        x = todo.pop()
        if x is None:
            if blocks[-1]:
                blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif x.tag == "br":
            blocks[-1].append(" ")
        elif id(x) not in gone:
            if x.tag in BLOCKS:
                todo.append(None)
                todo.extend(reversed(x.children))
                todo.append(None)
            else:
                todo.extend(reversed(x.children))
    return [t for b in blocks if (t := " ".join(entities.unescape("".join(b)).split()))]


def _text(nodes: list[Node], gone: set[int]) -> str:
    """Blocks of the outermost main elements, or of the page if they have none."""
    mains, under = [], set()  # under: elements that are gone or main, and what stands in them
    for x in nodes:
        main = x.tag == "main" or x.role == "main"
        if id(x) in gone or id(x.parent) in under:
            under.add(id(x))
        elif main:
            mains.append(x)
            under.add(id(x))
    text = "\n".join(t for x in mains for t in _blocks(x, gone))
    return text or "\n".join(_blocks(nodes[0], gone))


def main_text(page: str | None, known=lambda kind, h: False) -> str:
    """The main text's blocks, one line each; known(kind, hash) tells the host's template: 0 whether its pages are enough to judge, 1 subtrees, 2 places."""
    if not page:
        return ""
    nodes = parse(page)
    plain = {id(x) for x in nodes if x.no_article}
    judged = known(0, 0)
    named, recurring = set(), set()
    for x, kind, h in candidates(nodes):
        if kind == 1 and known(1, h):
            recurring.add(id(x))
        elif kind == 2 and (known(2, h) or not judged) and 2 * x.length < nodes[0].length:
            named.add(id(x))
    comments = {id(x) for x in nodes if x.names & COMMENTS and not x.article and x.tag not in KEPT - {"article"}}
    # what would leave nothing is not believed: the names of comments first, then recurrence
    for gone in (plain | named | recurring | comments, plain | recurring, plain):
        if text := _text(nodes, gone):
            return text
    return ""


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _key(host: str, kind: int, h: int) -> int:
    return xxhash.xxh3_64_intdigest(host.encode(errors="replace") + bytes([kind]), h) - (1 << 63)


def recurring_subtrees(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(key long), hashes of a host and: nothing else, if it has min_pages pages; a subtree on so many of its pages and on min_share of them; a place on so many."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            n: dict[tuple[str, int, int], int] = {}
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                host = host_of(url)
                for kind, h in {(0, 0), *((kind, h) for _, kind, h in candidates(parse(page)))} if page else {(0, 0)}:
                    n[(host, kind, h)] = n.get((host, kind, h), 0) + 1
            keys = [_key(*x) for x in n]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in n]), pa.array([x[1] for x in n], pa.int32()), pa.array(keys, pa.int64()), pa.array(list(n.values()), pa.int64())], ["host", "kind", "key", "n"])

    counted = pages.mapInArrow(count, "host string, kind int, key long, n long").groupBy("host", "kind", "key").agg(F.sum("n").alias("n"))
    counted = saved(counted.where(F.col("n") >= min_pages), "subtrees")
    total = counted.where("kind = 0").select("host", F.col("n").alias("pages"))
    subtrees = counted.where("kind = 1").join(total, "host").where(F.col("n") >= min_share * F.col("pages")).select("key")
    return counted.where("kind <> 1").select("key").unionAll(subtrees)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page; text is empty if there is none.

    Null and empty pages have no text. A null or bad url counts as a host of its own, named by the empty
    string. Repeated rows count as pages and get the same text each; null ids pass through. A subtree on exactly
    min_pages pages or min_share of them counts as recurring. A page of any length is parsed whole, in time
    proportional to it; it is held by one task. An empty table gives an empty result. Columns besides the three
    named are not read, so theirs may clash with those added.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    known = saved(recurring_subtrees(base, min_pages, min_share), "template")
    id_type = base.schema["page_id"].dataType.simpleString()
    schema = f"page_id {id_type}, url string, text string, n_chars long"

    def result(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if known.count() <= BROADCAST_ROWS:
        keys = pages.sparkSession.sparkContext.broadcast(np.sort(known.toArrow()["key"].to_numpy()))

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have = set(keys.value.tolist())
            for batch in slices(batches, "html"):
                texts = []
                for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    host = host_of(url)
                    texts.append(main_text(page, lambda kind, h, host=host: _key(host, kind, h) in have))
                yield result(batch, texts)

        return base.mapInArrow(extract, schema)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            row, key = [], []
            for i, (url, page) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                host = host_of(url)
                own = {_key(host, 0, 0), *(_key(host, kind, h) for _, kind, h in candidates(parse(page)))} if page else set()
                row += [i] * len(own)
                key += own
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(3).take(row), pa.array(key, pa.int64())], ["page_id", "own", "key"])

    # an id and the hash of its url and page name a row; rows that share them have the same text
    base = base.withColumn("own", F.xxhash64("url", "html"))
    hits = base.mapInArrow(keyed, f"page_id {id_type}, own long, key long").join(known, "key").groupBy("page_id", "own").agg(F.collect_set("key").alias("keys"))
    joined = base.join(hits, base["page_id"].eqNullSafe(hits["page_id"]) & (base["own"] == hits["own"]), "left").select(base["page_id"], "url", "html", "keys")

    def extract_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = []
            for url, page, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                host, have = host_of(url), set(own or ())
                texts.append(main_text(page, lambda kind, h, host=host, have=have: _key(host, kind, h) in have))
            yield result(batch, texts)

    return joined.mapInArrow(extract_joined, schema)
