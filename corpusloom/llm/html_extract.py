"""Main text of web pages by wrapper induction over pages of the same host.

A page's blocks form a tree of elements.  Pages of a host are aligned with the host's reference page by
simple tree matching, which gives every block the slot of the reference node that it matches.  Spark counts
how often a slot shows the same text: constant slots are template, varying slots are content, on every page.
Without a word of the slots, a page that marks an article has its text there and other pages anywhere; what
stands in navigation, header, footer, side, form or advert elements is never text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import ROW, keyed, need, saved, split_by_keys

CONSTANT_SHARE = 0.5
LEAST_PAGES = 3
#: Cells of an alignment that are held at once; a longer pair of levels is halved first.
CELLS = 4096
#: References sent to every task at once; with more hosts they are joined.
HOSTS_SENT = 20_000

# Element names and class words of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg iframe object select textarea button canvas".split())
RAW = ("script", "style", "noscript", "template", "svg", "textarea", "iframe", "title")
APART = frozenset("nav header footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("caption tbody td tfoot th thead tr".split())
APART_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|header|masthead|footer|foot|sidebar|side|widget|related|share|social|"
    r"cookies?|consent|notice|popup|modal|newsletter|subscribe|comments?|replies|reply|disqus|login|search|toolbar|pagination|pager|copyright)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "kids", "texts", "parent", "apart", "main", "size", "slot")

    def __init__(self, tag: str, parent: Node | None, apart: bool = False, main: bool = False):
        self.tag, self.parent, self.kids, self.size, self.slot = tag, parent, [], 1, -1
        self.apart = apart or (parent is not None and parent.apart)
        self.main = main or (parent is not None and parent.main)


def parse(source: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of block elements and the page's blocks of text in order, with the element that holds each."""
    root = Node("html", None)
    node, stack, blocks, run = root, [("html", root)], [], []

    def flush():
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if text:
            blocks.append((node, text))

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            run.append(source[at:])
            break
        if m.start() > at:
            run.append(source[at : m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if any(t in BLOCK for t, _ in stack[i:]):
                        flush()
                    del stack[i:]
                    node = stack[-1][1]
                    break
            continue
        if tag in ("br", "hr"):
            if tag == "hr":
                flush()
            run.append(" ")
            continue
        if tag in RAW:
            end = _END[tag].search(source, at)
            at = end.end() if end else n
            continue
        if tag in ("html", "body"):
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P and any(t == "p" for t, _ in stack):
                i = max(i for i, (t, _) in enumerate(stack) if t == "p")
                # A paragraph ends here and takes its open inline elements along.
                if not any(t in BLOCK for t, _ in stack[i + 1 :]):
                    del stack[i:]
                    node = stack[-1][1]
            if tag in ("li", "dt", "dd", "tr", "td", "th"):
                same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in same:
                        del stack[i:]
                        node = stack[-1][1]
                        break
                    if stack[i][0] in ("ul", "ol", "dl", "table", "menu"):
                        break
        attrs = m.group(3)
        apart, main = tag in APART or tag in HIDDEN, tag in MAIN
        if attrs and not attrs.isspace():
            for name, a, b, c in _ATTR.findall(attrs):
                value = a or b or c
                name = name.lower()
                if name in ("class", "id") and APART_WORDS.search(value) and not main:
                    apart = True
                elif name == "role":
                    apart |= value.lower() in ROLES
                    main |= value.lower() == "main"
                elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                    apart = True
        if tag == "header" and node.main and not node.apart:
            apart = False  # an article's own heading
        if tag in BLOCK or apart:
            if tag not in BLOCK:
                flush()
            child = Node(tag, node, apart, main)
            node.kids.append(child)
            stack.append((tag, child))
            node = child
        elif not attrs.rstrip().endswith("/"):
            stack.append((tag, node))
    flush()
    return root, blocks


def number(root: Node) -> list[Node]:
    """Nodes in page order; ``size`` counts a node's subtree."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(reversed(x.kids))
    for x in reversed(order):
        x.size = 1 + sum(k.size for k in x.kids)
    return order


def _pairs(xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
    """Best in-order pairs of equal tags, weighted by the likeness of their sizes."""
    w = [[0 if p.tag != q.tag else 1 + min(p.size, q.size) / (1 + max(p.size, q.size)) for q in ys] for p in xs]
    best = [[0.0] * (len(ys) + 1)]
    for row in w:
        above, left = best[-1], 0.0
        line = [left]
        for j, gain in enumerate(row):
            left = max(above[j + 1], left, above[j] + gain if gain else 0)
            line.append(left)
        best.append(line)
    i, j, found = len(xs), len(ys), []
    while i and j:
        if w[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + w[i - 1][j - 1]:
            found.append((xs[i - 1], ys[j - 1]))
            i, j = i - 1, j - 1
        elif best[i - 1][j] >= best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return found


def _last_line(xs: list[Node], ys: list[Node]) -> np.ndarray:
    """Weight of the best pairs of all ``xs`` with each prefix of ``ys``, one line at a time."""
    number: dict[str, int] = {}
    tags = np.array([number.setdefault(q.tag, len(number)) for q in ys])
    size, line = np.array([q.size for q in ys], float), np.zeros(len(ys) + 1)
    for p in xs:
        gain = np.where(tags == number.get(p.tag, -1), 1 + np.minimum(size, p.size) / (1 + np.maximum(size, p.size)), 0)
        line[1:] = np.maximum.accumulate(np.maximum(line[1:], np.where(gain > 0, line[:-1] + gain, 0)))
    return line


def align(xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
    """``_pairs`` of levels of any length: halves of ``xs`` meet where their best weights add up to the most."""
    found, todo = [], [(xs, ys)]
    while todo:
        x, y = todo.pop()
        if not x or not y:
            continue
        if len(x) * len(y) <= CELLS:
            found += _pairs(x, y)
        elif len(x) == 1:
            todo += [(x, [max((q for q in y if q.tag == x[0].tag), key=lambda q: min(q.size, x[0].size) / (1 + max(q.size, x[0].size)), default=y[0])])]
        else:
            m = len(x) // 2
            cut = int(np.argmax(_last_line(x[:m], y) + _last_line(x[:m - 1:-1], y[::-1])[::-1]))
            todo += [(x[:m], y[:cut]), (x[m:], y[cut:])]
    return found


def match(a: Node, b: Node) -> None:
    """Simple tree matching: gives nodes under ``a`` the slots of the nodes of ``b`` they match.

    Children are aligned in order by dynamic programming over equal tags, weighted by what their own
    children match at the next level; levels of any length are aligned whole.
    """
    a.slot = b.slot
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        for p, q in align(x.kids, y.kids):
            p.slot = q.slot
            todo.append((p, q))


def host_of(url):
    """Host of a url column, lower-cased; null or odd urls share one empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _likely(blocks: list[tuple[Node, str]]) -> list[bool]:
    """Whether each block is text as far as the marks tell: what the page's article holds, or all of a page without one."""
    marked = any(x.main and not x.apart for x, _ in blocks)
    return [not x.apart and (x.main or not marked) for x, _ in blocks]


def _aligned(references: dict[str, str] | None):
    """(row, host, block number, slot, text hash, whether its slot may tell, whether it is likely text) of each page's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Node] = {}
        for batch in batches:
            out = []
            refs = batch.column(3).to_pylist() if references is None else None
            for i, (row, host, source) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                root, blocks = parse(source or "")
                if not blocks:
                    continue
                if host not in trees:
                    if len(trees) > 1000:
                        trees.clear()
                    tree, _ = parse((references[host] if refs is None else refs[i]) or "")
                    for k, x in enumerate(number(tree)):
                        x.slot = k
                    trees[host] = tree
                number(root)
                match(root, trees[host])
                out += [(row, host, k, x.slot, _hash(text), not x.apart, y) for k, ((x, text), y) in enumerate(zip(blocks, _likely(blocks)))]
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["__row", "host", "k", "slot", "t", "open", "likely"])

    return run


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for source, other in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            _, blocks = parse(source or "")
            other = set(other or ())
            kept = [t for k, ((_, t), y) in enumerate(zip(blocks, _likely(blocks))) if y != (k in other)]
            texts.append("\n".join(kept))
        n = [len(t) for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:3], pa.array(texts, pa.string()), pa.array(n, pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of ``pages(page_id, url, html)``: page_id, url, text, n_chars.

    One row per row; null or empty html gives an empty text; pages without a usable url are one host;
    equal rows count as pages each; an empty table gives no rows; other columns are ignored; a page of any
    length is read whole.  A host's reference is its page with the smallest content hash.
    """
    rows = keyed(need(pages, "page_id", "url", "html")).withColumn("host", host_of(F.col("url")))
    filled = rows.where("html is not null and html != ''")
    pick = filled.groupBy("host").agg(F.min(F.struct(F.xxhash64("html").alias("h"), F.col(ROW).alias("r"))).alias("m"))
    pick = saved(pick.select("host", F.col("m.r").alias("r")))
    chosen = pick.select(F.col("r").alias(ROW))
    some, rest = split_by_keys(filled, chosen)
    reference = some if rest is not None else filled.join(chosen, ROW, "left_semi")
    reference = reference.select("host", F.col("html").alias("ref"))
    if pick.limit(HOSTS_SENT + 1).count() <= HOSTS_SENT and reference.agg(F.coalesce(F.sum(F.length("ref")), F.lit(0))).first()[0] < 32 << 20:
        sent = {r[0]: r[1] for r in reference.collect()}
        aligned = filled.select(ROW, "host", "html").mapInArrow(_aligned(sent), "__row long, host string, k int, slot int, t long, open boolean, likely boolean")
    else:
        with_ref = filled.join(reference, "host").select(ROW, "host", "html", "ref")
        aligned = with_ref.mapInArrow(_aligned(None), "__row long, host string, k int, slot int, t long, open boolean, likely boolean")
    aligned = saved(aligned)
    shown = aligned.select("host", "slot", "t", ROW).distinct().groupBy("host", "slot", "t").agg(F.count(F.lit(1)).alias("n"))
    asked = aligned.select("host", ROW).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    constant = shown.where(F.col("n") >= LEAST_PAGES).join(asked, "host").where(F.col("n") >= F.col("pages") * CONSTANT_SHARE)
    slots = shown.where("slot >= 0").groupBy("host", "slot").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    varying = slots.where((F.col("n") >= LEAST_PAGES) & (F.col("most") < F.col("n") * CONSTANT_SHARE)).select("host", "slot")
    template = aligned.where("open and likely").join(constant.select("host", "slot", "t"), ["host", "slot", "t"]).select(ROW, "k")
    content = aligned.where("open and not likely").join(varying, ["host", "slot"]).select(ROW, "k")
    other = saved(template.unionByName(content).groupBy(ROW).agg(F.collect_list("k").alias("other")))
    some, rest = split_by_keys(rows.select(ROW, "page_id", "url", "html"), other)
    both = some.join(other, ROW, "left")
    if rest is not None:
        both = both.unionByName(rest.withColumn("other", F.lit(None).cast("array<int>")))
    return both.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
