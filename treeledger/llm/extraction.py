"""Main text of web pages by site style trees.

The DOMs of one host are merged by style path (tags with their classes and ids). Over the
host's distinct pages each node of the merged tree gets an importance from 0 to 1: the entropy
of its presentations (sequences of child styles) and of its contents, to base of the number of
pages, as (1 - decay) * presentation + decay * content. Branches that look and read alike
on every page are low and go; what differs from page to page stays.

Some styles have a known importance: menus, footers, forms, adverts, notices, comments and the like
(by tag, role, or words in class and id) have none, nor has what lies outside the article
where a page marks one; the article itself and its plain text tags have full importance. Nodes
seen on fewer than ``pages`` distinct pages of a host are not judged by entropy.

Blocks are the texts between block-level tags; unclosed and stray tags are tolerated, a line
break counts as white space. Null html is empty text; a url without host belongs to no
site, so only known styles count; repeated pages count once in the tree; an empty table gives
no rows; extra columns are dropped.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm.bytesets import packed
from treeledger.llm.registry import query
from treeledger.llm.urlfilter import host_and_path
from treeledger.operators.durable import durable, fetch
from treeledger.sources.adapters import table

# Tags that start and end blocks, hold no text for readers, close by themselves, or close an open paragraph's kin.
BLOCK_TAGS = frozenset((
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li link main menu meta nav ol option p pre section select summary table tbody td tfoot th thead title tr ul"
).split())
RAW_TAGS = ("script", "style", "iframe", "noembed", "noframes", "xmp", "template", "svg", "object", "textarea", "title")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": ("tbody",), "tfoot": ("tr", "td", "th", "tbody"),
}
HOLDERS = frozenset("ul ol dl table tr tbody thead tfoot select article section div body main".split())
# Styles without importance. The second and third hold outside an article only.
NO_TAGS = frozenset("head nav footer aside form button select menu dialog noscript input option fieldset".split())
NO_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
NO_TAGS_OUTSIDE = frozenset(("header",))
NO_WORDS_OUTSIDE = frozenset("header masthead banner top bottom logo legal copyright".split())
NO_WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus breadcrumb "
    "breadcrumbs footer sidebar sidebars aside cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup "
    "login register search form share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond widget "
    "widgets toolbar pagination pager skip"
).split())
PLAIN_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dd dt b i em strong a span br figure figcaption table tbody tr td th code".split())

TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^"'<>]|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW_TAGS}
NODES = "host string, path string, page long, presentation long, content long"
TEXTS = "page_id long, url string, text string, n_chars long"


@dataclass(frozen=True)
class StyleTree:
    decay: float = 0.9
    pages: int = 8
    least: float = 0.2
    links: float = 0.6


@lru_cache(maxsize=65_536)
def style(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Style name of an element, and whether it has no importance anywhere, or outside an article."""
    words, role = [], ""
    if attributes and "=" in attributes:
        for kind, *values in ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "")
            if kind.lower() == "role":
                role = value.lower()
            else:
                words += value.split()
    parts = {p for w in words for p in re.sub(r"([a-z])([A-Z])", r"\1 \2", w).lower().replace("_", " ").replace("-", " ").split()}
    name = ".".join([tag, *sorted({re.sub(r"\d+", "0", w.lower()) for w in words})])
    never = tag in NO_TAGS or role in NO_ROLES or not parts.isdisjoint(NO_WORDS)
    return name, never, never or tag in NO_TAGS_OUTSIDE or not parts.isdisjoint(NO_WORDS_OUTSIDE)


class Page:
    """A page's elements (parents first) and text blocks."""

    def __init__(self, html: str):
        self.parent, self.tag, self.path, self.never, self.outside, self.plain = [-1], [""], [""], [False], [False], [False]
        self.blocks: list[tuple[int, str]] = []
        self.linked = [0]  # characters of links in each block
        self.read(html)

    def read(self, html: str) -> None:
        open_, held, link, at, end = [0], [], 0, 0, len(html)
        linked = []

        def flush():
            text = " ".join(entities.unescape("".join(held)).split()) if held else ""
            if text:
                owner = next(k for k in reversed(open_) if self.tag[k] in BLOCK_TAGS or k == 0)
                self.blocks.append((owner, text))
                linked.append(sum(links))
            held.clear()
            links.clear()

        links: list[int] = []
        while at < end:
            m = TOKEN.search(html, at)
            text = html[at:m.start()] if m else html[at:]
            if text:
                held.append(text)
                if link:
                    links.append(len(text.strip()))
            if not m:
                break
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, closing = tag.lower(), m[1] or m[4]
            if closing:
                if tag in BLOCK_TAGS:
                    flush()
                if tag == "a":
                    link = max(0, link - 1)
                for k in range(len(open_) - 1, 0, -1):
                    if self.tag[open_[k]] == tag:
                        del open_[k:]
                        break
                    if tag not in BLOCK_TAGS and self.tag[open_[k]] in BLOCK_TAGS:
                        break
                continue
            if tag == "br":
                held.append(" ")
                continue
            if tag in BLOCK_TAGS:
                flush()
                link = 0
                self.close(open_, ("p",))
                if tag in CLOSES:
                    self.close(open_, CLOSES[tag])
            if tag in RAW_END:
                stop = RAW_END[tag].search(html, at)
                at = stop.end() if stop else end
                continue
            if tag in VOID_TAGS:
                continue
            attributes = m[3] if m[2] else m[6]
            name, never, outside = style(tag, attributes.strip())
            up = open_[-1]
            self.parent.append(up)
            self.tag.append(tag)
            self.path.append(f"{self.path[up]}/{name}")
            self.never.append(never)
            self.outside.append(outside)
            self.plain.append(name in PLAIN_TAGS)
            open_.append(len(self.tag) - 1)
            link += tag == "a"
        flush()
        self.linked = linked

    def close(self, open_: list[int], tags: tuple[str, ...]) -> None:
        """Closes an open element of these tags unless a holder lies between."""
        for k in range(len(open_) - 1, 0, -1):
            tag = self.tag[open_[k]]
            if tag in tags:
                del open_[k:]
                return
            if tag in HOLDERS:
                return

    def known(self, links: float) -> tuple[list[bool], list[bool]]:
        """For each element: whether it has no importance by its style, and whether entropy may judge it."""
        n = len(self.tag)
        holds = [False] * n
        wordy = {k for k, _ in self.blocks}
        for k in range(n - 1, 0, -1):
            if k in wordy:
                holds[k] = True
            holds[self.parent[k]] |= holds[k]
        root = next((t for t in ("article", "main") if any(self.tag[k] == t and holds[k] and not self.never[k] for k in range(n))), None)
        above = [False] * n  # has the root below
        inside = [False] * n
        if root:
            for k in range(n - 1, 0, -1):
                above[k] |= self.tag[k] == root and not self.never[k]
                above[self.parent[k]] |= above[k]
            for k in range(1, n):
                inside[k] = inside[self.parent[k]] or (self.tag[k] == root and not self.never[k])
        none, judged = [False] * n, [False] * n
        for k in range(1, n):
            own = self.never[k] if inside[k] else (self.outside[k] and not above[k])
            none[k] = none[self.parent[k]] or own or (root is not None and not inside[k] and not above[k])
            judged[k] = not above[k] and not (inside[k] and (self.plain[k] or self.tag[k] == root))
        if root is None:
            for (k, text), part in zip(self.blocks, self.linked):
                if part > links * len(text) and self.tag[k] in ("li", "ul", "ol", "td", "div"):
                    none[k] = True
        return none, judged

    def nodes(self, none: list[bool], judged: list[bool]) -> tuple[int, dict[str, tuple[int, int]]]:
        """Digest of the page's candidate text, and per style path its presentation and content digests."""
        mask, whole = (1 << 63) - 1, 0
        shown: dict[str, int] = {}
        said: dict[str, int] = {}
        for k in range(1, len(self.tag)):
            up = self.path[self.parent[k]]
            shown.setdefault(self.path[k], 0)
            shown[up] = (shown.get(up, 0) * 1_000_003 ^ xxhash.xxh64_intdigest(self.path[k])) & mask
        for k, text in self.blocks:
            digest = xxhash.xxh64_intdigest(text)
            if not none[k]:
                whole = (whole * 1_000_003 ^ digest) & mask
            while k:
                said[self.path[k]] = (said.get(self.path[k], 0) * 1_000_003 ^ digest) & mask
                k = self.parent[k]
        return whole, {p: (shown[p], said.get(p, 0)) for p in shown if p}

    def text(self, none: list[bool], judged: list[bool], low: set[str]) -> str:
        gone = [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            gone[k] = gone[self.parent[k]] or none[k] or (judged[k] and self.path[k] in low)
        return "\n".join(text for k, text in self.blocks if not gone[k])


def page_nodes(batches, options: StyleTree):
    for batch in batches:
        rows = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = Page(html)
            digest, nodes = page.nodes(*page.known(options.links))
            rows += [(host, path, digest, a, b) for path, (a, b) in nodes.items()]
        if rows:
            yield from packed(rows, NODES).to_batches(max_chunksize=50_000)


def page_texts(batches, options: StyleTree):
    for batch in batches:
        rows = []
        for page_id, url, html, low in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "low"))):
            page = Page(html)
            text = page.text(*page.known(options.links), set(low or ()))
            rows.append((page_id, url, text, len(text)))
        if rows:
            yield from packed(rows, TEXTS).to_batches()


def importance(nodes: DataFrame, options: StyleTree = StyleTree()) -> DataFrame:
    """host, path, pages, importance over the distinct pages of each host."""
    distinct = nodes.distinct()

    def entropy(column, name):
        counts = distinct.groupBy("host", "path", column).agg(F.count(F.lit(1)).alias("n"))
        sums = counts.groupBy("host", "path").agg(F.sum("n").alias(f"m_{name}"), F.sum(F.col("n") * F.log("n")).alias("s"))
        m = F.col(f"m_{name}")
        return sums.select("host", "path", m, F.when(m > 1, (F.log(m) - F.col("s") / m) / F.log(m)).otherwise(1.0).alias(name))

    both = entropy("presentation", "shape").join(entropy("content", "words"), ["host", "path"])
    value = (1 - options.decay) * F.col("shape") + options.decay * F.col("words")
    return both.select("host", "path", F.col("m_words").alias("pages"), F.when(F.col("m_words") >= options.pages, value).otherwise(1.0).alias("importance"))


def main_texts(pages: DataFrame, options: StyleTree = StyleTree()) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_and_path(F.col("url"))[0].alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    nodes = known.where("host <> ''").select("host", "html").mapInArrow(lambda it: page_nodes(it, options), NODES)
    low = durable(importance(nodes, options).where(F.col("importance") < options.least).groupBy("host").agg(F.collect_list("path").alias("low")))
    return fetch(known, low, ["host"], "left").select("page_id", "url", "html", "low").mapInArrow(lambda it: page_texts(it, options), TEXTS)


@query("op6_site_style_tree")
def op6_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
