"""Main text of web pages by site style trees.

Each page is read into a tree of elements. The trees of a host's distinct pages
are merged by style path (the tags and classes from the root). Importance of a
merged node is measured as entropies over those pages:

* presentation: how evenly pages differ in the node's sequence of children,
* content: one less the mean entropy of its texts; a text that many pages share
  is worth little, one that a single page has is worth most.

Branches of low importance go from every page, and so do single texts that
SHARED of a host's distinct pages have in the same place, inside articles as well.
What the markup itself declares (navigation, forms, scripts, adverts, notices,
comments ...) goes on any host, also where there are too few pages for entropies.
An article, where the markup declares one, is what is kept of the rest; but where
text outside is OUTSIDE times as long, and at least OUTSIDE_LEAST characters, the
article is taken for a teaser and text outside stays too.

A class or id declares noise if one of its names is a word for it (`sidebar`), or
is made of such words and neutral ones (`site-footer`), not if other words are in
it (`has-sidebar`, `share-price`).

Merging ships hashes and counts, not texts: counts are added up in each batch,
again before the exchange, and once more behind it, so a host with a third of
all pages is spread by its nodes and texts. The hosts' lists of unimportant nodes
are checkpointed and measured: up to BROADCAST_BYTES they go to every task and no
page moves; beyond that pages meet them in a join that adaptive execution splits.
The same goes for the list of pages that are copies on their host.

Defined cases: null html is an empty page; a page without text gives the empty
string; unclosed elements end with their parents and a page cut off in a tag ends
there; urls without a host (or null) count as one host; repeated rows and copies
count as one page of the tree and have a result each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.textcore import slices
from reelspark.session import cut, ship

#: A node on fewer pages than MIN_PAGES is not judged; PRESENTATION is that entropy's weight beside content's.
MIN_PAGES, THRESHOLD, PRESENTATION, SHARED = 8, 0.35, 0.1, 0.8
OUTSIDE, OUTSIDE_LEAST = 4, 600
BROADCAST_BYTES = 16 << 20

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td "
    "template tfoot th thead title tr ul".split()
)
DROPPED = set(
    "script style noscript template title head nav aside footer form fieldset button select textarea input datalist iframe object embed applet svg math "
    "canvas audio video map dialog menu search noembed noframes".split()
)
#: Opening one of these ends an open one of the values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"html", "body", "article", "main", "section", "div", "table", "ul", "ol", "dl", "blockquote", "td", "th", "aside", "nav", "header", "footer", "form", "fieldset", "details", "figure"}
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted banner cookie cookies consent gdpr notice notices alert newsletter "
    "subscribe subscription signup login sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist "
    "reply replies respond disqus share sharing social related recommended popup modal overlay search widget widgets toolbar pagination pager skip".split()
)
#: Words that may stand beside a noise word in one name, and beside "header" where that is the site's.
SITE_WORDS = set("site page global top bottom main primary secondary wrapper wrap container inner outer bar mobile".split())
NEUTRAL_WORDS = SITE_WORDS | set("left right list item items box block area section panel link links button buttons icon icons post posts article articles story stories col column group form body text title to".split())
#: What an article of its own may be declared as.
NOISE_ARTICLES = set("ad ads advert advertisement sponsored promo comment reply".split())
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
MAIN = {"article", "main"}


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _declared_noise(tag: str, attributes: dict[str, str], in_main: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_main:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in NOISE_ROLES:
        return tag not in ("html", "body")
    if tag in ("html", "body", "main"):
        return False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    if tag in MAIN:
        return any(n in NOISE_ARTICLES for n in names)
    return any(_noise_name(n, in_main) for n in names)


def _noise_name(name: str, in_main: bool) -> bool:
    words = set(re.split(r"[_-]+", name)) - {""}
    noise = words & NOISE_WORDS
    if "header" in words and not in_main:
        return words - {"header"} - noise <= SITE_WORDS
    return bool(noise) and words - noise <= NEUTRAL_WORDS


class Node:
    """An open element: its place in the style tree and what holds for texts in it."""

    __slots__ = ("children", "main", "noise", "path", "paths", "tag")

    def __init__(self, tag: str, paths: tuple[int, ...], noise: bool, main: int):
        self.tag, self.paths, self.path, self.noise, self.main, self.children = tag, paths, paths[-1], noise, main, []


class Page:
    """blocks: (text, style path of the article that it is in or 0, style paths from the root); nodes: (style path, its children's styles)."""

    def __init__(self, text: str, nodes: bool = False):
        self.blocks: list[tuple[str, int, tuple[int, ...]]] = []
        self.nodes: list[tuple[int, int]] = []
        self.has_main, self._keep_nodes, self._open = False, nodes, []
        self._stack = [Node("", (0,), False, 0)]
        self._read(text)

    def _end_block(self) -> None:
        if self._open:
            text = " ".join("".join(self._open).split())
            if text:
                node = self._stack[-1]
                self.blocks.append((text, node.main, node.paths))
            self._open = []

    def _pop(self) -> None:
        node = self._stack[-1]
        if node.tag in BLOCK:
            self._end_block()
        self._stack.pop()
        if self._keep_nodes and node.tag in BLOCK and not node.noise:
            self.nodes.append((node.path, xxhash.xxh64_intdigest(repr(node.children))))

    def _close(self, tags: set[str], scope: set[str]) -> bool:
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[k].tag
            if tag in tags:
                while len(self._stack) > k:
                    self._pop()
                return True
            if tag in scope:
                return False
        return False

    def _start(self, tag: str, rest: str) -> None:
        if tag in BLOCK:
            self._end_block()
            self._close({"p"}, SCOPE)
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPE - CLOSES[tag] - ({"td", "th"} if tag == "tr" else set()))
        if tag in VOID:
            if tag == "br":
                self._open.append(" ")
            return
        above = self._stack[-1]
        attributes = _attributes(rest) if rest.strip(" /\n\t\r") else {}
        noise = above.noise or _declared_noise(tag, attributes, above.main != 0)
        paths = above.paths
        if tag in BLOCK:
            style = f"{tag} {' '.join(sorted(attributes.get('class', '').split()))}"
            above.children.append(style)
            paths = (*paths, xxhash.xxh64_intdigest(style, above.path) or 1)
        main = above.main
        if not main and not noise and (tag in MAIN or attributes.get("role") in MAIN):
            main = paths[-1]
            self.has_main = True
        self._stack.append(Node(tag, paths, noise, main))

    def _read(self, text: str) -> None:
        at, raw = 0, None
        while True:
            if raw:
                stop = re.compile(rf"</{raw}(?=[\s/>]|\Z)", re.I).search(text, at)
                at, raw = stop.start() if stop else len(text), None
            m = TOKEN.search(text, at)
            piece = text[at : m.start() if m else len(text)]
            if piece and not self._stack[-1].noise:
                self._open.append(entities.unescape(piece) if "&" in piece else piece)
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "p" and not any(n.tag == "p" for n in self._stack):
                    self._end_block()
                elif tag not in VOID:
                    self._close({tag}, {"article", "main", "body", "html"} - {tag} if tag not in ("body", "html", "article", "main") else set())
            else:
                self._start(tag, m[3])
                if tag in RAW:
                    raw = tag
        while len(self._stack) > 1:
            self._pop()
        self._end_block()


def extract(page: Page, low: frozenset[int] = frozenset()) -> str:
    """The blocks that are kept, a line each; low has unimportant nodes, and texts as _text_key tells them."""
    kept = page.blocks
    if low:
        kept = [b for b in kept if not low.intersection(b[2]) and _text_key(b[2][-1], b[0]) not in low]
    if page.has_main:
        inside = [b for b in kept if b[1]]
        own, all_ = (sum(len(text) for text, _, _ in some) for some in (inside, kept))
        if all_ - own < max(OUTSIDE * own, OUTSIDE_LEAST):
            kept = inside
    return "\n".join(text for text, _, _ in kept)


def _text_key(node: int, text: str) -> int:
    return node ^ xxhash.xxh64_intdigest(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def features(pages: DataFrame) -> DataFrame:
    """host, node, kind, value, n: how many of pages(host, html) have a node with a sequence of children (kind s) or a text (kind t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 8 << 20):
                counts: Counter = Counter()
                for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    page = Page(text or "", nodes=True)
                    seen = {(node, "s", style) for node, style in page.nodes}
                    articles: dict[int, xxhash.xxh64] = {}
                    for block, main, paths in page.blocks:
                        if main:  # an article is one text, beside those of the nodes below it
                            articles.setdefault(main, xxhash.xxh64()).update(block)
                        if paths[-1] != main:
                            seen.add((paths[-1], "t", xxhash.xxh64_intdigest(block)))
                    seen |= {(node, "t", h.intdigest()) for node, h in articles.items()}
                    counts.update((host, *s) for s in seen)
                cols = list(zip(*((h, _signed(n), k, _signed(v), c) for (h, n, k, v), c in counts.items()), strict=True)) or [[]] * 5
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "node", "kind", "value", "n"])

    seen = pages.select("host", "html").mapInArrow(run, "host string, node long, kind string, value long, n long")
    return seen.groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("n"))


def style_tree(values: DataFrame) -> DataFrame:
    """host, node, pages, importance, has_text: the merged trees of all hosts, from features."""
    # p log p needs the node's pages, which sum(n) of kind s gives only below: keep sum(n), sum(n ln n) and sum(ln n)
    n = F.col("n").cast("double")
    parts = values.groupBy("host", "node", "kind").agg(F.sum("n").alias("n"), F.sum(n * F.log(n)).alias("n_log"), F.sum(F.log(n)).alias("log"), F.count("*").alias("values"))
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    node = parts.groupBy("host", "node").agg(pick("s", "n").alias("pages"), pick("s", "n_log").alias("n_log"), pick("t", "log").alias("log"), pick("t", "values").alias("texts"))
    m = F.log(F.greatest(F.col("pages").cast("double"), F.lit(2.0)))
    presentation = F.when(F.col("pages") > 1, F.least(F.lit(1.0), (F.log(F.col("pages").cast("double")) - F.col("n_log") / F.col("pages")) / m)).otherwise(1.0)
    content = F.greatest(F.lit(0.0), 1 - F.col("log") / F.col("texts") / m)
    importance = F.when(F.col("texts").isNull(), presentation).otherwise(PRESENTATION * presentation + (1 - PRESENTATION) * content)
    return node.where("pages IS NOT NULL").select("host", "node", "pages", importance.alias("importance"), F.col("texts").isNotNull().alias("has_text"))


def distinct_pages(rows: DataFrame) -> DataFrame:
    """rows(page_id, host, html, ...) without those that copy another page of their host (of equal page_ids all stay)."""
    digest = F.xxhash64("html")
    groups = rows.groupBy("host", digest.alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1 AND first IS NOT NULL")
    copies = cut(groups.select(F.col("host").alias("copy_host"), "digest", "first"))
    size = copies.agg(F.sum(F.octet_length("copy_host") + 48)).first()[0] or 0
    copies = F.broadcast(copies) if size <= BROADCAST_BYTES else copies
    return rows.join(copies, (rows.host == F.col("copy_host")) & (digest == F.col("digest")) & ~rows.page_id.eqNullSafe(F.col("first")), "left_anti")


def unimportant(values: DataFrame, threshold: float, min_pages: int, shared: float) -> DataFrame:
    """low_host, low: each host's unimportant nodes and texts."""
    tree = style_tree(values).where(F.col("pages") >= min_pages)
    nodes = tree.where(F.col("has_text") & (F.col("importance") <= threshold)).select("host", F.col("node").alias("low"))
    texts = values.where((F.col("kind") == "t") & (F.col("n") >= shared * min_pages)).join(tree.select("host", "node", "pages"), ["host", "node"])
    # no more than 1 / shared texts for each text of a page
    texts = texts.where(F.col("n") >= shared * F.col("pages")).select("host", F.col("node").bitwiseXOR(F.col("value")).alias("low"))
    return nodes.union(texts).groupBy("host").agg(F.collect_set("low").alias("low")).withColumnRenamed("host", "low_host")


def main_text(pages: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES, shared: float = SHARED) -> DataFrame:
    """page_id, url, text of every page."""
    ship(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host.alias("host"))
    values = cut(features(distinct_pages(rows)))
    low = cut(unimportant(values, threshold, min_pages, shared))
    size = low.agg(F.sum(F.size("low") * 8 + F.octet_length("low_host") + 64)).first()[0] or 0
    # within the bound every task gets the lists, and pages stay where they are; beyond it hosts meet in a join that can be split
    joined = rows.join(F.broadcast(low) if size <= BROADCAST_BYTES else low, rows.host == F.col("low_host"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 8 << 20):
                lows: dict[str, frozenset[int]] = {}
                texts = []
                for k, (own, text) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    if own not in lows:
                        lows[own] = frozenset(x & (1 << 64) - 1 for x in batch.column(4)[k].as_py() or ())
                    texts.append(extract(Page(text or ""), lows[own]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "host", "low").mapInArrow(run, "page_id long, url string, text string")
