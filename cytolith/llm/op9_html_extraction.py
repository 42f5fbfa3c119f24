"""Main text of web pages by site style trees.

The DOMs of one host's pages are merged: elements with the same chain of tag and classes are one style node, and the
texts that stand in one are its text node. Over the host's m distinct pages that have a node,

* content: a text that stands in c of m pages has entropy log c / log m; a text node's content importance is 1 less the
  mean entropy of its texts;
* presentation: a style node's importance is the entropy, to the base m, of how its pages lay it out (the sequences of
  its children's tags and classes): 0 for a layout that is always the same, 1 for one that each page has its own of;
* bottom-up, a style node's importance is the mean of its presentation and of the content of all text nodes below it.

A text node's importance is its content times (1 + b) / 2, where b is the mean importance of the style nodes around it
(the BRANCH nearest ones, each weighing half of the one inside it). One page more is added on which it would have been
important, so a few pages say little. Branches of an importance under LOW are removed from each page; the rest of its
article gives the text, block by block.

Elements that are by their tag or role no article text (menus, forms and the like, NOISE_TAGS and NOISE_ROLES) count for
nothing. Names are a prior: an element that is called by NOISE_NAMES has its importance multiplied by 1 - NAMED w
(1 - share^k), where w is how much of its name those words are and share the part of the page's text that it holds (of the
article's, with a larger k, if it is inside one). So a name alone never removes what holds most of a text, nor an element
around an article.

Identical pages count once, so copies don't make their own article look like a template. Inside an article or main
element a node must show at most ARTICLE_TEXTS texts over ARTICLE_PAGES pages to be taken for template.

Two passes over the html (nodes; removal), with counts by host, node and text in between; a host's rows are spread by
text and summed before each shuffle. What joins the pages is the host's list of removed nodes, written first: Spark
broadcasts a small one; with a large one the pages of a host are dealt over SALTS tasks.

Defined results: null html is an empty one and gives an empty text. Pages without a url have no host and are not merged.
Unclosed elements end with their parent; an article that begins in an unclosed menu is not part of it. Repeated rows are
separate rows; extra columns are ignored; an empty table gives an empty result. A very long page is a batch of its own,
read in time linear in its length; memory follows the longest page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

LOW = 0.3
BRANCH = 8
NAMED = 0.9
#: Exponents of the share of a text that a named element holds: of the page's, and of the article's inside one.
SHARE, ARTICLE_SHARE = 2, 32
ARTICLE_PAGES = 20
ARTICLE_TEXTS = 2
SALTS = 32
#: Kinds of the rows that a page gives.
TEXT, ARTICLE_TEXT, LAYOUT, AROUND, PRIOR = range(5)
PRIOR_UNIT = 1000
#: Fixed word lists: elements and names of parts that are no article text.
RAW_TAGS = frozenset("script style title textarea iframe noframes noembed xmp".split())
NOISE_TAGS = frozenset("head nav footer aside form button select option input label noscript template svg math canvas object video audio dialog menu".split())
NOISE_NAMES = frozenset(
    "ad ads advert advertisement adverts adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead topbar toolbar comment comments disqus replies reply respond "
    "related recommended share sharing social follow newsletter subscribe signup login search widget widgets pagination pager skip copyright".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_TAGS = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that hold the article, the narrower one higher.
CONTENT_TAGS = {"main": 1, "article": 2}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLANKS = re.compile(r"\s+")


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text, seed)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def path_of(*labels: str) -> int:
    """Style node of a chain of labels (tag, or tag.class.class), as a signed hash."""
    node = 0
    for label in labels:
        node = _hash(label, node)
    return _signed(node)


class Element:
    """An element of a page. path: hash of the chain of labels; content: 2 in an article, 1 in a main element."""

    __slots__ = ("tag", "path", "parent", "dead", "content", "named", "kids", "chars", "article", "factor")

    def __init__(self, tag: str, path: int, parent: Element | None, dead: bool, content: int, named: float):
        self.tag, self.path, self.parent, self.dead, self.content, self.named = tag, path, parent, dead, content, named
        self.kids: list[str] = []
        self.chars, self.article, self.factor = 0, 0, 1.0


def _named(tokens: list[str]) -> float:
    """How much of an element's name is noise: all, if one of its classes is, else the share of the words."""
    words = [[w.lower() for w in _NAME.findall(t)] for t in tokens]
    flat = [w for part in words for w in part]
    noise = sum(w in NOISE_NAMES for w in flat)
    if not noise:
        return 0.0
    return 1.0 if any(part and all(w in NOISE_NAMES for w in part) for part in words) else noise / len(flat)


def _open(tag: str, attributes: str, parent: Element) -> Element:
    dead, content, classes, names = parent.dead, max(parent.content, CONTENT_TAGS.get(tag, 0)), "", []
    for key, value in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        value, key = value.strip("\"'"), key.lower()
        if key == "role":
            dead |= value.lower() in NOISE_ROLES
            content = max(content, CONTENT_TAGS.get(value.lower(), 0))
            continue
        names += value.split()
        if key == "class":
            classes = ".".join(sorted(value.lower().split()))
    dead |= tag in NOISE_TAGS or tag == "header" and not parent.content
    named = _named(names) if names and tag not in ("body", "html") else 0.0
    if tag in INLINE_TAGS and not names:  # no style node of its own
        inline = Element(tag, parent.path, parent, dead, content, named)
        inline.kids = parent.kids
        return inline
    label = f"{tag}.{classes}" if classes else tag
    parent.kids.append(label)
    return Element(tag, _hash(label, parent.path), parent, dead, content, named)


class Page:
    """A page's elements, and its blocks as lists of (element, text).

    A block is a run of text between starts and ends of block elements.
    """

    def __init__(self, page: str | None):
        self.elements = [Element("", 0, None, False, 0, 0.0)]
        self.blocks: list[list[tuple[Element, str]]] = []
        self._parse(page or "")
        self._weigh()

    def _parse(self, page: str) -> None:
        stack, opened = [self.elements[0]], Counter()
        run: list[tuple[Element, str]] = []

        def flush() -> None:
            if any(not text.isspace() for _, text in run):
                self.blocks.append([(e, entities.unescape("".join(t for _, t in part))) for e, part in groupby(run, lambda x: x[0])])
            run.clear()

        def close(k: int) -> None:
            for e in stack[k:]:
                opened[e.tag] -= 1
            del stack[k:]

        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.match(page, at)
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                piece = m[0]
                if piece[0] == "<" and len(piece) > 1:
                    continue
                run.append((stack[-1], piece))
                continue
            tag, closing, inline = tag.lower(), bool(m[1] or m[4]), tag.lower() in INLINE_TAGS
            if not inline:
                flush()
            if closing:
                for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if inline and stack[k].tag not in INLINE_TAGS:
                        break
                continue
            if tag == "br" and run:
                run.append((stack[-1], " "))
            if tag in RAW_TAGS:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else n
                continue
            if tag in CONTENT_TAGS and stack[-1].dead and not stack[-1].content:
                while len(stack) > 1 and stack[-1].tag not in ("body", "html") and stack[-1].dead:
                    close(len(stack) - 1)
            if tag in CLOSES:
                while len(stack) > 1 and stack[-1].tag in CLOSES[tag] | INLINE_TAGS:
                    close(len(stack) - 1)
            if not inline:
                for k in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag not in INLINE_TAGS:
                        break
            if tag in VOID_TAGS or (m[3] or m[6] or "").endswith("/") and tag in ("svg", "path"):
                continue
            stack.append(_open(tag, m[3] or m[6] or "", stack[-1]))
            opened[tag] += 1
            self.elements.append(stack[-1])
        flush()

    def _weigh(self) -> None:
        """The factor of each element: 0 for what its tag or role rules out, else that of the prior, all elements around it included."""
        for block in self.blocks:
            for e, text in block:
                e.chars += 0 if e.dead else len(text)
        for e in reversed(self.elements[1:]):
            e.parent.chars += e.chars
            own = 1 if e.tag in CONTENT_TAGS and e.named < 1 and not e.dead else 0
            e.parent.article |= e.article | own
        whole = max(self.elements[0].chars, 1)
        outer: dict[int, int] = {}  # characters of the article around, by element
        self.elements[0].factor = 1.0
        for e in self.elements[1:]:
            inside = e.parent.content
            total = outer.get(id(e.parent), whole) if inside else whole
            if e.content and not inside:
                outer[id(e)] = max(e.chars, 1)
            elif inside:
                outer[id(e)] = total
            own = 1.0
            if e.named and not e.article:
                weight = e.named if e.tag in CONTENT_TAGS else min(1.0, 2 * e.named)
                own = 1 - NAMED * weight * (1 - (e.chars / total) ** (ARTICLE_SHARE if inside else SHARE))
            e.factor = 0.0 if e.dead else min(own, e.parent.factor)

    def parts(self) -> list[tuple[Element, str]]:
        """(element it begins in, text) of the blocks, in page order, without what the page itself rules out."""
        out = []
        for block in self.blocks:
            held = [(e, text) for e, text in block if e.factor >= LOW]
            text = _BLANKS.sub(" ", "".join(t for _, t in held)).strip()
            if text:
                out.append((next(e for e, t in held if not t.isspace()), text))
        return out

    def rows(self) -> set[tuple[int, int, int, int]]:
        """Rows (kind, node, value, page or distance) of the merged tree, for TEXT to PRIOR; page is a hash of the page's texts."""
        texts, found, wanted = set(), set(), {}
        for e, text in self.parts():
            texts.add((ARTICLE_TEXT if e.content else TEXT, _signed(e.path), _signed(_hash(text))))
            if e.factor < 1:
                found.add((PRIOR, _signed(e.path), round(e.factor * PRIOR_UNIT), 0))
            if e.path not in wanted:
                around, at = [], e
                while at is not None and len(around) < BRANCH:
                    if not around or around[-1].path != at.path:
                        around.append(at)
                    at = at.parent
                wanted[e.path] = [x.path for x in around]
        page = _signed(_hash(repr(sorted(texts))))
        found = {(*x[:3], page) for x in found} | {(*x, page) for x in texts}
        found |= {(AROUND, _signed(path), _signed(x), k) for path, around in wanted.items() for k, x in enumerate(around)}
        styles = {x for around in wanted.values() for x in around}
        layouts: dict[int, list[str]] = {}
        for e in self.elements:
            if e.path in styles and not (e.parent is not None and e.parent.path == e.path):
                layouts.setdefault(e.path, []).append(",".join(e.kids))
        return found | {(LAYOUT, _signed(path), _signed(_hash("|".join(x))), page) for path, x in layouts.items()}


def extract(page: str | None, removed: set[int] | None = None) -> str:
    """Main text of a page, without the removed text nodes (hashes of their paths)."""
    parts = [(e, text) for e, text in Page(page).parts() if not removed or _signed(e.path) not in removed]
    sizes = [sum(len(t) for e, t in parts if e.content >= level) for level in range(3)]
    # the articles, if they are most of the main element; else that, if there is one
    least = 2 if sizes[2] and 2 * sizes[2] >= sizes[1] else 1 if sizes[1] else 0
    return "\n".join(text for e, text in parts if e.content >= least)


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def node_rows(pages: DataFrame) -> DataFrame:
    """host, kind, node, value, page: the rows of the pages that have a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            hosts, rows = [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = Page(page).rows()
                rows += mine
                hosts += [host] * len(mine)
            if rows:
                columns = np.array(rows, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(c) for c in columns)], ["host", "kind", "node", "value", "page"])

    named = pages.select(host_of(F.col("url")).alias("host"), "html").filter(F.col("host").isNotNull())
    return named.mapInArrow(run, "host string, kind long, node long, value long, page long")


def style_nodes(pages: DataFrame) -> DataFrame:
    """host, node, kind, n_pages, n_texts, content, branch, prior, importance of the merged trees' text nodes."""
    seen = materialise(node_rows(pages).distinct(), "nodes")
    texts, key = seen.filter(F.col("kind") <= ARTICLE_TEXT), ["host", "node", "kind"]
    by_page = texts.groupBy(*key, "page").agg(F.count("*").alias("n")).groupBy(*key).agg(F.count("*").alias("n_pages"))
    by_text = texts.groupBy(*key, "value").agg(F.count("*").alias("c")).groupBy(*key).agg(F.count("*").alias("n_texts"), F.sum(F.log("c")).alias("logs"))
    content = F.when(F.col("n_pages") > 1, 1 - F.col("logs") / F.col("n_texts") / F.log("n_pages")).otherwise(1.0)
    nodes = materialise(by_page.join(by_text, key).select(*key, "n_pages", "n_texts", content.alias("content")), "contents")
    layouts = seen.filter(F.col("kind") == LAYOUT).groupBy("host", "node", "value").agg(F.count("*").alias("c"))
    spread = F.log("m") - F.col("s") / F.col("m")
    styles = (
        layouts.groupBy("host", "node").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s"))
        .select("host", F.col("node").alias("value"), F.when(F.col("m") > 1, spread / F.log("m")).otherwise(1.0).alias("presentation"))
    )
    around = seen.filter(F.col("kind") == AROUND).select("host", "node", "value", F.col("page").alias("k"))
    below = around.join(nodes.select("host", "node", "content"), ["host", "node"]).groupBy("host", "value").agg(F.avg("content").alias("below"))
    combined = styles.join(below, ["host", "value"]).select("host", "value", ((F.col("presentation") + F.col("below")) / 2).alias("style"))
    weight = F.pow(F.lit(0.5), F.col("k"))
    branches = around.join(combined, ["host", "value"]).groupBy("host", "node").agg((F.sum(weight * F.col("style")) / F.sum(weight)).alias("branch"))
    priors = seen.filter(F.col("kind") == PRIOR).groupBy("host", "node").agg(F.avg(F.col("value") / PRIOR_UNIT).alias("prior"))
    of_text = F.col("content") * (1 + F.col("branch")) / 2
    shrunk = (F.col("n_pages") * of_text + 1) / (F.col("n_pages") + 1)
    return (
        nodes.join(branches, ["host", "node"]).join(priors, ["host", "node"], "left")
        .select(*key, "n_pages", "n_texts", "content", "branch", F.coalesce("prior", F.lit(1.0)).alias("prior"))
        .withColumn("importance", shrunk * F.col("prior"))
    )


def main_text(pages: DataFrame, salted: bool | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages. salted: how the removed nodes are joined; None: by their size."""
    pages = pages.select("page_id", "url", "html")
    spark = pages.sparkSession
    low = style_nodes(pages).filter((F.col("importance") < LOW) & ((F.col("kind") == TEXT) | (F.col("n_texts") <= ARTICLE_TEXTS) & (F.col("n_pages") >= ARTICLE_PAGES)))
    # written first: Spark then knows its size
    removed = materialise(low.groupBy("host").agg(F.collect_set("node").alias("removed")), "removed")
    if salted is None:
        size = removed.agg(F.sum(8 * F.size("removed") + F.octet_length("host") + 32)).first()[0] or 0
        salted = size > int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            texts = [extract(page, set(nodes or ())) for page, nodes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind, keys = pages.schema["page_id"].dataType.simpleString(), ["host"]
    hosted = pages.withColumn("host", host_of(F.col("url")))
    if salted:
        keys = ["host", "salt"]
        hosted = hosted.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)))
        removed = removed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return hosted.join(removed, keys, "left").select("page_id", "url", "html", "removed").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
