"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of styles. A node is a path of elements,
each with its tag, classes and id; neighbours that look the same count as one. Over the
m different pages that have a node, its presentation matters as far as the entropy of
its rows of children goes (to base m), and its content as far as its texts and links
differ from page to page: a text on k of m pages adds log(k) / log(m) to what is
common. A branch's importance joins its own presentation and the content of all that it
holds. Branches of low importance, with no node of a higher one, are removed from each
page, inside marked articles as well as outside; parts of a line go with their block.

What counts as low follows the site: the node with the most text of its own is its
reference, and a branch may be LACK_FACTOR times as common as that, and LACK more; within
what a page marks as its article or main part, ARTICLE_LACK more. So a site of copies,
whose main text is as common as its menus, loses nothing.

Tags that are never part of an article (menus, forms, scripts) go as well. Names that
tell of adverts, notices, comments and the like are a first guess that can be taken
back: an element that holds a page's article or main part keeps it, and where next to
nothing but such elements is left of a page that marks no article, they stay.

Of what is left, the main part counts where it holds half of the text or more, and
within that the articles where they hold a third or more; smaller articles beside other
text are teasers, and go. A page that the tree would leave empty keeps what it removed.
Removed parts of a line, such as a script or a hidden word, do not end its block.

The tree is counted in partial sums by host, path and value, so that no host, path or
text is gathered in one task; only the paths of low importance come back to the pages.
They are sent to all tasks as long as their measured size is within bounds; beyond that
pages are joined with them by host and a salt, so that no task gets all pages of a large
host.

Defined results: null or empty html gives an empty text; a null url, or one without a
host, belongs to the empty host; repeated rows give equal rows and count once in the
tree; an empty table gives an empty table; other columns are ignored. Elements that lie
deeper than DEEPEST count as parts of the one at that depth, as they do in browsers.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import ascii_lower, staged

#: How much of a branch's importance is the content it holds; the rest is its own presentation.
CONTENT_SHARE = 0.9
LACK_FACTOR = 4.0
LACK = 0.04
#: The same for what a page marks as part of its article or main part.
ARTICLE_LACK = 0.5
#: Nodes on fewer different pages of their host say nothing about it.
MIN_PAGES = 5
#: Fixed value: the depth to which browsers nest elements.
DEEPEST = 512
#: Tables of paths of up to this size are sent to all tasks.
BROADCAST_BYTES = 32 << 20
#: Pages of one host that share a salt where the paths are too many to be sent.
SALT_PAGES = 4096
#: Shares of the text that is left: of the main part, and of the articles, to count alone.
MAIN_SHARE, ARTICLE_SHARE = 0.5, 1 / 3
#: Named elements stay if all other text is less than this share of theirs.
REST_SHARE = 0.1

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul caption".split()
)
#: Elements that end an open one of their own kind, and what that may not reach beyond.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that are not part of an article.
NOISE = frozenset(
    "head nav aside footer form script style noscript template iframe object svg canvas audio video select button textarea menu"
    " input fieldset datalist".split()
)
#: These are removed only outside an article or a main part.
OUTSIDE = frozenset({"header", "title", "dialog"})
#: Words in classes, ids and roles of elements that are seldom part of an article.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice"
    " notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended sidebar aside widget"
    " menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer comment comments reply replies respond disqus"
    " toolbar search skip hidden alert complementary contentinfo".split()
)
#: Elements with these words do not come back.
ADVERT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense promo sponsor sponsored cookie cookies consent gdpr".split())
#: Names that begin so tell what stands beside an element.
ABOUT_OTHERS = ("with-", "has-", "no-", "without-")
#: Words that count only outside an article: inside, such an element holds its title.
HEADERS = frozenset({"header", "masthead"})

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|href|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME_PART = re.compile(r"[a-z]+")


class Node:
    """An open element."""

    __slots__ = ("tag", "above", "judged", "noise", "named", "final", "guesses", "article", "main", "children")

    def __init__(self, tag: str, above: tuple[int, ...], noise: bool, named: bool, final: bool, guesses: tuple[Node, ...], article: bool, main: bool):
        self.tag, self.above, self.noise, self.article, self.main = tag, above, noise, article, main
        #: The paths by which the tree may remove it: parts of a line go with their block only.
        self.judged = above
        #: Whether its own name speaks against it, for good or not, and the elements from the top to it of which that is so.
        self.named, self.final, self.guesses = named, final, (*guesses, self) if named else guesses
        self.children: list[str] = []


class Block(NamedTuple):
    """What is left of a block of text: its own text, or that of named elements alone."""

    text: str
    named: str
    article: bool
    main: bool


def signed(data: str) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def clean(pieces: list[str]) -> str:
    return " ".join(html.unescape("".join(pieces)).split())


class Page:
    """A page's blocks of text in order, and what it adds to its site's tree."""

    def __init__(self, source: str | None, tree: bool):
        #: Each block as pieces with the elements that hold them.
        self.blocks: list[list[tuple[str, Node]]] = []
        #: path: (all paths from the top to it, rows of children, sizes of texts (0: links) by hash, whether inside an article)
        self.nodes: dict[int, tuple[tuple[int, ...], list[str], dict[int, int], bool]] = {}
        self.tree = tree
        self.stack = [Node("", (), False, False, False, (), False, False)]
        self.open: Counter[str] = Counter()
        self.pieces: list[tuple[str, Node]] = []
        self.read(source or "")
        self.block()
        while len(self.stack) > 1:
            self.close()

    def read(self, source: str) -> None:
        at = 0
        while (token := TOKEN.search(source, at)) is not None:
            if token.start() > at:
                self.pieces.append((source[at : token.start()], self.stack[-1]))
            at = token.end()
            if (tag := token["tag"]) is None:
                continue
            tag = tag.lower()
            if token["end"]:
                self.end(tag)
                continue
            if not source.endswith(">", token.start(), at):
                return  # a tag that the page's end cuts off
            self.start(tag, token["attributes"])
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(source, at)
                if tag == "title":
                    self.pieces.append((source[at : end.start() if end else len(source)], self.stack[-1]))
                at = end.end() if end else len(source)
                self.end(tag)
        if at < len(source):
            self.pieces.append((source[at:], self.stack[-1]))

    def block(self) -> None:
        """End the block of text that is open."""
        if self.pieces:
            self.blocks.append(self.pieces)
            if self.tree:
                own: dict[int, list[str]] = {}
                for piece, node in self.pieces:
                    if node.above:
                        own.setdefault(node.above[-1], []).append(piece)
                for path, pieces in own.items():
                    if text := clean(pieces):
                        self.nodes[path][2][signed(text)] = len(text)
            self.pieces = []

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.block()
        elif tag == "br":
            self.pieces.append((" ", self.stack[-1]))
        if tag in BLOCKS and tag not in ("html", "body"):
            self.close_up_to({"p"}, {"article", "section", "div", "td", "li", "body", "table", "button", "blockquote", "main", "form", "aside"})
        if tag in SIBLINGS:
            self.close_up_to(*SIBLINGS[tag])
        names, link, role, hidden = "", None, "", False
        if attributes:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            names = " ".join(sorted(f"{found.get('class', '')} {found.get('id', '')}".lower().split()))
            link, role, hidden = found.get("href"), found.get("role", "").lower(), "hidden" in found
        top = self.stack[-1]
        label = f"{tag}.{re.sub('[0-9]+', '0', names)}" if names else tag
        if not top.children or top.children[-1] != label:
            top.children.append(label)
        above = top.above
        if len(above) < DEEPEST:
            above = (*above, signed(f"{above[-1] if above else 0}>{label}"))
        if self.tree:
            if above[-1] not in self.nodes:
                self.nodes[above[-1]] = above, [], {}, top.article or top.main
            if link:
                self.nodes[above[-1]][2].setdefault(signed(link), 0)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            return
        article, main = top.article or tag == "article", top.main or tag == "main" or role == "main"
        inside, whole = article or main, tag in ("html", "body")
        said = [n for n in f"{names} {role}".split() if not n.startswith(ABOUT_OTHERS)]
        parts = NAME_PART.findall(" ".join(said))
        named = not whole and (not NOISE_WORDS.isdisjoint(parts) or not inside and not HEADERS.isdisjoint(parts))
        noise = top.noise or not whole and (hidden or tag in NOISE or not inside and tag in OUTSIDE)
        if (tag in ("article", "main") or role == "main") and not named and not noise:
            for node in top.guesses:
                node.named = False
        final = named and (tag not in BLOCKS or not ADVERT_WORDS.isdisjoint(parts))
        self.stack.append(Node(tag, above, noise, named, final, top.guesses, article, main))
        if tag not in BLOCKS:
            self.stack[-1].judged = top.judged
        self.open[tag] += 1

    def close(self) -> None:
        node = self.stack.pop()
        self.open[node.tag] -= 1
        if self.tree:
            self.nodes[node.above[-1]][1].append(" ".join(node.children))

    def close_up_to(self, tags: set[str], limit: set[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth].tag
            if tag in tags:
                self.block()
                while len(self.stack) > depth:
                    self.close()
                return
            if tag in limit:
                return

    def end(self, tag: str) -> None:
        if not self.open[tag]:
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag == tag:
                if tag in BLOCKS:
                    self.block()
                while len(self.stack) > depth:
                    self.close()
                return

    def left(self, common: frozenset[int]) -> list[Block]:
        """The blocks without what is noise or lies under a common path."""
        out = []
        for pieces in self.blocks:
            own, named = [], []
            for piece, node in pieces:
                if not node.noise and common.isdisjoint(node.judged):
                    against = [n for n in node.guesses if n.named]
                    if not against:
                        own.append(piece)
                    elif not any(n.final for n in against):
                        named.append(piece)
            text, more = clean(own), clean(named) if named else ""
            if text or more:
                node = pieces[-1][1]
                out.append(Block(text, more, node.article, node.main))
        return out

    def text(self, common: frozenset[int] = frozenset()) -> str:
        """The blocks that are part of the article, given the paths that are common to the site."""
        found = self.left(common)
        if common and not any(b.text for b in found):
            found = self.left(frozenset())
        own, marked = sum(len(b.text) for b in found), any(b.text and (b.article or b.main) for b in found)
        if not marked and own < REST_SHARE * sum(len(b.named) for b in found):
            found = [b._replace(text=f"{b.text} {b.named}".strip()) for b in found]
        found = [b for b in found if b.text]
        size = lambda blocks: sum(len(b.text) for b in blocks)
        if (main := [b for b in found if b.main]) and size(main) >= MAIN_SHARE * size(found):
            found = main
        if article := [b for b in found if b.article]:
            found = article if size(article) >= ARTICLE_SHARE * size(found) else [b for b in found if not b.article]
        return "\n".join(b.text for b in found)


def with_host(pages: DataFrame) -> DataFrame:
    host = ascii_lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"), host.alias("host"))


def site_nodes(pages: DataFrame) -> DataFrame:
    """host, page, path, above, article, kind, value, size: what each page adds to its host's tree.

    Kind 0 is the row of children of a node, one for each page; kind 1 its texts and links.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for host, source in zip(frame["host"], frame["html"]):
                name = signed(source or "")
                for path, (above, children, values, article) in Page(source, tree=True).nodes.items():
                    rows.append((host, name, path, above, article, 0, signed("|".join(sorted(set(children)))), 0))
                    rows += [(host, name, path, above, article, 1, v, size) for v, size in values.items()]
            yield pd.DataFrame(rows, columns=["host", "page", "path", "above", "article", "kind", "value", "size"])

    schema = "host string, page long, path long, above array<long>, article boolean, kind int, value long, size int"
    return pages.select("host", "html").mapInPandas(batches, schema)


def importances(pages: DataFrame) -> DataFrame:
    """host, path, article, pages, presentation, content, best, importance and least, for all nodes.

    content is that of the whole branch, best the content of its best node, least the
    importance that a branch of this host would need.
    """
    key = ["host", "path", "kind", "value"]
    facts = [F.first(c).alias(c) for c in ("above", "article", "size")]
    times = site_nodes(pages).groupBy(*key, "page").agg(*facts).groupBy(*key).agg(F.count(F.lit(1)).alias("k"), *facts)
    style, k = F.col("kind") == 0, F.col("k")
    shared = k * F.log(k.cast("double"))
    none = lambda c: F.coalesce(c, F.lit(0.0))
    nodes = times.groupBy("host", "path").agg(
        F.first("above").alias("above"), F.first("article").alias("article"), F.sum(F.when(style, k)).alias("m"),
        none(F.sum(F.when(style, shared))).alias("style_sum"), none(F.sum(F.when(~style, shared))).alias("shared_sum"),
        none(F.sum(F.when(~style, k)).cast("double")).alias("n"), none(F.sum(k * F.col("size")).cast("double")).alias("text"),
    )
    base = F.log(F.col("m").cast("double"))
    alone = F.col("m") <= 1
    rated = staged(
        nodes.select(
            "host", "path", "above", "article", "m", "n", "text",
            F.when(alone, 1.0).otherwise(1 - F.col("style_sum") / (F.col("m") * base)).alias("presentation"),
            F.when(alone, 0.0).otherwise(F.col("shared_sum") / base).alias("common"),
        ),
        "nodes",
    )
    lack = F.try_divide(F.col("common"), F.col("n"))
    # The node with the most text of its own tells how common a site's main text is.
    main = rated.filter("n > 0").groupBy("host").agg(F.max_by(lack, F.struct("text", "path")).alias("main_lack"))
    branch = (
        rated.select("host", F.explode("above").alias("path"), "common", "n", F.when(F.col("n") > 0, 1 - lack).alias("own"))
        .groupBy("host", "path").agg(F.try_divide(F.sum("n") - F.sum("common"), F.sum("n")).alias("content"), F.max("own").alias("best"))
    )
    both = rated.join(branch, ["host", "path"]).join(main, "host")
    importance = (1 - CONTENT_SHARE) * F.col("presentation") + CONTENT_SHARE * F.coalesce("content", F.lit(1.0))
    lack = F.when(F.col("article"), ARTICLE_LACK).otherwise(LACK)
    least = CONTENT_SHARE * (1 - LACK_FACTOR * F.col("main_lack") - lack)
    return both.select("host", "path", "article", F.col("m").alias("pages"), "presentation", "content", "best", importance.alias("importance"), least.alias("least"))


def common_paths(hosted: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, common: the paths of low importance of each host that has any."""
    low = importances(hosted).filter((F.col("importance") < F.col("least")) & (F.col("pages") >= min_pages))
    low = low.filter(F.coalesce(F.col("best"), F.lit(0.0)) * CONTENT_SHARE < F.col("least"))
    return staged(low.groupBy("host").agg(F.collect_set("path").alias("common"), F.max("pages").alias("pages")), "common")


def with_common(hosted: DataFrame, common: DataFrame, broadcast_bytes: int) -> DataFrame:
    size = common.agg(F.coalesce(F.sum(F.size("common") * 8 + F.length("host") + 16), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        return hosted.join(F.broadcast(common), "host", "left")
    salts = common.select("host", "pages").agg(F.max(F.ceil(F.col("pages") / SALT_PAGES))).first()[0]
    copies = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1).cast("int"))))
    return hosted.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(copies, ["host", "salt"], "left")


def extracted(pages: DataFrame, min_pages: int = MIN_PAGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, for each row of pages."""
    hosted = with_host(pages)
    known = with_common(hosted, common_paths(hosted, min_pages), broadcast_bytes)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            paths = [frozenset(c) if c is not None else frozenset() for c in frame["common"]]
            text = [Page(source, tree=False).text(c) for source, c in zip(frame["html"], paths)]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": text})

    return known.select("page_id", "url", "html", "common").mapInPandas(batches, "page_id long, url string, text string")
