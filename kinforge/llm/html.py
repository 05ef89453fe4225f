"""Main text of web pages by consensus of each host's pages.

A page becomes blocks of text, each with the elements it stands in. Containers (article, main, section, div and
the like) are scored by the words of their blocks, less those in links, and by tag and class. Each page votes for
the generalised path (tags and classes, digits masked) of its best container with that score; votes are summed
per host in Spark. The host's paths, best first, then decide which container a page's text comes from: the first that
holds most words of the page's own best container, which itself stands among them by its votes. So a page keeps its text
whatever templates its host has; a page without a host uses its own best container. A path that one page alone votes for
counts for that page only.

Inside the container, menus, headers, footers, asides, forms, scripts, styles, adverts, notices and comments are
left out. Character references are decoded, white space within a block becomes one space, blocks are joined by
one line feed.

Class names are only guesses. An element whose names say that it is not the text, but which holds most of the page's
words and an element that is named or tagged as text, is a wrapper: its names count for nothing. Where names and
hidden elements leave nothing of a page, the text of its articles is read without them.

Null or empty html, and pages without text, give an empty text. Pages of any length are read whole. Of containers and
paths with equal scores the greater path in code-point order counts. Repeated rows are pages of their own (they vote as
often as they occur); a null page_id is an ordinary one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.llm.common import column, pieces, written

# Elements by role.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg annotation annotation-xml".split())
#: Those that may close themselves, and without an end leave the rest of the page alone.
FOREIGN = frozenset("svg annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINER = frozenset("article main section div td body center".split())
BLOCK = CONTAINER | frozenset(
    "address blockquote dd details dialog dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html head legend li menu nav ol p pre search summary table tbody tfoot th thead tr ul caption aside option".split()
)
OUTSIDE = frozenset("nav footer aside form button select option head menu dialog search header script style noscript template iframe".split())
CLOSES_P = BLOCK - frozenset("option legend summary caption figcaption".split())
# Words in class, id and role of elements that are not the text; doubtful ones only without a wanted one.
REPLIES = re.compile(r"(?:comments?|disqus|repl(?:y|ies)|respond|discussions?)(?:[-_]*(?:lists?|area|section|thread|respond|form|body|content|text|meta|author|item|wrap|wrapper|container|box|block|inner))?(?:[-_]*\d+)?")
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored outbrain taboola "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sidebar aside related recommended recirc trending "
    "sharing masthead topbar footer bottombar copyright notice notices cookie cookies consent gdpr popup modal overlay "
    "newsletter subscribe signup login paywall".split()
)
DOUBTFUL = frozenset("header rail widget widgets popular share social follow legal alert form search skip print".split())
WANTED = frozenset("article content main post entry story body text page maincontent".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<open_end>/?)(?P<open_tag>[a-zA-Z][^\s/>]*)(?P<open_attrs>[^<>]*)>", re.S)
ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>`]+)))?")
NAME = re.compile(r"[a-z]+|[0-9]+")


class Node:
    __slots__ = ("tag", "names", "parent", "step", "named", "firm", "way", "n_words", "n_linked")

    def __init__(self, tag: str, attrs: str, parent: Node | None, by_name: bool = True):
        self.tag, self.parent, self.way = tag, parent, None
        self.n_words = self.n_linked = 0
        classes, names, hidden, replies = "", frozenset(), False, False
        if attrs and not attrs.isspace():
            for key, a, b, c in ATTR.findall(attrs):
                key, value = key.lower(), (a or b or c).lower()
                if key == "class":
                    classes = value
                if key in ("class", "id", "role", "aria-label"):
                    names |= frozenset(NAME.findall(value))
                    replies |= any(map(REPLIES.fullmatch, value.split()))
                hidden |= key == "hidden" or key == "style" and "display:none" in value.replace(" ", "") or key == "aria-hidden" and value == "true"
        self.names = names
        own = "" if not classes else "." + ".".join(sorted({re.sub(r"\d+", "#", c) for c in classes.split()}))
        self.step = tag + own
        in_text = parent is not None and parent.inside("article", "main")
        whole = tag in ("body", "html", "article", "main")
        by_tag = tag in OUTSIDE and not (tag == "header" and in_text) or by_name and hidden and tag not in ("body", "html")
        # what readers say, and roles by tag, are never the text; class names may also sit on wrappers of it
        self.firm = by_tag or by_name and replies and not whole or (parent.firm if parent else False)
        self.named = not whole and by_name and (bool(names & UNWANTED) or bool(names & DOUBTFUL) and not names & WANTED)

    def outside(self) -> bool:
        """Whether a name around it, up to the article it stands in, says that it is not the text."""
        for up in self.chain():
            if up.named:
                return True
            if up.tag in ("article", "main", "body"):
                break
        return False

    def inside(self, *tags: str) -> bool:
        node: Node | None = self
        while node is not None:
            if node.tag in tags:
                return True
            node = node.parent
        return False

    def path(self) -> str:
        if self.way is not None:
            return self.way
        steps, node = [], self
        while node is not None:
            if node.tag in CONTAINER or node.tag in ("html", "body"):
                steps.append(node.step)
            node = node.parent
        self.way = ">".join(reversed(steps))
        return self.way

    def chain(self) -> Iterator[Node]:
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent


def blocks_of(html: str) -> list[tuple[str, Node]]:
    """Blocks of text outside menus and the like, each with the innermost block element around it; if names and
    hidden elements leave none, those of the page's articles whatever they are named."""
    if (blocks := read_blocks(html)) or not ("<article" in (low := html.lower()) or "<main" in low):
        return blocks
    blocks = [(text, node) for text, node in read_blocks(html, False) if node.inside("article", "main")]
    counted: set[int] = set()
    for _, node in blocks:  # words outside the articles count for nothing
        for up in node.chain():
            if id(up) not in counted:
                counted.add(id(up))
                if not up.inside("article", "main"):
                    up.n_words = up.n_linked = 0
    return blocks


def unwrap(found: list[tuple[str, Node, int, int]]) -> None:
    """Takes the names off wrappers: they hold most of the page's words outside links, and something named as text."""
    named: dict[int, list] = {}
    total = 0
    for _, node, n, linked in found:
        total += n - linked
        text = False
        for up in node.chain():
            text |= up.tag in ("article", "main", "h1") or bool(up.names & WANTED) and not up.named
            if up.named:
                held = named.setdefault(id(up), [up, 0, False])
                held[1] += n - linked
                held[2] |= text
    for up, n, text in named.values():
        if text and 2 * n > total:
            up.named = False


def read_blocks(html: str, by_name: bool = True) -> list[tuple[str, Node]]:
    root = Node("html", "", None)
    node, link, found, text, words = root, 0, [], [], [0, 0]
    at, low, endless = 0, None, set()

    def flush() -> None:
        if text:
            whole = " ".join("".join(text).split())
            text.clear()
            if whole:
                n = whole.count(" ") + 1
                found.append((whole, node, n, min(n, words[1])))
            words[0] = words[1] = 0

    def say(raw: str) -> None:
        if raw and not node.firm:
            raw = unescape(raw) if "&" in raw else raw
            text.append(raw)
            if link:
                words[1] += len(raw.split())

    def close_to(stop: Node) -> None:
        nonlocal node
        flush()
        node = stop

    for m in TOKEN.finditer(html):
        if m.start() < at:
            continue
        say(html[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            say(m["cdata"])
            continue
        tag = (m["tag"] or m["open_tag"] or "").lower()  # a quote left open ends with its tag
        if not tag:
            continue
        attrs = m["attrs"] or m["open_attrs"] or ""
        if m["end"] or m["open_end"]:
            if tag == "a":
                link = max(0, link - 1)
            elif tag in BLOCK and tag not in ("html", "body"):
                for up in node.chain():
                    if up.tag == tag and up.parent is not None:
                        close_to(up.parent)
                        break
                else:
                    flush()
            elif tag == "button" or tag == "select":
                for up in node.chain():
                    if up.tag == tag:
                        close_to(up.parent)
                        break
            continue
        if tag in RAW:
            if tag in FOREIGN and (attrs.endswith("/") or tag in endless):
                continue
            low = low or html.lower()
            end = low.find(f"</{tag}", at)
            if end < 0 and tag in FOREIGN:
                endless.add(tag)
                continue
            close = html.find(">", end) if end >= 0 else -1
            at = len(html) if close < 0 else close + 1
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            link = 1
        elif tag == "html" or tag == "body":
            flush()
            if tag == "body" and node.inside("body"):
                continue
            if tag == "body":
                node = Node("body", attrs, root, by_name)
        elif tag in BLOCK or tag == "button" or tag == "select":
            flush()
            if tag in CLOSES_P:
                for up in node.chain():
                    if up.tag == "p":
                        node = up.parent
                        break
                    if up.tag in CONTAINER or up.tag in ("table", "ul", "ol", "blockquote"):
                        break
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                peers = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[tag]
                stop = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}.get(tag, ("table",))
                for up in node.chain():
                    if up.tag in stop:
                        break
                    if up.tag in peers and up.parent is not None:
                        node = up.parent
                        break
            if node is root and tag not in ("head",):
                node = Node("body", "", root)
            if tag == "body" or tag in VOID:
                continue
            if node.tag == "head":
                node = Node("body", "", root)
            node = Node(tag, attrs, node, by_name)
    say(html[at:])
    flush()
    unwrap(found)
    out = []
    for whole, node, n, linked in found:
        if not node.outside():
            out.append((whole, node))
            for up in node.chain():
                up.n_words += n
                up.n_linked += linked
    return out


def containers(blocks: list[tuple[str, Node]]) -> dict[str, float]:
    """Score of each container path: words of its blocks not in links, weighted by tag and class, less what a
    wider container would merely wrap around it."""
    nodes: dict[int, Node] = {}
    for _, node in blocks:
        for up in node.chain():
            nodes.setdefault(id(up), up)
    scores: dict[str, float] = {}
    for node in nodes.values():
        if node.tag not in CONTAINER:
            continue
        bonus = {"article": 1.6, "main": 1.4, "section": 1.05, "body": 0.9}.get(node.tag, 1.0)
        bonus *= 1.25 if node.names & WANTED else 1.0
        depth = sum(1 for _ in node.chain())
        score = max(0.0, node.n_words - 1.5 * node.n_linked) * bonus * (1 + 0.01 * min(depth, 10))
        path = node.path()
        scores[path] = scores.get(path, 0.0) + score
    return scores


def vote(html: str | None) -> tuple[str, float] | None:
    """The page's best container path and its score."""
    scores = containers(blocks_of(html)) if html else {}
    if not scores:
        return None
    path = max(scores, key=lambda p: (scores[p], p))
    return path, scores[path]


def extract(html: str | None, paths: list[str], votes: list[float] | None = None) -> str:
    """Text of the blocks in containers of the first of ``paths`` that holds most words of the page's own best one.

    ``votes`` are the scores of the paths, best first: from where they are below the page's own, its own comes first.
    """
    blocks = blocks_of(html) if html else []
    if not blocks:
        return ""
    scores = containers(blocks)
    if not scores:
        return "\n".join(text for text, _ in blocks)
    own = [{up.path() for up in node.chain() if up.tag in CONTAINER} for _, node in blocks]
    best = max(scores, key=lambda p: (scores[p], p))
    held: dict[str, int] = {}
    for (text, _), inside in zip(blocks, own, strict=True):
        if best in inside:
            n = text.count(" ") + 1
            for p in inside:
                held[p] = held.get(p, 0) + n
    path = best
    for at, p in enumerate(paths):
        if votes and votes[at] < scores[best]:
            break
        if 2 * held.get(p, 0) > held[best]:
            path = p
            break
    return "\n".join(text for (text, _), inside in zip(blocks, own, strict=True) if path in inside)


def host_of(url: Column) -> Column:
    """Host in lower case, without port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths, votes): the container paths that several pages of a host vote for, votes summed over all its pages."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], list[float]] = {}
        for batch in pieces(batches):
            for host, html in zip(column(batch, "host"), column(batch, "html"), strict=True):
                if (best := vote(html)) is not None:
                    sums = total.setdefault((host, best[0]), [0.0, 0])
                    sums[0] += best[1]
                    sums[1] += 1
            if len(total) > 50_000:
                yield out(total)
                total = {}
        yield out(total)

    def out(total: dict) -> pa.RecordBatch:
        cols = [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array([v[0] for v in total.values()], pa.float64()), pa.array([v[1] for v in total.values()], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["host", "path", "score", "pages"])

    rows = pages.select(host_of(F.col("url")).alias("host"), "html").where("host is not null and html is not null")
    sums = rows.mapInArrow(votes, "host string, path string, score double, pages long").groupBy("host", "path")
    sums = sums.agg(F.round(F.sum("score"), 3).alias("score"), F.sum("pages").alias("pages")).where("pages > 1")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "path")))
    return sums.groupBy("host").agg(ranked.alias("ranked")).select("host", F.transform("ranked", lambda x: x["path"]).alias("paths"), F.transform("ranked", lambda x: -x["less"]).alias("votes"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    The hosts' paths are written first: from that table's size Spark itself decides whether they can be
    broadcast or must be joined by a shuffle.
    """
    paths = written(host_paths(pages), "html-paths")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(paths, "host", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [extract(h, p or [], v) for h, p, v in zip(*(column(batch, c) for c in ("html", "paths", "votes")), strict=True)]
            cols = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "html", "paths", "votes").mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
