"""Main text of web pages by consensus host paths.

Each page is parsed into a small tree, its containers are scored by the text
of their own blocks, and the best one votes for its generalised path (tags and
classes, digits as #) within its host. Votes are counted in Spark. Every page
is then extracted again: the containers on its host's winning path if it has
any, else its own best container.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.tables import column, stored
from twinfold.llm.urls import host_of

#: Winners are broadcast up to so many hosts (a path has at most ``PATH_CHARS``), else joined by host and salt.
BROADCAST_HOSTS, SALTS, PATH_CHARS = 50_000, 16, 400

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split()
)
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
#: Elements that are never main text.
DROPPED = frozenset("head script style title textarea noscript template svg math nav footer aside form button select option object iframe "
                    "canvas audio video dialog menu fieldset label input xmp noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag that ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody",), "tfoot": ("tbody", "tr", "td", "th")}
#: What such an implied end must not cross.
SCOPE = frozenset("ul ol dl table html body div section article select td th".split())
CONTAINERS = frozenset("article main section div td body html center #root".split())
#: Words of a class, id or role that mark what is not main text.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adbox|adsense|advert\w*|banner|breadcrumbs?|byline|comments?|commentlist|consent|cookies?|copyright|disqus|footer|"
    r"gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|notification|outbrain|overlay|pagination|pager|paywall|popup|"
    r"promo\w*|recommend\w*|related|replies|respond|search|share|sharing|sidebar|sidebars|signup|skip|social|sponsor\w*|subscribe|"
    r"subscription|taboola|toolbar|topbar|widget|widgets|alert|toc|tags|login|complementary|contentinfo|dialog)(?:$|[\s_-])",
    re.I,
)
#: These only as the whole class, id or role, since articles have headers of their own.
NOISE_WHOLE = frozenset("header site-header page-header banner top bottom legal hidden".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_NAMES = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_DIGITS = re.compile(r"\d+")


class Page:
    """Nodes in page order: tag, parent, classes; and texts with the node that holds them (a text of None is a break)."""

    def __init__(self, html: str):
        self.tag, self.parent, self.classes, self.noise = ["#root"], [-1], [""], [False]
        self.texts: list[tuple[int, str]] = []
        stack = [0]
        at, end = 0, len(html)
        text = self.texts.append
        while at < end:
            found = _TAG.search(html, at)
            if found is None:
                text((stack[-1], html[at:]))
                break
            if found.start() > at:
                text((stack[-1], html[at:found.start()]))
            at = found.end()
            closing, name, rest = found.group(1, 2, 3) if found[2] else found.group(4, 5, 6)
            if name is None:
                continue
            name = name.lower()
            if closing:
                self._close(stack, name)
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    text((stack[-1], " "))
                continue
            self._implied_end(stack, name)
            stack.append(self._open(stack[-1], name, rest))
            if name in RAW and not rest.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = close.end() if close else end
                stack.pop()
            elif rest.endswith("/") and name not in CONTAINERS and name not in INLINE and name != "p":
                stack.pop()
        self._mark()

    def _open(self, parent: int, name: str, rest: str) -> int:
        classes, noise = "", name in DROPPED
        if "=" in rest or "hidden" in rest:
            for key, a, b, c in _NAMES.findall(rest):
                key, value = key.lower(), (a or b or c)
                if key == "class":
                    classes = value
                if key in ("class", "id", "role"):
                    noise = noise or bool(NOISE.search(value)) or value.strip().lower() in NOISE_WHOLE
                elif key == "style":
                    noise = noise or bool(_HIDDEN_STYLE.search(value))
                elif key == "hidden" and not value or key == "aria-hidden" and value.lower() == "true":
                    noise = True
        self.tag.append(name)
        self.parent.append(parent)
        self.classes.append(classes)
        self.noise.append(noise)
        return len(self.tag) - 1

    def _close(self, stack: list[int], name: str) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag == name:
                del stack[depth:]
                return
            if name in INLINE and tag not in INLINE or name == "p" and tag in SCOPE:
                return

    def _implied_end(self, stack: list[int], name: str) -> None:
        ends = ("p",) if name in ENDS_P else ENDS_SAME.get(name, ())
        while ends:
            for depth in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[depth]]
                if tag in ends:
                    del stack[depth:]
                    break
                if tag in SCOPE and not (tag in ("td", "th") and name in ("tr", "tbody", "tfoot")):
                    return
            else:
                return
            if ends == ("p",):
                return

    def _mark(self) -> None:
        """Noise goes down to all below; an element that holds an article or main, and these and the body, is none by its class."""
        n = len(self.tag)
        holds = [False] * n
        inside = [False] * n  # within an article or main
        for k in range(n - 1, 0, -1):
            if self.tag[k] in ("article", "main"):
                holds[k] = holds[k] or not self.noise[k]
            if holds[k]:
                holds[self.parent[k]] = True
        for k in range(1, n):
            up = self.parent[k]
            tag = self.tag[k]
            inside[k] = inside[up] or tag in ("article", "main")
            if self.noise[k] and tag not in DROPPED and (tag in ("html", "body") or holds[k]):
                self.noise[k] = False
            if tag == "header" and not inside[up]:
                self.noise[k] = True
            self.noise[k] = self.noise[k] or self.noise[up]

    def path(self, node: int) -> str:
        steps = []
        while node > 0:
            names = ".".join(sorted(set(_DIGITS.sub("#", self.classes[node]).lower().split())))
            steps.append(self.tag[node] + (f".{names}" if names else ""))
            node = self.parent[node]
        path = ">".join(reversed(steps)) or "#root"
        if len(path) <= PATH_CHARS:
            return path
        # A hash of the whole path stands for the rest; the tag of its last step stays beside it.
        digest = hashlib.blake2b(path.encode(), digest_size=16).hexdigest()
        return f"{path[:PATH_CHARS // 2]}~{digest}>{path.rsplit('>', 1)[-1].split('.', 1)[0]}"

    def best(self) -> tuple[int, float]:
        """The container with the most text of its own blocks: a block counts whole for its container and half for the one above."""
        score: dict[int, float] = {}
        for node, text in self.texts:
            if self.noise[node]:
                continue
            size = len(text) - text.count(" ")
            if not size:
                continue
            linked = False
            while self.tag[node] in INLINE:
                linked = linked or self.tag[node] == "a"
                node = self.parent[node]
            if linked:
                size = -size
            weight = 1.0
            for _ in range(2):
                while self.tag[node] not in CONTAINERS:
                    node = self.parent[node]
                score[node] = score.get(node, 0.0) + weight * size
                if node == 0:
                    break
                node, weight = self.parent[node], weight / 2
        if not score:
            return 0, 0.0
        node = max(score, key=lambda k: (score[k], -k))
        # Sections of one article belong together.
        up = node
        while up > 0:
            if self.tag[up] == "article" or self.tag[up] == "main" and self.tag[node] != "article":
                node = up
                if self.tag[up] == "article":
                    break
            up = self.parent[up]
        return node, max(score.values())

    def on_path(self, path: str) -> list[int]:
        last = path.rsplit(">", 1)[-1].split(".", 1)[0]
        return [k for k in range(len(self.tag)) if self.tag[k] == last and not self.noise[k] and self.path(k) == path]

    def text(self, nodes: list[int]) -> str:
        """Text below the nodes without noise: white space becomes one space, and so does what parts two blocks."""
        chosen = [False] * len(self.tag)
        for k in nodes:
            chosen[k] = True
        block = [0] * len(self.tag)  # nearest node that is not inline
        for k in range(1, len(self.tag)):
            chosen[k] = chosen[k] or chosen[self.parent[k]]
            block[k] = block[self.parent[k]] if self.tag[k] in INLINE else k
        out, before = [], None
        for node, text in self.texts:
            if chosen[node] and not self.noise[node]:
                if before is not None and block[node] != before:
                    out.append(" ")
                out.append(unescape(text))
                before = block[node]
            elif block[node] != before:
                before = -1  # something else stood between
        return " ".join("".join(out).split())


def _pages(pages: DataFrame) -> DataFrame:
    url = column(pages, "url", "string")
    return pages.select(column(pages, "page_id", "long").alias("page_id"), url.alias("url"), column(pages, "html", "string").alias("html"), host_of(url).alias("host"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): of each host, the path that most pages' best containers are on; ties by score, then by path."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, scores = [], [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(html or "")
                node, score = page.best()
                if score > 0:
                    hosts.append(host)
                    paths.append(page.path(node))
                    scores.append(int(score))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], ["host", "path", "score"])

    votes = _pages(pages).select("host", "html").mapInArrow(run, "host string, path string, score long")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    best = F.max(F.struct("votes", "score", "path"))
    return counted.groupBy("host").agg(best.alias("best")).select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, and the path it was taken from.

    A null or empty html, and one without text, gives an empty text. Pages without host are one host. Repeated rows
    and rows without page_id stay as they come; other columns are ignored; an empty table gives an empty one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, used = [], []
            for html, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                page = Page(html or "")
                nodes = page.on_path(path) if path else []
                text = page.text(nodes) if nodes else ""
                if not text:
                    nodes = [page.best()[0]]
                    text, path = page.text(nodes), page.path(nodes[0])
                texts.append(text)
                used.append(path)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(used, pa.string())],
                ["page_id", "url", "text", "n_chars", "path"])

    winners = stored(host_paths(pages), "host-paths")
    rows = _pages(pages)
    if winners.count() <= broadcast_hosts:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        # A third of the pages may be of one host: its pages are dealt over the salts.
        salted = winners.select("host", "path", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long, path string")
