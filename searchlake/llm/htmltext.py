"""HTML extraction by consensus paths of each host.

Every page scores its containers; the best container's generalised tag-and-class path is the
page's vote, votes are counted by host in Spark, and pages are extracted again along the
winning path of their host.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_arrow, with_fields

MAX_BROADCAST_BYTES = 32 << 20
CONTAINERS = frozenset("body main article section div td table nav header footer aside form ul ol dl blockquote figure details".split())
BOILERPLATE = frozenset("nav footer aside form header".split())
BREAKS = CONTAINERS | frozenset("p br h1 h2 h3 h4 h5 h6 li tr hr pre dt dd th".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Comments; elements whose content is no text; tags, with quotes only behind an = as in HTML; other declarations; a tag
#: that never ends, with all behind it. Nothing here backtracks: every match takes what it has looked at.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z].*\Z",
    re.S | re.I,
)
_CLASS = re.compile(r"\bclass\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_DIGITS, _SPACE = re.compile(r"\d+"), re.compile(r"\s+")


def step(tag: str, attributes: str) -> str:
    """One step of a path: the tag and its classes, with digits generalised away."""
    m = _CLASS.search(attributes) if attributes else None
    classes = sorted({_DIGITS.sub("#", x).replace(">", "") for x in (m[1] or m[2] or m[3] or "").split()}) if m else []
    return ".".join([tag, *classes])


class Page:
    """A page's containers and its texts in the order of the document.

    Containers hang on their parents; paths are numbered, and are only spelled out when asked
    for, so that memory follows the page however deep it nests. Node 0 is outside of any container.
    """

    def __init__(self, page: str):
        self.parent, self.path, self.boilerplate = [-1], [0], [False]  # by node
        self.size, self.in_links, self.paragraphs = [0], [0], [0]
        self.texts: list[tuple[int, str]] = []
        self.steps: list[tuple[int, str]] = [(-1, "")]  # by path: the path above it and the last step
        self.known: dict[tuple[int, str], int] = {}
        self._read(page)

    def _open(self, above: int, name: str, tag: str) -> int:
        key = (self.path[above], name)
        path = self.known.get(key)
        if path is None:
            path = self.known[key] = len(self.steps)
            self.steps.append(key)
        self.parent.append(above)
        self.path.append(path)
        self.boilerplate.append(self.boilerplate[above] or tag in BOILERPLATE)
        for counts in (self.size, self.in_links, self.paragraphs):
            counts.append(0)
        return len(self.path) - 1

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = []  # open containers: tag, the node around it
        open_tags: dict[str, int] = {}
        node, links, at, texts = 0, 0, 0, self.texts

        def add(text: str) -> None:
            n = len(text.strip())
            texts.append((node, text))
            self.size[node] += n
            if links:
                self.in_links[node] += n

        for m in _TOKEN.finditer(page):
            if m.start() > at:
                add(page[at : m.start()])
            at = m.end()
            if m[3] is None:
                continue
            tag, closing = m[3].lower(), m[2] == "/"
            if tag in BREAKS:
                texts.append((node, "\n"))
            if tag == "a":
                links = max(0, links + (-1 if closing else 1))
            elif tag == "p" and not closing:
                self.paragraphs[node] += 1
            if tag not in CONTAINERS:
                continue
            if not closing:
                if not m[4].endswith("/"):
                    stack.append((tag, node))
                    open_tags[tag] = open_tags.get(tag, 0) + 1
                    node = self._open(node, step(tag, m[4]), tag)
            elif open_tags.get(tag):
                while True:  # a closing tag ends what was left open inside
                    t, node = stack.pop()
                    open_tags[t] -= 1
                    if t == tag:
                        break
        if at < len(page):
            add(page[at:])

    def score(self, node: int) -> float:
        """How much a container looks like content: its text outside links, paragraphs count extra, boilerplate counts little."""
        size, links = self.size[node], self.in_links[node]
        if not size:
            return 0.0
        value = (size - links) * (1 - links / size) + 50 * self.paragraphs[node]
        return value / 10 if self.boilerplate[node] else value

    def spelled(self, path: int) -> str:
        names = []
        while path:
            path, name = self.steps[path]
            names.append(name)
        return ">".join(reversed(names))

    def best_path(self) -> tuple[str, float] | None:
        """The path of highest total score, of equal ones the first in the page; None where nothing scores. Text outside of containers has the path ""."""
        total: dict[int, float] = {}
        for node, path in enumerate(self.path):
            total[path] = total.get(path, 0.0) + self.score(node)
        best = max(total, key=total.get)
        return (self.spelled(best), total[best]) if total[best] > 0 else None

    def text_at(self, path: str) -> str | None:
        """The text of the containers at a path and, but for boilerplate, below it, in the order of the page; None where the page has no such path."""
        at: int | None = 0
        for name in path.split(">") if path else ():
            at = self.known.get((at, name))
            if at is None:
                return None
        inside = [False] * len(self.path)
        for node, own in enumerate(self.path):
            above = self.parent[node]
            inside[node] = own == at or (above >= 0 and inside[above] and self.steps[own][1].split(".", 1)[0] not in BOILERPLATE)
        # where the text leaves the chosen containers, what follows stands on a line of its own
        parts, last = [], None
        for node, text in self.texts:
            if inside[node]:
                parts.append(text)
            elif last is None or inside[last]:
                parts.append("\n")
            last = node
        return tidy("".join(parts))


def tidy(text: str) -> str:
    """Lines without blanks around them, one blank for several, and no empty lines."""
    lines = (_SPACE.sub(" ", x).strip() for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def host_of(url) -> F.Column:
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def extract(pages: DataFrame, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(page_id, host, path, text, consensus): every page's main text.

    path is the host's winning path, by votes, then by the total of scores, then by the alphabet;
    a page without that path, or whose URL has no host, uses its own best path, of equal ones the
    first in the page, and consensus is then false. Text is in the order of the page; a tag that
    never ends goes with all behind it. A null or empty page, or one without text, has a null path
    and an empty text. Time and memory follow a page's length, however long, nested or broken it
    is. Repeated rows vote and are extracted each; an empty table gives no rows; other columns, of
    whatever name, are not looked at.
    """
    scratch = Scratch(pages.sparkSession, "html")
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), "html")

    def vote(batch):
        got = [(Page(x).best_path() if x else None) or ("", 0.0) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in got]), pa.array([s for _, s in got])], ["host", "path", "score"])

    votes = map_arrow(own.filter("host IS NOT NULL").select("host", "html"), vote, "host string, path string, score double").filter("score > 0")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("s"))
    winners = counted.groupBy("host").agg(F.min(F.struct(-F.col("n"), -F.col("s"), F.col("path").alias("path"))).alias("w")).select("host", F.col("w.path").alias("winner"))
    winners = scratch.save(winners)
    size = winners.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("winner") + 48), F.lit(0))).first()[0]
    # beyond the bound pages and paths meet by shuffle, where adaptive execution splits hosts that are hot
    joined = own.join(F.broadcast(winners) if size <= max_broadcast else winners, "host", "left").select("page_id", "host", "html", "winner")

    def again(batch):
        path, text, agreed = [], [], []
        for page, winner in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            own = Page(page) if page else None
            got = own.text_at(winner) if own and winner is not None else None
            agreed.append(got is not None)
            if got is None:
                best = own.best_path() if own else None
                winner = best[0] if best else None
                got = own.text_at(winner) if best else ""
            path.append(winner)
            text.append(got)
        cols = [batch.column(0), batch.column(1), pa.array(path, pa.string()), pa.array(text, pa.string()), pa.array(agreed)]
        yield pa.RecordBatch.from_arrays(cols, ["page_id", "host", "path", "text", "consensus"])

    kind = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType)])
    return map_arrow(joined, again, with_fields(kind, host=T.StringType(), path=T.StringType(), text=T.StringType(), consensus=T.BooleanType()))
