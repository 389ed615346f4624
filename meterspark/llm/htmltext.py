"""Main text of web pages by consensus of their hosts.

Each page's containers are scored by the text in them, and a page votes for the
paths of its good ones: the chain of tags, classes and ids from the root, with digits
generalised, so that the pages of one template agree (``div.post-#``). Votes
are summed for each host in Spark. A page is then extracted again from the
containers on the host's winning path that it has; where it has none of them
(or no host), from its own best one.

Inside a container, what is plainly no article text stays out: menus, headers,
footers, sidebars, notices, adverts, forms, reader comments, scripts, styles
and hidden elements, told by tag, role, or a word of their class or id.

Scale: two passes over the pages; between them only (host, path, vote) is
shuffled, reduced in the map tasks first, so a host that holds a third of all pages is
as many rows as it has paths and tasks. The winners are written before they
are joined: Spark broadcasts them while small, else it splits hot hosts. Votes for
paths below ``MIN_SHARE`` of a host's pages are left out of the winners only.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterspark.llm.common import read, rows_of, scratch

NEAR = 0.8                  # a page votes for its paths of at least this part of its best score; above DECAY, so not for a mere wrapper
MIN_SHARE = 0.1             # part of the best path's votes that a winner needs
DECAY = 0.75                # what a container gets of the text of a container inside it

#: A comment, a tag, another mark, a tag that never ends, or text.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^<>]*>?|<[a-zA-Z][^<>]*>?|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())       # their text holds no tags
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                   "hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDERS = frozenset("article blockquote body center dd details div dl fieldset figure html li main ol section table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opened tag closes an open one of these, unless one of the second set lies between.
CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
          "tbody": ("thead tbody tr td th", "table"), "tfoot": ("thead tbody tr td th", "table"), "option": ("option", "select")}
CLOSES = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in CLOSES.items()}

JUNK_TAGS = frozenset("aside button canvas dialog footer form head header input label map math menu nav noscript object option script select style svg template textarea title".split()) | RAW
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
JUNK_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disclaimer discussion disqus footer gdpr "
                       "masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promos promotion related replies reply "
                       "respond share sharing sidebar sidebars skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split())
GOOD_WORDS = frozenset("article body content entry main post story text".split())
POST_WORDS = frozenset("article entry post story".split())       # what calls itself one article, whose header holds its title
KEPT_TAGS = frozenset("html body main article".split())         # never junk by a word of their class


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def words_of(own: dict[str, str]) -> list[str]:
    return [w.lower() for w in WORD.findall(own.get("class", "") + " " + own.get("id", ""))]


def is_junk(tag: str, own: dict[str, str]) -> bool:
    if tag in JUNK_TAGS:
        return True
    if not own:
        return False
    if "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")):
        return True
    if tag in KEPT_TAGS and tag != "article":
        return False
    if own.get("role", "").lower() in JUNK_ROLES:
        return True
    words = words_of(own)
    if tag == "article":                                        # only a reader's comment is an article of its own
        return not {"comment", "comments", "reply"}.isdisjoint(words)
    return any(w in JUNK_WORDS and words[max(0, i - 1):i] not in (["has"], ["with"], ["no"]) for i, w in enumerate(words))


def step_of(tag: str, own: dict[str, str]) -> str:
    classes = sorted({DIGITS.sub("#", c) for c in own.get("class", "").split()})
    return tag + "".join("." + c for c in classes) + ("#" + DIGITS.sub("#", own["id"].strip()) if own.get("id", "").strip() else "")


class Frame(NamedTuple):
    """An open element."""
    tag: str
    container: int
    junk: bool = False
    link: bool = False
    article: bool = False
    header: bool = False
    heading: bool = False


class Page:
    """The blocks of a page, in order: (text, characters in links, container).

    ``parts`` are the containers: (path, parent, whether it calls itself content). A
    path is a number; ``steps`` holds its parent path and last step, so that
    deeply nested pages stay small."""

    def __init__(self, html: str):
        self.steps: list[tuple[int, str]] = [(-1, "")]
        self._paths: dict[tuple[int, str], int] = {}
        self.parts: list[tuple[int, int, bool]] = [(0, -1, False)]
        self.blocks: list[tuple[str, int, int]] = []
        self._open: list[Frame] = [Frame("", 0)]
        self._count: Counter[str] = Counter()       # open elements by tag
        self._text: list[str] = []
        self._linked = 0
        self._read(html)
        self._flush()

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((text, self._linked, self._open[-1].container))
            self._text, self._linked = [], 0

    def _pop_to(self, depth: int) -> None:
        gone = [frame.tag for frame in self._open[depth:]]
        if not BLOCKS.isdisjoint(gone):
            self._flush()
        self._count.subtract(gone)
        del self._open[depth:]

    def _path(self, parent: int, step: str) -> int:
        if (parent, step) not in self._paths:
            self._paths[parent, step] = len(self.steps)
            self.steps.append((parent, step))
        return self._paths[parent, step]

    def written(self, path: int) -> str:
        out = []
        while path > 0:
            path, step = self.steps[path]
            out.append(step)
        return ">".join(reversed(out))

    def find_path(self, written: str) -> int | None:
        """The number of a written path, None if the page lacks it."""
        path: int | None = 0
        for step in written.split(">"):
            path = self._paths.get((path, step))
            if path is None:
                return None
        return path

    def _start(self, tag: str, own: dict[str, str]) -> None:
        closed, fence = CLOSES.get(tag, (frozenset(), frozenset()))
        if any(self._count[c] for c in closed):
            for depth in range(len(self._open) - 1, 0, -1):
                if self._open[depth].tag in fence:
                    break
                if self._open[depth].tag in closed:
                    self._pop_to(depth)
                    break
        if tag in BLOCKS:
            if self._count["p"]:                                # a block ends an open paragraph
                depth = next(d for d in range(len(self._open) - 1, 0, -1) if self._open[d].tag in BLOCKS)
                if self._open[depth].tag == "p":
                    self._pop_to(depth)
            self._flush()
        elif tag == "br":
            self._text.append(" ")
        if tag in VOID:
            return
        up = self._open[-1]
        title = tag == "header" and up.article                  # an article's own header holds its title
        junk = up.junk or (not title and is_junk(tag, own))
        container, article = up.container, up.article or tag == "article"
        if tag in HOLDERS and not junk:
            article = article or (tag in ("div", "section") and not POST_WORDS.isdisjoint(words_of(own)))
            good = tag in ("article", "main") or own.get("itemprop") == "articleBody" or (tag in ("div", "section", "td") and not GOOD_WORDS.isdisjoint(words_of(own)))
            self.parts.append((self._path(self.parts[container][0], step_of(tag, own)), container, good))
            container = len(self.parts) - 1
        self._open.append(Frame(tag, container, junk, up.link or tag == "a", article, up.header or title, up.heading or tag in HEADINGS))
        self._count[tag] += 1

    def _end(self, tag: str) -> None:
        if not self._count[tag]:
            return
        for depth in range(len(self._open) - 1, 0, -1):
            name = self._open[depth].tag
            if name == tag:
                self._pop_to(depth)
                return
            if tag not in BLOCKS and name in HOLDERS:           # the end of a phrase ends no container
                return

    def _add(self, text: str) -> None:
        up = self._open[-1]
        if up.junk or (up.header and not up.heading):
            return
        self._text.append(text)
        if up.link:
            self._linked += len("".join(text.split()))

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            m = TOKEN.match(html, at)
            at = m.end()
            tag = m[2]
            if tag is None:
                text = m[0]
                if text[0] != "<" or len(text) == 1:
                    self._add(entities.unescape(text))
                continue
            tag = tag.lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, attributes(m[3]))
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
                at = end.start() if end else size

    def scores(self) -> dict[int, float]:
        """Each path's score: its containers' own text outside links, and part
        of that of the containers inside them; more for what calls itself content."""
        own = [0.0] * len(self.parts)
        for text, linked, container in self.blocks:
            plain = len(text) - 2 * linked
            own[container] += plain * (1.0 if len(text) >= 40 or text[-1] in ".!?…。" else 0.5)
        out: dict[int, float] = {}
        for i in range(len(self.parts) - 1, 0, -1):
            path, parent, good = self.parts[i]
            own[parent] += DECAY * max(0.0, own[i])
            out[path] = out.get(path, 0.0) + own[i] * (1.6 if good else 1.0)
        return {path: score for path, score in out.items() if score > 0}

    def text(self, path: int | None) -> str:
        """The blocks inside containers of that path; all without one."""
        if path is None:
            return "\n".join(b[0] for b in self.blocks)
        inside = [False] * len(self.parts)
        for i, (own, parent, _) in enumerate(self.parts):
            inside[i] = own == path or (i > 0 and inside[parent])
        return "\n".join(text for text, _, container in self.blocks if inside[container])


def extract(html: str, winners: list[str]) -> str:
    """The main text; from the first of the host's winning paths that holds
    text on this page, else from the page's own best container (of equal ones the first)."""
    page = Page(html)
    scores = page.scores()
    for path in map(page.find_path, winners):
        if path in scores:
            return page.text(path)
    return page.text(min(scores, key=lambda p: (-scores[p], p)) if scores else None)


def _vote_batches(batches):
    for batch in batches:
        for part in rows_of(batch, 64):
            votes: dict[tuple[str, str], int] = {}
            for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                page = Page(html or "")
                scores = page.scores()
                most = max(scores.values(), default=0.0)
                for path, score in scores.items():
                    if score >= NEAR * most:
                        key = host, page.written(path)
                        votes[key] = votes.get(key, 0) + round(1e6 * score / most)        # whole numbers, so that sums have no order
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()), pa.array(votes.values(), pa.int64())],
                                             ["host", "path", "votes"])


def _extract_batches(batches):
    for batch in batches:
        for part in rows_of(batch, 64):
            found = [extract(html or "", paths or []) for html, paths in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and final dot; '' if there is none."""
    return F.coalesce(F.lower(F.rtrim(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/]*\]|[^/:?#]*)", 1), F.lit("."))), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths: the winning paths, most votes first."""
    asked = pages.select(host_of(pages["url"]).alias("host"), pages["html"].cast("string").alias("html")).filter("host != ''")
    votes = asked.mapInArrow(_vote_batches, "host string, path string, votes bigint").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    ranked = votes.withColumn("most", F.max("votes").over(Window.partitionBy("host"))).filter(F.col("votes") >= MIN_SHARE * F.col("most"))
    return ranked.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("order"), "path"))), lambda x: x["path"]).alias("paths"))


def extract_text(pages: DataFrame, path: str) -> DataFrame:
    """page_id, url, text, n_chars for each input row; the winning paths are
    written to ``path``.

    A null or empty html has an empty text. Pages without a host (null or
    relative url) are extracted by their own best container. Repeated rows and null ids come out
    as they came in; an empty table gives no rows. Other columns are ignored."""
    spark = pages.sparkSession
    host_paths(pages).write.parquet(path)
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), pages["html"].cast("string").alias("html"), host_of(pages["url"]).alias("host"))
    known = spark.read.schema("host string, paths array<string>").parquet(path)
    return rows.join(known, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(_extract_batches, "page_id bigint, url string, text string, n_chars bigint")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"), scratch(spark, "host-paths"))
