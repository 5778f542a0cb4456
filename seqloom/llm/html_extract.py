"""Main text of web pages by removal of site templates.

Each page is parsed once into text blocks and element subtrees, every subtree
with a hash of its tags and text.  All subtrees of all pages, menus, footers,
adverts and the paragraphs of articles too, are counted per host in Spark (as
hashes, without texts), over pages with different main text.  Those that recur
on ``MIN_PAGES`` pages of their host are deleted, however many pages the host
has.  Only a paragraph of a marked article must recur on half of the host's
pages for that: quotations and licence lines recur too.

After that goes what the markup itself calls navigation, header, footer,
sidebar, notice, advert, form, script, style or comment, and where a page marks
its article, what lies outside of it.  A form or the like around an article
or around most of the page's text is no such mark.  A class, id or role counts if all its
words are such names or plain ones like 'box'; inside an article, around one
and on inline elements only names that no chapter has count, such as those of
comments, adverts and newsletters.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_hot
from ..plans.scratch import materialize
from .url_filter import host_and_path

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/A-Za-z][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
RAW = frozenset("script style noscript template iframe svg textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td th dd dt figcaption b i em strong span a code q cite u s sub sup small mark".split())
DROPPED = frozenset("nav header footer aside form button select label fieldset dialog menu head".split())
#: Of these, tags that also stand around a whole page: not if they hold an article or most of the page's text.
WRAPPERS = frozenset("form fieldset menu dialog".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
#: Words in class, id or role that mark a part of the page as no main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation navigational breadcrumb breadcrumbs topbar masthead header footer foot "
    "cookie cookies consent gdpr notice notices notification alert disclaimer newsletter subscribe subscription signup login popup modal overlay paywall comment comments commentlist disqus respond replies reply discussion "
    "related recommended recommendations share sharing social toolbar widget pagination pager search searchbox skip contentinfo complementary dialog".split()
)
#: Inside an article only these count: 'discussion' or 'ad-hoc' may name a chapter.
INSIDE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion comment comments commentlist disqus "
    "newsletter subscribe subscription share sharing social cookie cookies consent gdpr pagination pager breadcrumb breadcrumbs related recommended recommendations".split()
)
#: Words that may stand beside them in a name.
PLAIN = frozenset("container wrapper wrap list section area box block slot unit inner outer top bottom left right inline native google article post entry thread site page main global primary secondary mobile bar links link item items button buttons icon icons text title js id posts articles stories notice banner form".split())
SPLIT = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
MIN_PAGES = 4
#: Share of a host's pages on which a paragraph of an article must recur.
ARTICLE_SHARE = 0.5


class _Element:
    __slots__ = ("tag", "first", "dropped", "soft", "main", "digest", "text")

    def __init__(self, tag: str, first: int, dropped: bool, soft: bool, main: bool):
        self.tag, self.first, self.dropped, self.soft, self.main, self.text = tag, first, dropped, soft, main, False
        self.digest = blake2b(tag.encode(), digest_size=8)


def _marked(attributes: str) -> tuple[bool, bool]:
    """Whether class, id or role name an advert, comments or something hidden; and whether they call the element no main text at all."""
    sure = "hidden" in attributes.lower().split()
    any_ = sure
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = {x for x in SPLIT.split(CAMEL.sub(" ", word).lower()) if x}
                sure = sure or bool(parts & INSIDE) and parts <= INSIDE | PLAIN
                any_ = any_ or bool(parts & MARKS) and parts <= MARKS | PLAIN
        elif name == "aria-hidden" and value.lower() == "true":
            sure = True
    return sure, sure or any_


class Page:
    """The text blocks of a page and its element subtrees.

    ``blocks``: texts in page order.  ``marked``: for each, whether the markup
    calls it no main text.  ``mains``: whether it lies in a marked article.
    ``elements``: (hash, first block, end) of each element with text; the hash
    is odd for an article or a paragraph in one.  ``print``: a fingerprint of
    the article's text, or of all text where no article is marked.
    """

    def __init__(self, page: str) -> None:
        self.blocks: list[str] = []
        self.marked: list[bool] = []
        self.mains: list[bool] = []
        self.elements: list[tuple[int, int, int]] = []
        self._whole, self._article = blake2b(digest_size=8), blake2b(digest_size=8)
        self._stack: list[_Element] = []
        self._held: list[str] = []
        self._depths: list[int] = []  # how many elements call each block no main text
        self._around: list[tuple[int, int]] = []
        self._dropped = self._main = 0
        self._mute: list = []  # an inline element whose text is no main text, and how deep it is nested in itself
        self._parse(page)
        while self._stack:
            self._close()
        total = sum(map(len, self.blocks))
        for first, end in self._around:
            alone = [i for i in range(first, end) if self._depths[i] == 1]
            if 2 * sum(len(self.blocks[i]) for i in alone) > total:
                for i in alone:
                    self.marked[i] = False
        self.print = int.from_bytes((self._article if any(self.mains) else self._whole).digest(), "big", signed=True)

    def _flush(self) -> None:
        self._mute = []
        text = " ".join(html.unescape("".join(self._held)).split())
        self._held.clear()
        if not text:
            return
        raw = text.encode("utf-8", "replace")
        self._whole.update(raw + b"\n")
        if self._stack:
            self._stack[-1].digest.update(raw)
            self._stack[-1].text = True
        self.blocks.append(text)
        self.marked.append(self._dropped > 0)
        self._depths.append(self._dropped)
        self.mains.append(self._main > 0 and not self._dropped)
        if self.mains[-1]:
            self._article.update(raw + b"\n")

    def _open(self, tag: str, attributes: str) -> None:
        sure, any_ = _marked(attributes)
        by_tag = tag in DROPPED and not (tag == "header" and self._main)
        soft = not sure and not self._main and (tag in WRAPPERS if by_tag else any_)
        dropped = (by_tag or sure or soft) and tag not in ("html", "body")
        main = tag in ("article", "main") and not dropped
        if main and not any(e.dropped and not e.soft for e in self._stack):
            for e in self._stack:  # a wrapper's class does not speak of the article inside
                if e.dropped:
                    e.dropped = False
                    self._dropped -= 1
        self._dropped += dropped
        self._main += main
        self._stack.append(_Element(tag, len(self.blocks), dropped, soft, main))

    def _close(self) -> None:
        self._flush()
        e = self._stack.pop()
        self._dropped -= e.dropped
        if e.dropped and e.soft and e.tag in WRAPPERS:
            self._around.append((e.first, len(self.blocks)))
        inside = self._main > 0
        self._main -= e.main
        digest = e.digest.digest()
        if self._stack:
            self._stack[-1].digest.update(digest)
            self._stack[-1].text |= e.text
        if e.text and e.tag not in ("html", "body"):
            self.elements.append(((int.from_bytes(digest, "big", signed=True) & ~1 or 2) | (inside and (e.main or e.tag in PARAGRAPH)), e.first, len(self.blocks)))

    def _close_to(self, tags, stop) -> None:
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i].tag in tags:
                while len(self._stack) > i:
                    self._close()
                return
            if self._stack[i].tag in stop:
                return

    def _inline(self, tag: str, ending: str, attributes: str) -> None:
        if self._mute:
            if tag == self._mute[0]:
                self._mute[1] += -1 if ending else 1
                if not self._mute[1]:
                    self._mute = []
        elif not ending and not attributes.rstrip().endswith("/") and (tag in DROPPED or attributes and _marked(attributes)[0]):
            self._mute = [tag, 1]

    def _parse(self, page: str) -> None:
        at, endless = 0, set()
        while at < len(page):
            found = TOKEN.search(page, at)
            end = found.start() if found else len(page)
            if end > at and not self._mute:
                self._held.append(page[at:end])
            if not found:
                break
            at = found.end()
            tag = found[2] or found[5]
            if not tag:
                continue
            tag, ending, attributes = tag.lower(), found[1] or found[4], found[3] or found[6] or ""
            if ending:
                if tag not in BLOCK:
                    self._inline(tag, ending, "")
                    continue
                self._flush()
                for i in range(len(self._stack) - 1, -1, -1):
                    if self._stack[i].tag == tag:
                        while len(self._stack) > i:
                            self._close()
                        break
            elif tag in RAW:
                if not attributes.rstrip().endswith("/") or tag in ("script", "style"):
                    close = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                    if close:
                        at = close.end()
                    elif tag in ("script", "style"):
                        break
                    else:  # never closed: the tag alone goes
                        endless.add(tag)
            elif tag in VOID:
                self._held.append(" ")
                if tag == "hr":
                    self._flush()
            elif tag in BLOCK:
                self._flush()
                self._close_to({"p"}, {"table", "td", "th", "article", "div", "section", "li", "blockquote", "body"} if tag != "p" else {"table", "article", "div", "section", "body"})
                if tag in CLOSES:
                    self._close_to(*CLOSES[tag])
                self._open(tag, attributes)
            else:
                self._inline(tag, "", attributes)
        self._flush()


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, markup: bool = True) -> DataFrame:
    """One row for each page: id, url, text, n_chars, n_recurring, n_marked.

    A subtree is a site template if it recurs on at least ``min_pages`` pages
    of a host (a paragraph of a marked article also on ``ARTICLE_SHARE`` of
    them); pages of a host with the same main text count once, so copies of a
    page or article are no template.  ``n_marked`` blocks go by the markup,
    ``n_recurring`` further ones by the counts; without ``markup`` all that go
    go by the counts, and no article is known.  Null html is an empty page; a null url has the host ''.
    A page without text left gives an empty text.  Rows given twice give two
    rows; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.monotonically_increasing_id().alias("uid"))
    id_type = rows.schema["id"].dataType.simpleString()
    element = pa.list_(pa.struct([("hash", pa.int64()), ("article", pa.bool_()), ("first", pa.int32()), ("end", pa.int32()), ("holds", pa.bool_())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                parsed = [Page(x.as_py() or "") for x in part.column(2)]
                hosts = [host_and_path(x.as_py())[0].encode("utf-8", "replace") for x in part.column(1)]
                sites = [int.from_bytes(blake2b(x, digest_size=8).digest(), "big", signed=True) for x in hosts]
                texts, elements, prints = [], [], []
                for p, site in zip(parsed, sites, strict=True):
                    only = markup and any(p.mains)
                    texts.append([None if markup and (m or only and not a) else b for b, m, a in zip(p.blocks, p.marked, p.mains, strict=True)])
                    # the host is part of the hash: one column to count and to join by
                    # elements whose blocks go by the markup in any case are counted, but need not be joined to be deleted
                    left = list(accumulate((x is not None for x in texts[-1]), initial=0))
                    elements.append([{"hash": (h & ~1) * 0x9E3779B97F4A7C15 + site + (1 << 63) & (1 << 64) - 1, "article": bool(markup and h & 1), "first": a, "end": b, "holds": left[b] > left[a]} for h, a, b in p.elements])
                    for e in elements[-1]:
                        e["hash"] -= 1 << 63
                    prints.append(p.print)
                columns = [part.column(3), part.column(0), part.column(1), pa.array(sites, pa.int64()), pa.array(prints, pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(elements, element)]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "id", "url", "site", "print", "blocks", "elements"])

    schema = f"uid long, id {id_type}, url string, site long, print long, blocks array<string>, elements array<struct<hash: long, article: boolean, first: int, end: int, holds: boolean>>"
    parsed = materialize(rows.mapInArrow(read, schema), "parsed")
    sizes = parsed.select("site", "print").distinct().groupBy("site").agg(F.count("*").alias("pages"))
    found = parsed.select("site", "print", F.explode(F.array_distinct(F.col("elements.hash"))).alias("hash")).distinct().groupBy("hash").agg(F.count("*").alias("n"), F.first("site").alias("site"))
    found = materialize(found.where(F.col("n") >= min_pages), "found")
    template = join_hot(found, sizes, "site").select("hash", (F.col("n") >= ARTICLE_SHARE * F.col("pages")).alias("most"))
    wanted = parsed.select("uid", F.inline("elements")).where("holds").drop("holds")
    gone = join_hot(wanted, template, "hash").where("most or not article").groupBy("uid").agg(F.collect_list(F.struct("first", "end")).alias("gone"))
    out = parsed.select("uid", "id", "url", "blocks").join(materialize(gone, "gone"), "uid", "left").withColumn("gone", F.coalesce("gone", F.array()))
    # a recurring element takes all blocks from its first to its end
    out = out.withColumn("blocks", F.transform("blocks", lambda b, i: F.struct(b.alias("text"), F.exists("gone", lambda g: (g["first"] <= i) & (i < g["end"])).alias("recurs"))))
    left = F.filter("blocks", lambda b: b["text"].isNotNull() & ~b["recurs"])
    n_recurring = F.size(F.filter("blocks", lambda b: b["recurs"] & b["text"].isNotNull())).cast("long")
    n_marked = F.size(F.filter("blocks", lambda b: b["text"].isNull())).cast("long")
    text = F.array_join(F.transform(left, lambda b: b["text"]), "\n")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"), n_recurring.alias("n_recurring"), n_marked.alias("n_marked")).withColumn("n_chars", F.length("text").cast("long")).select(id_col, url_col, "text", "n_chars", "n_recurring", "n_marked")
