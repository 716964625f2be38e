"""Main-text extraction with site template removal.

A page is parsed into a tree of elements. Every subtree gets a digest of its
tags and text; Spark counts, per host, the different pages that hold each digest, and a
subtree on at least MIN_PAGES pages and MIN_SHARE of a host's pages is the
site's template and is deleted there. Pages whose main part (all of the page, if it marks none)
has the same tags and text are copies and count as one, so an article isn't taken for a template because it
is held many times; the chosen article or main element itself never is one. Words within a
sentence, list items, cells, headings and the paragraphs of a marked article recur by themselves (in
near copies, quotations): they need PART_SHARE.
What stands for itself by its
element or name (menus, page headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments) goes as well, recurring or not. What is left
of the article (of the body, if the page marks none) gives the blocks.

A host has at most its pages' mean number of subtrees / MIN_SHARE templates, so the
list a page is joined with has a bound that the host's size doesn't move. Counts are
combined before the shuffle. The templates are broadcast if their bytes,
counted, allow it; else pages are dealt by host and a salt, so a host that has a
third of all pages is spread over SALT tasks. Hosts and subtrees are told apart by 64-bit digests.

Defined results: null and empty html give an empty text; pages without a
valid url share the host ""; repeated rows each give a row and count as one page; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, saved

MIN_PAGES, MIN_SHARE, PART_SHARE = 10, 0.05, 0.5
SALT = 32
#: In the place of a digest: the page itself, counted with its subtrees.
PAGE = 0

#: Elements without content, and those whose content is not markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that begin a new block of text.
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th "
                  "thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a list, table or section, and elements that stand in a sentence.
PART = HEADING | frozenset("li dt dd tr td th tbody thead tfoot caption figcaption summary option legend".split())
PHRASE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var".split())
#: Elements, roles and names that are not main text.
CHROME = frozenset("head script style noscript template nav header footer aside form button select textarea input iframe object "
                   "svg canvas video audio dialog menu title".split())
CHROME_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
CHROME_NAME = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar "
                        "navigation breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies consent notice gdpr "
                        "comment comments commentlist disqus reply replies share sharing social related newsletter subscribe "
                        "popup modal login search widget toolbar pagination pager skip".split())
#: A start tag of the first kind ends an open element of the second.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",)}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
                    r"|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?<=\s)(hidden)(?=[\s>/]|\Z)")
_NAME = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "attrs", "parts", "digest")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.parts, self.digest = tag, attrs, [], None


def parse(source: str) -> Node:
    """The tree of a page; unclosed and crossed elements are closed like a browser does."""
    root = Node("#root")
    stack, at = [root], 0
    n = len(source)
    while at < n:
        # The next "<" that opens something; others are text.
        low, m = source.find("<", at), None
        while low >= 0 and (m := _TOKEN.match(source, low)) is None:
            low = source.find("<", low + 1)
        if low < 0:
            stack[-1].parts.append(_html.unescape(source[at:]))
            break
        if low > at:
            stack[-1].parts.append(_html.unescape(source[at:low]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ENDS.get(tag, ()):
                del stack[i:]
                break
            if stack[i].tag in BLOCK and stack[i].tag not in ("td", "th", "p"):
                break
        node = Node(tag, m[3])
        stack[-1].parts.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>|\Z", re.I).search(source, at)
            node.parts.append(source[at:end.start()])
            at = end.end()
            continue
        stack.append(node)
    return root


def subtree_digests(root: Node) -> set[int]:
    """Digest of every element that holds text; set on the nodes."""
    out: set[int] = set()
    todo = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo.append((node, True))
            todo.extend((p, False) for p in node.parts if type(p) is Node)
            continue
        h, text = hashlib.blake2b(node.tag.encode(), digest_size=8), False
        for p in node.parts:
            if type(p) is Node:
                h.update(p.digest[0])
                text |= p.digest[1]
            elif t := p.strip():
                h.update(b"\0" + t.encode("utf-8", "surrogatepass"))
                text = True
        node.digest = (h.digest(), text)
        if text and node.tag not in RAW and node.tag not in ("#root", "html", "body"):
            out.add(int.from_bytes(h.digest(), "little", signed=True))
    return out


def is_chrome(node: Node, in_article: bool) -> bool:
    if node.tag in CHROME:
        return not (node.tag == "header" and in_article)
    if node.attrs and "=" in node.attrs or " hidden" in node.attrs:
        for k, a, b, c, hidden in _ATTR.findall(node.attrs):
            k, v = k.lower(), (a or b or c).lower()
            if hidden or k == "role" and v in CHROME_ROLE or k == "aria-hidden" and v == "true" or (
                    k == "style" and "display:none" in v.replace(" ", "")):
                return True
            if k in ("class", "id") and node.tag not in ("html", "body", "article", "main") and not CHROME_NAME.isdisjoint(_NAME.findall(v)):
                return True
    return False


def _mains(root: Node) -> list[Node]:
    """The outermost articles outside chrome, else main elements, else the whole page."""
    for want in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.tag == want and node.tag not in CHROME:
                found.append(node)
            elif not is_chrome(node, False):
                todo.extend(p for p in reversed(node.parts) if type(p) is Node)
        if found:
            return found
    return [root]


def main_text(root: Node, templates: set[int], strong: set[int] | None = None) -> str:
    """The blocks of the main text; needs the digests of subtree_digests().
    Parts and phrases go only if they are among the ``strong`` templates."""
    blocks: list[str] = []
    open_: list[str] = []
    strong = templates if strong is None else strong

    def close() -> None:
        if t := " ".join("".join(open_).split()):
            blocks.append(t)
        open_.clear()

    for main in _mains(root):
        # The last: whether the element is within a part, or a text of its own.
        todo: list = [(main, main.tag == "article", False, False)]
        while todo:
            x, in_article, headings, within = todo.pop()
            if x is None:
                close()
                continue
            if type(x) is str:
                if not headings:
                    open_.append(x)
                continue
            part = x.tag in PART or within and x.tag in PHRASE or x.tag == "p" and main is not root
            if is_chrome(x, in_article) or x is not main and _number(x.digest[0]) in (strong if part else templates):
                if x.tag in BLOCK:
                    close()
            else:
                if x.tag == "br":
                    open_.append(" ")
                if x.tag in BLOCK:
                    close()
                    todo.append((None, False, False, False))
                headings = (headings or x.tag == "header") and x.tag not in HEADING
                within = part or any(type(p) is str and not p.isspace() for p in x.parts)
                todo.extend((p, in_article, headings, within) for p in reversed(x.parts))
        close()
    return "\n\n".join(blocks)


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, main, digests): of each page the digest of its main part, and those of its subtrees."""
    for b in batches:
        mains, out = [], []
        for source in b.column(1):
            root = parse(source.as_py() or "")
            d = subtree_digests(root)
            mains.append(_number(hashlib.blake2b(b"".join(x.digest[0] for x in _mains(root)), digest_size=8).digest()))
            out.append(np.sort(np.fromiter(d, np.int64, len(d))).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mains, pa.int64()), pa.array(out, pa.binary())], ["host", "main", "digests"])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, digest) of the subtrees, and one PAGE for each page."""
    for b in batches:
        d = [np.append(np.frombuffer(x.as_buffer(), np.int64), PAGE) for x in b.column(1)]
        if d:
            host = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(x) for x in d])
            yield pa.RecordBatch.from_arrays([pa.array(host), pa.array(np.concatenate(d))], ["host", "digest"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for source, templates, strong in zip(b.column("html"), b.column("templates"), b.column("strong")):
            root = parse(source.as_py() or "")
            subtree_digests(root)
            texts.append(main_text(root, set(templates.as_py() or ()), set(strong.as_py() or ())))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, templates, strong) of pages (host, html): digests of the template
    subtrees, and of those on PART_SHARE of the host's pages."""
    # Copies of a main part fall together before the shuffle.
    different = pages.select("host", "html").mapInArrow(_digests, "host long, main long, digests binary").groupBy("host", "main").agg(
        F.min("digests").alias("digests"))
    counts = saved(different.select("host", "digests").mapInArrow(_each, "host long, digest long").groupBy("host", "digest").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages), "site-counts")
    per_host = counts.where(F.col("digest") == PAGE).select("host", F.col("n").alias("pages"))
    strong = F.col("n") >= F.col("pages") * max(min_share, PART_SHARE)
    return counts.where(F.col("digest") != PAGE).join(per_host, "host").where(F.col("n") >= F.col("pages") * min_share).groupBy("host").agg(
        F.collect_list("digest").alias("templates"), F.collect_list(F.when(strong, F.col("digest"))).alias("strong"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    url = F.col(url_col).cast("string")
    p = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.xxhash64(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))).alias("host"),
                     F.col(html_col).cast("string").alias("html"))
    templates = saved(site_templates(p, min_pages, min_share), "site-templates")
    size = templates.agg(F.sum(8 + 8 * F.size("templates") + 8 * F.size("strong"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        found = p.join(F.broadcast(templates), "host", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
        found = p.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALT)).cast("int")).join(
            templates.withColumn("salt", salts), ["host", "salt"], "left")
    id_type = p.schema["page_id"].dataType.simpleString()
    return found.select("page_id", "url", "html", "templates", "strong").mapInArrow(_texts, f"page_id {id_type}, url string, text string").withColumn(
        "n_chars", F.length("text").cast("long"))
