"""HTML extraction: site template removal.

Each page is parsed to a tree. Outside the article, every element subtree gets a
hash of its tags, classes and text; Spark counts with how many differing contents of
a host each hash stands, and the subtrees that recur with many of them are deleted.
Elements that name themselves as furniture (nav, footer, forms, adverts,
comments, ...) go as well. What is left of the article, or of the body where a
page names no article, is the text.

Within the article only furniture-like containers (aside, div, section, lists,
tables, figures) are counted and never its paragraphs and headings by themselves.
Names count there whole ("share") or as known compounds ("share-buttons"), and ids
of headings, sections and other text never. Reader comments are also known by their
shape: a container behind the article's last paragraph whose children are of one kind,
bear no headings, and each have two of an author, a date and a way to reply. A header
in an article goes as any header does, with its headings; a button or label amid the
words of a sentence stays.

Copies of an article count as one content, so that an article under many urls of a
host stays whole. A page's content is known by its longest run of text outside the
subtrees that recur on the host's pages; where little stands outside them, the page
is a copy and its largest recurring subtree stands for it. Copies may thus differ in
a date or some paragraphs. A subtree that holds most of a page's text stays there.

Defined cases: null or empty html gives an empty text; a null url has an empty
host, whose pages count together; repeated rows are one page in the counts and
each keep their result; unclosed or stray tags are closed where their parent
ends or ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, own_columns

#: A subtree recurs if it stands with so many differing contents of its host, however large the host is.
LEAST_PAGES = 5
#: A page whose recurring subtrees leave a smaller share of its text is a copy.
LEAST_OWN = 0.1
#: A subtree with such a share of a page's text isn't its template.
MOST_TEXT = 0.75

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose words are sentences.
SENTENCES = frozenset("p li dd td blockquote span b i em strong a q cite".split())
#: Never text.
FURNITURE = frozenset("head script style nav header footer aside form noscript template iframe object svg canvas button select textarea "
                      "dialog menu audio video noembed noframes title input option label fieldset".split())
#: Words of class, id or role that name furniture.
FURNITURE_NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
                            "breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notices alert announcement disclaimer popup modal overlay "
                            "newsletter subscribe subscription signup login share sharing social related recommended comment comments "
                            "disqus respond reply replies widget toolbar pagination pager skip complementary contentinfo search".split())
#: Inside an article a name of several words names furniture if it has one of the heads (words that an article's own parts seldom
#: bear) and no words but furniture's and the parts below: "share-buttons", not "share-prices" or "article-header".
COMPOUND_HEADS = FURNITURE_NAMES - frozenset("header announcement disclaimer complementary respond skip".split())
COMPOUND_PARTS = FURNITURE_NAMES | frozenset("box block container wrapper wrap area list link links button buttons bar icon icons form top bottom left right "
                                             "inner site page post posts article articles section items unit slot "
                                             "thread threads user users reader readers visitor visitors guest guests count counter latest recent all more load show view "
                                             "panel holder global system web website blog js wp facebook fb twitter".split())
#: Words of class or id, tags, and words of links that show parts of a comment.
COMMENT_PARTS = {"author": frozenset("author authors byline user username nickname nick avatar commenter poster vcard fn".split()),
                 "date": frozenset("date time datetime timestamp posted published ago".split()),
                 "reply": frozenset("reply replies respond answer vote votes upvote downvote like likes flag report permalink quote".split())}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAY_COMMENT = re.compile(r"(?i)author|user|nick|avatar|commenter|poster|byline|vcard")
#: Characters of a paragraph that belongs to the article's run of text.
PARAGRAPH = 40
#: Text of other elements stays in its block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong "
                   "sub sup time tt u var wbr img".split())
MAIN = frozenset(("article", "main"))
WHOLE_PAGE = frozenset(("html", "body", "main"))
#: Their ids are anchors, made from the text's own words, and say nothing about what they hold; as little do those of elements of the class "section".
ANCHORED = INLINE | frozenset("h1 h2 h3 h4 h5 h6 hgroup section p pre blockquote dt dd li caption tr td th figcaption".split())
#: A name that begins so says something about the element's surroundings.
NEGATIONS = frozenset(("has", "with", "no", "without", "not", "is"))
#: Subtrees that may be counted inside the article.
CONTAINERS = frozenset("div section aside ul ol dl table figure details center".split())
#: An open element that ends where another of the named begins.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
END_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "names", "kids", "hash", "inner", "comments", "amid")

    def __init__(self, tag: str, names: frozenset[str] = frozenset()):
        self.tag, self.names, self.kids, self.hash, self.inner = tag, names, [], 0, False
        self.comments = self.amid = False  # holds reader comments; stands amid the words of a sentence

    def says(self, *marks: str) -> bool:
        """Whether class or role, or an id that isn't an anchor, say one of the marks of names_of."""
        anchor = self.tag in ANCHORED or "=section" in self.names
        return any(m in self.names or (not anchor and "#" + m in self.names) for m in marks)

    def furniture(self, inside: bool) -> bool:
        """By its tag or its names: in an article whole names and known compounds count, outside any word of a name.
        Of an article only a whole name counts ("comment", not "comments-open"), and names say nothing about what holds the page."""
        if self.tag in WHOLE_PAGE:
            return False
        if self.comments:
            return True
        if self.amid and inside:
            return self.says("whole", "compound")
        return self.tag in FURNITURE or (self.named if self.tag == "article" else self.says("whole", "compound") if inside else self.says("whole", "word"))

    @property
    def named(self) -> bool:
        return self.says("whole")


def names_of(attrs: str) -> frozenset[str]:
    """The names in class and role (after "=") and id (after "#="), and what they say of furniture: whole, compound or word (for id after "#")."""
    out: set[str] = set()
    for k, a, b, c in ATTR.findall(attrs):
        k = k.lower()
        if k in ("class", "id", "role"):
            mark = "#" if k == "id" else ""
            for name in (a or b or c).lower().split():
                words = [x for x in re.split(r"[^a-z0-9]+", name) if x]
                out.add(f"{mark}={name}")
                if name in FURNITURE_NAMES:
                    out.add(mark + "whole")
                if words and words[0] not in NEGATIONS and not FURNITURE_NAMES.isdisjoint(words):
                    out.add(mark + "word")
                    if COMPOUND_PARTS.issuperset(words) and not COMPOUND_HEADS.isdisjoint(words):
                        out.add(mark + "compound")
        elif k in ("hidden", "aria-hidden") and (a or b or c).lower() in ("", "true", "hidden"):
            out.update(("compound", "word"))
    return frozenset(out)


def parse(html: str) -> Node:
    """A tree whose leaves are strings (decoded text)."""
    root = Node("")
    stack, i, n = [root], 0, len(html)
    may_comment = False
    while i < n:
        m = TOKEN.search(html, i)
        j = m.start() if m else n
        if j > i:
            stack[-1].kids.append(htmllib.unescape(html[i:j]))
        if not m:
            break
        i = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in MAIN and tag not in ("body", "html"):
                    break  # a stray end tag doesn't close the article
            continue
        if tag in CLOSES or tag in ENDS_P:
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        node = Node(tag, names_of(m[3]) if m[3] else frozenset())
        may_comment = may_comment or tag == "time" or bool(m[3] and MAY_COMMENT.search(m[3]))
        if tag in ("button", "label"):
            node.amid = stack[-1].tag in SENTENCES and any(type(k) is str and not k.isspace() for k in stack[-1].kids)
        stack[-1].kids.append(node)
        if tag in RAW:
            e = END_RAW[tag].search(html, i)
            j = e.start() if e else n
            if tag in ("title", "textarea"):
                node.kids.append(htmllib.unescape(html[i:j]))
            i = j
            stack.append(node)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    if may_comment:
        for a in [x for x, _ in walk(root) if x.tag in MAIN]:
            mark_comments(a)
    return root


def comment_parts(x: Node) -> tuple[set[str], bool]:
    """The parts of a comment that an element has, by tags and by words of names; and whether it has headings."""
    parts, headed = set(), False
    for k, _ in walk(x):
        headed |= k.tag in HEADINGS
        if k.tag == "time":
            parts.add("date")
        words = {w for n in k.names if "=" in n for w in re.split(r"[^a-z0-9]+", n.partition("=")[2])}
        if k.tag in ("a", "button"):
            words |= {w for t in k.kids if type(t) is str for w in t.lower().split()[:2]}
        parts.update(part for part, of in COMMENT_PARTS.items() if not of.isdisjoint(words))
    return parts, headed


def mark_comments(article: Node) -> None:
    """Marks the containers behind the last paragraph of an article whose children are comments."""
    def length(x: Node) -> int:
        return sum(len(t.strip()) for k, _ in walk(x) for t in k.kids if type(t) is str)

    def shape(x: Node) -> tuple[str, frozenset[str]]:
        # names with a number in them are a comment's own
        return x.tag, frozenset(n for n in x.names if n.startswith("=") and not any(c.isdigit() for c in n))

    spine = [article]
    while spine:
        x = spine.pop()
        kids = [k for k in x.kids if type(k) is Node]
        for n in range(len(kids) - 1, -1, -1):
            k = kids[n]
            if k.tag == "p" and length(k) >= PARAGRAPH:
                break  # the article's text goes on to here
            if k.tag not in CONTAINERS:
                continue
            items = [i for i in k.kids if type(i) is Node and i.tag not in INLINE and i.tag not in HEADINGS and i.tag not in VOID]
            if len(items) >= 2 and len({shape(i) for i in items}) == 1 and all(len(p) >= 2 and not headed for p, headed in map(comment_parts, items)):
                # something of the article stands before
                k.comments = any(type(t) is Node and t.tag == "p" and length(t) >= PARAGRAPH for t, _ in walk(article, True) if t is not k and not _under(k, t))
            elif not k.comments:
                spine.append(k)


def _under(top: Node, x: Node) -> bool:
    return any(k is x for k, _ in walk(top))


def walk(node: Node, inside: bool = False) -> Iterator[tuple[Node, bool]]:
    """Each element and whether it is in an article; iterative, as pages may nest deeply."""
    todo = [(node, inside)]
    while todo:
        x, there = todo.pop()
        yield x, there
        there = there or x.tag in MAIN
        todo.extend((k, there) for k in x.kids if type(k) is Node)


def hash_subtrees(root: Node) -> list[tuple[Node, bool]]:
    """Sets ``hash`` of every element from its tag, names and children; returns the elements and whether they're in the article."""
    nodes = list(walk(root))
    for x, _ in reversed(nodes):  # children come after their parents
        h = hashlib.blake2b(f"{x.tag}|{' '.join(sorted(x.names))}".encode(), digest_size=8)
        for k in x.kids:
            if type(k) is Node:
                h.update(b"\1" + k.hash.to_bytes(8, "little"))
                x.inner |= k.inner or k.tag in MAIN
            elif t := " ".join(k.split()):
                h.update(b"\2" + t.encode("utf-8", "surrogatepass"))
        x.hash = int.from_bytes(h.digest(), "little") >> 1
    return nodes


def may_recur(x: Node, inside: bool) -> bool:
    """Elements outside the article that don't hold it, and containers within it. Inline elements alone aren't counted."""
    return bool(x.tag and not x.inner and x.tag not in INLINE and x.tag not in VOID and (x.tag in CONTAINERS if inside else x.tag not in MAIN and x.tag not in ("html", "body", "head")))


def countable(root: Node) -> set[int]:
    """Hashes of the subtrees of a page that may be template."""
    return {x.hash for x, inside in hash_subtrees(root) if may_recur(x, inside)}


def articles(root: Node) -> list[Node]:
    """The outermost articles in page order, without those that furniture holds or that are furniture (a comment's)."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.tag not in WHOLE_PAGE and (x.tag in FURNITURE or x.named):
            continue
        if x.tag in MAIN:
            out.append(x)
        else:
            todo.extend(k for k in reversed(x.kids) if type(k) is Node)
    return out


def text_of(root: Node, template: frozenset[int] | set[int]) -> str:
    """The text of the articles, else of the whole page, without furniture and template subtrees."""
    top = articles(root) or [root]
    out: list[str] = []
    for m in top:
        todo: list = [m]
        while todo:
            x = todo.pop()
            if type(x) is str:
                out.append(x)
            elif x is m or not (x.furniture(m is not root) or x.hash in template):
                if x.tag not in INLINE:
                    out.append(" ")
                    todo.append(" ")
                todo.extend(reversed(x.kids))
    return " ".join("".join(out).split())


def outline(root: Node) -> list[list[int]]:
    """The countable subtrees of a page's text, after 0 for the page: hash, place of the one around it, characters of its
    text outside those within it, length and hash of its longest run of such text. Wants hash_subtrees first."""
    out, run, at = [[0, -1, 0, 0, 0]], [], 0

    def end_run() -> None:
        if t := " ".join("".join(run).split()):
            o = out[at]
            o[2] += len(t)
            if len(t) > o[3]:
                o[3:] = len(t), int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1
        run.clear()

    for m in articles(root) or [root]:
        todo: list = [m]
        while todo:
            x = todo.pop()
            if type(x) is str:
                run.append(x)
            elif type(x) is int:  # an element's end: the subtree around it goes on
                end_run()
                at = x
            elif x is m or not x.furniture(m is not root):
                if x.tag not in INLINE:
                    end_run()
                    todo.append(at)
                    if x is not m and may_recur(x, m is not root):
                        out.append([x.hash, at, 0, 0, 0])
                        at = len(out) - 1
                todo.extend(reversed(x.kids))
        end_run()
    return out


def content_of(nodes: list[list[int]], often: set[int]) -> tuple[int, set[int]]:
    """What the content of a page is known by, and the subtrees with most of its text. ``often``: the page's subtrees that recur on its host."""
    sizes = [n[2] for n in nodes]
    for k in range(len(nodes) - 1, 0, -1):  # children come after their parents
        sizes[nodes[k][1]] += sizes[k]
    under = [False] * len(nodes)
    own, longest, copied = 0, (0, 0), (0, 0)
    for k, (h, up, n, size, run) in enumerate(nodes):
        above = k > 0 and under[up]
        under[k] = above or h in often
        if not under[k]:
            own += n
            longest = max(longest, (size, run))
        elif not above:
            copied = max(copied, (sizes[k], h))
    most = {n[0] for n, size in zip(nodes[1:], sizes[1:], strict=True) if size and size >= MOST_TEXT * sizes[0]}
    return (longest if own >= LEAST_OWN * sizes[0] else copied)[1], most


def host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


NODES = "array<array<long>>"


def page_subtrees(pages: DataFrame) -> DataFrame:
    """host, key, subtrees (distinct countable hashes) and nodes (outline) of each page. ``pages``: host, key, html."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets, nodes = [], []
            for h in b.column(2).to_pylist():
                root = parse(h or "")
                sets.append(sorted(countable(root)))
                nodes.append(outline(root))
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64))).astype(np.int32)
            flat = pa.array([x for s in sets for x in s], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(nodes, pa.list_(pa.list_(pa.int64())))],
                                             ["host", "key", "subtrees", "nodes"])

    return pages.select("host", "key", "html").mapInArrow(run, f"host string, key long, subtrees array<long>, nodes {NODES}")


def recurring(each: DataFrame, number, least: int) -> DataFrame:
    """The rows of ``each`` (host, key, subtree) whose subtree reaches ``number`` on its host, as one array for each page."""
    often = each.groupBy("host", "subtree").agg(number.alias("n")).where(F.col("n") >= least).select("host", "subtree")
    return each.join(often, ["host", "subtree"]).groupBy("host", "key").agg(F.collect_list("subtree").alias("template"))


def page_contents(subtrees: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, key, content and subtrees (on many pages of the host, without those that hold most of the text) of each page with such subtrees."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            contents, left = [], []
            for nodes, often in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                content, most = content_of(nodes, set(often))
                contents.append(content)
                left.append([x for x in often if x not in most])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(contents, pa.int64()), pa.array(left, pa.list_(pa.int64()))], ["host", "key", "content", "subtrees"])

    pages = subtrees.dropDuplicates(["host", "key"])  # a page that stands in several rows counts once
    often = recurring(pages.select("host", "key", F.explode("subtrees").alias("subtree")), F.count("*"), least_pages)
    known = pages.select("host", "key", "nodes").join(often, ["host", "key"])
    return known.mapInArrow(run, "host string, key long, content long, subtrees array<long>")


def template_subtrees(contents: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, key (of a page) and template: its subtrees that recur on its host with differing contents."""
    each = contents.select("host", "key", "content", F.explode("subtrees").alias("subtree"))
    return recurring(each, F.count_distinct("content"), least_pages)


def packed(pages: DataFrame) -> DataFrame:
    """The html compressed, for the one shuffle that moves it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            html = [zlib.compress((h or "").encode("utf-8", "surrogatepass"), 3) for h in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(html, pa.binary())], ["page_id", "url", "host", "key", "html"])

    return pages.select("page_id", "url", "host", "key", "html").mapInArrow(run, "page_id long, url string, host string, key long, html binary")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``. The html is shuffled once, compressed, by host and the hash of the page."""
    spark = pages.sparkSession
    own = own_columns(pages, "page_id", "url", "html")
    own = own.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    keyed = own.withColumn("host", host(F.col("url"))).withColumn("key", F.xxhash64("url", "html"))
    scratch = Scratch(spark, "op6")
    contents = scratch.table(page_contents(scratch.table(page_subtrees(keyed), "subtrees"), least_pages), "contents")
    scratch.drop("subtrees")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = []
            for h, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                root = parse(zlib.decompress(h).decode("utf-8", "surrogatepass"))
                if t:
                    hash_subtrees(root)
                texts.append(text_of(root, set(t or ())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    known = packed(keyed).join(template_subtrees(contents, least_pages), ["host", "key"], "left")
    return known.select("page_id", "url", "html", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")
