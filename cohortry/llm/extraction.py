"""Main text of web pages by container paths that the pages of a host agree on.

Each page is parsed once for its containers: elements that hold text, named by the generalised tag-class path from the body down
(ids, and digits and case of classes left out). Lists, tables, quotes and figures belong to the container around them. What stands in
an article or main element is one text, a frame, whatever containers it is in; so is what stands in a child of the body, and what stands in
the body itself. A frame's score is the text of the blocks in it, less text in links, and weighed by its names. A page gives each of its
frames' paths a vote in proportion to its share of the score. Spark adds the votes by host and path. The path with most votes wins; of
the others, those are voted out that have the same text on most of the host's pages that have them (three different pages at least), as
strips around articles do. A second pass takes the text of all frames on paths that are not voted out: where there is an article or
main, of these, of frames on the winning path, and of a first heading before them if they have none; else of all with some text outside links.

The text of a page is a line per block (paragraph, heading, list item, cell, ...): character references decoded, white space made
one space, trimmed, empty blocks left out. Menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles
and reader comments are left out wherever they stand, by element, role or a class name or id with a word for them; names like
with-sidebar don't count, nor does a name on what holds a first heading, article or main and most of the page's text. Scripts, styles and
text areas without an end tag go on to the end of the page, as in browsers; the tags of other embedded elements without one are passed
over, and their text stays. Null html is empty and gives an empty text; a null url belongs to the host
without name. Rows that repeat an id are pages of their own. An empty table gives no rows. Other columns play no part. Pages of any
size are read in one pass, or in two if a wrapper is named like what is left out; time and memory follow their length and tags.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.tables import slots_of, spread, stage

# Element names of HTML by their kind
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea".split())
#: Left out with all they hold, if they have an end tag; of SELF_CLOSING a slash is one.
SKIPPED = frozenset("title noscript template iframe svg math object select button canvas audio video".split())
SELF_CLOSING = frozenset("svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike "
                   "strong sub sup time tt u var wbr br img".split())
LEFT_OUT = frozenset("nav aside footer form dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a text that aren't containers of their own.
PARTS = frozenset("ul ol dl table caption thead tbody tfoot colgroup blockquote figure figcaption pre address details summary hgroup".split())
#: What holds the page, and what holds the whole of an article.
OUTER, WHOLE = frozenset(("", "html", "body")), frozenset(("article", "main"))
#: Parts of class and id names of what isn't the article.
BOILERPLATE = frozenset("""ad ads advert advertisement advertising banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies
disqus disclaimer footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay
pagination pager popup promo promoted promotion related reply replies respond share sharing sidebar signup skip skyscraper social sponsor
sponsored subscribe subscription syndication toc toolbar tooltip topbar widget widgets""".split())
#: Words in a class name that tell something about what is or isn't around.
MODIFIERS = frozenset("with without no not non has have hide hides hidden show shows is enable enabled disable disabled".split())
#: Words of what readers write, which may be longer than the article.
READERS = frozenset("captcha comment comments disqus reply replies respond".split())
#: Attributes that tell something about an element.
TELLING = frozenset("class id role hidden".split())
#: Names that speak for a container.
ARTICLE = frozenset("article main content body post entry story text blog page hentry".split())

#: A tag ends before the next one begins, but for what is quoted in it.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*)([^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*)>|<[!?][^<>]*>", re.S)
_CUT = re.compile(r"</?[a-zA-Z!?][^<]*\Z")
_ENDS = {tag: re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I) for tag in RAW}
#: Every attribute in turn, so that nothing in a value passes for one.
_ATTRIBUTE = re.compile(r"([^\s/][^\s/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
#: Different pages of a host that must have a path before it can be voted out.
REPEATED = 3
_WORD = re.compile(r"[a-z]+")
_SKIPPED = re.compile(rf"<(?:{'|'.join(sorted(SKIPPED))})[\s/>]", re.I)
#: Elements whose end closes what is open in them.
_FIRM = frozenset("html body main article section div header footer nav aside form ul ol table".split())
#: Elements that an opening tag of the same kind closes.
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}}
_PARAGRAPH = {"p"}
_HOLDS = {"li": {"ul", "ol", "menu"}, "p": {"div", "article", "section", "main", "body", "td", "li", "blockquote"}, "dt": {"dl"}, "dd": {"dl"},
          "tr": {"table", "tbody"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}


class Element:
    """An open or closed element. ``path``: its number in the page's paths; ``holder``: the container its text counts for; ``frame``: the
    element whose text is one with it; ``words``: of its class and id; ``inside``: in an article or main, by element or name."""

    __slots__ = ("tag", "path", "words", "inside", "out", "named", "linked", "holder", "frame", "own")

    def __init__(self, tag: str, path: int, words: list[str], parent: Element | None, out: bool, linked: bool, holder: Element | None):
        self.tag, self.path, self.words, self.out, self.linked = tag, path, words, out, linked
        #: number of the element around that is left out for its name alone
        self.named = parent.named if parent else None
        self.inside = bool(parent and parent.inside) or any(w in name for w in WHOLE for name in (tag, *words))
        self.holder = holder or self
        around = parent.frame if parent else self
        # the outermost article or main, or else the container right in the body
        first = holder is None and (parent is None or tag in OUTER or parent.tag in OUTER)
        self.frame = self if first or tag in WHOLE and around.tag not in WHOLE else around
        self.own = 0.0


class Paths:
    """The paths of a page by number: each is another one with a name after it, so that deep pages stay small."""

    def __init__(self):
        self.parent, self.name = [-1], [""]
        self.known: dict[tuple[int, str], int] = {}

    def under(self, parent: int, name: str) -> int:
        number = self.known.get((parent, name))
        if number is None:
            number = self.known[parent, name] = len(self.name)
            self.parent.append(parent)
            self.name.append(name)
        return number

    def text(self, number: int) -> str:
        names = []
        while number > 0:
            names.append(self.name[number])
            number = self.parent[number]
        return "/".join(reversed(names))


@dataclass
class Page:
    """``frames``: of each block; ``titles``: whether it is in a first heading. ``named``: for elements left out for their names alone, by
    number: length of text in them alone, whether an article begins there, and the number of the one around."""

    blocks: list[str]
    frames: list[Element]
    titles: list[bool]
    containers: list[Element]
    named: dict[int, list]
    paths: Paths

    def scores(self) -> dict[Element, float]:
        """Every frame with text outside links, in page order, and its score."""
        out: dict[Element, float] = {}
        for e in self.containers:
            if e.own > 0:
                named = e.frame.tag in ARTICLE or not ARTICLE.isdisjoint(e.frame.words)
                out[e.frame] = out.get(e.frame, 0.0) + e.own * (2.0 if named else 1.0)
        return out


def boilerplate(name: list[str]) -> bool:
    """Whether the words of one class name or id tell that the element isn't the article; with-sidebar and no-share don't."""
    return not BOILERPLATE.isdisjoint(name) and MODIFIERS.isdisjoint(name)


def describe(tag: str, attributes: str, parent: Element, paths: Paths) -> tuple[int, list[str], bool, bool]:
    """The path of an element, the words of its class and id, whether it is left out, and whether it is for its names alone."""
    words: list[str] = []
    classes: set[str] = set()
    named = False
    role = ""
    if attributes and not attributes.isspace():
        for name, *values in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name not in TELLING:
                continue
            value = "".join(values).lower()
            if name == "role":
                role = value
            elif name == "hidden":
                return parent.path, words, True, False
            else:
                found = [_WORD.findall(v) for v in value.split()]
                named = named or any(map(boilerplate, found))
                words += [w for f in found for w in f]
                if name == "class":
                    classes.update(w for f in found for w in f)
    out = tag in LEFT_OUT or role in ROLES or tag == "header" and not parent.inside
    if tag in ("body", "article", "main"):  # what holds the page isn't left out for a word like page-header
        out, named = tag == "article" and "comment" in words, False
    name = ".".join([tag, *sorted(classes)])
    return paths.under(parent.path, name), words, out or named, named and not out


def skips(page: str) -> dict[int, int]:
    """Where elements of SKIPPED that have an end tag of their own begin and end; what is open around them closes them."""
    ends: dict[int, int] = {}
    if not _SKIPPED.search(page):
        return ends
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() < at or m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW and not m[1]:
            at = raw_end(page, tag, m.end())
        elif tag not in SKIPPED and tag not in _FIRM:
            continue
        elif not m[1]:
            if tag in SELF_CLOSING and m[3].endswith("/"):
                ends[m.start()] = m.end()
            else:
                stack.append((tag, m.start()))
                opened[tag] += 1
        elif opened[tag] > 0:
            last = ""
            while last != tag:
                last, start = stack.pop()
                opened[last] -= 1
            if tag in SKIPPED:
                ends[start] = m.end()
    return ends


def raw_end(page: str, tag: str, at: int) -> int:
    stop = _ENDS[tag].search(page, at)
    return stop.end() if stop else len(page)


def parse(page: str) -> Page:
    """Blocks of a page in their order and its containers; what is left out is in neither.

    Elements that are left out for their names alone but hold an article and most of the page's text are kept."""
    ends = skips(page)
    got = _parse(page, ends, set())
    if not got.named:
        return got
    # what stands in one of them stands in those around it, too; they begin earlier
    total = {n: [length, holds] for n, (length, holds, _) in got.named.items()}
    for n in sorted(total, reverse=True):
        around = got.named[n][2]
        if around is not None:
            total[around][0] += total[n][0]
            total[around][1] |= total[n][1]
    whole = sum(map(len, got.blocks)) + sum(total[n][0] for n, (_, _, around) in got.named.items() if around is None)
    spared = {n for n, (length, holds) in total.items() if holds and 2 * length > whole}
    return _parse(page, ends, spared) if spared else got


def _parse(page: str, ends: dict[int, int], spared: set[int]) -> Page:
    paths = Paths()
    root = Element("", 0, [], None, False, False, None)
    stack, found, blocks, frames, titles = [root], [root], [], [], []
    opened: Counter[str] = Counter()
    named: dict[int, list] = {}
    parts: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = "".join(parts)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            top = stack[-1]
            if text and not top.out:
                top.holder.own += max(0, len(text) - 2 * links)
                blocks.append(text)
                frames.append(top.holder.frame)
                titles.append(opened["h1"] > 0)
            elif text and top.named is not None:
                named[top.named][0] += max(0, len(text) - 2 * links)
            parts.clear()
            links = 0

    def close(upto: int) -> None:
        for e in stack[upto:]:
            opened[e.tag] -= 1
        del stack[upto:]

    at = 0
    for m in _TOKEN.finditer(page):
        start = m.start()
        if start < at:
            continue
        if start > at:
            parts.append(page[at:start])
            if stack[-1].linked:
                links += start - at
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if m[1]:
            if opened[tag] > 0:
                level = len(stack) - 1
                while stack[level].tag != tag:
                    level -= 1
                if not inline or any(e.tag not in INLINE or e.out != stack[level - 1].out for e in stack[level:]):
                    flush()
                close(level)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in RAW:
            at = raw_end(page, tag, at)
            continue
        if tag in SKIPPED:
            at = ends.get(start, at)
            continue
        parent = stack[-1]
        if inline:
            path, words = parent.path, []
            out, by_name = describe(tag, m[3], parent, paths)[2:] if m[3] else (False, False)
            if start in spared:
                out = False
            if out and not parent.out:
                flush()
        else:
            flush()
            closes = _CLOSES.get(tag, _PARAGRAPH)
            if any(opened[c] > 0 for c in closes):
                holds = _HOLDS.get(tag, _HOLDS["p"])
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in closes:
                        close(i)
                        break
                    if stack[i].tag in holds:
                        break
                parent = stack[-1]
            path, words, out, by_name = describe(tag, m[3], parent, paths)
            if start in spared:
                out = False
        container = not (inline or tag in _HOLDS or tag in HEADINGS or tag in PARTS)
        element = Element(tag, path, words, parent, parent.out or out, parent.linked or tag == "a", None if container else parent.holder)
        if out and by_name and (not parent.out or parent.named is not None) and READERS.isdisjoint(words):
            element.named, named[start] = start, [0, False, parent.named]
        elif out:
            element.named = None
        if tag in ("h1", *WHOLE) and element.named is not None:
            named[element.named][1] = True
        stack.append(element)
        opened[tag] += 1
        if container and not element.out:
            found.append(element)
    rest = page[at:]
    cut = _CUT.search(rest)
    parts.append(rest[: cut.start()] if cut else rest)
    flush()
    return Page(blocks, frames, titles, found, named, paths)


def best(page: Page) -> tuple[str, float]:
    """Path of the frames with the best score, and its share of all; of equal ones the first by path."""
    total = shares(page)
    path = min(total, key=lambda p: (-total[p][0], p), default="")
    return path, total[path][0] if total else 0.0


def shares(page: Page) -> dict[str, tuple[float, str]]:
    """For the path of every frame with a score: its share of all scores, and its text."""
    scores = page.scores()
    whole = sum(scores.values())
    paths = {frame: page.paths.text(frame.path) for frame in scores}
    texts: dict[str, list[str]] = {}
    for block, frame in zip(page.blocks, page.frames, strict=True):
        if frame in paths:
            texts.setdefault(paths[frame], []).append(block)
    share: dict[str, float] = {}
    for frame, score in scores.items():
        share[paths[frame]] = share.get(paths[frame], 0.0) + score / whole
    return {p: (x, "\n".join(texts.get(p, []))) for p, x in share.items()}


def main_text(page: Page, winner: str | None = None, out: frozenset[str] = frozenset()) -> str:
    """The blocks of the frames that belong to the article, in page order."""
    paths = {frame: page.paths.text(frame.path) for frame in page.scores()}
    kept = {frame for frame, path in paths.items() if path not in out or path == winner} or set(paths)
    if not kept:
        return "\n".join(page.blocks)
    whole = {frame for frame in kept if frame.tag in WHOLE}
    if whole:
        kept = whole | {frame for frame in kept if paths[frame] == winner}
    at = [i for i, frame in enumerate(page.frames) if frame in kept]
    if whole and not any(page.titles[i] for i in at):
        at = [i for i in range(at[0] if at else 0) if page.titles[i]] + at
    return "\n".join(page.blocks[i] for i in at)


def extract_page(html: str, path: str | None = None, out: frozenset[str] = frozenset()) -> str:
    """Main text of a page; ``path`` and ``out`` are what its host's pages voted for and voted out."""
    return main_text(parse(html), path, out)


def with_host(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    url = F.col(url_col).cast("string")
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"),
                        slots_of(F.col(id_col), F.col(url_col)).alias("slot"))


def host_paths(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """What the pages of each host agree on: ``(host, path, votes, pages, out, slots)``. ``path`` has won, those of ``out`` are voted out;
    ``slots`` has a bit for each place with pages of the host. Pages of equal html vote once for what is voted out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, slot, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = hash64(html or "")
                found = shares(parse(html or "")) or {"": (0.0, "")}
                rows += [(host, slot, page, path, hash64(text), round(share * 1e6)) for path, (share, text) in found.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                                             ["host", "slot", "page", "path", "text", "vote"])

    schema = "host string, slot int, page long, path string, text long, vote long"
    votes = with_host(pages, id_col, url_col, html_col).select("host", "slot", "html").mapInArrow(run, schema)
    slots = F.expr("bit_or(shiftleft(1L, slot))").alias("slots")
    by_page = votes.groupBy("host", "path", "text", "page").agg(F.sum("vote").alias("votes"), F.count("*").alias("n"), slots)
    by_text = by_page.groupBy("host", "path", "text").agg(F.sum("votes").alias("votes"), F.sum("n").alias("n"), F.count("*").alias("pages"), F.bit_or("slots").alias("slots"))
    by_path = by_text.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("n").alias("n"), F.sum("pages").alias("pages"), F.max("pages").alias("alike"),
                                                  F.bit_or("slots").alias("slots"))
    repeated = (F.col("pages") >= REPEATED) & (2 * F.col("alike") > F.col("pages"))
    won = by_path.groupBy("host").agg(F.max(F.struct("votes", "path", "n")).alias("top"), F.collect_list(F.when(repeated, F.col("path"))).alias("out"),
                                      F.bit_or("slots").alias("slots"))
    return won.select("host", "top.path", "top.votes", F.col("top.n").alias("pages"), F.array_sort(F.array_except("out", F.array("top.path"))).alias("out"), "slots")


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars, host, path (the winning path of the host)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_page(p or "", path, frozenset(out)) for p, path, out in zip(*(batch.column(c).to_pylist() for c in (2, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                                              batch.column(3), batch.column(4)], ["page_id", "url", "text", "n_chars", "host", "path"])

    winners = stage(host_paths(pages, id_col, url_col, html_col), "paths")
    rows = with_host(pages, id_col, url_col, html_col).join(spread(winners.drop("votes", "pages"), "slots", "slot"), ["host", "slot"])
    found = rows.select("page_id", "url", "html", "host", "path", "out").mapInArrow(
        run, "page_id long, url string, text string, n_chars long, host string, path string")
    return found.withColumnRenamed("page_id", id_col).withColumnRenamed("url", url_col)
