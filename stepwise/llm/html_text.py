"""Operator 3, main text of web pages by equivalence-class template deduction.

Tokens of a page are its tags, opening and closing, each with the path of containers around it (once
plain and once with its class, id and role names), and its text blocks. Over the different pages of a
host, tokens with one and the same occurrence vector (how often they occur on each page) form an
equivalence class; the vector is kept as a sum of hashes of (page, count), so it is counted without
listing pages. A class is frequent when it occurs on ``SUPPORT`` of the host's pages (and on
``LEAST_PAGES``), so an error page or a second layout takes nothing from the others, and large when it
has at least ``MIN_CLASS`` tokens, two of them tags (a text that some articles share has no tags of its
own and stays). A class is valid when on every
page its tokens repeat in one order, don't cross a class that weighs more and lie in one place of the class
around them. The valid classes, nested, are the host's template. Their texts are constant and go; what
lies between two neighbouring tokens of a class is a slot, and the article's slots give the text. The
elements and names around a slot are its labels: they say which slots are the article's.

Slots under menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments
(by element or by names in class, id and role) are left out. A name with a negation or a state in it
("no-sidebar", "comments-open") doesn't count, and no name takes out html, body, main or article or an
element around a main or article; only an article that is itself named a comment, advert or the like
stays out with the element around it, if the page has another main or article. With slots inside an ``article`` or ``main`` of
the template only those count, else those inside such an element of the page, if it has one. A template
needs a host with ``MIN_PAGES`` different pages; on smaller hosts the labels alone decide. Pages with less
than ``OWN`` of their words in texts of their own are near copies and don't count, so a host of near copies
has no template and keeps its texts; on a host with one the constant texts go from every page, short or long.

Null or empty html has the empty text. Pages equal to each other count once for the template. Pages
without a host share the empty host. The whole html is read and nothing is cut. Repeated rows are extracted each;
empty tables give empty results. Only page_id, url and html are read: further columns, whatever their names, neither
disturb nor return.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .url_filter import with_parts

MIN_PAGES = 8
MIN_CLASS = 3
#: a class is frequent on this share of a host's different pages, and on this many of them at least
SUPPORT, LEAST_PAGES = 0.25, 5
#: share of its words that a page has to itself, or else it is a near copy of others
OWN = 0.2
#: numbers before the tokens of a class where templates are kept as lists
HEAD = 4
#: hosts whose templates a task keeps at hand
REMEMBERED = 1_000
#: elements whose content is never text of the article
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg button select textarea head title dialog".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
#: parts of names in class, id and role that mark an element as no article text
NOISE = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|popup|modal|overlay|sidebar|side|menu\w*|nav\w*|"
                   r"breadcrumbs?|footer|masthead|comments?|replies|respond|disqus|share|sharing|social|related|recommend\w*|newsletter|"
                   r"subscribe|widget|complementary|contentinfo|search|pagination|pager", re.I)
#: parts that make a name say something about a page or a state, not what the element is
STATES = frozenset("no not non has with without is by js open opened closed close enabled disabled allowed off hidden visible active "
                   "results result layout".split())
PARTS = re.compile(r"[-_]+")
#: elements that a name never takes out, nor the elements around an article or main
KEPT = frozenset(("html", "body", "main", "article"))
#: attributes run to the first ">" outside quoted values; a quote that is never closed is a character like others
TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|$)|<[!?][^>]*(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
LABELS = frozenset(("class", "id", "role"))


class Element:
    """An open element: left out by its kind (``own``) or its names (``named``), or inside such a one."""

    __slots__ = ("name", "parent", "own", "named", "main", "path", "words")

    def __init__(self, name: str, parent: Element | None, own: bool, named: bool, main: bool, words: str) -> None:
        self.name, self.parent, self.own, self.named, self.main, self.words = name, parent, own, named, main, words
        self.path = f"{parent.path}/{name}" if parent else name

    def tokens(self, mark: str) -> list[str]:
        """Its tag as a token, and as another with its names."""
        return [mark + self.path, f"{mark}{self.path}.{self.words}"] if self.words else [mark + self.path]

    def dropped(self) -> bool:
        at: Element | None = self
        while at:
            if at.own or at.named:
                return True
            at = at.parent
        return False

    def keep_around(self) -> None:
        at = self.parent
        while at:
            at.named, at = False, at.parent


@dataclass
class Block:
    text: str
    main: bool
    dropped: bool
    path: str


@dataclass
class Page:
    """Text blocks in page order; the stream of tokens (token, element open after it, block or -1), every
    element closed; and whether a main part exists."""

    blocks: list[Block]
    stream: list[tuple[str, Element | None, int]]
    has_main: bool


def is_noise(words: str) -> bool:
    """Whether a name in class, id and role values says that the element holds no article text."""
    for name in words.lower().split():
        if name == "hidden":
            return True
        parts = PARTS.split(name)
        if any(map(NOISE.fullmatch, parts)) and STATES.isdisjoint(parts):
            return True
    return False


def parse(html: str) -> Page:
    found: list[tuple[str, Element | None]] = []
    mains: list[tuple[Element, bool]] = []
    stream: list[tuple[str, Element | None, int]] = []
    here: Element | None = None
    text: list[str] = []

    def flush() -> None:
        joined = " ".join(entities.unescape("".join(text)).split()) if text else ""
        text.clear()
        if joined:
            stream.append(("t" + (here.path if here else "") + ">" + joined, here, len(found)))
            found.append((joined, here))

    def close(to: Element | None) -> Element | None:
        """Closes the open elements inside ``to``."""
        at = here
        while at is not to:
            stream.extend((t, at.parent, -1) for t in at.tokens("/"))
            at = at.parent
        return to

    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        if m is None:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        closing, name, attributes = m.group(1), m.group(2), m.group(3)
        if name is None:
            continue
        name = name.lower()
        if name in VOID:
            if name not in INLINE:
                flush()
            continue
        words = " ".join(x or y or z for key, x, y, z in ATTRIBUTE.findall(attributes)
                         if key.lower() in LABELS) if "=" in attributes and not closing else ""
        noise = bool(words and is_noise(words))
        to = here
        while closing and to and to.name != name:
            to = to.parent
        if name in INLINE and not noise and not (closing and to):
            continue
        flush()
        if closing:
            if to:
                here = close(to.parent)
        else:
            if name in ("p", "li", "td", "tr", "th", "dt", "dd", "option") and here and here.name == name:
                here = close(here.parent)  # closed by the next of its kind
            if name == "p" or name.startswith("h") and name[1:].isdigit():
                while here and here.name == "p":
                    here = close(here.parent)
            inside = bool(here and here.main)
            here = Element(name, here, name in DROPPED or name == "header" and not inside, noise and name not in KEPT, name in MAIN or inside, words)
            stream.extend((t, here, -1) for t in here.tokens("<"))
            if name in MAIN:
                mains.append((here, noise))
                if not noise:
                    here.keep_around()
            if name in RAW:
                ends = re.compile(rf"</{name}\b", re.I).search(html, at)
                at = ends.start() if ends else end
    flush()
    close(None)
    if all(e.dropped() for e, _ in mains):
        for e, _ in mains:
            e.keep_around()
    blocks = [Block(t, bool(e and e.main), bool(e and e.dropped()), e.path if e else "") for t, e in found]
    return Page(blocks, stream, any(not e.dropped() for e, _ in mains))


def token_of(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) - (1 << 63)


def page_tokens(html: str) -> list[tuple[int, int]]:
    """The page's tokens in order with their weights: a text's words, 0 of a tag."""
    page = parse(html)
    return [(token_of(t), len(page.blocks[i].text.split()) if i >= 0 else 0) for t, _, i in page.stream if i < 0 or not page.blocks[i].dropped]


class Template:
    """A host's classes: token -> (class, rank in its order); class -> (last rank, pages that hold it)."""

    def __init__(self, flat: list[int] | frozenset = ()) -> None:
        self.rank: dict[int, tuple[int, int]] = {}
        self.last: dict[int, int] = {}
        self.weight: dict[int, tuple[int, int, int]] = {}
        numbers = list(flat)
        at = 0
        while at < len(numbers):  # class, pages, occurrences of a token, number of tokens, tokens
            name, pages, all_n, n = numbers[at : at + HEAD]
            self.rank |= {t: (name, i) for i, t in enumerate(numbers[at + HEAD : at + HEAD + n])}
            self.last[name], self.weight[name] = n - 1, (pages, -all_n, name)
            at += HEAD + n


def check_order(tokens: list[int], template: Template) -> list[tuple[int, int, bool]]:
    """(class, 0, whether its tokens repeat in its order) of the classes on a page."""
    now: dict[int, int] = {}
    wrong: set[int] = set()
    for name, rank in (template.rank[t] for t in tokens if t in template.rank):
        if rank != (now.get(name, template.last[name]) + 1) % (template.last[name] + 1):
            wrong.add(name)
        now[name] = rank
    return [(name, 0, name not in wrong and rank == template.last[name]) for name, rank in now.items()]


def check_nesting(tokens: list[int], template: Template) -> list[tuple[int, int, bool]]:
    """(class, its place in the class around it, whether nesting holds) of the ordered classes on a page. Of
    two classes that cross, the one of fewer pages, or else of more occurrences, is at fault; a class is
    placed among those that weigh more."""
    place: dict[int, int] = {}
    wrong: set[int] = set()
    stack: list[list[int]] = []  # class, rank
    for name, rank in (template.rank[t] for t in tokens if t in template.rank):
        if rank == 0:
            own = template.weight[name]
            around = next(((c, r) for c, r in reversed(stack) if template.weight[c] > own), (0, 0))
            where = xxhash.xxh64_intdigest(repr(around).encode()) - (1 << 63)
            if place.setdefault(name, where) != where:
                wrong.add(name)
            stack.append([name, 0])
        else:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), 0)
            wrong |= {min(c, name, key=template.weight.__getitem__) for c, _ in stack[at + 1 :]}
            stack[at][1] = rank
        if rank == template.last[name]:
            stack = [x for x in stack if x[0] != name]
    return [(name, where, name not in wrong) for name, where in place.items()]


def article_text(html: str, template: Template | frozenset) -> str:
    """The text of a page's article slots, without the host's constant texts."""
    page = parse(html)
    rank = template.rank if isinstance(template, Template) else {}
    slots: list[tuple[Block, bool]] = []  # blocks, and whether their slot lies in a main part
    open_slots: list[list] = []  # class, whether its present slot lies in a main part
    for token, element, i in page.stream if rank else ():
        if i >= 0 and page.blocks[i].dropped:
            continue
        known = rank.get(token_of(token))
        if known:
            name, at = known
            while at and open_slots and open_slots[-1][0] != name:
                open_slots.pop()
            if at == 0:
                open_slots.append([name, False])
            if open_slots:
                open_slots[-1][1] = bool(element and element.main and not element.dropped())
                if at == template.last[name]:
                    open_slots.pop()
        elif i >= 0:
            slots.append((page.blocks[i], bool(open_slots and open_slots[-1][1])))
    if not rank:
        slots = [(b, False) for b in page.blocks if not b.dropped]
    if any(main for _, main in slots):
        return " ".join(b.text for b, main in slots if main)
    return " ".join(b.text for b, _ in slots if b.main or not page.has_main)


def page_streams(pages: DataFrame) -> DataFrame:
    """(host, page, tokens, weights) of the different pages of each host that have any token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = [page_tokens(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), batch.column("page"), pa.array([[t for t, _ in x] for x in streams], pa.list_(pa.int64())),
                 pa.array([[w for _, w in x] for x in streams], pa.list_(pa.int32()))], names=["host", "page", "tokens", "weights"])

    rows = pages.select("host", F.xxhash64("html").alias("page"), "html").where("trim(html) != ''")
    streams = rows.mapInArrow(run, "host string, page long, tokens array<long>, weights array<int>").where(F.size("tokens") > 0)
    return streams.dropDuplicates(["host", "page"])


def without_near_copies(streams: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """The pages that count for a template: at least ``OWN`` of a page's words stand in texts that few pages
    of its host hold. Hosts with fewer than ``min_pages`` pages are left out."""
    sizes = streams.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    texts = F.filter(F.arrays_zip("tokens", "weights"), lambda x: x["weights"] > 0)
    held = streams.select("host", F.explode(F.array_distinct(texts)).alias("x")).groupBy("host", F.col("x.tokens").alias("token")).agg(
        F.count("*").alias("df")).where(F.col("df") >= LEAST_PAGES)
    common = held.join(sizes, "host").where(F.col("df") >= F.col("pages") * SUPPORT).groupBy("host").agg(F.collect_set("token").alias("common"))
    hosts = stored(sizes.join(common, "host", "left").select("host", F.coalesce("common", F.array().cast("array<bigint>")).alias("common")), "common")
    words = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["weights"])
    own = F.filter(texts, lambda x: ~F.array_contains("common", x["tokens"]))
    return streams.join(hosts, "host").where(words(own) >= OWN * words(texts)).select(*streams.columns)


def classes(streams: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, template): the frequent large classes of each host, order and nesting not yet checked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, page, tokens, weights in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own: dict[int, list[int]] = {}
                for place, (token, weight) in enumerate(zip(tokens, weights, strict=True)):
                    own.setdefault(token, [0, place, weight])[0] += 1
                rows += [(host, page, t, *v) for t, v in own.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["host", "page", "token", "n", "place", "weight"])

    sizes = streams.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    tokens = streams.select("host", "page", "tokens", "weights").mapInArrow(
        run, "host string, page long, token long, n long, place long, weight long")
    vectors = tokens.groupBy("host", "token").agg(
        F.count("*").alias("df"), F.sum(F.shiftright(F.xxhash64("page", "n"), 20)).alias("vector"), F.avg("place").alias("place"),
        F.max("weight").alias("weight"), F.sum("n").alias("all_n"))
    frequent = vectors.where(F.col("df") >= LEAST_PAGES).join(sizes, "host").where(F.col("df") >= F.col("pages") * SUPPORT)
    own = frequent.groupBy("host", "vector").agg(
        F.max("df").alias("df"), F.max("all_n").alias("all_n"), F.sum(F.when(F.col("weight") == 0, 1).otherwise(0)).alias("tags"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("tokens")).where(
        (F.col("tags") > 1) & (F.size("tokens") >= MIN_CLASS))
    flat = F.concat(F.array("vector", "df", "all_n", F.size("tokens").cast("long")), "tokens")
    return own.groupBy("host").agg(F.flatten(F.collect_list(flat)).alias("template"))


def that_hold(streams: DataFrame, found: DataFrame, check: Callable) -> DataFrame:
    """``found`` with the classes that pass a check, in one and the same place, on all pages of their host."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates()
        for batch in batches:
            rows: list[tuple] = []
            for i, (host, tokens) in enumerate(zip(batch.column("host").to_pylist(), batch.column("tokens").to_pylist(), strict=True)):
                rows += [(host, *x) for x in check(tokens, known.of(host, batch.column("template"), i))]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)],
                                             names=["host", "class", "place", "holds"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for flat, valid in zip(batch.column("template").to_pylist(), batch.column("valid").to_pylist(), strict=True):
                names, out, at = set(valid), [], 0
                while at < len(flat):
                    end = at + HEAD + flat[at + HEAD - 1]
                    out += flat[at:end] if flat[at] in names else []
                    at = end
                kept.append(out)
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(kept, pa.list_(pa.int64()))], names=["host", "template"])

    checked = streams.select("host", "tokens").join(found, "host").mapInArrow(run, "host string, class long, place long, holds boolean")
    valid = checked.groupBy("host", "class").agg(
        F.min("holds").alias("holds"), F.min("place").alias("lo"), F.max("place").alias("hi")).where(
        F.col("holds") & (F.col("lo") == F.col("hi"))).groupBy("host").agg(F.collect_set("class").alias("valid"))
    return found.join(valid, "host").mapInArrow(keep, "host string, template array<long>").where(F.size("template") > 0)


def host_templates(streams: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, template): the classes of each host whose order and nesting hold on all its pages."""
    streams = stored(without_near_copies(streams, min_pages), "counted-streams")
    found = stored(classes(streams, min_pages), "classes")
    ordered = stored(that_hold(streams, found, check_order), "ordered-classes")
    return that_hold(streams, ordered, check_nesting)


class Templates(dict):
    """The templates a task has read, by host."""

    def of(self, host: str | None, column: pa.Array, i: int) -> Template:
        if host not in self:
            if len(self) >= REMEMBERED:
                self.clear()
            self[host] = Template(column[i].as_py() or ())
        return self[host]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    rows = with_parts(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))).drop("path")
    # written first: the planner then knows its size, and the pages move only if it is too large to send
    templates = stored(host_templates(stored(page_streams(rows), "streams")), "templates")
    both = rows.join(templates, "host", "left").select("page_id", "url", "html", "host", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates()
        for batch in batches:
            column = batch.column("template")
            texts = [article_text(h, known.of(host, column, i)) for i, (h, host) in
                     enumerate(zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    kind = dict(both.dtypes)["page_id"]
    return both.mapInArrow(run, f"page_id {kind}, url string, text string")
