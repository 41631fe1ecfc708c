"""Main text of web pages by wrappers inferred as union-free regular expressions.

Every page of a host is read as a stream of block tags and texts. Runs of alike groups are folded into repeated groups;
the streams are then aligned one after the other with the wrapper so far: equal texts stay fixed, unequal ones become
slots, and groups that only some pages have become optional. Each task aligns the pages it reads and the tasks' wrappers
of a host are aligned in two rounds, so no page is left out. A text is template if every page that has its place agrees
and at least two different pages do, whatever its share of the page.

The host's content place follows from what fills the slots. Parts whose text is mostly links, and parts that hold less
than a tenth of what the largest holds, don't decide; the innermost container of the others is the place. Beside it,
under the same element, headings that vary from page to page belong to it too, and prose between them and the place.
Each page is then matched
against its host's wrapper and its text is what fills the slots (and what the wrapper doesn't know) there. Parts that say
that they are menus, headers, footers, sidebars, notices, adverts, forms or comments are left out, and decide nothing
about the place unless all text lies in such parts.

Two articles on one template and two copies of one article can't be told apart by few pages. Where pages differ in less
than SLOT_CHARS characters each, or a host has fewer than FEW different pages that agree on more than they differ in, they
are taken for copies: what they share is not template, and an article narrows the place.

Nulls: a null html counts as empty and has an empty text. A null url has the empty host. Markup may be cut off or
nested wrongly: whatever is open at the end is closed there; elements nested more than DEPTH deep are one place with the
last of that depth. Repeated pages get equal texts and weigh as often as they come. A host with one page has a wrapper
without slots and its content place is where that page's text is. Very long pages are read whole. Columns of the input
named text, n_chars or wrapper are replaced or left out.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayspan.llm.common import Scratch
from wayspan.llm.url_rules import url_parts
from wayspan.session import ship

#: Bytes of wrappers up to which they are broadcast; beyond, those of a host are dealt out in SALTS parts.
BROADCAST_BYTES, SALTS = 8_000_000, 16
DEPTH = 150
#: Different pages from which on what they agree on is template; characters a page that must differ.
FEW, SLOT_CHARS = 5, 30
#: A part decides the place if it holds at least the largest one's share of one in so many.
TENTH = 10
#: Characters from which on a text between a heading and the place is prose.
PROSE = 60
#: Wrappers of a host are merged in so many parts first.
MERGE_PARTS = 64
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
LEAVES = frozenset("p li td th tr dd dt h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
#: Hosts whose wrappers a task holds before it passes them on.
OPEN_HOSTS = 500
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|template|noscript|svg|iframe|object|math)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("head title nav header footer aside form menu button select textarea dialog".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside "
    "cookie cookies consent notice notification alert popup modal newsletter subscribe signup login search form share sharing social related recommended comment comments disqus reply replies respond widget pagination pager toolbar".split()
)
#: Tags whose opening closes an open one of the same kind.
SELF_CLOSE = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Text(str):
    """A run of text that knows how many of its characters are a link's."""

    linked = 0

    def __add__(self, other: str) -> Text:
        out = Text(str.__add__(self, other))
        out.linked = self.linked + getattr(other, "linked", 0)
        return out


class Node:
    __slots__ = ("cls", "kids", "marked", "tag")

    def __init__(self, tag: str, cls: str = ""):
        self.tag, self.cls, self.kids, self.marked = tag, cls, [], tag in ("article", "main")

    @property
    def name(self) -> str:
        cls = re.sub(r"\d+", "#", self.cls)  # numbered ids are one place
        return f"{self.tag}.{cls}" if cls else self.tag

    def left_out(self) -> bool:
        if self.tag in LEFT_OUT:
            return self.tag != "header" or not self.marked
        named = self.tag not in ("html", "body", "article", "main") and not NAMES.isdisjoint(re.split(r"[^a-z0-9]+", self.cls.lower()))
        return named and not self.marked  # a wrapper around the article isn't a part beside it


def parse(page: str) -> Node:
    """The page as a tree of block elements; inline tags vanish, a break is a space between texts."""
    root = Node("")
    stack, at, link = [root], 0, False

    def text(s: str) -> None:
        if s:
            s = Text(s)
            s.linked = len(s) if link else 0
            kids = stack[-1].kids
            if kids and isinstance(kids[-1], str):
                kids[-1] += s
            else:
                kids.append(s)

    def close(upto: int) -> None:
        while len(stack) > upto:
            n = stack.pop()
            stack[-1].marked |= n.marked

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if tag == "a":
            link = not m[2]
        if not tag or tag in INLINE:
            continue
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            stack[-1].kids.append(None)
            continue
        if tag in VOID:
            stack[-1].kids.append(None)
            continue
        shut = SELF_CLOSE.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        while len(stack) > 1 and stack[-1].tag in shut:
            close(len(stack) - 1)
        cls = " ".join(filter(None, (a or b or c for a, b, c in _NAMED.findall(m[4] or ""))))
        n = Node(tag, cls)
        if len(stack) > DEPTH:  # its text counts for the element of that depth, but for a part left out
            stack[-1].kids.append(None)
            n.kids = [] if n.left_out() else stack[-1].kids
        else:
            stack[-1].kids.append(n)
        stack.append(n)
    text(page[at:])
    close(1)
    return root


def clean(s: str) -> str:
    return " ".join(entities.unescape(s).split())


def texts(node: Node, path: tuple[str, ...] = (), left_out: bool = False) -> Iterator[tuple[tuple[str, ...], str, bool, bool]]:
    """(path of containers, text, whether mostly links, whether in a part to leave out) of each block of the page; its
    head has none."""
    for k in node.kids:
        if isinstance(k, str):
            if t := clean(k):
                yield path, t, 2 * getattr(k, "linked", 0) > len(k), left_out
        elif k is not None and k.tag not in ("head", "title"):
            yield from texts(k, (*path, k.name), left_out or k.left_out())


# Wrappers: a list of items ("tag", name), ("text", fixed, pages, times), ("slot",), ("rep", items) and ("opt", items); of
# the pages that have a fixed text, the two least hashes are kept.


def stream(node: Node, page: int = 0) -> list[tuple]:
    out: list[tuple] = []
    for k in node.kids:
        if isinstance(k, str):
            if t := clean(k):
                out.append(("text", t, (page,), 1))
        elif k is not None:
            out += [("tag", k.name), *fold(stream(k, page)), ("tag", "/" + k.name)]
    return fold(out)


def units(items: list[tuple]) -> list[list[tuple]]:
    """Split into whole elements and single texts."""
    out, depth = [], 0
    for i in items:
        if depth == 0:
            out.append([])
        out[-1].append(i)
        if i[0] == "tag":
            depth += -1 if i[1].startswith("/") else 1
    return out


def fold(items: list[tuple]) -> list[tuple]:
    """Neighbouring elements of one name become one repeated group that fits them all."""
    out: list[tuple] = []
    for u in units(items):
        if out and out[-1][0] == "rep" and u[0][0] == "tag" and out[-1][1][0] == u[0]:
            out[-1] = ("rep", align(out[-1][1], u))
        elif u[0][0] == "tag":
            out.append(("rep", u))
        else:
            out += u
    return out


def symbol(u: list[tuple]) -> tuple:
    first = u[0]
    if first[0] == "rep":
        return ("tag", first[1][0][1])
    return ("slot",) if first[0] in ("text", "slot") else ("opt",) if first[0] == "opt" else first


def align(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """The least common wrapper of two item lists: matched in order, the rest optional."""
    ua, ub = units(a), units(b)
    ua = [x for u in ua for x in ([[i] for i in u] if u[0][0] == "tag" and len(u) > 1 else [u])]
    ub = [x for u in ub for x in ([[i] for i in u] if u[0][0] == "tag" and len(u) > 1 else [u])]
    ka = [symbol(u if u[0][0] != "opt" else u[0][1]) for u in ua]
    kb = [symbol(u if u[0][0] != "opt" else u[0][1]) for u in ub]
    out: list[tuple] = []
    i = j = 0
    optional = lambda u: u[0] if u[0][0] == "opt" else ("opt", u)
    for x, y in [*common(ka, kb), (len(ua), len(ub))]:
        out += [optional(u) for u in (*ua[i:x], *ub[j:y])]
        if x < len(ua):
            out.append(merge(ua[x][0], ub[y][0]))
        i, j = x + 1, y + 1
    return out


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, whatever the lengths: a bit per cell, a whole row a step."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    where: dict = {}
    for i, k in enumerate(a):
        where[k] = where.get(k, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, rows = full, []
    for k in b:
        u = v & where.get(k, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out = []
    i, j = len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if not j or rows[j - 1] >> (i - 1) & 1:
                i -= 1
                out.append((i, j))
    return out[::-1]


def merge(x: tuple, y: tuple) -> tuple:
    if x[0] == "opt" or y[0] == "opt":
        p, q = (v[1][0] if v[0] == "opt" else v for v in (x, y))
        return ("opt", [merge(p, q)])
    if x[0] == "rep" or y[0] == "rep":
        p, q = (v[1] if v[0] == "rep" else [v] for v in (x, y))
        return ("rep", align(p, q))
    if x[0] in ("text", "slot"):
        return ("text", x[1], tuple(sorted({*x[2], *y[2]})[:2]), x[3] + y[3]) if x[0] == y[0] == "text" and x[1] == y[1] else ("slot",)
    return x


def written(items: list[tuple]) -> str:
    """The wrapper as a regular expression over tags and texts."""
    how = {"tag": lambda i: f"<{i[1]}>", "text": lambda i: json.dumps(i[1], ensure_ascii=False), "slot": lambda i: "#TEXT", "rep": lambda i: f"({written(i[1])})+", "opt": lambda i: f"({written(i[1])})?"}
    return " ".join(how[i[0]](i) for i in items)


def fixed(items: list[tuple], path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str, int]]:
    """(path, text, how often) of the template: texts that two different pages agree on."""
    for i in items:
        if i[0] == "text" and len(i[2]) > 1:
            yield path, i[1], i[3]
        elif i[0] == "opt":
            yield from fixed(i[1], path)
        elif i[0] == "rep":
            yield from fixed(i[1][1:-1], (*path, i[1][0][1]))


class Host:
    """What is known of a host from the pages read so far: the wrapper, its pages' number and the least hashes of
    different ones, and by path [characters, those of links, those in parts to leave out, texts, pages]."""

    def __init__(self, items: list[tuple] | None = None, mass: dict | None = None, n: int = 0, pages: list[int] | None = None):
        self.items, self.mass, self.n, self.pages = items, mass or {}, n, pages or []

    def add(self, page: str) -> None:
        tree = parse(page)
        h = int.from_bytes(hashlib.blake2b(page.encode("utf-8", "surrogatepass"), digest_size=6).digest())
        mass: dict = {}
        for path, t, link, left_out in texts(tree):
            m = mass.setdefault(path, [0, 0, 0, 0, 1])
            m[0] += len(t)
            m[1] += len(t) * link
            m[2] += len(t) * left_out
            m[3] += 1
        self.join(Host(stream(tree, h), mass, 1, [h]))

    def join(self, other: Host) -> None:
        self.items = other.items if self.items is None else align(self.items, other.items)
        for path, m in other.mass.items():
            mine = self.mass.setdefault(path, [0] * 5)
            self.mass[path] = [a + b for a, b in zip(mine, m)]
        self.n += other.n
        self.pages = sorted({*self.pages, *other.pages})[:FEW]

    def dumps(self) -> str:
        return json.dumps([self.items, [[p, m] for p, m in self.mass.items()], self.n, self.pages])

    @classmethod
    def loads(cls, s: str) -> Host:
        items, mass, n, pages = json.loads(s)
        return cls(as_items(items), {tuple(p): m for p, m in mass}, n, pages)

    def wrapper(self) -> dict:
        const = list(fixed(self.items or []))
        left = {p: m[0] for p, m in self.mass.items()}
        for path, t, times in const:
            left[path] = left.get(path, 0) - len(t) * times
        slots = {p: v for p, v in left.items() if v > 0}
        total = sum(m[0] for m in self.mass.values())
        copies = sum(slots.values()) < SLOT_CHARS * self.n or (len(self.pages) < FEW and 2 * sum(slots.values()) < total)
        if copies:
            slots = {p: m[0] for p, m in self.mass.items() if m[0]}
        linked, left_out = (lambda p: 2 * self.mass[p][1] > self.mass[p][0]), (lambda p: 2 * self.mass[p][2] > self.mass[p][0])
        open_ = {p: v for p, v in slots.items() if not left_out(p)}
        wrapped = not open_  # all text lies in parts that say they are something else: then they don't
        open_ = open_ or slots
        prose = {p: v for p, v in open_.items() if not linked(p)} or open_
        most = max(prose.values(), default=0)
        place: tuple[str, ...] | None = None
        for p, v in prose.items():
            if TENTH * v < most:
                continue
            while p and (p[-1].split(".")[0] in LEAVES or (p in self.mass and self.mass[p][3] > 1.2 * self.mass[p][4])):
                p = p[:-1]  # one of several texts side by side
            place = p if place is None else place[: next((i for i, (a, b) in enumerate(zip(place, p)) if a != b), min(len(place), len(p)))]
        place = place or ()
        around, order = place[:-1], {p: i for i, p in enumerate(self.mass)}  # paths come in the order of a page
        near = [p for p in prose if around and p[: len(around)] == around and p[: len(place)] != place and not linked(p)]
        heads = [p for p in near if {c.split(".")[0] for c in p[len(around) :]} & HEADINGS]
        begin = min((order[p] for p in self.mass if p[: len(place)] == place), default=0)
        after = min((order[p] for p in heads), default=begin)
        beside = heads + [p for p in near if p not in heads and after < order[p] < begin and self.mass[p][0] >= PROSE * self.mass[p][3]]
        return {"items": self.items or [], "copies": copies, "fixed": [] if copies else sorted({t for _, t, _ in const}), "place": list(place), "beside": sorted(map(list, beside)), "wrapped": wrapped, "expression": written(self.items or [])}


def as_items(found: list) -> list[tuple]:
    return [(i[0], as_items(i[1])) if i[0] in ("rep", "opt") else (i[0], i[1], tuple(i[2]), i[3]) if i[0] == "text" else tuple(i) for i in found]


def infer(pages: list[str]) -> dict:
    """Wrapper of one host from its pages: its items and expression, fixed texts, and content place."""
    host = Host()
    for p in dict.fromkeys(pages):
        host.add(p)
    return host.wrapper()


def match(node: Node, items: list[tuple], path: tuple[str, ...] = (), inside: bool = False, left_out: bool = False) -> Iterator[tuple[tuple[str, ...], str, bool, bool]]:
    """(path, text, whether in an article, whether in a part to leave out) of what fills the wrapper's slots or isn't in it."""
    runs: list[list] = []
    for k in node.kids:
        if isinstance(k, str):
            if t := clean(k):
                runs.append([("slot",), t])
        elif k is not None:
            if runs and runs[-1][0] == ("tag", k.name):
                runs[-1].append(k)
            else:
                runs.append([("tag", k.name), k])
    bare = [i[1][0] if i[0] == "opt" else i for i in items]
    met = dict(common([r[0] for r in runs], [symbol([i]) for i in bare]))
    for n, (_, *found) in enumerate(runs):
        i = bare[met[n]] if n in met else None
        for k in found:
            if isinstance(k, str):
                if not (i and i[0] == "text" and len(i[2]) > 1 and i[1] == k):
                    yield path, k, inside, left_out
            elif k.tag not in ("head", "title"):
                yield from match(k, i[1][1:-1] if i else [], (*path, k.name), inside or k.tag in ("article", "main"), left_out or k.left_out())


def extract(page: str | None, wrapper: dict | None) -> str:
    """The main text of a page: what fills its host's wrapper in the content place and beside it, less the parts that say
    they are something else. Without a wrapper it is all of the page's text."""
    tree = parse(page or "")
    if wrapper is None:
        return " ".join(t for _, t, _, _ in texts(tree))
    place, beside = tuple(wrapper["place"]), {tuple(p) for p in wrapper["beside"]}
    found = list(match(tree, [] if wrapper["copies"] else wrapper["items"]))
    kept = [x for x in found if x[0][: len(place)] == place or x[0] in beside] or found
    if not wrapper["wrapped"]:
        kept = [x for x in kept if not x[3]]
    if wrapper["copies"]:  # no slots decide
        kept = [x for x in kept if x[2]] or kept
    return " ".join(x[1] for x in kept)


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper as JSON) of every host, from all of its pages."""
    rows = pages.select(url_parts(F.col(url))[0].alias("host"), F.coalesce(html, F.lit("")).alias("html"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Host] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"host": list(known), "part": [h.dumps() for h in known.values()]}, dtype="object")
            known.clear()
            return out

        for b in batches:
            for host, page in zip(b["host"], b["html"]):
                known.setdefault(host, Host()).add(page)
            if len(known) > OPEN_HOSTS:
                yield flush()
        yield flush()

    def merged(b: pd.DataFrame) -> Host:
        host = Host()
        for p in sorted(b["part"]):
            host.join(Host.loads(p))
        return host

    def some(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": b["host"][:1], "part": [merged(b).dumps()]})

    def all_(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": b["host"][:1], "wrapper": [json.dumps(merged(b).wrapper())]})

    ship(pages.sparkSession)
    parts = rows.mapInPandas(part, "host string, part string")
    # A host that every task has seen is merged in parts first, so none of its groups grows with the number of tasks alone.
    parts = parts.groupBy("host", F.pmod(F.xxhash64("part"), F.lit(MERGE_PARTS)).alias("salt")).applyInPandas(some, "host string, part string")
    return parts.groupBy("host").applyInPandas(all_, "host string, wrapper string")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with text and n_chars; html is dropped."""
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars", "wrapper", "__host")]
    w = Scratch(pages.sparkSession, "wrappers").write(wrappers(pages, url, html).withColumnRenamed("host", "__host"), "wrappers")
    size = w.agg(F.sum(F.length("wrapper") + F.length("__host") + 64)).head()[0] or 0
    rows, on = pages.select(*keep, html, url_parts(F.col(url))[0].alias("__host")), ["__host"]
    if size <= BROADCAST_BYTES:
        w = F.broadcast(w)
    else:
        w, on = w.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["__host", "__salt"]
        rows = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, dict] = {}
        for pages_, found in batches:
            out = []
            for p, f in zip(pages_, found):
                if f is not None and f not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[f] = json.loads(f)
                    known[f]["items"] = as_items(known[f]["items"])
                out.append(extract(p, known.get(f)))
            yield pd.Series(out, dtype="object")

    ship(pages.sparkSession)
    j = rows.join(w, on, "left")
    return j.select(*keep, text(F.col(html), F.col("wrapper")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
