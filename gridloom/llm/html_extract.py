"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: start tags, told apart by their path, and blocks of text, told apart by path and words.

1. Pages are parsed once; of pages of a host with the same text one speaks for all.
2. Tokens that occur equally often in every page of a host (one occurrence vector) form an equivalence class, if enough pages hold it.
3. Of a class those tokens are valid that keep one order, and it nests where all of it lies in one slot of the host's main class, on
   nearly all pages that have it; text that wanders between other tokens is thus none of the template's. What is valid and nests makes the template.
4. The template's elements and texts leave slots. Text of pages' own, in no element that plays a role by its tag or name, tells which slots hold
   main text; a template's text outside articles goes where no slot near it holds text of pages' own, and what it lacks there stays.

Occurrence vectors are compared by an order-free hash that Spark adds up by token, and only what enough pages of a host hold is ever
gathered by host, so that a host with a third of all pages needs no task of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .tokens import text_of

#: Elements that end a block of text.
BLOCKS = frozenset(
    "html head body title address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr iframe label legend li main menu nav noscript ol optgroup option p pre "
    "script search section select style summary table tbody td template textarea tfoot th thead tr ul".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never main text.
ASIDE = frozenset("head nav aside footer form script style noscript menu button select option textarea iframe template dialog svg object canvas title search".split())
#: Elements that part a page; each has a place of its own among its like. Articles of one list stay together.
SECTIONS = frozenset("body div section aside header footer nav form center fieldset details figure".split())
#: Words that name a page's furniture in class, id or role.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promos nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars aside widget widgets footer foot header masthead topbar toolbar cookie cookies consent notice notices alert gdpr popup modal overlay "
    "newsletter subscribe signup login search form share sharing social related recommended teaser teasers comment comments commentlist reply replies respond disqus discussion "
    "pagination pager skip copyright legal disclaimer contentinfo complementary".split()
)
#: Words that say nothing of what an element holds; a name is furniture if its other words are among these.
NEUTRAL = frozenset(
    "site page main top bottom left right upper lower first last box block list item items wrapper wrap container section area bar panel inner outer holder "
    "row col column grid group link links post posts article articles button buttons btn icon icons primary secondary global local user users reader readers thread "
    "body content text title slot unit zone sticky fixed mobile desktop small large js id class module component region".split()
)
#: Of these, words that may also head a part of an article; inside one they name no furniture.
AMBIGUOUS = frozenset("discussion notice notices alert legal copyright disclaimer complementary related reply respond form search share social skip banner modal overlay form".split())
#: Elements whose text is drawn, chosen or run, and no part of the block around it; and what ends one that is not closed.
UNSEEN = frozenset("script style svg canvas object button select textarea".split())
ENDS_UNSEEN = BLOCKS - frozenset("title option optgroup label legend script style select textarea caption search menu".split())
#: A token is of the template where at least so large a part of the host's pages hold it, and its class where so many agree on its order.
SHARE = 0.5
AGREE = 0.9
#: On pages without article or main, an element holds the main text with so much of the host's own text.
HOLDS = 0.8
#: Templates of all hosts are sent to every task up to so many tokens.
BROADCAST = 1_000_000
#: Hosts with fewer different pages have no template.
LEAST_PAGES = 4
#: Characters of text in one batch of parsed pages, about; an element counts as 32.
BATCH = 4_000_000

#: Start tags that end an open paragraph, and elements whose like ends them.
_ENDS_P = BLOCKS - {"option", "label", "legend", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "button"}
_ENDS_LIKE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


_NO_MARKS = str.maketrans("[]/", "___")


class _Page(HTMLParser):
    """Blocks of text with their places, and how often and where each path begins.

    A path is a number; ``parents``, ``steps`` and ``marks`` tell its last step, what is before that, and a hash of all of it, and ``roles`` whether it is
    of a page's furniture. So a page takes memory in proportion to its elements, however deep they lie.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.open: Counter = Counter()
        self.at = [0]
        self.likes: list[dict[str, int] | None] = [None]  # sections so far under each open element
        self.parents, self.steps, self.marks, self.roles, self.inside = [-1], [""], [0], [False], [False]
        self.known: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int, int]] = []  # path, text, characters (no spaces) not in links, place
        self.begun: dict[int, list[int]] = {}  # times, first place
        self.place = 0
        self.parts: list[str] = []
        self.linked = 0
        self.unseen: list[str] = []  # open elements from one whose text is none on

    def _step(self, step: str) -> int:
        """The path that goes on from the open one by a step."""
        before = self.at[-1]
        found = self.known.get((before, step))
        if found is None:
            found = self.known[before, step] = len(self.steps)
            inside = self.inside[before] or tag_of(step) in ("article", "main")
            self.parents.append(before)
            self.steps.append(step)
            self.marks.append(_mark(self.marks[before], step))
            self.roles.append(self.roles[before] or step_plays_role(step, inside))
            self.inside.append(inside)
        return found

    def _close_block(self):
        if self.parts:
            found = "".join(self.parts).split()
            if found:
                self.blocks.append((self.at[-1], " ".join(found), max(0, sum(map(len, found)) - self.linked), self.place))
                self.place += 1
            self.parts, self.linked = [], 0

    def _pop(self, n: int):
        if any(tag in BLOCKS for tag, _ in self.stack[n:]):
            self._close_block()
        for tag, _ in self.stack[n:]:
            self.open[tag] -= 1
        del self.stack[n:], self.at[n + 1 :], self.likes[n + 1 :]

    def handle_starttag(self, tag, attrs):
        if self.unseen and tag in ENDS_UNSEEN:
            self.unseen.clear()
        if self.unseen or tag in UNSEEN:
            if tag not in VOID and (not self.unseen or tag == self.unseen[0]):
                self.unseen.append(tag)
            return
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            if tag in _ENDS_P and self.open["p"]:
                self._end("p", BLOCKS - {"p"})
            if tag in _ENDS_LIKE and self.open[tag]:
                self._end(tag, _ENDS_LIKE[tag])
            if tag in ("dt", "dd"):
                self._end("dd" if tag == "dt" else "dt", {"dl"})
            self._close_block()
        if tag in VOID:
            return
        named = "".join(sorted({f".{w}" for k, v in attrs if v and k in ("class", "id", "role") for w in v.replace(".", "_").split()})) if attrs else ""
        if named:  # numbers in names tell pages apart, not templates
            named = re.sub(r"\d+", "#", named.translate(_NO_MARKS))
        at = self.at[-1]
        if tag in BLOCKS or named:
            self._close_if_role(named)
            step = tag + named
            if tag in SECTIONS:
                like = self.likes[-1] = self.likes[-1] or {}
                like[step] = nth = like.get(step, 0) + 1
                if nth > 1:
                    step += f"[{nth}]"
            at = self._step(step)
            self.begun.setdefault(at, [0, self.place])[0] += 1
            self.place += 1
        self.stack.append((tag, named))
        self.open[tag] += 1
        self.at.append(at)
        self.likes.append(None)

    def _close_if_role(self, named: str):
        if named and any(map(furniture, named.split("."))):
            self._close_block()  # an inline element that plays a role is a block of its own

    def _end(self, tag: str, within: set | frozenset):
        """Close an open ``tag``, unless one of ``within`` lies between."""
        for n in range(len(self.stack) - 1, -1, -1):
            if self.stack[n][0] == tag:
                self._pop(n)
                return
            if self.stack[n][0] in within:
                return

    def handle_startendtag(self, tag, attrs):
        if tag not in UNSEEN:
            self.handle_starttag(tag, attrs)
            if tag not in VOID and tag not in BLOCKS:
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.unseen:
            if tag == self.unseen[0]:
                self.unseen.pop()
                return
            if tag not in ENDS_UNSEEN or not self.open[tag]:
                return
            self.unseen.clear()
        if not self.open[tag]:
            if tag in BLOCKS:
                self._close_block()
            return
        for n in range(len(self.stack) - 1, -1, -1):
            if self.stack[n][0] == tag:
                if self.stack[n][1] and tag not in BLOCKS:
                    self._close_if_role(self.stack[n][1])
                self._pop(n)
                return

    def handle_data(self, data):
        if self.unseen:
            return
        self.parts.append(data)
        if self.open["a"]:
            self.linked += sum(map(len, data.split()))

    def finish(self):
        self.close()
        self._close_block()
        return self


def parse(html: str) -> _Page:
    page = _Page()
    page.feed(html)
    return page.finish()


@lru_cache(100_000)
def furniture(name: str, inside: bool = False) -> bool:
    """Whether a name is of a page's furniture: it has such a word, and its others say nothing (``site-footer``, not ``share-price``)."""
    words = [w.lower() for w in re.findall(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+", name)]
    telling = FURNITURE - AMBIGUOUS if inside else FURNITURE
    return any(w in telling for w in words) and all(w in FURNITURE or w in NEUTRAL for w in words)


@lru_cache(100_000)
def step_plays_role(step: str, inside: bool) -> bool:
    """Whether an element is furniture by its tag or its names; ``inside`` (or being) an article or main a header is not, nor what ambiguous names name."""
    tag, *names = step.partition("[")[0].split(".")
    if tag in ASIDE or (tag == "header" and not inside):
        return True
    return tag not in ("html", "body", "main") and not (inside and tag == "header") and any(furniture(n, inside) for n in names)


def tag_of(step: str) -> str:
    return re.split(r"[.\[]", step, maxsplit=1)[0]


def host_of(url):
    """Host of a url column, without scheme, user and port; a null or odd url has the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _mark(before: int, step: str) -> int:
    return xxhash.xxh64_intdigest(f"{before}/{step}")


def _named(mark: int, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{mark}\n{text}") - (1 << 63)


def _token(path: str, text: str = "") -> int:
    """The token of an element, or of a text in it, by its path."""
    return _named(reduce(_mark, path.split("/")[1:], 0), text)


_PARSED = {
    "sig": pa.int64(), "steps": pa.list_(pa.string()), "ptok": pa.list_(pa.int64()), "bpath": pa.list_(pa.int32()), "btok": pa.list_(pa.int64()),
    "bfree": pa.list_(pa.int64()), "btext": pa.list_(pa.string()), "toks": pa.list_(pa.int64()), "counts": pa.list_(pa.int32()), "places": pa.list_(pa.int32()),
    "parents": pa.list_(pa.int32()), "roles": pa.list_(pa.bool_()),
}
_PARSED_SQL = "sig long, steps array<string>, ptok array<long>, bpath array<int>, btok array<long>, bfree array<long>, btext array<string>, toks array<long>, counts array<int>, places array<int>, parents array<int>, roles array<boolean>"
#: What of a parsed page tells its frame.
_LIGHT = ["host", "steps", "ptok", "parents", "roles", "bpath", "btok", "bfree"]


def parsed_row(html: str) -> tuple:
    """A page's signature, elements (last step, token), blocks (path, token, own characters, text), tokens (times, first place), and elements' parents and roles."""
    page = parse(html)
    ptok = [_named(m) for m in page.marks]
    tokens: dict[int, list[int]] = {ptok[p]: list(held) for p, held in page.begun.items()}
    btok = [_named(page.marks[path], text) for path, text, _, _ in page.blocks]
    for t, (_, _, _, place) in zip(btok, page.blocks, strict=True):
        tokens.setdefault(t, [0, place])[0] += 1
    sig = xxhash.xxh64_intdigest("\n".join(text for path, text, _, _ in page.blocks if not page.roles[path])) - (1 << 63)
    counts, places = zip(*tokens.values(), strict=True) if tokens else ((), ())
    return sig, page.steps, ptok, [b[0] for b in page.blocks], btok, [b[2] for b in page.blocks], [b[1] for b in page.blocks], list(tokens), counts, places, page.parents, page.roles


def _parse_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, first, held = [], 0, 0
        for i, html in enumerate(batch.column("html")):
            rows.append(parsed_row(text_of(html)))
            held += sum(map(len, rows[-1][6])) + 32 * len(rows[-1][1])
            if held >= BATCH or i + 1 == len(batch):
                same = [batch.column(c).slice(first, len(rows)) for c in ("page_id", "url", "host")]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PARSED.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*same, *cols], names=["page_id", "url", "host", *_PARSED])
                rows, first, held = [], i + 1, 0


def _beside(rows: DataFrame, hosts: DataFrame, columns: list[str], size: str) -> DataFrame:
    """``rows`` with what is known of their hosts; a broadcast up to a checked size, else a join whose skew Spark splits."""
    total = hosts.agg(F.sum(F.size(size) + 1)).first()[0] or 0
    return rows.join(F.broadcast(hosts) if total <= BROADCAST else hosts, "host", "left").select(*columns)


class _Hosts:
    """What was read of hosts, kept for the rows that follow."""

    def __init__(self, make):
        self.make, self.seen = make, {}

    def __call__(self, batch: pa.RecordBatch, i: int):
        host = batch.column("host")[i].as_py()
        if host not in self.seen:
            if len(self.seen) > 1000:
                self.seen.clear()
            self.seen[host] = self.make(batch, i)
        return self.seen[host]


def classes_of(reps: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host``, ``ctoks``, ``vectors``, ``supports``: tokens that enough of a host's pages hold, once each, in the order of a page that holds them, with their occurrence vectors."""
    sizes = reps.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    rows = reps.select("host", "sig", F.explode(F.arrays_zip("toks", "counts", "places")).alias("t")).select("host", "sig", "t.*")
    held = rows.groupBy("host", "toks").agg(F.expr("bit_xor(xxhash64(sig, counts))").alias("vector"), F.count("*").alias("support"), F.sum("counts").alias("n"), F.min(F.struct("sig", "places")).alias("first"))  # a class has one such page
    held = held.where(F.col("support") >= least_pages * share)  # no host has so few pages: most texts are on one, and go no further
    enough = held.join(sizes, "host").where((F.col("support") >= F.col("pages") * share) & (F.col("n") == F.col("support")))
    # tokens that enough pages hold are few: no more than 1 / share pages' worth
    one = enough.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("first", "toks", "vector", "support"))).alias("t"))
    return one.select("host", F.col("t.toks").alias("ctoks"), F.col("t.vector").alias("vectors"), F.col("t.support").alias("supports"))


def in_order(ranks: list[int]) -> list[int]:
    """Numbers of the items of a longest rising subsequence."""
    ends: list[int] = []  # least last rank of a rising sequence of each length, and the item that has it
    last: list[int] = []
    before = []
    for i, r in enumerate(ranks):
        k = bisect_left(ends, r)
        ends[k : k + 1], last[k : k + 1] = [r], [i]
        before.append(last[k - 1] if k else -1)
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _classes(batch: pa.RecordBatch, i: int) -> tuple[dict[int, list[int]], int | None]:
    """A host's classes, tokens in the order of one page, by vector; and its main class: the most common, of these the largest."""
    classes, support = defaultdict(list), {}
    for t, v, n in zip(*(batch.column(c)[i].as_py() or [] for c in ("ctoks", "vectors", "supports")), strict=True):
        classes[v].append(t)
        support[v] = n
    return classes, max(classes, key=lambda v: (support[v], len(classes[v]), v), default=None)


def ordered_tokens(place_of: dict[int, int], classes: dict[int, list[int]], root: int) -> Iterator[tuple[int, int]]:
    """Of each class that a page holds whole: its tokens, with 1 for those that come in their order."""
    for toks in classes.values():
        if all(t in place_of for t in toks):
            rank = {t: k for k, t in enumerate(toks)}
            here = sorted(toks, key=place_of.__getitem__)
            kept = {here[k] for k in in_order([rank[t] for t in here])}
            yield from ((t, int(t in kept)) for t in toks)


def nested_classes(place_of: dict[int, int], classes: dict[int, list[int]], root: int) -> Iterator[tuple[int, int]]:
    """Of each class that a page holds whole: the slot of the main class that it lies in (-1: several)."""
    marks = sorted(place_of[t] for t in classes[root] if t in place_of)
    for c, toks in classes.items():
        if all(t in place_of for t in toks):
            slots = {0} if c == root else {bisect_left(marks, place_of[t]) for t in toks}
            yield c, slots.pop() if len(slots) == 1 else -1


def _votes(ask):
    """What ``ask`` finds on pages: ``host``, ``what``, ``answer``, and on how many pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts = _Hosts(_classes)
        for batch in batches:
            votes: Counter = Counter()
            for i in range(len(batch)):
                classes, root = hosts(batch, i)
                if root is not None:
                    host = batch.column("host")[i].as_py()
                    place_of = {t: p for t, n, p in zip(*(batch.column(c)[i].as_py() for c in ("toks", "counts", "places")), strict=True) if n == 1}
                    votes.update((host, *vote) for vote in ask(place_of, classes, root))
            yield pa.RecordBatch.from_pylist([dict(zip(("host", "what", "answer", "n"), (*k, n), strict=True)) for k, n in votes.items()], schema=_VOTES)

    return run


_VOTES = pa.schema([("host", pa.string()), ("what", pa.int64()), ("answer", pa.int64()), ("n", pa.int64())])


def _agreed(reps: DataFrame, classes: DataFrame, ask, least: int) -> DataFrame:
    """``host``, ``what``: where nearly all pages give one answer, of those from ``least`` on."""
    columns = ["host", "toks", "counts", "places", "ctoks", "vectors", "supports"]
    votes = _beside(reps, classes, columns, "ctoks").mapInArrow(_votes(ask), "host string, what long, answer long, n long")
    votes = votes.groupBy("host", "what", "answer").agg(F.sum("n").alias("n"))
    most = F.max(F.when(F.col("answer") >= least, F.col("n")))
    return votes.groupBy("host", "what").agg(most.alias("most"), F.sum("n").alias("all")).where(F.col("most") >= F.col("all") * AGREE).select("host", "what")


def templates(parsed: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host``, ``tokens``: the elements and texts of each host's template (hosts without one are left out).

    ``parsed`` has ``host``, ``sig``, ``toks``, ``counts``, ``places``; pages of a host with one ``sig`` count once.
    """
    reps = parsed.groupBy("host", "sig").agg(F.min(F.struct("toks", "counts", "places")).alias("t")).select("host", "sig", "t.*")
    reps = stored(reps, "pages-once")
    classes = stored(classes_of(reps, share, least_pages), "classes")
    one = F.explode(F.arrays_zip("ctoks", "vectors", "supports")).alias("t")
    tokens = classes.select("host", one).select("host", F.col("t.ctoks").alias("token"), F.col("t.vectors").alias("vector"), F.col("t.supports").alias("support"), F.monotonically_increasing_id().alias("nth"))
    tokens = stored(tokens.join(_agreed(reps, classes, ordered_tokens, 1).withColumnRenamed("what", "token"), ["host", "token"]), "ordered")
    valid = tokens.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("nth", "token", "vector", "support"))).alias("t"))
    valid = stored(valid.select("host", F.col("t.token").alias("ctoks"), F.col("t.vector").alias("vectors"), F.col("t.support").alias("supports")), "valid")
    nested = _agreed(reps, valid, nested_classes, 0).withColumnRenamed("what", "vector")
    return tokens.join(nested, ["host", "vector"]).groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("tokens"))


class _Frame:
    """A page's elements and blocks beside its host's template. Paths are numbered so that a path comes after what it goes on from."""

    def __init__(self, batch: pa.RecordBatch, i: int, template: set[int]):
        self.template = template
        self.steps, self.ptok, self.parents, self.roles, self.bpath, self.btok, self.bfree = (batch.column(c)[i].as_py() for c in _LIGHT[1:])
        self.tags = [tag_of(s) for s in self.steps]
        self.element = [t in template and tag in SECTIONS | {"article", "main"} for t, tag in zip(self.ptok, self.tags, strict=True)]

    def down(self, own: list) -> list:
        """Each path's nearest value from the root on: its own, or else that of the path before."""
        out = list(own)
        for k in range(1, len(out)):
            out[k] = out[k] or out[self.parents[k]]
        return out

    def up(self, of_block: list[int]) -> list[int]:
        """Sums over the blocks in each path."""
        out = [0] * len(self.steps)
        for p, n in zip(self.bpath, of_block, strict=True):
            out[p] += n
        for k in range(len(out) - 1, 0, -1):
            out[self.parents[k]] += out[k]
        return out


def _masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own text of pages in each element of their host's template; token 0 for all of it."""
    hosts = _Hosts(lambda batch, i: set(batch.column("tokens")[i].as_py() or []))
    for batch in batches:
        sums: Counter = Counter()
        for i in range(len(batch)):
            template = hosts(batch, i)
            if not template:
                continue
            host = batch.column("host")[i].as_py()
            f = _Frame(batch, i, template)
            held = f.up([0 if t in template or f.roles[p] else n for p, t, n in zip(f.bpath, f.btok, f.bfree, strict=True)])
            sums[host, 0] += held[0]
            for k, n in enumerate(held):
                if n and f.element[k]:
                    sums[host, f.ptok[k]] += n
        yield pa.RecordBatch.from_pylist([{"host": h, "token": t, "mass": n} for (h, t), n in sums.items()], schema=pa.schema([("host", pa.string()), ("token", pa.int64()), ("mass", pa.int64())]))


def chosen_blocks(f: _Frame, mass: dict[int, int]) -> list[int]:
    """Numbers of the blocks that are main text: what plays no role, and of that

    * on a host with a template no template text outside articles and mains whose section holds no page's own text;
    * where the page has a main, only what is in it; where it has articles, nothing outside them that is links alone;
    * where it has neither, of what is links alone or the template's only that in the innermost template element that holds most of the host's own text and all of the page's;
    * on a host without a template, which can't tell more, the articles and first headings alone if most text is in articles.
    """
    free = [k for k, p in enumerate(f.bpath) if not f.roles[p]]
    kept = set(free)
    size = f.up([max(1, n) * (k in kept) for k, n in enumerate(f.bfree)])
    mains, articles = (f.down([f.tags[k] == tag and size[k] > 0 and not f.roles[k] for k in range(len(size))]) for tag in ("main", "article"))
    total = mass.get(0, 0)
    section = f.down([k if e else 0 for k, e in enumerate(f.element)])
    if total:
        stays = [a or m or not s or mass.get(f.ptok[s], 0) > 0 for a, m, s in zip(articles, mains, section, strict=True)]
        free = [k for k in free if f.btok[k] not in f.template or stays[f.bpath[k]]]
    if any(mains):
        return [k for k in free if mains[f.bpath[k]]]
    if any(articles):
        if total:
            return [k for k in free if articles[f.bpath[k]] or f.bfree[k]]
        inside = sum(max(1, f.bfree[k]) for k in free if articles[f.bpath[k]])
        if 2 * inside >= size[0]:
            return [k for k in free if articles[f.bpath[k]] or f.tags[f.bpath[k]] == "h1"]
        return free
    if not total:
        return free
    needed = f.up([int(k in kept and t not in f.template and n > 0) for k, (t, n) in enumerate(zip(f.btok, f.bfree, strict=True))])
    depth = [0] * len(f.steps)
    for k in range(1, len(depth)):
        depth[k] = depth[f.parents[k]] + 1
    holds = [k for k, e in enumerate(f.element) if e and mass.get(f.ptok[k], 0) >= HOLDS * total and not f.roles[k] and needed[k] == needed[0]]
    best = max(holds, key=depth.__getitem__, default=0)
    under = f.down([k == best for k in range(len(f.steps))])
    return [k for k in free if under[f.bpath[k]]]


def _main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def make(batch, i):
        masses = dict(zip(batch.column("mtok")[i].as_py() or [], batch.column("mass")[i].as_py() or [], strict=True))
        return set(batch.column("tokens")[i].as_py() or []), masses

    hosts = _Hosts(make)
    for batch in batches:
        out = []
        for i in range(len(batch)):
            template, mass = hosts(batch, i)
            kept = chosen_blocks(_Frame(batch, i, template), mass)
            texts = batch.column("btext")[i].values
            out.append("\n\n".join(texts[k].as_py() for k in kept))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` per input row.

    Null, empty and tagless html: what text there is, else the empty text. Null urls are one host, the empty one.
    Repeated rows are pages of their own, which tell no more of the template than one; further columns are not read; an
    empty table gives an empty one.
    """
    keyed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    kind = dict(pages.dtypes)["page_id"]
    parsed = stored(keyed.select("page_id", "url", "host", "html").mapInArrow(_parse_pages, f"page_id {kind}, url string, host string, {_PARSED_SQL}"), "parsed", "zstd")
    template = stored(templates(parsed.select("host", "sig", "toks", "counts", "places"), share, least_pages), "templates")
    masses = _beside(parsed.select(*_LIGHT), template, [*_LIGHT, "tokens"], "tokens").mapInArrow(_masses, "host string, token long, mass long").groupBy("host", "token").agg(F.sum("mass").alias("mass"))
    masses = masses.groupBy("host").agg(F.collect_list(F.struct("token", "mass")).alias("m")).select("host", F.col("m.token").alias("mtok"), F.col("m.mass").alias("mass"))
    known = stored(template.join(masses, "host", "left"), "hosts")
    columns = ["page_id", "url", *_LIGHT, "btext"]
    return _beside(parsed.select(*columns), known, [*columns, "tokens", "mtok", "mass"], "tokens").mapInArrow(_main_text, f"page_id {kind}, url string, text string, n_chars long")


def op8_query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
