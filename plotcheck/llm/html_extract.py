"""Main text of web pages, with templates deduced from equivalence classes of tokens.

A token is the start or end of an element with its place in the page, or a text with its place. Tokens of a host with
equal occurrence vectors (equally often on every distinct page) form a class; a class is considered if it is on most of
the host's pages and has several tokens. Of a class those tokens stay that have one and the same rank in it on every
page, once or again and again; it is valid if several do and it nests (each time within one and the same gap of one and
the same other class).
Valid classes are the host's template; whatever stands in their gaps beside template texts is in a slot.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotcheck.llm.common import slices
from plotcheck.storage import materialize

#: A class is considered on so many distinct pages of a host at least, and on over half of them, with so many tokens.
PAGES, TOKENS = 3, 3
#: A text is the template's on this share of the pages at least, and within a main element on so many pages: copies of
#: an article on its host are no template.
SHARE, PAGES_INSIDE = 0.8, 10
#: Tokens that a task adds up before it hands them on.
HELD = 200_000
#: Templates of up to so many tokens in all are broadcast (8 bytes each); beyond, pages are dealt to them by host and SALTS.
BROADCAST, SALTS = 1_000_000, 32

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<=\s)(hidden)(?=[\s/>]|\Z)")
_RAW = {name: re.compile(rf"</{name}[^>]*>|\Z", re.I) for name in ("script", "style", "textarea", "title", "noscript", "template", "xmp", "iframe")}
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[a-zA-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements that are never part of the main text.
_OUT = frozenset("nav footer aside form button select option textarea input dialog menu svg head object canvas audio video".split())
#: The same by words of class, id or role.
_OUT_WORDS = frozenset(
    """ad ads adv advert advertisement adverts adslot alert alertdialog banner breadcrumb breadcrumbs byline comment commentlist comments complementary
    consent contentinfo cookie cookies copyright dialog disclaimer disqus footer gdpr login masthead menu menubar modal nav navbar navigation
    newsletter notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond search share
    sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar topbar widget""".split()
)
_HEADERS = frozenset(("header",))
#: Of these, what keeps out a main element that stands within too.
_HARD = frozenset("nav footer aside dialog menu svg head object canvas audio video select textarea button".split())
_HARD_WORDS = frozenset("comment commentlist comments disqus recommended related replies reply respond teaser".split())
#: How far a place is out of the main text: not, unless it is a main element's, in any case.
_IN, _SOFT, _FULL = 0, 1, 2


class _Page:
    """Tokens of a page in order, and its texts: (index of the token, text, within the main element, left out)."""

    def __init__(self, source: str) -> None:
        self.tokens: list[int] = []
        self.blocks: list[tuple[int, str, bool, bool]] = []
        self.stack: list[tuple[str, int, int, bool]] = [("", 0, _IN, False)]  # name, place, left out, main
        self.buffer: list[str] = []
        self.buffer_state: tuple[int, bool, int] | None = None
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        if self.buffer:
            text = _SPACE.sub(" ", html.unescape("".join(self.buffer))).strip()
            if text:
                place, main, out = self.buffer_state
                self.blocks.append((len(self.tokens), text, main, out != _IN))
                self.tokens.append(xxhash.xxh64_intdigest(text, place) | 1)
            self.buffer = []
        self.buffer_state = None

    def _token(self, name: str, place: int) -> None:
        """Of an element; texts have odd numbers, elements even ones."""
        self.tokens.append(xxhash.xxh64_intdigest(name, place) & ~1)

    def _text(self, text: str) -> None:
        _, place, out, main = self.stack[-1]
        if text:
            if self.buffer_state is None and not text.isspace():
                self.buffer_state = (place, main, out)
            if self.buffer_state is not None:
                self.buffer.append(text)

    def _open(self, name: str, attributes: str) -> None:
        if name in _BLOCK:
            self._flush()
            if name in ("p", "li", "dd", "dt", "td", "th", "tr", "option"):
                self._implied_end(name)
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes) if m[1]} if attributes else {}
        _, place, out, main = self.stack[-1]
        place = xxhash.xxh64_intdigest(f"{name}.{found.get('class', '')}", place)
        if name in _BLOCK:
            self._token("", place)
        if name in _VOID or attributes.endswith("/") and name not in _BLOCK:
            if name == "br":
                self._text(" ")
            return
        words = set(map(str.lower, _WORDS.findall(f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}"))) if found else set()
        hidden = " hidden" in attributes and re.search(r"\shidden(?=[\s/=]|\Z)", attributes) or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        own_main = name in ("article", "main") or found.get("role") == "main" or found.get("itemprop") == "articleBody"
        if hidden or name in _HARD:
            leave = _FULL
        elif own_main and not main:
            # The outermost main element is in, whatever it and the elements around it are called, but for those of comments.
            leave, out = _FULL if words & _HARD_WORDS else _IN, _IN if out == _SOFT else out
        elif words & _HARD_WORDS and name not in ("html", "body"):
            leave = _FULL
        elif name in _OUT or words & _OUT_WORDS and name not in ("html", "body", "main") or not main and (name in _HEADERS or words & _HEADERS) and name not in ("h1", "body", "html"):
            leave = _SOFT
        else:
            leave = _IN
        self.stack.append((name, place, max(out, leave), main or own_main))

    def _implied_end(self, name: str) -> None:
        """A paragraph or cell that was not closed ends where the next begins."""
        stops = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "option": ("select",)}.get(name, ())
        for i in range(len(self.stack) - 1, 0, -1):
            at = self.stack[i][0]
            if at == name:
                self._end(i)
                return
            if at in stops or name == "p" and at in _BLOCK:
                return

    def _end(self, i: int) -> None:
        for name, place, _, _ in reversed(self.stack[i:]):
            if name in _BLOCK:
                self._token("/", place)
        del self.stack[i:]

    def _close(self, name: str) -> None:
        if name in _BLOCK:
            self._flush()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == name:
                self._end(i)
                return
            if name not in _BLOCK and self.stack[i][0] in _BLOCK:
                return  # a stray inline end

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = _TAG.search(source, at)
            if m is None:
                self._text(source[at:])
                return
            if m.start() > at:
                self._text(source[at : m.start()])
            at = max(m.end(), at + 1)
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                self._close(name)
            elif name in _RAW:
                self._token(name, self.stack[-1][1])
                at = _RAW[name].search(source, at).end()
            else:
                self._open(name, m[3] or "")

    def main_text(self, template: Template | None) -> str:
        """The texts of the template's slots, as far as they are no menu, advert or the like; those of the main element, where one is marked.

        Without a template (too few pages on the host) the whole page is one slot.
        """
        fixed = template.texts(self.tokens) if template else {}
        marked = any(main and not out for _, _, main, out in self.blocks)
        keep = []
        for at, text, main, out in self.blocks:
            share, pages = fixed.get(at, (0.0, 0))
            if not out and (main or not marked) and not (share >= SHARE and (pages >= PAGES_INSIDE or not main)):
                keep.append(text)
        return "\n".join(keep)


class Template:
    """The classes of a host: for each token its class, with the class's pages, and how its texts are found in a page."""

    def __init__(self, tokens: list[int], classes: list[int], pages: list[int], host_pages: int) -> None:
        self.of = {t & _MASK: c for t, c in zip(tokens, classes)}  # noqa: B905
        self.size = Counter(self.of.values())
        self.pages = dict(zip(classes, pages))  # noqa: B905
        self.host_pages = max(host_pages, 1)

    def spans(self, sequence: list[int]) -> dict[int, tuple[tuple[int, ...], list[list[int]]] | None]:
        """For each class on the page the order of its tokens and the indexes of each time it occurs; None if it is not ordered."""
        at: dict[int, list[int]] = {}
        for i, t in enumerate(sequence):
            c = self.of.get(t)
            if c is not None:
                at.setdefault(c, []).append(i)
        out = {}
        for c, where in at.items():
            k = self.size[c]
            order = tuple(sequence[i] for i in where[:k])
            sound = len(set(order)) == k and all(sequence[i] == order[n % k] for n, i in enumerate(where))
            out[c] = (order, [where[n : n + k] for n in range(0, len(where), k)]) if sound else None
        return out

    def ranks(self, sequence: list[int]) -> set[tuple[int, int, int]]:
        """(class, token, rank) for each time a class occurs; rank -1 if it does not have each of its tokens once."""
        at: dict[int, list[int]] = {}
        for t in sequence:
            if t in self.of:
                at.setdefault(self.of[t], []).append(t)
        out = set()
        for c, own in at.items():
            k = self.size[c]
            for n in range(0, len(own), k):
                time = own[n : n + k]
                sound = len(set(time)) == k
                out |= {(c, t, i if sound else -1) for i, t in enumerate(time)}
        return out

    def shape(self, sequence: list[int]) -> dict[int, int]:
        """For each class on the page a number that says its order, and the class and gap that it nests in; 0 if it is not ordered or not nested."""
        spans = self.spans(sequence)
        times = [(where, c) for c, found in spans.items() if found for where in found[1]]
        out: dict[int, int] = {}
        for c, found in spans.items():
            if found is None:
                out[c] = 0
                continue
            homes = set()
            for where in found[1]:
                a, b = where[0], where[-1]
                home, start = (0, 0), -1
                for other, d in times:
                    if d != c and other[0] < a and other[-1] > a:
                        gap = bisect.bisect(other, a)
                        if b > other[gap]:
                            home = None  # it reaches over a token of the other class
                            break
                        if other[0] > start:
                            home, start = (d, gap), other[0]
                homes.add(home)
            sound = len(homes) == 1 and None not in homes
            out[c] = xxhash.xxh64_intdigest(repr((found[0], homes))) or 1 if sound else 0
        return out

    def texts(self, sequence: list[int]) -> dict[int, tuple[float, int]]:
        """Indexes of template texts on a page: share and number of the host's pages that have their class."""
        out = {}
        for c, found in self.spans(sequence).items():
            if found:
                n = self.pages[c]
                out |= {i: (n / self.host_pages, n) for where in found[1] for i in where if sequence[i] & 1}
        return out


_MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))


def token_rows(pages: DataFrame) -> DataFrame:
    """(host, page, tokens): each distinct html of a host once, as the tokens of the whole page in order; page is a hash of the html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 2_000_000):
            found = [list(map(_signed, _Page(x).tokens)) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("page"), pa.array(found, pa.list_(pa.int64()))], names=["host", "page", "tokens"])

    src = _with_host(pages).filter("html <> ''").select("host", F.xxhash64("html").alias("page"), "html")
    return src.dropDuplicates(["host", "page"]).mapInArrow(run, "host string, page long, tokens array<long>")


def candidate_classes(rows: DataFrame) -> DataFrame:
    """(host, host_pages, tokens, classes, pages): the tokens of every class that is on over half of a host's pages and large enough.

    Occurrence vectors are added up as the sum of fingerprints of (page, count), within tasks first, so that a host of
    any size costs a row for each token and task. Tokens on over half of the pages are at most twice as many as a page
    has on average, so that the arrays are bounded by the pages' length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}

        def out() -> pa.RecordBatch:
            columns = zip(*((h, t, _signed(v & _MASK), n, total) for (h, t), (v, n, total) in held.items()))  # noqa: B905
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "token", "vector", "pages", "total"])  # noqa: B905

        for batch in batches:
            for host, page, tokens in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "tokens"))):  # noqa: B905
                for token, n in Counter(tokens).items():
                    entry = held.setdefault((host, token), [0, 0, 0])
                    entry[0] += xxhash.xxh64_intdigest(n.to_bytes(8, "little"), page & _MASK)
                    entry[1] += 1
                    entry[2] += n
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    # Sums of 64-bit fingerprints wrap; two halves keep them within a long.
    sums = rows.mapInArrow(run, "host string, token long, vector long, pages long, total long")
    low, high = F.col("vector").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("vector", 32)
    tokens = sums.groupBy("host", "token").agg(F.sum(low).alias("low"), F.sum(high).alias("high"), F.sum("pages").alias("pages"), F.sum("total").alias("total"))
    tokens = tokens.withColumn("class", F.xxhash64(F.col("low").bitwiseAND(F.lit(0xFFFFFFFF)), (F.col("high") + F.shiftrightunsigned("low", 32)).bitwiseAND(F.lit(0xFFFFFFFF)), "pages", "total"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_pages"))
    common = tokens.filter(F.col("pages") >= PAGES).join(hosts, "host").filter(2 * F.col("pages") > F.col("host_pages"))
    large = common.groupBy("host", "class").agg(F.count("*").alias("size")).filter(F.col("size") >= TOKENS).select("host", "class")
    kept = common.join(large, ["host", "class"]).groupBy("host", "host_pages").agg(F.array_sort(F.array_agg(F.struct("token", "class", "pages"))).alias("found"))
    return kept.select("host", "host_pages", F.col("found.token").alias("tokens"), F.col("found.class").alias("classes"), F.col("found.pages").alias("pages"))


def _meet(rows: DataFrame, known: DataFrame, salt: str) -> DataFrame:
    """``rows`` with what their host has in ``known`` (nulls if nothing): by broadcast up to BROADCAST tokens in all, counted first."""
    if (known.agg(F.sum(F.size("tokens"))).first()[0] or 0) <= BROADCAST:
        return rows.join(F.broadcast(known), "host", "left")
    salts = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salts, ["host", "salt"], "left").drop("salt")


def templates(pages: DataFrame) -> DataFrame:
    """(host, host_pages, tokens, classes, pages): the tokens of each host's valid classes, with the number of pages of their class.

    A host with fewer than PAGES distinct pages, or without a valid class, has no row. Null and empty html are no pages.
    """
    rows = materialize(token_rows(pages), "tokens")
    known = materialize(candidate_classes(rows), "classes")

    def looked_at(found: DataFrame, look: Callable[[Template, list[int]], Iterable[tuple[int, int, int]]]) -> DataFrame:
        """What ``look`` finds on every page, as (host, class, token, value), less repetitions within a batch."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hosts: dict[str, Template] = {}
            for batch in batches:
                held: set[tuple[str, int, int, int]] = set()
                at = [batch.column(c) for c in ("host", "sequence", "tokens", "classes", "pages", "host_pages")]
                for i in range(batch.num_rows):
                    host = at[0][i].as_py()
                    if host not in hosts:
                        if len(hosts) > 1000:
                            hosts.clear()
                        hosts[host] = Template(*(c[i].as_py() for c in at[2:]))
                    held |= {(host, c, _signed(t), _signed(v)) for c, t, v in look(hosts[host], [t & _MASK for t in at[1][i].as_py()])}
                columns = list(zip(*held)) or [()] * 4  # noqa: B905
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["host", "class", "token", "value"])

        met = _meet(rows.select("host", "page", F.col("tokens").alias("sequence")), found, "page").filter("tokens IS NOT NULL")
        return met.select("host", "sequence", "tokens", "classes", "pages", "host_pages").mapInArrow(run, "host string, class long, token long, value long")

    def keep(found: DataFrame, by: str, sound: DataFrame) -> DataFrame:
        """The tokens of ``found`` that ``sound`` (host, ids) names, by token or class; bounded by the pages' length, as before."""
        own = F.filter(F.arrays_zip("tokens", "classes", "pages"), lambda x: F.array_contains("ids", x[by]))
        # A class that is left with too few tokens goes.
        large = F.filter(own, lambda x: F.size(F.filter(own, lambda y: y["classes"] == x["classes"])) >= TOKENS)
        out = found.join(sound, "host").select("host", "host_pages", large.alias("own")).filter(F.size("own") > 0)
        return out.select("host", "host_pages", F.col("own.tokens").alias("tokens"), F.col("own.classes").alias("classes"), F.col("own.pages").alias("pages"))

    ranks = looked_at(known, lambda template, page: template.ranks(page)).groupBy("host", "token").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    stable = ranks.filter("low = high AND low >= 0").groupBy("host").agg(F.collect_set("token").alias("ids"))
    ordered = materialize(keep(known, "tokens", stable), "ordered")
    shapes = looked_at(ordered, lambda template, page: ((c, 0, v) for c, v in template.shape(page).items())).groupBy("host", "class").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    nested = shapes.filter("low = high AND low <> 0").groupBy("host").agg(F.collect_set("class").alias("ids"))
    return keep(ordered, "classes", nested)


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    The article as blocks joined by line feeds: the texts in the slots of its host's template, without menus, headers,
    footers, sidebars, notices, adverts, forms, scripts, styles and reader comments. Null and empty html gives an empty
    text; a null url belongs to the host without name; rows that repeat stay, and count once in the template. An empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, Template | None] = {}
        for batch in slices(batches, "html", 2_000_000):
            found = []
            at = [batch.column(c) for c in ("host", "tokens", "classes", "pages", "host_pages")]
            for i, source in enumerate(batch.column("html").to_pylist()):
                host = at[0][i].as_py()
                if host not in hosts:
                    if len(hosts) > 1000:
                        hosts.clear()
                    hosts[host] = Template(*(c[i].as_py() for c in at[1:])) if at[1][i].is_valid else None
                found.append(_Page(source or "").main_text(hosts[host]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    known = materialize(templates(pages), "templates")
    met = _meet(_with_host(pages).withColumn("salted", F.xxhash64("page_id", "url")), known, "salted")
    return met.select("page_id", "url", "html", "host", "tokens", "classes", "pages", "host_pages").mapInArrow(run, "page_id long, url string, text string, n_chars long")
