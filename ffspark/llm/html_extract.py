"""Main text of web pages by nearest-URL page differencing.

Every page becomes a list of text lines, one for each block. Within a host, pages are ordered by URL path; each page is
aligned with its nearest neighbour of another path and other content by a longest common subsequence of lines. Lines that both pages share
in the same order are the site's furniture and are deleted.

What is left is then checked against the structure of the page, where it gives any: blocks of prose inside an article
(or main) element are text and are put back if a neighbour repeats them; blocks inside navigation, headers, footers,
asides, forms, scripts, adverts, notices and reader comments are furniture and go even if no neighbour has them. If a
page has such an element, only its blocks count. Differencing alone decides all other blocks: those of pages without
such an element, and those inside one that are links only. Pages of one path, and pages that share four fifths of their
sentences, are versions of one another: between them only lines that are no sentences are deleted.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ffspark.llm.shared import PARTS, lookup, materialise

#: Fixed values of HTML: elements whose content isn't text, and elements that begin or end a block.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "title", "xmp", "noembed", "noframes")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav header footer aside form menu button select dialog head label input fieldset search".split())
MAIN = frozenset(("article", "main"))
#: Words of class, id and role attributes that mark furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion promoted nav navbar navigation menu menus breadcrumb "
    "breadcrumbs header masthead footer sidebar side aside cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "share sharing social related recommended comment comments commentlist discussion disqus reply replies respond complementary contentinfo".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(%s)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)" % "|".join(RAW),
    re.S | re.I,
)
_ATTR = re.compile(r"(?<![^\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
#: Words that can also name a part of the article: inside one they decide nothing.
OUTSIDE_WORDS = frozenset("discussion related notice notices alert side reply replies respond social recommended promotion header".split())
#: Words that add nothing to a class name.
NEUTRAL_WORDS = frozenset("area bar block box container content inner links list outer section site widget wrap wrapper".split())
#: Words that mark furniture whatever else a name says, unless it has one of the words after them.
STRONG_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored comment comments commentlist disqus".split())
MODIFIERS = frozenset("has have with without no not free hide hidden show open opened closed enabled disabled status".split())
#: Furniture that may also hold a whole page.
FORMS = frozenset(("form", "fieldset"))
#: Closing tags that HTML lets one leave out: an opening tag of the key ends an open element of the value.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

TEXT, ARTICLE, OTHER, LINKS = 0, 1, 2, 3  # of a line: undecided, inside the main element, furniture, links inside the main element


def _is_furniture(tag: str, attributes: str, inside: bool) -> bool:
    """``inside``: of an article. A name marks furniture if all its words do, neutral ones aside, or if a strong one does."""
    if tag in FURNITURE:
        return True
    if tag in ("html", "body") or tag in MAIN or "=" not in attributes:
        return False
    for m in _ATTR.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in _WORDS.split(name) if w} - NEUTRAL_WORDS
            if words and words <= FURNITURE_WORDS and not (inside and words <= OUTSIDE_WORDS):
                return True
            if words & STRONG_WORDS and not words & MODIFIERS:
                return True
    return False


def page_lines(page: str) -> list[tuple[int, str]]:
    """(role, text) of every block with text, in page order. White space of any kind becomes one space.

    An article inside an element whose attributes mark furniture (a reader's comment, a teaser) is furniture too, unless
    the page has no other; a form is, unless the page has no article and two thirds of its text stand in the form."""
    lines, articles, forms = _parse(page)
    if articles and not any(role in (ARTICLE, LINKS) for role, _ in lines):
        lines, *_ = _parse(page, attributes=False)
    if forms and not articles:
        whole, *_ = _parse(page, forms=False)
        size = lambda found: sum(len(t) for role, t in found if role != OTHER)
        if size(whole) > 3 * size(lines):
            return whole
    return lines


def _parse(page: str, attributes: bool = True, forms: bool = True) -> tuple[list[tuple[int, str]], bool, bool]:
    """The lines, and whether there are articles and forms. Without ``attributes``, those of the elements around an article
    don't count; without ``forms``, forms are no furniture."""
    lines: list[tuple[int, str]] = []
    held: list[str] = []
    open_: list[tuple[str, int, int]] = []  # tag, furniture and main elements so far, itself included
    places: dict[str, list[int]] = {}  # depths of the open elements of each tag
    furniture = main = 0
    paragraph = False  # in a paragraph that is furniture by its attributes; any block boundary ends it
    prose = False  # the block has text outside links
    at = 0
    articles = formed = False

    def flush() -> None:
        nonlocal paragraph, prose
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            lines.append((OTHER if furniture or paragraph else TEXT if not main else ARTICLE if prose else LINKS, text))
        paragraph = prose = False

    def close_to(depth: int) -> None:
        nonlocal furniture, main
        for tag, *_ in open_[depth:]:
            places[tag].pop()
        del open_[depth:]
        _, furniture, main = open_[-1] if open_ else ("", 0, 0)

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
            prose = prose or not (places.get("a") or held[-1].isspace())
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br":
            held.append(" ")
            continue
        if m[2]:
            depth = places[tag][-1] if places.get(tag) else None
            if tag in BLOCK or (depth is not None and open_[depth][1] != (open_[depth - 1][1] if depth else 0)):
                flush()
            if depth is not None:
                close_to(depth)
            continue
        articles, formed = articles or tag in MAIN, formed or tag in FORMS
        ours = _is_furniture(tag, m[4], main > 0) and (forms or tag not in FORMS)
        if tag in BLOCK or ours:
            flush()
        if tag in IMPLIED and open_ and open_[-1][0] in IMPLIED[tag]:
            close_to(len(open_) - 1)
        if tag == "p":
            paragraph = ours
        elif tag not in VOID and not m[4].endswith("/"):
            if tag in MAIN and not main:  # a form around an article holds the page
                around = sum(len(places.get(t, ())) for t in FORMS) if forms else 0
                furniture = furniture - around if attributes else sum(len(places.get(t, ())) for t in FURNITURE - FORMS)
            places.setdefault(tag, []).append(len(open_))
            furniture, main = furniture + ours, main + (tag in MAIN)
            open_.append((tag, furniture, main))
    if at < len(page):
        held.append(page[at:])
        prose = prose or not (places.get("a") or held[-1].isspace())
    flush()
    return lines, articles, formed


def _rows(a: list, b: list) -> list[int]:
    """Bit-parallel longest common subsequence: after each item of ``a``, the bits j where LCS(a[:i], b[:j + 1])
    exceeds LCS(a[:i], b[:j])."""
    full = (1 << len(b)) - 1
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    v, out = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        out.append(~v & full)
    return out


def lcs_members(a: list, b: list, cells: int = 1 << 26) -> list[bool]:
    """Which items of ``a`` belong to a longest common subsequence with ``b``. Beyond ``cells`` bits of rows the
    problem is split in two at the best place, so memory stays bounded for pages of any length."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    inner = [False] * len(x)
    if x and y:
        if len(x) * len(y) > cells and len(x) > 1:
            mid = len(x) // 2
            left, right = _last_row(x[:mid], y), _last_row(x[:mid - 1 : -1], y[::-1])
            ahead = [0]
            for j in range(len(y)):
                ahead.append(ahead[-1] + (left >> j & 1))
            behind = [0]
            for j in range(len(y)):
                behind.append(behind[-1] + (right >> j & 1))
            cut = max(range(len(y) + 1), key=lambda j: ahead[j] + behind[len(y) - j])
            inner = lcs_members(x[:mid], y[:cut], cells) + lcs_members(x[mid:], y[cut:], cells)
        else:
            rows, j = _rows(x, y), len(y) - 1
            for i in range(len(x) - 1, -1, -1):
                row, above = rows[i] & ((1 << (j + 1)) - 1), (rows[i - 1] if i else 0) & ((1 << (j + 1)) - 1)
                if row.bit_count() > above.bit_count():
                    inner[i] = True
                    j = _match_before(j, x[i], y) - 1
    return [True] * lo + inner + [True] * hi


def _last_row(a: list, b: list) -> int:
    full, where = (1 << len(b)) - 1, {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return ~v & full


def _match_before(j: int, item: object, b: list) -> int:
    """The last place up to ``j`` where ``b`` has ``item``: the best partner in a row that raises the length."""
    while b[j] != item:
        j -= 1
    return j


def common_path(a: str, b: str) -> tuple[int, int]:
    """Leading path segments that two paths share, then characters of the next one."""
    x, y = a.split("/"), b.split("/")
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    rest_x, rest_y = x[n] if n < len(x) else "", y[n] if n < len(y) else ""
    k = 0
    while k < min(len(rest_x), len(rest_y)) and rest_x[k] == rest_y[k]:
        k += 1
    return n, k


def _is_sentence(text: str) -> bool:
    return text[-1] in ".!?" or text.count(" ") >= 7


def _sizes(lines: list[tuple[int, str]]) -> list[int]:
    """Characters of each line, 0 of one that is no sentence."""
    return [len(t) if _is_sentence(t) else 0 for _, t in lines]


def shared_lines(own: list, other: list, sizes: list[int], other_size: int, same_path: bool = False) -> list[bool]:
    """Which of a page's lines differencing deletes: those of a longest common subsequence with its neighbour's, without
    sentences if the two are versions of one page. ``other_size``: the sum of the neighbour's sizes."""
    shared = lcs_members(own, other)
    both = sum(size for size, gone in zip(sizes, shared, strict=True) if gone)
    if same_path or (both and 5 * both >= 4 * max(sum(sizes), other_size)):
        shared = [gone and not size for size, gone in zip(sizes, shared, strict=True)]
    return shared


def checked(lines: list[tuple[int, str]], deleted: list[bool]) -> tuple[str, int, int]:
    """The text after differencing and the check of its result by structure, how many deleted lines that puts back, and
    how many others it takes out."""
    inside = (ARTICLE, LINKS) if any(role in (ARTICLE, LINKS) for role, _ in lines) else (TEXT,)
    kept = [role in inside and (role == ARTICLE or not gone) for (role, _), gone in zip(lines, deleted, strict=True)]
    pairs = list(zip(kept, deleted, strict=True))
    return "\n".join(t for (_, t), stays in zip(lines, kept, strict=True) if stays), pairs.count((True, True)), pairs.count((False, False))


def main_text(lines: list[tuple[int, str]], neighbour: list[tuple[int, str]] | None, same_path: bool = False) -> str:
    """Delete the lines shared with the neighbour, then check by structure what is left."""
    deleted = [False] * len(lines)
    if neighbour and neighbour != lines:
        deleted = shared_lines([t for _, t in lines], [t for _, t in neighbour], _sizes(lines), sum(_sizes(neighbour)), same_path)
    return checked(lines, deleted)[0]


def is_decided(lines: list[tuple[int, str]]) -> bool:
    """Structure alone gives the text."""
    return not lines or any(role == ARTICLE for role, _ in lines) and not any(role == LINKS for role, _ in lines)


ORDER = ("host", "path", "page_id", "digest")
#: Bytes of a line's digest, by which the lines of different pages are compared.
MARK = 8
#: Most pages of a range, on average: a task holds their addresses, without lines.
RANGE_PAGES = 50_000


class _Scan:
    """Goes along pages in path order. ``last`` is the last page of an earlier path of the host and ``other`` the last one
    whose content differs from that, so one of the two is the nearest page with another path and other content."""

    def __init__(self) -> None:
        self.host = self.path = self.last = self.other = self.newest = self.second = None

    def step(self, page: dict) -> None:
        if page["host"] != self.host:
            self.__init__()
            self.host, self.path = page["host"], page["path"]
        if page["path"] != self.path:
            self.last, self.other, self.path = self.newest, self.second, page["path"]
        if self.newest and self.newest["digest"] != page["digest"]:
            self.second = self.newest
        self.newest = page

    def nearest(self, page: dict) -> dict | None:
        """To be asked after ``step(page)``."""
        return self.last if not self.last or self.last["digest"] != page["digest"] else self.other

    def same_path(self, page: dict) -> dict | None:
        """The page before it, of the same path but other content."""
        return self.second if self.second and self.second["path"] == page["path"] else None

    def summary(self) -> list[dict]:
        """Pages that lead any scan to the state of this one."""
        out = []
        for page in (self.other, self.last, self.second, self.newest):
            if page and not any(page is x for x in out):
                out.append(page)
        return sorted(out, key=lambda x: x["at"])


def _scan(table: pa.Table, backwards: bool) -> list[dict]:
    pages = sorted(table.to_pylist(), key=lambda x: (x["host"], x["path"], x["page_id"] is not None, x["page_id"] or 0, x["digest"]), reverse=backwards)
    for at, page in enumerate(pages):
        page["at"] = at
    return pages


def _pairs(reps: DataFrame, most: int) -> DataFrame:
    """key, other, other_id: the partner of each page of ``reps`` (key, host, path, digest, page_id; at most ``most``
    rows), the same for any partitioning. The nearest pages before and after it with another path and other content
    count, and the one that shares more of the path is taken (the one before if equal); a page without either gets one of
    its own path with other content, if there is any. The number of ranges grows with the pages. The last pages of each
    range, four at most and without their lines, go through the driver, and from there only to the task of the next range."""
    spark = reps.sparkSession
    number = [max(-(-most // RANGE_PAGES), int(spark.conf.get("spark.sql.shuffle.partitions")))] if most > RANGE_PAGES else []
    ranges = reps.select("key", "host", "path", "digest", "page_id").repartitionByRange(*number, *ORDER).withColumn("part", F.spark_partition_id())
    ranges = materialise(ranges, "ranges")
    fields = [*((c, pa.string()) for c in ("key", "host", "path", "digest")), ("page_id", pa.int64()), ("part", pa.int32()), ("backwards", pa.bool_()), ("at", pa.int64())]
    edge = pa.schema(fields)

    def edges(table: pa.Table) -> pa.Table:
        out = []
        for backwards in (False, True):
            scan = _Scan()
            for page in _scan(table, backwards):
                scan.step(page)
            out += [page | {"backwards": backwards} for page in scan.summary()]
        return pa.Table.from_pylist(out, schema=edge)

    found: dict[tuple[bool, int], list[dict]] = {}
    for r in ranges.groupBy("part").applyInArrow(edges, "key string, host string, path string, digest string, page_id long, part int, backwards boolean, at long").collect():
        found.setdefault((r["backwards"], r["part"]), []).append(r.asDict())
    before: list[dict] = []  # what lies before each range, in the order of the scan
    for backwards in (False, True):
        scan, at = _Scan(), 0
        for part in sorted({part for _, part in found}, reverse=backwards):
            before += [page | {"part": part, "backwards": backwards} for page in scan.summary()]
            for page in sorted(found[backwards, part], key=lambda r: r["at"]):
                at += 1
                scan.step(page | {"at": at})

    def pair(table: pa.Table, earlier: pa.Table) -> pa.Table:
        near: dict[str, list] = {}
        for backwards in (False, True):
            scan = _Scan()
            for page in sorted((x for x in earlier.to_pylist() if x["backwards"] == backwards), key=lambda x: x["at"]):
                scan.step(page)
            for page in _scan(table, backwards):
                scan.step(page)
                near.setdefault(page["key"], [page]).append((scan.nearest(page), scan.same_path(page)))
        out = []
        for page, (a, a2), (b, b2) in near.values():
            some = [x for x in (a, b) if x] or [x for x in (a2, b2) if x]
            other = max(some, key=lambda y: common_path(page["path"], y["path"]), default=None)
            if other:
                out.append({"key": page["key"], "other": other["key"], "other_id": other["page_id"]})
        return pa.Table.from_pylist(out, schema=pa.schema([("key", pa.string()), ("other", pa.string()), ("other_id", pa.int64())]))

    sent = spark.createDataFrame(pa.Table.from_pylist(before, schema=edge))
    return ranges.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(pair, "key string, other string, other_id long")


def _marks(lines: list[tuple[int, str]]) -> list[bytes]:
    return [hashlib.blake2b(t.encode("utf-8", "backslashreplace"), digest_size=MARK).digest() for _, t in lines]


def _pack(lines: list[tuple[int, str]]) -> bytes:
    """Lines, which hold no line break, as one compressed value: they cross the cluster once."""
    return zlib.compress("\n".join(["".join(str(role) for role, _ in lines), *(t for _, t in lines)]).encode("utf-8", "surrogatepass"), 1)


def _unpack(packed: bytes) -> list[tuple[int, str]]:
    roles, *texts = zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n")
    return [(int(role), t) for role, t in zip(roles, texts, strict=True)]


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", every_page: bool = False) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, neighbour_id, n_shared, n_restored, n_removed.

    With ``every_page`` each page has its partner, see ``_pairs``, differencing deletes the lines it shares with that (their
    number: ``n_shared``), and the check by structure then puts ``n_restored`` of them back and takes out ``n_removed``
    others. Without, pages that structure decides get the same text without differencing, and the three numbers are null:
    pages are only paired on hosts with a page that it doesn't decide, and elsewhere ``neighbour_id`` is null.

    Pages with equal host, path and lines are one page for the pairing. A page alone on its host has no partner. Very long
    pages are parsed and compared whole; pages that tie by path are taken in order of id and content. Lines of two pages
    are compared by 64-bit digests. A null or empty html gives an empty text; a null url counts as a host and path of its
    own. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """

    numbers = ("n_shared", "n_restored", "n_removed")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, list[tuple[str, str]], list]]:
        """Pages with their lines, key, digest and, if structure decides it, text."""
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [page_lines(x or "") for x in part.column("html").to_pylist()]
                digests = [hashlib.md5(repr(x).encode("utf-8", "backslashreplace")).hexdigest() for x in found]
                keys = [hashlib.md5(repr((h, p, d)).encode("utf-8", "backslashreplace")).hexdigest() for h, p, d in zip(part.column("host").to_pylist(), part.column("path").to_pylist(), digests, strict=True)]
                own = [main_text(x, None) if not every_page and is_decided(x) else None for x in found]
                yield part, found, [*zip(keys, digests, strict=True)], own

    def heads_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, names, own in slices(batches):
            marks = pa.array([b"".join(_marks(x)) for x in found], pa.binary())
            columns = [pa.array([d for _, d in names]), pa.array([k for k, _ in names]), pa.array(own, pa.string()), marks, pa.array([sum(_sizes(x)) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column(k) for k in range(5)] + columns, names=["page_id", "url", "host", "path", "part", "digest", "key", "own", "marks", "size"])

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, names, own in slices(batches):
            packed = pa.array([_pack(x) if text is None else None for x, text in zip(found, own, strict=True)], pa.binary())
            columns = [part.column(k) for k in (0, 1, 3, 4)] + [pa.array([k for k, _ in names]), packed]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "path", "part", "key", "lines"]).filter(packed.is_valid())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts, shared, restored, removed = [], [], [], []
                for x in part.select(["path", "lines", "other_path", "other_marks", "other_size"]).to_pylist():
                    lines, other = _unpack(x["lines"]), x["other_marks"]
                    deleted = [False] * len(lines)
                    if other is not None:
                        marks = [other[k : k + MARK] for k in range(0, len(other), MARK)]
                        deleted = shared_lines(_marks(lines), marks, _sizes(lines), x["other_size"], x["path"] == x["other_path"])
                    text, back, out = checked(lines, deleted)
                    texts, shared, restored, removed = [*texts, text], [*shared, sum(deleted)], [*restored, back], [*removed, out]
                found = [pa.array(x, pa.int64()) for x in (shared, restored, removed)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), part.column("other_id"), *found], names=["page_id", "url", "text", "neighbour_id", *numbers])

    url = F.coalesce(F.col(url_col), F.lit(""))
    source = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"),
        F.pmod(F.xxhash64(id_col, url_col, html_col), F.lit(PARTS)).cast("int").alias("part"),
        F.col(html_col).alias("html"),
    )
    heads = materialise(source.mapInArrow(heads_of, "page_id long, url string, host string, path string, part int, digest string, key string, own string, marks binary, size long"), "heads")
    decided = lambda df, other: df.select("page_id", "url", F.col("own").alias("text"), F.char_length("own").cast("long").alias("n_chars"), other.alias("neighbour_id"), *(F.lit(None).cast("long").alias(c) for c in numbers))
    undecided = heads.where("own IS NULL")
    if not every_page and undecided.isEmpty():
        return decided(heads, F.lit(None).cast("long"))
    near = heads if every_page else heads.join(undecided.select("host").distinct(), "host", "left_semi")
    reps = near.groupBy("key").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.first("digest").alias("digest"), F.min("page_id").alias("page_id"))
    pairs = materialise(_pairs(reps, near.count()), "pairs")
    # Many pages may have one partner, and one page many copies: both are dealt to parts. Lines are parsed again rather than stored.
    marks = near.groupBy("key").agg(F.first("path").alias("other_path"), F.first("marks").alias("other_marks"), F.first("size").alias("other_size")).withColumnRenamed("key", "other")
    known = lookup(undecided.select("key", "part").distinct().join(pairs, "key"), "other", marks).drop("other")
    lines = source.mapInArrow(lines_of, "page_id long, url string, path string, part int, key string, lines binary")
    compared = lines.join(known, ["key", "part"], "left").mapInArrow(compare, "page_id long, url string, text string, neighbour_id long, n_shared long, n_restored long, n_removed long")
    compared = compared.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "neighbour_id", *numbers)
    if every_page:
        return compared
    rest = heads.where("own IS NOT NULL").select("page_id", "url", "part", "key", "own")
    known = rest.select("key", "part").distinct().join(pairs, "key")
    return compared.unionByName(decided(rest.join(known, ["key", "part"], "left"), F.col("other_id")))
