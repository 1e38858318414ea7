"""Records from stored HTML pages.

S6 (shelf pages) needs nested element tests, so it parses in Python with the
standard library's ``html.parser`` inside a Python UDF: Spark partitions and
batches the pages, and each task parses only its own pages.
S7's flat link rows stay JVM-side with ``regexp_extract_all``.
"""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ranking import spread

# fixed values: shelf page layout (table id, row id prefix, cell classes),
# rows per page and the site prefix of book links
BOOKS_TABLE_ID = "books"
ROW_ID_PREFIX = "review_"
TITLE_CELL = "field title"
AUTHOR_CELL = "field author"
REVIEW_CELL = "field review"
VALUE_DIV = "value"
STARS_DIV = "stars"
PER_PAGE = 100
SITE = "https://books.example"

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def cls(self) -> str:
        return " ".join((self.attrs.get("class") or "").split())

    def has_class(self, name: str) -> bool:
        return name in (self.attrs.get("class") or "").split()

    def iter(self):
        """Elements below, in page order (no recursion: pages may nest deeply)."""
        todo = list(reversed(self.children))
        while todo:
            ch = todo.pop()
            if isinstance(ch, _Node):
                yield ch
                todo.extend(reversed(ch.children))

    def find(self, tag, pred=lambda n: True):
        return next((n for n in self.iter() if n.tag == tag and pred(n)), None)

    def text(self) -> str:
        """Every text piece stripped, empty pieces dropped, joined without separator."""
        out, todo = [], list(reversed(self.children))
        while todo:
            ch = todo.pop()
            if isinstance(ch, _Node):
                todo.extend(reversed(ch.children))
            elif ch.strip():
                out.append(ch.strip())
        return "".join(out)


class _TreeBuilder(HTMLParser):
    """A small DOM: closes void elements at once, treats a new ``tr``/``td``
    as closing the open one, and an end tag closes up to its matching open
    element (stray end tags are ignored)."""

    IMPLIED = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "p": ("p",), "li": ("li",),
               "option": ("option",)}
    # an implied end does not reach beyond these
    STOPS = {"p": ("div", "td", "th", "li", "table"), "li": ("ul", "ol", "table"), "option": ("select",)}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {}, None)
        self.cur = self.root

    def _close_to(self, tags, stop=("table",)):
        n = self.cur
        while n is not self.root and n.tag not in stop:
            if n.tag in tags:
                self.cur = n.parent
                return
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in self.IMPLIED:
            self._close_to(self.IMPLIED[tag] if tag != "tr" else ("tr",), self.STOPS.get(tag, ("table",)))
        node = _Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.cur)
        self.cur.children.append(node)
        if tag not in VOID:
            self.cur = node

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(_Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.cur))

    def handle_endtag(self, tag):
        n = self.cur
        while n is not self.root:
            if n.tag == tag:
                self.cur = n.parent
                return
            n = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


def _cell_link(row: _Node, cell_class: str):
    cell = row.find("td", lambda n: n.cls() == cell_class)
    div = cell.find("div", lambda n: n.cls() == VALUE_DIV) if cell else None
    return div.find("a") if div else None


def _rating(text: str) -> int | None:
    """An integer within 32 bits, else nothing."""
    try:
        n = int(text)
    except ValueError:
        return None
    return n if -(1 << 31) <= n < 1 << 31 else None


def shelf_page(html: str | None, site: str = SITE) -> tuple[int | None, list[tuple]]:
    """One shelf page, parsed once: its number of review rows (``None`` without
    a books table) and ``(row, title, author, book_url, rating, review)``.

    Only ``tr`` rows whose id starts with ``review_`` inside ``table#books``;
    rows without a title or an author are dropped; ``row`` counts every
    review row (the page size test uses it).
    """
    if not html:
        return None, []
    b = _TreeBuilder()
    b.feed(html)
    b.close()
    table = b.root.find("table", lambda n: n.attrs.get("id") == BOOKS_TABLE_ID)
    if table is None:
        return None, []
    out = []
    rows = [n for n in table.iter() if n.tag == "tr" and (n.attrs.get("id") or "").startswith(ROW_ID_PREFIX)]
    for i, row in enumerate(rows, start=1):
        link = _cell_link(row, TITLE_CELL)
        title = link.text() if link is not None else None
        url = site + link.attrs["href"] if link is not None and "href" in link.attrs else None
        alink = _cell_link(row, AUTHOR_CELL)
        author = alink.text() if alink is not None else None
        stars = row.find("div", lambda n: n.has_class(STARS_DIV))
        rating = None
        if stars is not None and "data-rating" in stars.attrs:
            rating = _rating(stars.attrs["data-rating"])
        rcell = row.find("td", lambda n: n.cls() == REVIEW_CELL)
        rdiv = rcell.find("div", lambda n: n.cls() == VALUE_DIV) if rcell else None
        review = (rdiv.text() or None) if rdiv is not None else None
        if title and author:
            out.append((i, title, author, url, rating, review))
    return len(rows), out


def parse_shelf_page(html: str | None, site: str = SITE) -> list[tuple]:
    """The rows of ``shelf_page``."""
    return shelf_page(html, site)[1]


def count_review_rows(html: str | None) -> int | None:
    """The row count of ``shelf_page``."""
    return shelf_page(html)[0]


_ROWS = ("array<struct<row:long,title:string,author:string,book_url:string,rating:int,review:string>>")


_PAGE = f"n_rows int, rows {_ROWS}, error string"
_PARSED = f"user_id string, page long, {_PAGE}"
_BOOK = pa.struct([("row", pa.int64()), ("title", pa.string()), ("author", pa.string()), ("book_url", pa.string()), ("rating", pa.int32()),
                   ("review", pa.string())])
_PARSED_ARROW = pa.schema([("user_id", pa.string()), ("page", pa.int64()), ("n_rows", pa.int32()), ("rows", pa.list_(_BOOK)), ("error", pa.string())])
_NAMES = ("row", "title", "author", "book_url", "rating", "review")
# pages a worker holds parsed at once
PARSED_AT_ONCE = 64


def _page_parser(site: str):
    def parsed(html: str | None) -> tuple[int | None, list[tuple], str | None]:
        """Row count, rows and error of a page."""
        try:
            return *shelf_page(html, site), None
        except Exception as e:  # noqa: BLE001 - recorded per page
            return None, [], f"{type(e).__name__}: {e}"
    return parsed


def _parser(site: str, per_page: int):
    """Parse pages in the order they come; a user's pages after an unfull one are left out unparsed."""
    parsed = _page_parser(site)

    def parse(batches):
        stopped = None
        for batch in batches:
            for at in range(0, batch.num_rows, PARSED_AT_ONCE):
                users, pages, texts = (c.to_pylist() for c in batch.slice(at, PARSED_AT_ONCE).columns)
                kept = []
                for user, page, html in zip(users, pages, texts):
                    if user is not None and user == stopped:
                        continue
                    n, found, error = parsed(html)
                    stopped = user if n is None or n < per_page else None
                    kept.append({"user_id": user, "page": page, "n_rows": n, "rows": [dict(zip(_NAMES, r)) for r in found], "error": error})
                yield pa.RecordBatch.from_pylist(kept, _PARSED_ARROW)
    return parse


def parse_pages(pages: DataFrame, site: str = SITE) -> DataFrame:
    """S6 + W5 input in one pass: ``(user_id, page, n_rows, rows, error)`` per page.

    A page that cannot be parsed keeps its place, with no rows, a null count
    and the reason in ``error``; it never fails the job.  Pages reach a worker a
    hundred at a time (a plain UDF; Arrow batches would hold 10,000 of them).
    """
    pages = spread(pages.select("user_id", F.col("page").cast("long").alias("page"), "html"), "user_id", "page")
    # not deterministic: a plan never parses a page twice
    parse = F.udf(_page_parser(site), _PAGE, useArrow=False).asNondeterministic()
    return (pages.select(F.col("user_id").cast("string").alias("user_id"), "page", parse("html").alias("_p"))
            .select("user_id", "page", "_p.n_rows", "_p.rows", "_p.error"))


def parse_until_short(pages: DataFrame, per_page: int, site: str = SITE, slice_pages: int = 64) -> DataFrame:
    """As ``parse_pages``, reading each user's pages in order and stopping at an unfull one.

    A user's pages are cut into slices of ``slice_pages`` pages, which are read
    by separate tasks; inside a slice nothing behind the stop is parsed.
    """
    part = F.floor(F.col("page") / slice_pages)
    dealt = (pages.select(F.col("user_id").cast("string").alias("user_id"), F.col("page").cast("long").alias("page"), "html")
             .repartition(F.col("user_id"), part).sortWithinPartitions("user_id", "page"))
    return dealt.mapInArrow(_parser(site, per_page), _PARSED)


def shelf_rows(parsed: DataFrame, per_page: int = PER_PAGE) -> DataFrame:
    """Book rows of parsed pages; ``position = (page - 1) * per_page + row`` keeps
    the list order across pages (null without a page number)."""
    return parsed.select("user_id", "page", F.explode("rows").alias("r")).select(
        "user_id", "page", "r.row", ((F.col("page") - 1) * per_page + F.col("r.row")).alias("position"),
        "r.title", "r.author", "r.book_url", "r.rating", "r.review")


def extract_shelf(pages: DataFrame, site: str = SITE, per_page: int = PER_PAGE) -> DataFrame:
    """Shelf rows from ``(user_id, page, html)`` pages."""
    return shelf_rows(parse_pages(pages, site), per_page)


def page_row_counts(pages: DataFrame) -> DataFrame:
    """Review rows per page (null when the page has no books table), for W5."""
    return parse_pages(pages).select("user_id", "page", "n_rows")


@dataclass(frozen=True)
class ElementSpec:
    """Which elements of a page become rows.

    ``tag`` of the element, the ``attrs`` to return, and optionally the tag and
    class of an element it must lie in.
    """
    tag: str
    attrs: tuple[str, ...] = ()
    inside: str | None = None
    inside_class: str | None = None


def extract_elements(pages: DataFrame, spec: ElementSpec, key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, pos, <attrs>, text)`` per matching element, in page order.

    Quotes, other attributes, nesting and unclosed elements are handled by the
    parser; a page that cannot be parsed gives one row with ``pos`` 0 and the
    reason in ``error``.
    """
    base = spread(pages.select(key, F.col(html).alias("html")), key)
    schema = T.StructType([base.schema[key], T.StructField("pos", T.LongType()),
                           *[T.StructField(a, T.StringType()) for a in spec.attrs],
                           T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])

    def rows(page: str | None):
        b = _TreeBuilder()
        b.feed(page or "")
        b.close()
        pos = 0
        for n in b.root.iter():
            if n.tag != spec.tag or not _lies_in(n, spec):
                continue
            pos += 1
            yield (pos, *[n.attrs.get(a) for a in spec.attrs], n.text(), None)

    def extract(batches):
        for pdf in batches:
            out = []
            for k, page in zip(pdf[key].tolist(), pdf["html"]):
                try:
                    out += [(k, *r) for r in rows(page)]
                except Exception as e:  # noqa: BLE001 - recorded per page
                    out.append((k, 0, *[None] * len(spec.attrs), None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame.from_records(out, columns=schema.fieldNames())

    return base.mapInPandas(extract, schema)


def _lies_in(n: _Node, spec: ElementSpec) -> bool:
    if spec.inside is None:
        return True
    up = n.parent
    while up is not None:
        if up.tag == spec.inside and (spec.inside_class is None or up.has_class(spec.inside_class)):
            return True
        up = up.parent
    return False


# fixed value: a navigation link item as the pages render it
LINK_PATTERN = r'<li><a href="([^"]*)">([^<]*)</a>'


def extract_links(pages: DataFrame, key: str = "page_id", html: str = "html",
                  pattern: str = LINK_PATTERN) -> DataFrame:
    """S7 (flat form): repeated ``(href, text)`` items per page, in page order."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(pattern), 1)
    texts = F.regexp_extract_all(F.col(html), F.lit(pattern), 2)
    z = pages.select(key, F.arrays_zip(hrefs.alias("href"), texts.alias("text")).alias("_z"))
    return z.select(key, F.posexplode("_z").alias("pos", "_e")) \
            .select(key, (F.col("pos") + 1).alias("pos"), F.col("_e.href").alias("href"), F.col("_e.text").alias("text"))
