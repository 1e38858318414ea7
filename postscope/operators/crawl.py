"""The crawl prefix of paged shelves.

A shelf is read page by page until a page has fewer than ``per_page`` rows
(that page is still kept) or the page is unusable (no table, no rows, failed
fetch: null count).  Over known counts this is a set operation: the first
stopping page per user is a partial aggregate; pages up to and including it are
kept (``crawl_prefix``).  Over pages still to be parsed, ``crawl_shelf`` reads
in waves that double, so that pages behind the stop are left unparsed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.html import PER_PAGE, SITE, parse_pages, parse_until_short, shelf_rows


def crawl_prefix(pages: DataFrame, per_page: int = PER_PAGE, user: str = "user_id",
                 page: str = "page", n_rows: str = "n_rows") -> DataFrame:
    stop = F.col(n_rows).isNull() | (F.col(n_rows) < per_page)
    first_stop = (pages.filter(stop).groupBy(user).agg(F.min(page).alias("_stop")))
    return (pages.join(first_stop, user, "left")
            .filter(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop")))
            .drop("_stop"))


def crawl_waves(pages: DataFrame, site: str = SITE, per_page: int = PER_PAGE, first: int = 4) -> DataFrame:
    """The parsed pages a crawl would have read, as ``parse_pages`` gives them.

    Wave k reads the pages from ``first * 2**(k - 1)`` up to twice that, of the
    shelves that have not stopped, and stores them; a shelf of n pages takes
    about log2(n) waves, and a stop found in one wave closes the shelf for the
    next.  Inside a wave a shelf's pages are read in order, in slices, and those
    behind its stop are not parsed.  Shelves without an owner id never stop, as
    in ``crawl_prefix``; pages without a number are read last, and kept where no
    page stopped the shelf.  Only the number of waves depends on the driver.
    """
    spark = pages.sparkSession
    pages = pages.select("user_id", F.col("page").cast("long").alias("page"), "html")
    path = scratch_path(spark, "parsed-waves")
    last = pages.agg(F.max("page")).first()[0]
    schema = None

    def stored() -> DataFrame:
        return spark.read.schema(schema).parquet(path)

    def still_open(some: DataFrame) -> DataFrame:
        if schema is None:
            return some
        done = stored().filter(F.col("n_rows").isNull() | (F.col("n_rows") < per_page)).select("user_id").distinct()
        return some.join(done, "user_id", "left_anti")

    low, high = None, first
    while last is not None and (low is None or low <= last):
        wave = pages.filter(F.col("page") < high)
        if low is not None:
            wave = wave.filter(F.col("page") >= low)
        parsed = parse_until_short(still_open(wave), per_page, site)
        parsed.write.mode("append").parquet(path)
        schema = parsed.schema
        low, high = high, 2 * high
    rest = parse_pages(still_open(pages.filter(F.col("page").isNull())), site)
    return rest if schema is None else crawl_prefix(stored(), per_page).unionByName(rest)


def crawl_shelf(pages: DataFrame, site: str = SITE, per_page: int = PER_PAGE) -> DataFrame:
    """S6 + W5: the book rows of the pages a crawl would have read."""
    return shelf_rows(crawl_waves(pages, site, per_page), per_page)
