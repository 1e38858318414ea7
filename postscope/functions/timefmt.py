"""time as ISO text and calendar dates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: ISO text form of a logged timestamp (microseconds always shown)
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def iso_text(ts) -> Column:
    """timestamp -> ISO text as the log stores it."""
    return F.date_format(_c(ts), ISO_FORMAT)


def date_text(timestamp_text) -> Column:
    """calendar date of an ISO text timestamp (first ten characters)."""
    return F.substring(_c(timestamp_text), 1, 10)


def parse_iso(timestamp_text) -> Column:
    """ISO text (with or without fraction) -> timestamp_ntz."""
    return F.to_timestamp_ntz(F.regexp_replace(_c(timestamp_text), "T", " "))
