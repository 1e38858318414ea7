"""Text helpers: Unicode strip, tag normalisation and validation (F1-F3),
null defaults (F7), safe integer parse (F8), excerpt (F9), links (F6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tag rules (strip Unicode white space, drop one leading '#';
# letters, digits and underscore only, at least one letter or digit)
STRIP_PATTERN = r"^(?U)\s+|(?U)\s+$"
HASH_PREFIX = r"^#"
TAG_CHARS = r"^[\p{L}\p{N}_]+$"
TAG_HAS_ALNUM = r"[\p{L}\p{N}]"
# fixed value: review excerpt length
EXCERPT_CHARS = 200
# fixed value: placeholder for a missing count in a brief
MISSING = "N/A"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """Strip Unicode white space on both sides (plain ``trim`` only drops spaces)."""
    return F.regexp_replace(_c(c), STRIP_PATTERN, "")


def normalize_tag(raw) -> Column:
    """stripped, with at most one leading '#' removed."""
    return F.regexp_replace(ustrip(raw), HASH_PREFIX, "")


def valid_tag(tag) -> Column:
    """F2: letters/digits/underscore and at least one letter or digit."""
    t = _c(tag)
    return t.rlike(TAG_CHARS) & t.rlike(TAG_HAS_ALNUM)


def fold(c) -> Column:
    """case fold used for every comparison."""
    return F.lower(_c(c))


def safe_int(c, default=None) -> Column:
    """F8: integer or ``default`` when the text does not parse."""
    v = F.expr(f"try_cast({c} AS INT)") if isinstance(c, str) else _c(c).try_cast("int")
    return v if default is None else F.coalesce(v, F.lit(default))


def excerpt(c, n: int = EXCERPT_CHARS) -> Column:
    """first ``n`` characters."""
    return F.substring(_c(c), 1, n)


def post_link(code, prefix: str) -> Column:
    """link of a post from its short code."""
    return F.concat(F.lit(prefix), _c(code), F.lit("/"))


def or_missing(c) -> Column:
    """text of a value, ``N/A`` when null."""
    return F.coalesce(_c(c).cast("string"), F.lit(MISSING))


def contains_any(text, terms) -> Column:
    """True when any of ``terms`` (already lower-case) occurs in lower(text)."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    out = F.lit(False)
    for term in terms:
        out = out | t.contains(F.lit(term))
    return out
