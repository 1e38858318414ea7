"""P13/O5 helpers: reproducible hash draws (no rand(), no clock)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_hex(key, seed) -> Column:
    """md5 of ``key|seed`` as hex text."""
    return F.md5(F.concat(_c(key).cast("string"), F.lit("|"), F.lit(str(seed))))


def seeded_bucket(key, seed, modulo: int = 100) -> Column:
    """First 8 hex digits of md5(key|seed) as an integer, modulo ``modulo``."""
    return F.conv(F.substring(seeded_hex(key, seed), 1, 8), 16, 10).cast("bigint") % F.lit(modulo)
