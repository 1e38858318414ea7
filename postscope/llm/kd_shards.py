"""Shards of near-equal bytes from a k-d tree over document metadata.

Equal texts are aggregated to one unit first (its bytes are its weight), so
copies stay together; only a group of copies that does not fit into one shard is
cut, into parts of ``PART_SHARE`` of a shard.  The units are split at
weighted medians, again and again, along the dimension that is widest in the
node: text size (log scale), source and language (categories, placed by a hash).
Ties in a dimension are ordered by a hash of the unit, so a cut goes through a
value that many units share.

A median is found by radix search: three grouped sums of 2,048 bins narrow a
33-bit key to the exact cut, for all nodes of a level at once.  Only these sums
and the nodes' extents reach the driver.  DataFrame operations only.

Defined cases: a null text has size 1 and crc32 0, like an empty one; null
metadata is a category of its own; repeated rows are separate rows; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import bucketed_row_number
from .common import pick, staged

PART_SHARE = 0.05
CODE_BITS, TIE_BITS, RADIX = 12, 21, 11
DIMENSIONS = ("by_size", "by_source", "by_lang")


def _category(c: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(c.cast("string"), F.lit(""))), F.lit(1 << CODE_BITS))


def _key(dim: str) -> Column:
    return F.shiftleft(F.col(dim), TIE_BITS).bitwiseOR(F.col("tie"))


def _cuts(units: DataFrame, choice: dict[int, str]) -> dict[int, int]:
    """Per node the last key of its lower half, by weight."""
    key = F.lit(None).cast("long")
    for node, dim in choice.items():
        key = F.when(F.col("node") == node, _key(dim)).otherwise(key)
    keyed = units.select("node", key.alias("key"), "bytes")
    prefix = {n: 0 for n in choice}          # bits found so far
    before = {n: 0 for n in choice}          # weight below the prefix
    half: dict[int, float] = {}
    bits = CODE_BITS + TIE_BITS
    for done in range(RADIX, bits + 1, RADIX):
        at_prefix = F.lit(False)
        for n in choice:
            same = F.col("node") == n
            if done > RADIX:
                same = same & (F.shiftright("key", bits - done + RADIX) == prefix[n])
            at_prefix = at_prefix | same
        sums = (keyed.filter(at_prefix).groupBy("node", F.shiftright("key", bits - done).alias("bin"))
                .agg(F.sum("bytes").alias("bytes")).collect())      # at most nodes * 2,048 rows
        for n in choice:
            mine = sorted((r["bin"], r["bytes"]) for r in sums if r["node"] == n)
            if done == RADIX:
                half[n] = sum(b for _, b in mine) / 2
            for b, w in mine:
                prefix[n] = b
                if before[n] + w >= half[n]:
                    break
                before[n] += w
            if done == bits and len(mine) and half[n] - before[n] < before[n] + dict(mine)[prefix[n]] - half[n]:
                prefix[n] -= 1               # the cut before this key is nearer to the half
    return prefix


def shard(docs: DataFrame, shards: int = 8, target_bytes: int | None = None, doc_id: str = "doc_id",
          text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): one row per document.

    The tree has ``shards`` leaves (a power of two), or as many levels as
    leaves of ``target_bytes`` need.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = pick(docs, doc_id=doc_id, text=text, source=source, lang=lang)
    rows = staged(d.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("h"), _category(F.col("source")).alias("source"), _category(F.col("lang")).alias("lang")),
        "kd-rows")
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if target_bytes:
        shards = 1
        while shards * target_bytes < total:
            shards *= 2
    same = ["h", "text_crc32", "size"]
    fits, part = max(1.0, total / shards), max(1.0, PART_SHARE * total / shards)
    # fewer than ``shards`` groups; stored, so that a hot group's side of the join can be split
    large = staged(rows.groupBy(*same).agg(F.sum("size").alias("b")).filter(F.col("b") > fits)
                   .select(*same, F.ceil(F.col("b") / part).cast("long").alias("parts")), "kd-large")
    parted = rows.join(large, same, "left").select(
        *rows.columns, F.coalesce(F.pmod(F.xxhash64("rid"), F.col("parts")), F.lit(0)).alias("part"))
    units = staged(parted.groupBy(*same, "part").agg(
        F.sum("size").alias("bytes"), F.min("source").alias("by_source"), F.min("lang").alias("by_lang")).select(
        *same, "part", "bytes", "by_source", "by_lang",
        F.least(F.lit((1 << CODE_BITS) - 1), F.floor(F.log2("size") * 96)).cast("long").alias("by_size"),
        F.pmod(F.xxhash64(*same, "part"), F.lit(1 << TIE_BITS)).alias("tie")), "kd-units")
    node: Column = F.lit(0)
    extent: dict[str, float] = {}
    width = 1
    while width < shards:
        at = units.withColumn("node", node)
        spans = at.groupBy("node").agg(*[(F.max(c) - F.min(c)).alias(c) for c in DIMENSIONS]).collect()
        if not spans:
            break
        extent = extent or {c: max(1, spans[0][c]) for c in DIMENSIONS}
        choice = {r["node"]: max(DIMENSIONS, key=lambda c: r[c] / extent[c]) for r in spans}
        below = node * 2 + 1
        for n, cut in _cuts(at, choice).items():
            below = F.when(node == n, node * 2 + (_key(choice[n]) > cut).cast("int")).otherwise(below)
        # a stored level keeps the expressions short
        units = staged(units.withColumn("leaf", below.cast("int")), "kd-level")
        units = units.withColumnRenamed("leaf", f"leaf{width}")
        node = F.col(f"leaf{width}")
        width *= 2
    placed = parted.join(units.select(*same, "part", node.cast("int").alias("shard")), [*same, "part"])
    buckets = max(64, n_rows // (shards * 100_000))
    return bucketed_row_number(
        placed.select("rid", "doc_id", "size", "text_crc32", "shard"), ["shard"],
        F.pmod(F.xxhash64("rid"), F.lit(buckets)), ["rid"], "slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).cast("long").alias("slot"))
