"""The append-only action log stored as parquet partitioned by date."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..files import Folder
from ..functions.timefmt import iso_text, parse_iso
from ..schemas import ACTION_COLUMNS, ACTIONS, ACTIONS_V1

PARTITION_COLUMN = "date"


def with_date(df: DataFrame) -> DataFrame:
    """Add the ``date`` partition column from the typed timestamp."""
    return df.withColumn(PARTITION_COLUMN, F.to_date("ts"))


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """Scan a stored log with its explicit schema.

    No footer is merged or sampled: files written before ``post_link`` existed
    read back with null there, whichever version was written first.  A log that
    stores the ISO text only gets its typed time from the text.  Filters on
    ``date`` prune partitions, filters on ``ts`` reach the scan of typed logs.
    """
    schema = T.StructType([*ACTIONS.fields, T.StructField(PARTITION_COLUMN, T.DateType(), True)])
    log = spark.read.schema(schema).parquet(path)
    if BATCH_COLUMN in log.columns:
        for hidden in _hidden(Folder(spark, path)):
            log = log.filter(hidden)
    return log.select(*schema.names)


def read_actions_iso(spark: SparkSession, path: str) -> DataFrame:
    """S1 for a log without a typed time (the reference's own table): ``ts`` from the ISO text."""
    log = read_actions(spark, path)
    return log.withColumn("ts", F.coalesce("ts", parse_iso("timestamp")))


def stamp(df: DataFrame, now_col=None) -> DataFrame:
    """Fill ``ts``/``timestamp`` for new rows: the given instant column, else
    the batch's current UTC time (the only place a clock is read)."""
    ts = now_col if now_col is not None else F.current_timestamp().cast("timestamp_ntz")
    out = df.withColumn("ts", F.coalesce(F.col("ts"), ts)) if "ts" in df.columns else df.withColumn("ts", ts)
    return out.withColumn("timestamp", F.coalesce(F.col("timestamp"), iso_text("ts"))
                          if "timestamp" in df.columns else iso_text("ts"))


def append_actions(df: DataFrame, path: str, batch: str | None = None) -> bool:
    """Append a batch of actions, creating the log when missing.

    One write job per batch; files land in ``date=...`` folders so later
    scans prune by day.  Only the log's columns are written; rows without a
    time get the batch's UTC time (``stamp``).

    With ``batch`` (a name of letters, digits, ``-`` and ``_``) the append is
    committed once: the files stand in ``date=.../batch=<name>``, a batch that
    was committed is not written again (the result is False), one that was cut
    off is written anew, and readers do not see it until it is whole.  A log is
    written either with batch names or without.
    """
    df = stamp(df)
    cols = [F.col(c).cast(ACTIONS[c].dataType) if c in df.columns
            else F.lit(None).cast(ACTIONS[c].dataType).alias(c) for c in ACTION_COLUMNS]
    out = with_date(df.select(*cols))
    if batch is None:
        out.write.mode("append").partitionBy(PARTITION_COLUMN).parquet(path)
        return True
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError(f"batch name {batch!r}")
    log = Folder(df.sparkSession, path)
    if log.exists(f"{_DONE}/{batch}"):
        log.remove(f"{_OPEN}/{batch}")
        return False
    _drop_batch(log, batch)                 # what a cut-off run may have left
    log.write_text(f"{_OPEN}/{batch}", "")
    _put_batch(out, path, batch)
    log.write_text(f"{_DONE}/{batch}", "")
    log.remove(f"{_OPEN}/{batch}")
    return True


BATCH_COLUMN = "batch"
# marks of a log with batch names: being written, committed, days whose batches are being joined
_OPEN, _DONE, _JOINED = "_open", "_batches", "_joined"


def _put_batch(out: DataFrame, path: str, batch: str) -> None:
    (out.withColumn(BATCH_COLUMN, F.lit(batch)).write.mode("append").partitionBy(PARTITION_COLUMN, BATCH_COLUMN).parquet(path))


def _drop_batch(log: Folder, batch: str) -> None:
    if log.exists(f"{_OPEN}/{batch}"):
        for day in log.names():
            if day.startswith(f"{PARTITION_COLUMN}="):
                log.remove(f"{day}/{BATCH_COLUMN}={batch}")


def _joins(log: Folder) -> list[dict]:
    return [json.loads(log.read_text(f"{_JOINED}/{n}")) for n in log.names(_JOINED) if not n.startswith("_")]


def _hidden(log: Folder) -> list[Column]:
    """Conditions for what readers see: no batch being written, and of a day being joined one form only."""
    joins = _joins(log)
    out = []
    half = sorted({n for n in log.names(_OPEN) if not n.startswith("_")} - {j["into"] for j in joins})
    if half:
        out.append(~F.col(BATCH_COLUMN).isin(half))
    out += [~((F.col(PARTITION_COLUMN) == F.lit(j["day"]).cast("date")) & F.col(BATCH_COLUMN).isin(j["of"])) for j in joins]
    return out


def _finish_joins(log: Folder) -> None:
    for j in _joins(log):
        for old in j["of"]:
            log.remove(f"{PARTITION_COLUMN}={j['day']}/{BATCH_COLUMN}={old}")
        log.remove(f"{_OPEN}/{j['into']}")
        log.remove(f"{_JOINED}/{j['into']}")


def compact_day(spark: SparkSession, path: str, day: str, files: int = 1) -> int:
    """Join a day's batches (``day`` as ``yyyy-MM-dd``) into ``files`` files; returns how many were joined.

    The joined files become visible, and the old ones invisible, by one mark;
    only then the old ones go.  A run that was cut off is finished, or its
    half-written files dropped, by the next one.  Names of committed batches
    stay known, so a batch that was joined is still not written again.
    """
    log = Folder(spark, path)
    _finish_joins(log)
    half = set(log.names(_OPEN))
    there = [n.removeprefix(f"{BATCH_COLUMN}=") for n in log.names(f"{PARTITION_COLUMN}={day}") if n.startswith(f"{BATCH_COLUMN}=")]
    for n in [n for n in there if n in half and n.startswith("joined-")]:
        log.remove(f"{PARTITION_COLUMN}={day}/{BATCH_COLUMN}={n}")
    old = [n for n in there if n not in half]
    if len(old) < 2:
        return 0
    into = f"joined-{uuid.uuid4().hex[:12]}"
    rows = read_actions(spark, path).filter(F.col(PARTITION_COLUMN) == F.lit(day).cast("date"))
    log.write_text(f"{_OPEN}/{into}", "")
    _put_batch(rows.coalesce(files), path, into)
    log.write_text(f"{_JOINED}/{into}", json.dumps({"day": day, "into": into, "of": old}))
    _finish_joins(log)
    return len(old)


def save_history(actions: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """What was done to which post, as a table bucketed by account and post.

    The history tests (``screening.not_yet``, ``already``, ``done_flags``) take
    the result as their log: each bucket of it meets its posts without moving
    the log.  A later batch of actions is added by the same call (it may repeat
    rows).  Ids are stored as text, as the tests compare them.
    """
    rows = (actions.filter(F.col("media_id").isNotNull())
            .select(*[F.col(c).cast("string").alias(c) for c in ("account", "media_id", "action_type")]).distinct())
    writer = (rows.repartition(buckets, "account", "media_id").write.mode("append").format("parquet")
              .bucketBy(buckets, "account", "media_id").sortBy("account", "media_id"))
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return actions.sparkSession.table(table)


def union_evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Combine a log written before ``post_link`` existed with a newer one."""
    return old.unionByName(new, allowMissingColumns=True)


def v1_projection(df: DataFrame) -> DataFrame:
    """The log as the first schema version wrote it (no ``post_link``)."""
    return df.select(*[f.name for f in ACTIONS_V1.fields], *([PARTITION_COLUMN] if PARTITION_COLUMN in df.columns else []))
