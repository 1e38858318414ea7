"""T1-T3 over an action stream.

T1 is a stateful query: a watermark, ids dropped that were seen before, and
counts per day and type in the state store.  The state holds the days (and the
ids) that are not older than the delay, a batch costs what its rows cost, and
rows behind the watermark go to an output of their own.  T2 keeps the first row
per key for ever, as parts folded into a snapshot.  T3 stores rows by day,
decides a day once it has closed, and carries what was accepted into the days
after it.

Every write is keyed by the batch id, so a replayed batch changes nothing.
Sinks and checkpoints live under the session's shared checkpoint folder; every
run here uses ``availableNow``: a job drains what is there and stops, and a
restarted job resumes from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..files import Folder
from ..operators.quota import quota_over_days, with_history
from ..session import scratch_path
from .store import Marks, MergedTable


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table; empty while its folder does not exist (any other error is raised)."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run ``write`` on every available micro-batch, then stop."""
    q = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def _put(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


# ---- T1 -------------------------------------------------------------------

_COUNTS = T.StructType([T.StructField("date", T.DateType()), T.StructField("action_type", T.StringType()),
                        T.StructField("count", T.LongType())])
_LATE = T.StructType([T.StructField("id", T.LongType()), T.StructField("action_type", T.StringType()),
                      T.StructField("at", T.TimestampType())])
_EPOCH_MS = 0


class DailyCounts:
    """Live counts per day and type, each ``id`` once, while a day is open.

    A day is open until a row ``delay_days`` past its end has been seen; its
    counts come in update mode, so every batch stores the days it changed and
    the largest count is the latest.  Rows at or behind the watermark are not
    counted: ``late`` has them (also those that repeat a counted row).  Rows
    without a time are neither.
    """

    def __init__(self, spark: SparkSession, path: str, delay_days: int = 1):
        self.spark, self.path, self.delay_days = spark, path, delay_days
        self.counts = MergedTable(spark, f"{path}/counts", _COUNTS,
                                  lambda rows: rows.groupBy("date", "action_type").agg(F.max("count").alias("count")))
        self.marks = Marks(spark, f"{path}/marks")

    def drain(self, stream: DataFrame, checkpoint: str) -> DailyCounts:
        rows = stream.select("id", F.col("ts").cast("timestamp").alias("at"), "action_type")
        none = F.lit(None).cast("long")
        days = (rows.withWatermark("at", f"{self.delay_days} days").dropDuplicatesWithinWatermark(["id"])
                .groupBy(F.window("at", "1 day").alias("day"), "action_type").count()
                .select(F.lit(True).alias("counted"), F.col("day.start").alias("at"), "action_type", "count", none.alias("id")))
        # the rows themselves, in the same batch: those behind the watermark are stored apart
        seen = rows.select(F.lit(False).alias("counted"), "at", "action_type", none.alias("count"), "id")

        def write(batch: DataFrame, batch_id: int) -> None:
            # the watermark of a batch comes from the batches before it
            mark = self.marks.before(batch_id)
            latest, behind = mark.get("latest", _EPOCH_MS), mark.get("watermark", _EPOCH_MS)
            late = ~F.col("counted") & (F.col("at") <= F.timestamp_millis(F.lit(behind).cast("long")))
            top = Observation()
            part = f"{self.path}/parts/batch_id={batch_id}"
            (batch.observe(top, F.max(F.when(~F.col("counted"), F.unix_millis("at"))).alias("latest"))
             .filter(F.col("counted") | late).write.mode("overwrite").parquet(part))
            found = self.spark.read.schema(batch.schema).parquet(part)
            self.counts.put(found.filter("counted").select(F.to_date("at").alias("date"), "action_type", "count"), batch_id)
            _put(found.filter("not counted").select("id", "action_type", "at"), f"{self.path}/late", batch_id)
            Folder(self.spark, f"{self.path}/parts").remove(f"batch_id={batch_id}")
            latest = max(latest, top.get["latest"] or _EPOCH_MS)
            self.marks.put(batch_id, {"latest": latest, "watermark": max(behind, latest - self.delay_days * 86_400_000)})

        drain(days.unionByName(seen), write, checkpoint, "update")
        return self

    def read(self) -> DataFrame:
        """date, action_type, count, ``closed`` (its count is final)."""
        behind = F.timestamp_millis(F.lit(self.marks.last()[1].get("watermark", _EPOCH_MS)).cast("long"))
        return self.counts.read().select(
            F.date_format("date", "yyyy-MM-dd").alias("date"), "action_type", "count",
            (F.date_add("date", 1).cast("timestamp") <= behind).alias("closed"))

    def late(self) -> DataFrame:
        return stored(self.spark, f"{self.path}/late", _LATE).select("id", "action_type", "at")


def stream_daily_counts(stream: DataFrame, path: str, checkpoint: str, delay_days: int = 1) -> DataFrame:
    """T1 as one run: drains the stream and returns the counts (open days included)."""
    return DailyCounts(stream.sparkSession, path, delay_days).drain(stream, checkpoint).read()


# ---- T2 -------------------------------------------------------------------

KEYS = ("account", "media_id", "action_type")


def first_actions(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str] = KEYS, every: int = 16) -> MergedTable:
    """The table behind T2: per key the least (``ts``, ``id``); rows without a post id all stay."""
    keys = list(keys)

    def first(rows: DataFrame) -> DataFrame:
        at = F.min(F.struct("ts", "id")).alias("at")
        return (rows.filter(F.col("media_id").isNotNull()).groupBy(*keys).agg(at).select(*keys, "at.ts", "at.id")
                .unionByName(rows.filter(F.col("media_id").isNull()).select(*keys, "ts", "id").distinct()))
    return MergedTable(spark, path, T.StructType([schema[c] for c in (*keys, "ts", "id")]), first, every)


def stream_first_action(stream: DataFrame, path: str, checkpoint: str, history: DataFrame | None = None,
                        keys: Sequence[str] = KEYS, every: int = 16) -> DataFrame:
    """The first row (``ts``, then ``id``) per account, post and type, for ever.

    Each batch stores its first row per key, and parts are folded into a
    snapshot, so a read costs one snapshot and fewer than ``every`` parts.
    Keys that ``history`` (the stored log) already has are dropped on read.
    """
    keys = list(keys)
    table = first_actions(stream.sparkSession, path, stream.schema, keys, every)
    drain(stream, lambda batch, batch_id: table.put(table.merge(batch.select(*keys, "ts", "id")), batch_id), checkpoint)
    first = table.read()
    if history is None:
        return first
    known = first.filter(F.col("media_id").isNotNull()).join(history.select(*keys).distinct(), keys, "left_anti")
    return known.select(*keys, "ts", "id").unionByName(first.filter(F.col("media_id").isNull()).select(*keys, "ts", "id"))


# ---- T3 -------------------------------------------------------------------

class QuotaJob:
    """The quota (W3) over a stream, with memory across days.

    Rows are stored by day.  A day is decided once a row ``delay_days`` past it
    has been seen, from that day's stored rows, the history, and the posts that
    the account has had accepted on earlier days.  Rows for a day that was
    already decided go to ``too_late``.  A decided day's rows are removed one
    batch later; what is kept for ever is what was accepted.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, cap: int, by: Sequence[str] = ("account", "date"),
                 history: DataFrame | None = None, delay_days: int = 10, post: str = "media_id"):
        self.spark, self.path, self.schema, self.cap, self.history = spark, path, schema, cap, history
        self.run, self.day, self.post, self.delay_days = [c for c in by if c != "date"], "date", post, delay_days
        self.marks = Marks(spark, f"{path}/marks")
        # accepted rows are never changed, so folding only joins files
        self.accepted = MergedTable(spark, f"{path}/accepted", schema, lambda rows: rows.dropDuplicates(["id", "date"]))
        self._pending = Folder(spark, f"{path}/pending")

    def _days(self, upto: str) -> list[str]:
        days = (n.removeprefix("date=") for n in self._pending.names() if n.startswith("date="))
        return [d for d in days if d <= upto]

    def _decide(self, part: int, after: str, upto: str) -> None:
        days = [d for d in self._days(upto) if d > after]
        if not days:
            return
        rows = (self.spark.read.schema(self.schema).option("basePath", self._pending.path)
                .parquet(*[f"{self._pending.path}/date={d}" for d in days])
                .select(*self.schema.names).distinct())      # a row that came twice counts once
        keys = [*self.run, self.post]
        done = self.accepted.read().filter(F.col("date") <= after).select(*keys)
        rows = with_history(rows, done, post=self.post, by=self.run, null_safe=True)
        if self.history is not None:
            rows = with_history(rows, self.history.select(*keys), post=self.post, out="_before", by=self.run)
            rows = rows.withColumn("h", F.col("h") | F.col("_before")).drop("_before")
        out = quota_over_days(rows, self.cap, self.run, self.day, post=self.post, days=len(days))
        self.accepted.put(out.filter("accepted").select(*self.schema.names), part)

    def _write(self, batch: DataFrame, batch_id: int) -> None:
        mark = self.marks.before(2 * batch_id)
        closed, latest = mark.get("closed", ""), mark.get("latest", "")
        for d in self._days(closed):            # decided by an earlier batch, whose mark is stored
            self._pending.remove(f"date={d}")
        batch = batch.persist()
        try:
            top, late = batch.agg(F.max("date"), F.count_if(F.col("date") <= closed)).first()
            # a file per batch and day: a replay overwrites its own files only
            (batch.filter(F.col("date") > closed).withColumn("batch_id", F.lit(batch_id))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch_id").parquet(self._pending.path))
            if late:
                _put(batch.filter(F.col("date") <= closed), f"{self.path}/too_late", batch_id)
        finally:
            batch.unpersist()
        latest = max(latest, top or "")
        upto = closed
        if latest:
            upto = max(closed, (date.fromisoformat(latest) - timedelta(days=self.delay_days)).isoformat())
        self._decide(2 * batch_id, closed, upto)
        self.marks.put(2 * batch_id, {"latest": latest, "closed": upto})

    def drain(self, stream: DataFrame, checkpoint: str) -> QuotaJob:
        drain(stream, self._write, checkpoint)
        return self

    def finish(self) -> QuotaJob:
        """Decide the days that are still open.  They are closed then: later rows for them are too late."""
        last, mark = self.marks.last()
        closed = mark.get("closed", "")
        upto = max([closed, *self._days("9999-12-31")])
        # parts of batches have even numbers, so no batch overwrites this one
        self._decide(last + 1, closed, upto)
        self.marks.put(last + 1, {"latest": max(mark.get("latest", ""), upto), "closed": upto})
        return self

    def read(self) -> DataFrame:
        return self.accepted.read().select(*self.schema.names)

    def too_late(self) -> DataFrame:
        return stored(self.spark, f"{self.path}/too_late", self.schema).select(*self.schema.names)


def stream_quota(stream: DataFrame, path: str, checkpoint: str, cap: int, by: Sequence[str] = ("account", "date"),
                 history: DataFrame | None = None, delay_days: int = 10, finish: bool = True) -> DataFrame:
    """T3 as one run: drains the stream, decides the open days if asked, returns the accepted rows."""
    job = QuotaJob(stream.sparkSession, path, stream.schema, cap, by, history, delay_days).drain(stream, checkpoint)
    return (job.finish() if finish else job).read()


def stream_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh folders for a job's table and checkpoint, below the shared checkpoint folder."""
    return scratch_path(spark, name), scratch_path(spark, name + "-ckpt")
