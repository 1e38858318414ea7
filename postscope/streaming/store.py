"""Storage of the streaming jobs: merged tables and progress marks, replay-safe.

``MergedTable`` keeps what each micro-batch changed in a folder of its own and
folds them into one snapshot every ``every`` batches, so a reader meets one
snapshot and a bounded number of small parts, however long the job has run.
``Marks`` are small text files with the progress after each batch.  Both are
keyed by batch id: a replayed batch overwrites its own part and changes nothing
else.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..files import Folder

KEEP_MARKS = 3


class Marks:
    """Progress after each batch; the last few are kept for replays."""

    def __init__(self, spark: SparkSession, path: str):
        self._dir = Folder(spark, path)

    def _ids(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._dir.names() if n.endswith(".json") and not n.startswith("_")]

    def before(self, batch_id: int) -> dict:
        ids = [i for i in self._ids() if i < batch_id]
        return json.loads(self._dir.read_text(f"{max(ids):012d}.json")) if ids else {}

    def last(self) -> tuple[int, dict]:
        ids = self._ids()
        return (max(ids), self.before(max(ids) + 1)) if ids else (-1, {})

    def put(self, batch_id: int, mark: dict) -> None:
        self._dir.write_text(f"{batch_id:012d}.json", json.dumps(mark))
        for i in sorted(self._ids())[:-KEEP_MARKS]:
            self._dir.remove(f"{i:012d}.json")


class MergedTable:
    """Rows of all batches under ``merge`` (any fold that may be repeated, such as a least value per key)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType,
                 merge: Callable[[DataFrame], DataFrame], every: int = 16):
        self.spark, self.path, self.schema, self.merge, self.every = spark, path, schema, merge, every
        self._dir = Folder(spark, path)

    def _state(self) -> tuple[int, list[int], list[int]]:
        """(batch of the newest snapshot, all snapshots, parts after it); only whole ones count."""
        done = [n for n in self._dir.names() if self._dir.exists(f"{n}/_SUCCESS")]
        bases = sorted(int(n[5:]) for n in done if n.startswith("base-"))
        base = bases[-1] if bases else -1
        return base, bases, sorted(int(n[6:]) for n in done if n.startswith("delta-") and int(n[6:]) > base)

    def _rows(self, base: int, parts: list[int]) -> DataFrame:
        paths = [f"{self.path}/base-{base:012d}"] * (base >= 0) + [f"{self.path}/delta-{i:012d}" for i in parts]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.merge(self.spark.read.schema(self.schema).parquet(*paths))

    def read(self) -> DataFrame:
        base, _, parts = self._state()
        return self._rows(base, parts)

    def put(self, df: DataFrame, batch_id: int) -> None:
        """Store the batch's rows; fold once ``every`` parts have gathered."""
        df.write.mode("overwrite").parquet(f"{self.path}/delta-{batch_id:012d}")
        base, bases, parts = self._state()
        if len(parts) < self.every:
            return
        self._rows(base, parts).write.mode("overwrite").parquet(f"{self.path}/base-{parts[-1]:012d}")
        # the generation before stays for readers that have listed it
        for i in bases[:-1]:
            self._dir.remove(f"base-{i:012d}")
        for n in self._dir.names():
            if n.startswith("delta-") and int(n[6:]) <= base:
                self._dir.remove(n)
