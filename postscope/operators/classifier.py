"""A pluggable per-post classifier.

The caller injects ``fn(details: dict) -> str | None``; ``None`` means skip.
It runs as a plain Python UDF over only the columns it needs: rows reach a
worker a hundred at a time, so its memory does not grow with the number of
posts or the length of their texts (Arrow batches hold 10,000 whole texts).
Nulls reach it as ``None``.  An exception, or a result that is no text, becomes
an ``error`` value on that row (as the reference logs it) and never fails the
job.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..files import Folder


def with_classifier(df: DataFrame, fn: Callable[[dict], str | None], inputs: Sequence[str],
                    key: str = "media_id") -> DataFrame:
    """Add ``result``, ``skipped`` and ``error`` per row of ``df[key, *inputs]``."""
    cols = [key, *[c for c in inputs if c != key]]
    base = df.select(*cols)   # keeps the caller's partitioning (sources spread their scans)

    def call(row):
        try:
            r = fn({c: None if v is None or v != v else v for c, v in zip(cols, row)})
            if r is not None and not isinstance(r, str):
                raise TypeError(f"the classifier gave {type(r).__name__}, not text")
            return r, r is None, None
        except Exception as e:  # noqa: BLE001 - recorded per row
            return None, False, f"{type(e).__name__}: {e}"

    # not deterministic: a plan never calls it twice for a row
    answer = F.udf(call, "result string, skipped boolean, error string", useArrow=False).asNondeterministic()
    return base.withColumn("_answer", answer(F.struct(*cols))).select(*cols, "_answer.result", "_answer.skipped", "_answer.error")


_RESULT = T.StructType([T.StructField("_hash", T.StringType()), T.StructField("result", T.StringType()),
                        T.StructField("skipped", T.BooleanType()), T.StructField("error", T.StringType())])


def classify_once(df: DataFrame, fn: Callable[[dict], str | None], inputs: Sequence[str], store: str, version: str,
                  key: str = "media_id", retry_errors: bool = False) -> DataFrame:
    """``with_classifier`` that calls ``fn`` once per distinct input, over all runs.

    Results are stored below ``store`` under a hash of the inputs and of
    ``version`` (the name of the classifier; a new one is called anew).  A run
    calls ``fn`` for inputs that are not stored, adds them as one part, and
    answers every row from the store, so a restarted or extended run pays for
    its new rows only.  Only whole parts count.  ``key`` is passed to ``fn``
    only if it is among ``inputs``.  Errors are stored like results;
    ``retry_errors`` calls for them again, and the later answer counts.
    """
    spark = df.sparkSession
    folder = Folder(spark, store)

    def stored() -> DataFrame:
        parts = [n for n in folder.names() if folder.exists(f"{n}/_SUCCESS")]
        if not parts:
            return spark.createDataFrame([], _RESULT)
        rows = spark.read.schema(_RESULT).parquet(*[f"{store}/{n}" for n in parts])
        # an answer that is no error counts before one that is
        best = F.min(F.struct(F.col("error").isNotNull().alias("bad"), "error", "result", "skipped")).alias("b")
        return rows.groupBy("_hash").agg(best).select("_hash", "b.result", "b.skipped", "b.error")

    text = F.to_json(F.struct(*[F.col(c) for c in inputs]), {"ignoreNullFields": "false"})
    hashed = df.withColumn("_hash", F.sha2(F.concat_ws("\n", F.lit(version), text), 256))
    known = stored().filter("error IS NULL") if retry_errors else stored()
    new = hashed.select("_hash", *inputs).dropDuplicates(["_hash"]).join(known.select("_hash"), "_hash", "left_anti")
    called = with_classifier(new, lambda rec: fn({c: rec[c] for c in inputs}), list(inputs), "_hash")
    called.select(*_RESULT.names).write.parquet(f"{store}/part-{uuid.uuid4().hex}")
    return hashed.join(stored(), "_hash", "left").select(key, *[c for c in inputs if c != key], "result", "skipped", "error")
