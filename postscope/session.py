"""Session construction and shared storage locations.

On a cluster the session is created by the platform; ``configure`` only sets
the SQL options the operators rely on (UTC session zone, AQE with skew-join
splitting).  Scratch output (append round trips, streaming sinks and their
checkpoints) always goes under ``spark.checkpoint.dir``, a shared folder the
cluster names; a machine-local folder is only chosen for ``local[...]``
masters, i.e. tests and benchmarks.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# option read by ``plans.ranking.spread``
SPREAD_OPTION = "postscope.spread.partitions"

SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # runtime broadcast only for sides AQE has measured to be small
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    # map-side top-k (partial WindowGroupLimit) for k up to this many rows
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "postscope", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in {**SQL_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Give the SQL options the operators assume a value where the session has none."""
    for k, v in SQL_DEFAULTS.items():
        # no default given: Spark would check it against the option's type
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    # local masters read the test tables, one row group per file: spread the
    # text work over the cores unless the caller chose a value (a cluster
    # leaves it unset, its scans are wide)
    if spark.sparkContext.master.startswith("local") and spark.conf.get(SPREAD_OPTION, None) is None:
        spark.conf.set(SPREAD_OPTION, str(spark.sparkContext.defaultParallelism * 2))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Read from the session; only when it is unset on a ``local`` master is a
    folder under the system temp directory chosen (tests, benchmarks).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf = os.path.join(tempfile.gettempdir(), f"postscope-ckpt-{uuid.uuid4().hex[:8]}")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/postscope-scratch/{name}-{uuid.uuid4().hex[:12]}"
