"""Session construction and cluster-facing settings.

On a cluster the session already exists and carries its own settings; the
helpers here only fill in what is unset (tests, bench, local runs).
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Settings we rely on.  AQE re-plans joins at runtime: a side whose shuffle
# output is below the broadcast threshold becomes a broadcast hash join (the
# size check happens on real bytes, not estimates); larger sides stay
# sort-merge joins and skewed partitions are split by the skew-join rule.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "studiolake") -> SparkSession:
    """Return the active session, or build a local one with our defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("STUDIOLAKE_DRIVER_MEM", "4g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


AT_ONCE = 4


def together(spark: SparkSession, steps: list[Callable]) -> list:
    """Run steps that don't read each other's results, a few at a time: one's small jobs and last tasks leave cores to the
    others.  Returns their results in order; the first step's error is raised when all have ended."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [r.result() for r in [pool.submit(inheritable_thread_target(spark)(s)) for s in steps]]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local session (tests) gets a folder of its own where that is unset;
    on a cluster its executors would not see one, so that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="studiolake-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d
