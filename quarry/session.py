"""SparkSession construction and cluster-safe defaults.

Everything in the library takes a session as an argument; this module only
supplies the settings a job needs when the caller has not set them (tests,
bench).  Settings that the cluster already defines are never overridden.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings applied only when absent from the session / cluster config.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(app: str = "quarry", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """The active session with its settings untouched, or a new one for which
    ``DEFAULTS`` fill in what the submit configuration has not set; arguments
    given here win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if SparkSession.getActiveSession() is None:
        given = dict(SparkConf().getAll())
        for k, v in DEFAULTS.items():
            if k not in given:
                b = b.config(k, v)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    It is the folder named by ``spark.checkpoint.dir``, or one that the
    operator has already set on the context.  Only a local master may do
    without: then a folder is made (under ``$QUARRY_SCRATCH`` or ``/tmp``); on
    a cluster executors could not see it, so that is an error."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    known = sc.getCheckpointDir()
    if not d and known:
        # the context appends a folder of its own to the one that was set
        return known.rstrip("/").rsplit("/", 1)[0]
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-", dir=os.environ.get("QUARRY_SCRATCH", "/tmp"))
    if not known or known.rstrip("/").rsplit("/", 1)[0] != d.rstrip("/"):
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory for intermediate
    tables (never a machine-local temporary folder on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
