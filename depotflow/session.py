"""Session set-up and the shared working folder."""

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Long plans compile more classes than the default of 100 keeps, and would compile them all anew each time.
    "spark.sql.codegen.cache.maxEntries": "2000",
}


def build_session(app="depotflow", master=None, **extra):
    """Session with adaptive execution on; cluster settings stay with the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark):
    """Folder every executor can reach, named by `spark.checkpoint.dir`.

    Only a local session may fall back to a temporary folder, since there
    driver and executors are one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_dir()


_LOCAL = []


def _local_dir():
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="depotflow-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def fresh_path(spark, label):
    """A path below the shared folder that nothing has been written to yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
