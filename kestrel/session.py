"""Spark session and shared-storage helpers.

The library never assumes a machine-local scratch directory: lineage is cut
with ``DataFrame.checkpoint()`` into the shared folder named by the cluster in
``spark.checkpoint.dir``.  Only when that setting is absent (local tests) do we
create one under the system temp folder.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: folders of local sessions that name none, by application id
_OWN: dict[str, str] = {}

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def _driver_memory() -> str:
    """Local mode runs everything in the driver JVM: give it about 60 % of
    the machine, at most 8 GiB (a cluster sets its own)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    mb = max(1024, min(8192, int(total * 0.6 / 2**20)))
    return f"{mb}m"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "kestrel", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if master and master.startswith("local"):
        b = b.config("spark.driver.memory", _driver_memory())
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  Only a local session
    without one gets a folder of its own; a cluster must name it."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or _OWN.get(sc.applicationId)
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="kestrel-ckpt-")
        _OWN[sc.applicationId] = d  # the setting itself is fixed once the session runs
        atexit.register(shutil.rmtree, d, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table inside the shared checkpoint folder."""
    return "/".join((checkpoint_dir(spark).rstrip("/"), "tables", name))
