"""Sessions with the settings the plans are written for; a cluster's own session works as well."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "tallybook", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster, master and memory come from spark-submit and only unset values are given here."""
    cores = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return workers_find_package(SparkSession.builder.appName(app).config(map=settings).getOrCreate())


def workers_find_package(spark: SparkSession) -> SparkSession:
    """Puts this package's folder on the Python path of workers that share the driver's disk; elsewhere it is installed or shipped."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a local session may go without: it gets a
    temporary one. Elsewhere a missing setting is an error, as a folder of one machine would lose what the others write."""
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallybook-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
