"""SparkSession construction and cluster-safe defaults.

Every job in the library takes a SparkSession from the caller; this module only
builds one for tests, the bench and the entry point, and makes sure the session
has a reliable checkpoint folder (``spark.checkpoint.dir``) for the iterative
jobs that cut lineage.
"""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings that matter at scale as much as on one machine.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Stateful streaming operators keep their state in RocksDB, off-heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "eventide", extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    conf = dict(_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's reliable checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    it is. Only when it is unset and the master is local (tests) do we make a
    scratch folder; elsewhere that raises, since executors would not share it.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = configured or tempfile.mkdtemp(prefix="eventide-ckpt-")
    sc.setCheckpointDir(path)
    return path


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder of any Hadoop file system; none if it is absent."""
    p, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that a job of this library wrote; nothing if it is absent."""
    p, fs = _at(spark, path)
    fs.delete(p, True)


def replace(spark: SparkSession, path: str, by: str) -> None:
    """Put the folder ``by`` in the place of ``path``, on the same file system."""
    (old, fs), (new, _) = _at(spark, path), _at(spark, by)
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{by} could not be moved to {path}")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the ``eventide`` package importable by Python workers.

    Functions run by ``mapInPandas`` / ``applyInPandas*`` are pickled by
    reference to this package, so executors need it on their path. The
    package is zipped once per application and added with ``addPyFile``,
    which distributes it to every executor.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="eventide-code-"), "eventide.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(pkg.rglob("*.py")):
            z.write(f, f.relative_to(pkg.parent).as_posix())
    sc.addPyFile(out)
    _SHIPPED.add(app)
