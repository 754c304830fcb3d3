"""Session helpers: a tuned local session for tests/bench, the shared
checkpoint folder used to cut lineage and to stage intermediate tables, and
the few file-system calls that go through Spark's own file systems."""
from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(cpus: int | str = "*", shuffle_partitions: int | None = None,
              app: str = "quarry") -> SparkSession:
    """Local session used by tests and the bench. On a cluster, build the
    session with the cluster's own settings; the library reads only
    ``spark.checkpoint.dir`` and ``spark.sql.shuffle.partitions`` from it.
    A session that exists already keeps its checkpoint folder."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    parts = shuffle_partitions or max(8, int(n))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.quarry.scan.parallelism", str(n))
        .getOrCreate()
    )
    checkpoint_dir(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local_path(path: str) -> bool:
    return path.startswith("file:") or not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment sets it and it must be reachable from every
    node (HDFS, S3, or a mounted shared disk). Only a local session without
    the setting gets a folder of its own here."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...); "
                               "a machine-local folder does not survive executor loss")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
    if not sc.master.startswith("local") and _is_local_path(d):
        tmp = os.path.realpath(tempfile.gettempdir())
        at = os.path.realpath(re.sub(r"^file:/*", "/", d))
        if at == tmp:
            raise RuntimeError(f"spark.checkpoint.dir is the machine's own temporary folder ({d}); name a shared one")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)).rstrip("/")
    checkpoint_dir(spark)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a staged table that no plan reads any more."""
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)
