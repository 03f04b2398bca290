"""SparkSession helpers.

The library never creates a session behind the caller's back: every operator
takes DataFrames (or a ``Tables`` bundle) and returns lazy DataFrames.  These
helpers only exist for tests, the bench and command-line use.
"""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every basketry session wants.  On a cluster these are normally in
# spark-defaults; ``builder`` only fills the ones that are not set already.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.unionOutputPartitioning": "false",  # see plain_unions
}


def recommended_conf(total_executor_cores: int, input_bytes: int,
                     partition_bytes: int = 256 << 20) -> dict:
    """Settings sized for a cluster run (the values the README suggests).

    Scan splits and post-shuffle partitions target ``partition_bytes`` each so
    a task's working set fits executor memory; the shuffle partition count is
    the larger of 3x the cores and input / partition size (AQE coalesces the
    small ones and splits skewed ones at run time).
    """
    shuffle = max(3 * total_executor_cores, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
    }


def builder(master: str | None = None, app_name: str = "basketry",
            shuffle_partitions: int | None = None, conf: dict | None = None):
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (conf or {}).items():
        b = b.config(k, str(v))
    return b


def local_session(cores: int = 8, shuffle_partitions: int | None = None,
                  driver_memory: str = "8g", conf: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, checkpoint dir set)."""
    extra = {"spark.driver.memory": driver_memory,
             # catalog entries (bucketed snapshots) must not land in the working folder
             "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="basketry-warehouse-")}
    extra.update(conf or {})
    spark = builder(f"local[{cores}]", shuffle_partitions=shuffle_partitions or cores,
                    conf=extra).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's reliable checkpoint directory.

    On a cluster the directory must be a shared file system path named in
    ``spark.checkpoint.dir``; it is read from the session and never replaced.
    Only a local-mode session without one (tests, the bench) gets a fresh
    scratch directory of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: point it at a shared folder "
            "(HDFS/S3/ABFS) visible to every executor")
    path = tempfile.mkdtemp(prefix="basketry-ckpt-", dir=os.environ.get("BASKETRY_SCRATCH"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application), so that
    functions that run there can import it wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="basketry-code-"), "basketry-code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def plain_unions(spark: SparkSession) -> None:
    """Let the session plan unions as Spark did before 4.1, without taking over
    the partitioning that their inputs share.  Adaptive execution may replan one
    input (a join whose side turns out small) after a join above relied on it,
    which then fails: "Can't zip RDDs with unequal numbers of partitions".
    Tables in layers are such unions below joins, so whoever reads or changes
    them asks for it; the plans run later, so it stays set.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint directory (shared on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{next(_counter)}-{os.getpid()}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a folder that `scratch_path` named, once nothing reads it any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any
    more.  It does so when the driver's garbage collector finds them gone, which
    a loop of many small jobs may not bring about by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _count():
    i = 0
    while True:
        i += 1
        yield i


_counter = _count()


def session_key(spark: SparkSession):
    """A key that identifies the running application (for per-session memos)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # sessions without a reachable SparkContext
        return id(spark)
