"""Session and scratch-space helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(master: str | None = None, app: str = "reviewlens",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the engine expects.

    On a cluster the master, memory and checkpoint folder come from the
    submit configuration; locally we pin a few knobs for repeatable tests.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor; Spark's 1g default
        # heap makes every shuffle spill.  Clusters size executors at submit.
        builder = builder.config("spark.driver.memory",
                                 os.environ.get("REVIEWLENS_DRIVER_MEMORY", "16g"))
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not shuffle_partitions and not (master or "").startswith("local"):
        # adaptive execution merges small shuffle partitions but cannot split
        # big ones (except skew), so start from ~3 tasks per core on clusters
        # unless the submit configuration chose a number.
        if spark.sparkContext.getConf().get("spark.sql.shuffle.partitions", None) is None:
            cores = spark.sparkContext.defaultParallelism
            spark.conf.set("spark.sql.shuffle.partitions", str(max(200, 3 * cores)))
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that is
    used as is.  Only when nothing is configured (local runs, tests) a fresh
    folder under the system temp directory is taken.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote (Connect) sessions have no context
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
        if not configured:
            _local_only(sc.master)
            configured = tempfile.mkdtemp(prefix="reviewlens-ckpt-")
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not configured:
        _local_only("remote")
    return configured


def _local_only(master: str) -> None:
    """Executors elsewhere do not see this machine's temporary folders."""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")


_SCRATCH_ROOTS: set[str] = set()


def _remove_scratch(spark: SparkSession, root: str) -> None:
    """Delete this application's scratch folder at interpreter exit (best effort)."""
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may already be gone
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path inside the shared checkpoint folder.

    The application's checkpoint folder is unique per Spark application;
    the ``reviewlens`` part of it is removed when the Python process exits.
    """
    root = os.path.join(ensure_checkpoint_dir(spark), "reviewlens")
    if root not in _SCRATCH_ROOTS:
        _SCRATCH_ROOTS.add(root)
        atexit.register(_remove_scratch, spark, root)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage like a reliable checkpoint (a lost executor re-reads the
    files instead of recomputing upstream work), computes the data exactly
    once, and later readers get column pruning and filter pushdown.  The shuffle
    files behind the write are removed as soon as it has committed.
    """
    path = scratch_path(df.sparkSession, name)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote and no later step reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the actions inside the block."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


#: a written table is broadcast up to this many rows (counted first), and shuffled beyond
BROADCAST_ROWS = 1 << 18


def counted_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` (written before) with a broadcast hint if its counted rows are within the bound."""
    return F.broadcast(table) if table.count() <= rows else table


def row_name(df: DataFrame, name: str = "row") -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition ``df`` by ``keys`` when it has fewer partitions than cores.

    CPU-heavy text work (regex tokenising, sorting tokens) needs every core.
    A large scan already yields enough splits and is left alone; a small or
    unsplittable file (one row group) is spread once, by its row key, which
    also pre-clusters later per-document windows.
    """
    try:
        want = df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - remote sessions: leave partitioning to the server
        return df
    if have >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)
