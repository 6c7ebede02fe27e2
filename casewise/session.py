"""SparkSession helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at any scale: AQE (coalescing, skew-join splitting),
# UTC timestamps and Arrow for the few pandas hops.  Shuffle partitions are
# left to AQE; callers on a cluster size them from the input volume.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Fused methods over 8,000 bytes of bytecode are never compiled by the JVM; beyond
    # that size a stage's expressions are split into small methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Python workers run one task each; a multi-threaded BLAS inside every
    # worker would oversubscribe the executor's cores.
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.MKL_NUM_THREADS": "1",
}


def get_spark(master: str | None = None, app_name: str = "casewise",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with the engine defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``; a scratch folder only for local runs.

    On a cluster the setting names a shared folder (HDFS/S3/ABFS) so that
    checkpoints survive executor loss.  A cluster session without it raises:
    a machine-local folder would lose rows.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not conf_dir:
        master = sc.master
        if not (master.startswith("local") and not master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="casewise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def spread(df, *keys: str, always: bool = False):
    """Hash-partition ``df`` by ``keys`` when it has fewer partitions than the session's shuffle partitions, or ``always``.

    Text operators are CPU-bound per row, while file splits are sized by
    bytes: a small table of long texts can arrive as one split.  On real data
    the scan already has more partitions and this is a no-op
    (no extra shuffle).  The plan follows a setting, not the executors that happen to have
    registered.  Partitioning by the row id also lets later joins on that id reuse the layout.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Only call this on a plain scan: on a plan with exchanges, asking for the
    # RDD would make adaptive execution run the upstream stages.
    found = df.rdd.getNumPartitions()
    if found >= parts and not always:
        return df
    parts = max(parts, found)
    from pyspark.sql import functions as F
    return df.repartition(parts, *[F.col(k) for k in keys]) if keys else df.repartition(parts)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df, name: str = "stage", codec: str | None = None):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    This cuts lineage like ``checkpoint()`` but costs one job instead of two
    (a reliable RDD checkpoint recomputes its input unless cached), and the
    result is columnar: later readers prune columns and push filters.  The
    shuffle files of the writing query are released as soon as it ends.  ``codec``: Parquet compression
    other than the session's.
    """
    import uuid
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df) -> None:
    """Remove the table behind a frame that ``materialize`` returned, once nothing reads it any more.

    Iterations write a table in every step; the ones before the last would fill the shared folder.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/") + "/tables/"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(conf)
        root = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(base)).toString().rstrip("/") + "/"
        if fs.makeQualified(path).toString().startswith(root):
            fs.delete(path, True)
