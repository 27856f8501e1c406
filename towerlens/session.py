"""Session set-up shared by the entry file, the benchmark and the tests."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores="8", app="towerlens", shuffle_partitions=None, **conf):
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark):
    """Use the folder the cluster names in spark.checkpoint.dir.

    A folder of this machine is used only where none is named and the master is local, as in
    tests; it is removed when the program ends. On a cluster each executor would see its own disk,
    so a missing setting is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="towerlens-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)


def work_folder(spark):
    """A new folder next to the checkpoints, on storage that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/work-{uuid.uuid4().hex}"


def materialise(df):
    """Write ``df`` once to the checkpoint folder, so several consumers share one computation.

    The files live on shared storage, so losing an executor does not lose them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(spark, rows=2000):
    """Let at most ``rows`` rows at once go to a Python worker in this session. Rows that hold whole
    texts fill buffers outside the heap of both sides, which grow by doubling."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))
