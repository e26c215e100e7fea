"""Session helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "_corpusgrid_shipped"
#: Bytes of one Arrow batch between the JVM and Python. Texts are long, and each task holds a batch on
#: both sides, outside the JVM's heap.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def session(app: str = "corpusgrid", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with adaptive execution; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each context.

    Python functions are pickled by reference, so a worker must be able to import the package
    even where the driver found it through its own ``sys.path``.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH, None) is None:  # not set by the session
        spark.conf.set(BATCH, str(BATCH_BYTES))
    if getattr(sc, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(root)
    target = os.path.join(tempfile.mkdtemp(prefix="corpusgrid-"), "corpusgrid_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, dirs, files in os.walk(root):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, base))
    sc.addPyFile(target)
    setattr(sc, _SHIPPED, True)


def release() -> None:
    """Gives memory that a finished task of a Python worker holds back to the system: workers live on, and
    their next task may need it elsewhere."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, a laptop) a local folder is chosen, and only in
    local mode: on a cluster a machine-local folder would lose data.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()  # set by setCheckpointDir: a folder below it
        found = held.get().rsplit("/", 1)[0] if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "corpusgrid-checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of this package's own, through Hadoop's file systems."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def columnar(df: DataFrame) -> DataFrame:
    """``cut`` for wide rows: written as Parquet, so whoever reads them on takes only the columns that it needs."""
    folder = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/columnar-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def together(*jobs: Callable[[], object]) -> None:
    """Runs independent jobs at the same time: one that has few tasks left does not keep the others waiting."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for running in [pool.submit(j) for j in jobs]:
            running.result()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files are too few to keep them busy (one small file, say);
    inputs of many files stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
