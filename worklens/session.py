"""Session settings, shipping of the package, and the two guards every job uses: checkpoints and broadcast size."""

from __future__ import annotations

import atexit
import gc
import importlib.util
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in rows, that a join may broadcast after it was counted.
BROADCAST_ROWS = 200_000


def local_session(name: str = "worklens", cores: str | int = "*") -> SparkSession:
    """Session for tests and the benchmark; on a cluster the submitted session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("WORKLENS_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the executors this package as a zip, unless they find it by themselves; once per application.

    Pandas and Arrow functions are pickled by reference, so their workers must be able to import the package.
    """
    context = spark.sparkContext
    if getattr(context, "_worklens_shipped", None) == context.applicationId:
        return
    top = Path(__file__).resolve().parent
    # The driver serves the archive from its place, so it stays until the driver ends.
    folder = tempfile.mkdtemp(prefix="worklens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, "worklens-package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
        pipeline = importlib.util.find_spec("corpus_pipeline")
        if pipeline and pipeline.origin:
            out.write(pipeline.origin, "corpus_pipeline.py")
    context.addPyFile(str(archive))
    context._worklens_shipped = context.applicationId


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Where none is set, a local master, whose tasks all run on this machine, gets a scratch folder; anything else is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="worklens-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, so a lost executor costs no recomputed chain.

    A checkpointed plan keeps the constraints inferred for it, which in a loop of joins
    multiply from round to round until planning takes minutes; so none are inferred here.
    """
    shared_folder(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(key, before)


def release(*frames: DataFrame) -> None:
    """Delete the files of checkpoints that nothing will read again; in a loop, disk then holds one round and not all."""
    for df in frames:
        node = df._jdf.queryExecution().analyzed()
        file = node.rdd().getCheckpointFile() if node.getClass().getSimpleName() == "LogicalRDD" else None
        if file is not None and file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no plan refers to any more: it does so when the driver collects its garbage.

    A driver that only plans makes so little of it that this may not happen for the whole of a loop of joins.
    """
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a bounded count shows the side is small; else leave the join to AQE."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
