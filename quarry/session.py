"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every operator relies on. They can be changed on a live
# session, so `configure` also works on a session somebody else has built.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys are split at run time, also when that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Keep the map-side cut of "first n per group" for page-sized n.
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators expect and ship this package."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per Spark context.

    Same as passing it with --py-files: the archive is made on the driver and
    Spark itself hands it to the executors. An installed archive is left alone.
    """
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_quarry_shipped", False) or not os.path.isdir(package):
        return
    name = os.path.join(tempfile.mkdtemp(prefix="quarry-package-"), "quarry")
    context.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(package), os.path.basename(package)))
    context._quarry_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a plain scan over all cores when it has fewer partitions.

    For heavy per-row work on small inputs, which may sit in one file. Large
    inputs have more partitions than cores and are not shuffled. Only for
    frames without a shuffle of their own, whose partitions are known unrun.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def build_session(app: str = "quarry", master: str | None = None, **settings: str) -> SparkSession:
    """A new session with the settings above; the web page stays off."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is the one the cluster names in `spark.checkpoint.dir`. Only a
    local session may fall back to a temporary folder of its own machine.
    """
    path = f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    context._quarry_scratch = [*getattr(context, "_quarry_scratch", ()), path]
    return path


def release_scratch(spark: SparkSession) -> None:
    """Remove what this session has put under `scratch_path`.

    To be called when the results that read it have been consumed.
    """
    context = spark.sparkContext
    configuration = context._jsc.hadoopConfiguration()
    for path in getattr(context, "_quarry_scratch", ()):
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(configuration).delete(folder, True)
    context._quarry_scratch = []


def _shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_quarry_folder", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = spark.sparkContext._quarry_folder = tempfile.mkdtemp(prefix="quarry-")
    return base.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute a small frame once and keep it in the shared folder, free of its lineage."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(_shared_folder(df.sparkSession))
    return df.checkpoint()
