"""Session defaults and the shared checkpoint folder."""

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus="8", app="plumbline"):
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        # building a plan of many columns is faster without call-site capture per column
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PLUMBLINE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder the cluster names; survives lost executors.

    Only a local master without a configured folder gets one of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="plumbline-ckpt-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
