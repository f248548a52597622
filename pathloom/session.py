"""Session helpers: small conveniences that never override what a cluster sets."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, app: str = "pathloom", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, wherever the driver was started.

    The same as submitting it with ``--py-files``; done once per application.
    """
    sc = spark.sparkContext
    if getattr(sc, "_pathloom_shipped", None) != sc.applicationId:
        root = Path(__file__).resolve().parent
        if root.parent.is_dir():  # not when already running from a shipped archive
            out = Path(tempfile.mkdtemp(prefix="pathloom-pkg-")) / "pathloom"
            sc.addPyFile(shutil.make_archive(str(out), "zip", root.parent, root.name))
        sc._pathloom_shipped = sc.applicationId
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named in ``spark.checkpoint.dir``; make one only where it is unset."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not configured:
        # unset only in local runs: one JVM, so a local folder is shared by all tasks
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="pathloom-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame) -> DataFrame:
    """Write a stage that several later stages read (and cut its lineage) to reliable storage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame) -> DataFrame:
    """Re-alias every column, so that two frames of one origin can be co-grouped."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def spread(df: DataFrame, *keys: str, only_small: bool = False) -> DataFrame:
    """Hash rows by ``keys`` (id) over at least as many partitions as there are cores, more for large inputs.

    For work that costs far more per row than moving the row, so that a table read as a few
    splits still uses the whole cluster. ``only_small``: a table with more splits than cores stays as it lies, so that a
    hot key is not brought together and rows that lie together stay so.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # what the plan reads; estimates above a join, and those a checkpoint keeps of them, multiply and say nothing
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    parts = cores
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() == "LogicalRDD":
            parts = max(parts, leaf.rdd().getNumPartitions())
        else:
            parts = max(parts, min(int(str(leaf.stats().sizeInBytes())) >> 27, 1 << 20))
    return df if only_small and parts > cores else df.repartition(parts, *(keys or ("id",)))
