"""Session helpers: sane defaults for local runs, and a checkpoint folder that respects the cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "trawl") -> SparkSession:
    """A local session for tests and the bench. On a cluster, build the session yourself."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only where the session has none.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is. Only a
    local-mode session (tests, bench) without that setting gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running lineage-cutting jobs")
    scratch = tempfile.mkdtemp(prefix="trawl-ckpt-")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers (once per application), so that tasks can import it
    wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_trawl_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="trawl-zip-"), "trawl.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("trawl", os.path.relpath(path, home)))
    sc.addPyFile(target)
    sc._trawl_shipped = True


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint root for tables a job writes and reads back."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut lineage with a written table: parquet under the checkpoint root, read back.

    One pass (a reliable ``checkpoint()`` without caching computes its plan twice), survives
    lost executors (shared storage), and stays columnar so later reads prune columns.
    """
    spark = df.sparkSession
    ship_package(spark)  # the plan may run Python stages of this package
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # the schema is known: no footers are read for it
