"""Session helpers: settings every job relies on, and durable cut points for long lineages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import almenara

# Functions that run in tasks travel with their code, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(almenara)

_local_folder: str | None = None


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return prepare(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("almenara")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that change results (UTC) or skew handling; sizes stay with the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints, as the session sees it.

    A session that runs inside one process may do without; it gets a temporary folder, the same one every time.
    On a cluster a folder of one machine would lose rows, so there the setting is required.
    """
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder for a table a job writes and reads again."""
    return f"{shared_folder(spark).rstrip('/')}/almenara-{name}-{uuid.uuid4().hex}"
