"""A vector table that can be loaded again and again without repeating rows.

Rows lie in folders by a hash of their key. A load reads the folders its own keys fall into and of these only the key
column, so ten new rows read at most ten folders however large the table is. Every load adds at most one file to a
folder; :func:`compact` brings the files of a folder together.

A load may carry a batch id. The ids of finished loads are kept beside the table, written after the rows: a batch that
is replayed is skipped, and one that was cut off between the two is compared with the stored rows and adds the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from almenara.operators.quality import enforce, expect_unique
from almenara.session import pin

#: Folders of a table; a property of the table that must not change between loads.
FOLDERS = 256
#: The column the folders are named by.
FOLDER = "_folder"

#: What Spark says of a path that does not exist or holds no file yet.
NOTHING_STORED = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def missing_rows(new: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not stored yet."""
    return new.join(existing.select(key), key, "left_anti")


def folder_of(key: str, folders: int = FOLDERS) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(folders)).cast("int")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in NOTHING_STORED:
            raise
        return None


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table; None only where nothing was stored yet."""
    stored = _stored(spark, path)
    return stored if stored is None else stored.drop(FOLDER)


def touched(new: DataFrame, stored: DataFrame, key: str = "id", folders: int = FOLDERS) -> DataFrame:
    """The part of ``stored`` in the folders the keys of ``new`` fall into: a filter on partitions, before any file is opened."""
    own = [r[0] for r in new.select(folder_of(key, folders)).distinct().collect()]  # at most ``folders`` numbers
    return stored.filter(F.col(FOLDER).isin(own))


def _write(rows: DataFrame, path: str, key: str, folders: int, mode: str) -> None:
    placed = rows.withColumn(FOLDER, folder_of(key, folders))
    placed.repartition(FOLDER).write.mode(mode).partitionBy(FOLDER).parquet(path)


def _marks(path: str) -> str:
    return f"{path.rstrip('/')}.loaded"


def finished(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether the load of ``batch`` came to its end."""
    marks = _stored(spark, _marks(path))
    return marks is not None and not marks.filter(F.col("batch") == batch).isEmpty()


def load_index(new: DataFrame, path: str, key: str = "id", batch: str | None = None, folders: int = FOLDERS) -> None:
    """Append the rows that are not stored yet; repeated keys in ``new`` stop the job, a finished ``batch`` is skipped.

    Loads into one table follow each other; two at a time could both add a key.
    """
    spark = new.sparkSession
    if batch is not None and finished(spark, path, batch):
        return
    enforce(expect_unique(f"{key} unico", new, key))
    stored = _stored(spark, path)
    rows = new if stored is None else missing_rows(new, touched(new, stored, key, folders), key)
    _write(rows, path, key, folders, "append")
    if batch is not None:
        spark.range(1).select(F.lit(batch).alias("batch")).coalesce(1).write.mode("append").parquet(_marks(path))


def rebuild_index(new: DataFrame, path: str, key: str = "id", folders: int = FOLDERS) -> None:
    """Replace everything; ``new`` must not read from ``path``. Batches loaded before count as not loaded."""
    enforce(expect_unique(f"{key} unico", new, key))
    spark = new.sparkSession
    _write(new, path, key, folders, "overwrite")
    spark.range(0).select(F.lit("").alias("batch")).write.mode("overwrite").parquet(_marks(path))


def compact(spark: SparkSession, path: str, key: str = "id", folders: int = FOLDERS) -> None:
    """Bring the files of every folder together; the rows are stored apart before the table is overwritten.

    No load may run meanwhile. A job that dies while it overwrites leaves a table to load again; the marks stay.
    """
    rows = read_index(spark, path)
    if rows is not None:
        _write(pin(rows), path, key, folders, "overwrite")
