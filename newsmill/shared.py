"""Tables that end a lineage: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, spark.checkpoint.dir. Where it is unset, a folder of this machine serves a local session,
    in which driver and executors are one process; any other session must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="newsmill-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/newsmill/{name}-{uuid.uuid4().hex}"


#: Folders of the runs that are open, the innermost last.
_OPEN: list[str] = []


@contextmanager
def scratch(spark: SparkSession, name: str = "run"):
    """Tables stored inside of the block lie in one folder, which is deleted when the block ends, also by an error. What is to stay must be written
    outside of it before: :func:`one_table` does so."""
    folder = new_folder(spark, name)
    _OPEN.append(folder)
    try:
        yield folder
    finally:
        _OPEN.remove(folder)
        _delete(spark, folder)


def one_table(spark: SparkSession, name: str, make, always: bool = False) -> DataFrame:
    """The rows of ``make()`` in a table of their own, and none of the tables that ``make`` stored on the way. A result that stored none is returned
    as it is, unless it is ``always`` to be written."""
    with scratch(spark, name) as folder:
        out = make()
        if not always and not _exists(spark, folder):
            return out
        path = new_folder(spark, f"{name}-result")
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, folder: str) -> bool:
    path, system = _path(spark, folder)
    return system.exists(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path, system = _path(spark, folder)
    system.delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, so a lost executor costs only its tasks."""
    spark = df.sparkSession
    path = f"{_OPEN[-1]}/{name}-{uuid.uuid4().hex}" if _OPEN else new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`stored`, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def ranged(df: DataFrame, parts: int, order: list[str], part: str, name: str) -> DataFrame:
    """``df`` range-sorted by ``order`` over ``parts`` partitions and stored, with the partition's number in the column ``part``."""
    return stored(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()).sortWithinPartitions(*order), name)
