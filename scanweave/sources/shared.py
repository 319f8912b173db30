"""Intermediate tables in the folder that driver and executors share."""

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which a cluster names; a local session without it uses its
    warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


#: whether the shuffle files of a statement go when it ends, not when the driver collects its garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_leave(spark: SparkSession):
    """The shuffles of the statements that run within leave the disk as soon as these end."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Writes the rows and reads them back: later steps start from files, so a lost executor
    costs no more than the tasks it ran.  The shuffles that made the rows leave the disk."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    with shuffles_leave(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def has_rows(df: DataFrame) -> bool:
    """Whether there is any row, asked at once."""
    with shuffles_leave(df.sparkSession):
        return not df.isEmpty()


def discard(table: DataFrame) -> None:
    """Removes a settled table that nothing will read any more."""
    spark = table.sparkSession
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        if folder.rpartition("/")[2].startswith("settled-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
