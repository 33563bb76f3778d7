"""Tables that are used more than once, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set, a local session gets one of
    its own; on a cluster that is an error, as executors don't see each other's folders."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


#: Where the tables that materialize() has written are.
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: what follows neither repeats its work nor depends on executors
    that may be lost. The files go by release(), or when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables by materialize() that nothing reads any more."""
    for t in tables:
        if path := _written.pop(t, None):
            hadoop = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)
