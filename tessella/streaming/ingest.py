"""Records that arrive as files: each micro-batch is columnised and its cells appended to a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.encodings import long_frame
from ..operators.sequences import CHUNK


def start(spark: SparkSession, source: str, schema: str, order: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the cells of source's JSON records to the table target, in a folder for each batch, until no file is left. A
    cell's place counts within its batch, so batches whose order column begins anew stay apart. A batch that is repeated
    after a failure writes its own folder again."""

    def append(batch: DataFrame, number: int) -> None:
        long_frame(batch, order).sortWithinPartitions("path", "pos").write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compacted(cells: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The cells of all batches in their order as one frame: small chunks become full ones. Batches are laid end to end by
    the number of their rows, one row each."""
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.groupBy("batch").agg((F.max("pos") + 1).alias("n")).select("batch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = cells.join(F.broadcast(starts), "batch").withColumn("pos", F.col("start") + F.col("pos"))
    return placed.withColumn("chunk", F.floor(F.col("pos") / chunk).cast("long")).drop("batch", "start")
