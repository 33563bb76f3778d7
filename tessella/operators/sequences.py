"""Transforms of ordered columns. Every window is bounded by a chunk of a column, so no task holds a whole column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import common_prefix_len
from .ordering import numbered

#: Rows of a chunk.
CHUNK = 4096


def chunked(df: DataFrame, order: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """chunk, pos (the row's place in the order) and value. Chunks hold equally many rows whatever the order column holds."""
    rows = numbered(df.select(F.col(order).alias("_order"), F.col(value).alias("value")), "_order", "pos")
    return rows.select(F.floor(F.col("pos") / chunk).cast("long").alias("chunk"), "pos", "value")


def by_pos(*more: str) -> Window:
    return Window.partitionBy("chunk", *more).orderBy("pos")


def delta(c: DataFrame) -> DataFrame:
    """d: the first value, then differences."""
    return c.withColumn("d", F.col("value") - F.coalesce(F.lag("value").over(by_pos()), F.lit(0)))


def undelta(c: DataFrame) -> DataFrame:
    """value back from d."""
    return c.withColumn("value", F.sum("d").over(by_pos().rowsBetween(Window.unboundedPreceding, 0)))


def delta2(c: DataFrame) -> DataFrame:
    """dd: the first value, the first difference, then differences of differences."""
    w = by_pos()
    v, a, b = F.col("value"), F.lag("value").over(w), F.lag("value", 2).over(w)
    return c.withColumn("dd", F.when(a.isNull(), v).when(b.isNull(), v - a).otherwise(v - 2 * a + b))


def undelta2(c: DataFrame) -> DataFrame:
    """value back from dd: two running sums, the chunk's first value carried beside them."""
    w = by_pos().rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("dd").over(w)
    slope = c.withColumn("_first", first).withColumn("_slope", F.sum("dd").over(w) - first)
    return slope.withColumn("value", F.col("_first") + F.sum("_slope").over(w)).drop("_first", "_slope")


def runs(c: DataFrame) -> DataFrame:
    """chunk, begin, value, n for each maximal run of equal values; nulls are equal to each other."""
    changed = F.when(F.lag("pos").over(by_pos()).isNull() | ~F.col("value").eqNullSafe(F.lag("value").over(by_pos())), 1).otherwise(0)
    marked = c.withColumn("_c", changed)
    run = F.sum("_c").over(by_pos().rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_run", run).groupBy("chunk", "_run").agg(F.min("pos").alias("begin"), F.first("value").alias("value"), F.count("*").alias("n")).drop("_run")


def unrun(r: DataFrame) -> DataFrame:
    """chunk, begin, k, value: each run's rows again."""
    return r.select("chunk", "begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"), "value")


def dictionary(c: DataFrame) -> DataFrame:
    """chunk, value, code (in order of first appearance), n of each distinct value of a chunk."""
    seen = c.groupBy("chunk", "value").agg(F.min("pos").alias("_at"), F.count("*").alias("n"))
    return seen.withColumn("code", (F.row_number().over(Window.partitionBy("chunk").orderBy("_at")) - 1).cast("long")).drop("_at")


def encode_codes(c: DataFrame, d: DataFrame) -> DataFrame:
    return c.join(d.select("chunk", F.col("value").alias("_v"), "code").withColumnRenamed("chunk", "_c"), (F.col("chunk") == F.col("_c")) & F.col("value").eqNullSafe(F.col("_v"))).select("chunk", "pos", "code")


def decode_codes(codes: DataFrame, d: DataFrame) -> DataFrame:
    return codes.join(d.select("chunk", "code", "value"), ["chunk", "code"]).select("chunk", "pos", "value")


def front_coded(c: DataFrame) -> DataFrame:
    """shared: code points in common with the value before; suffix: the rest."""
    shared = F.coalesce(common_prefix_len(F.lag("value").over(by_pos()), F.col("value")), F.lit(0)).alias("shared")
    return c.select("chunk", "pos", "value", shared).withColumn("suffix", F.expr("substring(value, CAST(shared AS INT) + 1)"))


def front_decoded(coded: DataFrame) -> DataFrame:
    """chunk, pos, value back from front_coded()'s shared and suffix. A value is its suffix behind what the nearest earlier
    rows leave of theirs, so each chunk, whose size is bounded, is folded in order within one row."""
    row = F.struct("pos", "shared", "suffix")
    start = F.array().cast("array<struct<pos:bigint,value:string>>")
    before = lambda a, n: F.left(F.coalesce(F.get(a, F.size(a) - 1)["value"], F.lit("")), n)
    step = lambda a, x: F.array_append(a, F.struct(x["pos"].alias("pos"), F.concat(before(a, x["shared"].cast("int")), x["suffix"]).alias("value")))
    rows = coded.groupBy("chunk").agg(F.aggregate(F.array_sort(F.collect_list(row)), start, step).alias("x"))
    return rows.select("chunk", F.explode("x").alias("x")).select("chunk", "x.pos", "x.value")


def common_prefix(c: DataFrame) -> DataFrame:
    """chunk and prefix of all values: what the least and the greatest have in common."""
    ends = c.groupBy("chunk").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return ends.select("chunk", F.left("a", common_prefix_len(F.col("a"), F.col("b")).cast("int")).alias("prefix"))
