"""Row numbers over a whole table without a task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one task may number alone, and rows of a range beyond that, about.
ALONE, RANGE = 100_000, 50_000


def _places_before(cuts: Column, value: Column, most: int) -> Column:
    """How many of the sorted cuts (at most so many) are no greater than the value, in as many steps as most has bits."""
    powers = F.array(*[F.lit(2**k) for k in reversed(range(most.bit_length()))])
    fits = lambda n, step: (n + step <= F.size(cuts)) & (F.get(cuts, n + step - 1) <= value)
    return F.aggregate(powers, F.lit(0), lambda n, step: F.when(fits(n, step), n + step).otherwise(n))


def numbered(df: DataFrame, order: str, name: str, most_ranges: int = 4096) -> DataFrame:
    """df with name, the place (from 0) of each row in the order of a column that has no ties. A larger table is cut into
    ranges at values that a hash picks (about most_ranges of them at most), and a row's range is found by halving; rows are
    numbered within their range, and the ranges' counts, one row each, are summed."""
    place = lambda w: (F.row_number().over(w) - 1).cast("long")
    count = df.count()
    if count <= ALONE:
        return df.withColumn(name, place(Window.orderBy(order)))
    every = max(RANGE, count // most_ranges)
    picked = df.where((F.pmod(F.xxhash64(order), F.lit(every)) == 0) & F.col(order).isNotNull())
    cuts = F.broadcast(picked.agg(F.sort_array(F.collect_list(order)).alias("_cuts")))
    ranged = df.crossJoin(cuts).withColumn("_range", _places_before(F.col("_cuts"), F.col(order), 2 * (count // every) + 64)).drop("_cuts")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # As many tasks as ranges: a task's rows don't grow with the table.
    within = ranged.repartition(count // every + 1, "_range").withColumn("_at", place(Window.partitionBy("_range").orderBy(order)))
    return within.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_start", "_at")
