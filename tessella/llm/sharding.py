"""Extendible hashing: a directory of hash prefixes in which only buckets over their byte limit take another bit."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, packed, release

#: Bits of the hash, and those that one round of the directory adds at most: its sums are over so many prefixes of each
#: cell that is still over the limit.
BITS, STEP = 128, 20
LIMIT = 4 * 1024 * 1024
#: Buckets up to this number are broadcast (under 200 bytes each); more of them are joined by a shuffle.
BROADCAST_BUCKETS = 100_000


def hash_bits(key: Column) -> Column:
    """The key's MD5 as a text of 128 bits; a null key counts as an empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.concat(*[F.lpad(F.bin(F.conv(F.substring(digest, k, 8), 16, 10).cast("long")), 32, "0") for k in range(1, 33, 8)])


def directory(keys: DataFrame, limit: int) -> DataFrame:
    """depth, prefix, bytes, docs, single of each bucket, from keys(bits, bytes, docs); a hash may have several rows.

    A bucket is the shortest prefix that is within the limit, or that no further bit splits, as it holds a single hash.
    Buckets are found in rounds: the cells that are still too large take further bits, so many that their largest comes
    below the limit if it splits evenly, STEP at most, until no cell is left."""
    buckets: list[DataFrame] = []
    left, depth, largest = keys, 0, keys.agg(F.sum("bytes")).first()[0]
    while largest is not None:
        step = min(STEP, BITS - depth, max(1, math.ceil(math.log2(max(1.0, largest / max(1, limit)))) + 2))
        top = depth + 1 if depth else 0
        finest = left.groupBy(F.left("bits", F.lit(depth + step)).alias("bits")).agg(
            F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("bits").alias("least"), F.max("bits").alias("most")
        )
        levels = F.transform(F.sequence(F.lit(top), F.lit(depth + step)), lambda d: F.struct(d.alias("depth"), F.left("bits", d).alias("prefix")))
        each = finest.select("bytes", "docs", "least", "most", F.explode(levels).alias("x"))
        sums = materialize(each.groupBy("x.depth", "x.prefix").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), (F.min("least") == F.max("most")).alias("single")))
        over = (F.col("bytes") > limit) & ~F.col("single")
        below = sums.where(over).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(*[F.concat("prefix", F.lit(b)) for b in "01"])).alias("prefix"))
        leaf = sums.where(~over)
        buckets.append(materialize(leaf.where(F.col("depth") == top).unionByName(leaf.where(F.col("depth") > top).join(below, ["depth", "prefix"], "left_semi"))))
        depth += step
        cells = materialize(sums.where(over & (F.col("depth") == depth)).select("prefix", "bytes"))
        largest = cells.agg(F.max("bytes")).first()[0] if depth < BITS else None
        if largest is not None:
            left = materialize(left.join(cells, F.left("bits", F.lit(depth)) == F.col("prefix"), "left_semi"))
        release(sums)
    empty = keys.select(F.lit(0).alias("depth"), F.col("bits").alias("prefix"), "bytes", "docs", F.lit(True).alias("single")).limit(0)
    return reduce(DataFrame.unionByName, buckets, empty)


def _paged(rows: DataFrame, limit: int) -> DataFrame:
    """page of each row in buckets of a single hash over the limit. Rows over half the limit have a page each ("+number");
    the others are laid end to end, in the order of their texts' digests, and cut every half limit (".number"), so that a
    page and its last row stay within the limit. Both running sums are taken in two passes, within ranges of rows and over
    the ranges' totals, so that no task holds a bucket."""
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = materialize(rows.repartitionByRange(int(n), "prefix", "digest", "row").withColumn("slice", F.spark_partition_id()))
    half = max(1, limit // 2)
    large = F.col("n_bytes") > half
    small_bytes, one = F.when(large, 0).otherwise(F.col("n_bytes")), F.when(large, 1).otherwise(0)
    inner = Window.partitionBy("prefix", "slice").orderBy("digest", "row").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("prefix").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    totals = ranged.groupBy("prefix", "slice").agg(F.sum(small_bytes).alias("t"), F.sum(one).alias("u"))
    offsets = totals.select("prefix", "slice", F.coalesce(F.sum("t").over(outer), none).alias("t"), F.coalesce(F.sum("u").over(outer), none).alias("u"))
    within = ranged.withColumn("b", F.coalesce(F.sum(small_bytes).over(inner), none)).withColumn("k", F.coalesce(F.sum(one).over(inner), none))
    page = F.when(large, F.concat(F.lit("+"), (F.col("u") + F.col("k")).cast("string"))).otherwise(F.concat(F.lit("."), F.floor((F.col("t") + F.col("b")) / half).cast("string")))
    return within.join(offsets, ["prefix", "slice"]).withColumn("page", page).drop("slice", "b", "k", "t", "u")


def assign(docs: DataFrame, keep: list, key: Column, text: Column, limit: int = LIMIT) -> DataFrame:
    """keep, n_bytes, shard, shard_depth, shard_bytes, shard_docs for every row."""
    digest = F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    rows = materialize(
        docs.select(F.struct(*keep).alias("own"), hash_bits(key).alias("bits"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), digest.alias("digest"), F.monotonically_increasing_id().alias("row"))
    )
    buckets = materialize(directory(rows.select("bits", F.col("n_bytes").alias("bytes"), F.lit(1).cast("long").alias("docs")), limit))
    depths = sorted(r.depth for r in buckets.select("depth").distinct().collect())  # BITS + 1 at most
    n_buckets, n_single = buckets.agg(F.count("*"), F.count(F.when(F.col("bytes") > limit, 1))).first()
    paths = F.array(*[F.struct(F.lit(d).alias("depth"), F.left("bits", F.lit(d)).alias("prefix")) for d in depths] or [F.struct(F.lit(0).alias("depth"), F.lit("").alias("prefix"))])
    named = buckets.select("depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))
    placed = rows.select("own", "n_bytes", "digest", "row", F.explode(paths).alias("x")).select("own", "n_bytes", "digest", "row", "x.*")
    placed = placed.join(F.broadcast(named) if n_buckets <= BROADCAST_BUCKETS else named, ["depth", "prefix"])
    out = lambda df, shard: df.select("own.*", "n_bytes", shard.alias("shard"), F.col("depth").alias("shard_depth"), "shard_bytes", "shard_docs")
    fits = out(placed.where(F.col("shard_bytes") <= limit), F.col("prefix"))
    if not n_single:
        return fits
    paged = materialize(_paged(placed.where(F.col("shard_bytes") > limit), limit))
    sizes = paged.groupBy("prefix", "page").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return fits.unionByName(out(paged.drop("shard_bytes", "shard_docs").join(sizes, ["prefix", "page"]), F.concat("prefix", "page")))


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), shard (the bucket's hash bits), shard_depth, shard_bytes, shard_docs.

    A null text has no bytes; a null id hashes as an empty text. Every shard is within the limit, except one that holds
    a single row over it, as a very long text may be. A bucket over the limit takes another bit of the 128 until it fits;
    only rows of one key, which no bit tells apart, are cut into pages ("bits.page", and "bits+number" for a row over half
    the limit). Repeated rows are dealt each for itself. An empty table gives an empty result; other columns are left
    out."""
    return assign(docs, [F.col(f"`{doc_id}`").alias("doc_id")], F.col(f"`{doc_id}`"), F.col(f"`{text}`"), limit)


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> None:
    """Writes docs, all columns, as Parquet with a folder for each shard. Rows are numbered once and written, so that
    repeated rows, too, each go to the shard that was sized with them."""
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("_id"), packed(docs)))
    of = assign(numbered, ["_id"], F.col("_row")[doc_id], F.col("_row")[text], limit).select("_id", "shard")
    numbered.join(of, "_id").select("_row.*", F.concat(F.lit("s"), "shard").alias("_shard")).repartition("_shard").write.partitionBy("_shard").parquet(path)
    release(numbered)
