"""Lines of text files with their order, JSON lines, and the COPY blocks of PostgreSQL dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lines in which a dump's state is followed by one window; states are carried over slices.
SLICE = 100_000
#: A COPY head in any case, with its target and columns.
COPY_HEAD = r"(?i)^COPY\s+(.+?)\s*\(([^)]*)\)\s+FROM\s+stdin;\s*\z"
#: Files that a folder is searched for.
ENDINGS = "*.{json,jsonl,ndjson,csv,tsv,sql}"
BOM = "\ufeff"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, line, size (of the file): lines as they stand, but for the line feed. They are numbered within each
    split of a file, and the splits' totals (one row each) are summed, so no task numbers a whole file. A folder is searched
    with all below it for files of known endings."""
    reader = spark.read.option("lineSep", "\n")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", ENDINGS)
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line")
    )
    at = F.row_number().over(Window.partitionBy("file", "block").orderBy("n")) - 1
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = raw.groupBy("file", "block").agg(F.count("*").alias("c")).select("file", "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    return raw.withColumn("at", at).join(base, ["file", "block"]).select("file", (F.col("base") + F.col("at")).cast("long").alias("ordinal"), "line", "size")


def clean(raw: DataFrame) -> DataFrame:
    """file, ordinal, line without the byte order mark before a file's first line and the carriage return at a line's end."""
    line = F.when((F.col("ordinal") == 0) & F.col("line").startswith(BOM), F.substr("line", F.lit(2))).otherwise(F.col("line"))
    return raw.select("file", "ordinal", F.regexp_replace(line, "\r\\z", "").alias("line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, line of a file, or of all files below a folder."""
    return clean(read_raw(spark, path))


def files(lines: DataFrame) -> DataFrame:
    """The files of lines in the order of their names."""
    return lines.select("file").distinct().orderBy("file")


def layout(raw: DataFrame) -> DataFrame:
    """file, bom, eol, trailing_newline of read_raw()'s lines. The first line tells how lines end. The file's size, less the
    lines' bytes and a line feed each, is -1 if the last line isn't ended, and 3 more where the reader took a mark away."""
    first = raw.groupBy("file").agg(F.min_by("line", "ordinal").alias("first"), (F.max("size") - F.sum(F.octet_length("line")) - F.count("*")).alias("more"))
    return first.select("file", (F.col("first").startswith(BOM) | (F.col("more") >= 2)).alias("bom"), F.when(F.col("first").endswith("\r"), "\r\n").otherwise("\n").alias("eol"), F.col("more").isin(0, 3).alias("trailing_newline"))


def parse_json_lines(lines: DataFrame) -> DataFrame:
    """file, ordinal, rec, ok: blank lines are left out; rec is null and ok false where a line holds no object."""
    rec = F.try_parse_json(F.ltrim(F.regexp_replace("line", f"^{BOM}", "")))
    parsed = lines.where(F.trim("line") != "").select("file", "ordinal", rec.alias("rec"), F.rtrim("line").endswith("}").alias("whole"))
    # The parser takes the first value of a text and leaves what follows it.
    ok = F.col("whole") & F.coalesce(F.schema_of_variant("rec").startswith("OBJECT"), F.lit(False))
    return parsed.select("file", "ordinal", F.when(ok, F.col("rec")).alias("rec"), ok.alias("ok"))


def _last(mark: Column) -> Column:
    return F.max(F.when(mark, F.col("ordinal")))


def copy_unescape(s: Column) -> Column:
    """A cell of a COPY line; \\N is null."""
    hold = "\x00"
    out = F.replace(s, F.lit("\\\\"), F.lit(hold))
    for raw, name in (("\b", "b"), ("\f", "f"), ("\n", "n"), ("\r", "r"), ("\t", "t"), ("\x0b", "v")):
        out = F.replace(out, F.lit("\\" + name), F.lit(raw))
    return F.when(s != "\\N", F.replace(out, F.lit(hold), F.lit("\\")))


def copy_rows(lines: DataFrame) -> DataFrame:
    """file, ordinal, target, columns, cells of each data line of lines(file, ordinal, line). A line belongs to the last
    COPY head before it if no end mark stands between; both are found by running maxima, within slices and over the
    slices' maxima. A data line that reads like a head itself is taken for one."""
    sliced = lines.withColumn("slice", F.floor(F.col("ordinal") / SLICE))
    head, end = F.col("line").rlike(COPY_HEAD), F.col("line") == "\\."
    inner = Window.partitionBy("file", "slice").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy("file").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    tops = sliced.groupBy("file", "slice").agg(_last(head).alias("h"), _last(end).alias("e"))
    carried = tops.select("file", "slice", F.max("h").over(outer).alias("h0"), F.max("e").over(outer).alias("e0"))
    seen = sliced.withColumn("h", _last(head).over(inner)).withColumn("e", _last(end).over(inner)).join(carried, ["file", "slice"])
    seen = seen.withColumn("h", F.coalesce("h", "h0")).withColumn("e", F.coalesce("e", "e0", F.lit(-1)))
    data = seen.where((F.col("h") > F.col("e")) & (F.col("h") < F.col("ordinal"))).select("file", "ordinal", "line", "h")
    heads = lines.where(head).select("file", F.col("ordinal").alias("h"), F.regexp_extract("line", COPY_HEAD, 1).alias("target"), F.split(F.regexp_extract("line", COPY_HEAD, 2), ", ?").alias("columns"))
    return data.join(heads, ["file", "h"]).select("file", "ordinal", "target", "columns", F.transform(F.split("line", "\t"), copy_unescape).alias("cells"))
