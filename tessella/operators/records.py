"""Heterogeneous records as VARIANT rows: leaves, schemas, columns, and records again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordering import numbered
from .stored import materialize


def parse(lines: DataFrame, ordinal: str, text: str) -> DataFrame:
    """ordinal and rec from JSON texts; a text that is no object gives a null rec."""
    # A text that is JSON is an object if it begins with a brace; so each text is parsed once and its schema isn't asked for.
    opened = F.ltrim(F.col(text), F.lit(" \t\r\n")).startswith("{")
    return lines.select(F.col(ordinal).cast("long").alias("ordinal"), F.try_parse_json(F.when(opened, F.col(text))).alias("rec"))


def _nesting(schema: Column) -> Column:
    """Levels of brackets in a schema's text; names that hold brackets stand in back quotes and don't count."""
    brackets = F.regexp_replace(F.regexp_replace(schema, "`[^`]*`", ""), "[^<>]", "")
    start = F.struct(F.lit(0).alias("level"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        level = a["level"] + F.when(c == "<", 1).otherwise(-1)
        return F.struct(level.alias("level"), F.greatest(a["most"], level).alias("most"))

    return F.when(brackets == "", 0).otherwise(F.aggregate(F.split(brackets, ""), start, step, lambda a: a["most"]))


def depth(records: DataFrame) -> int:
    """Levels of objects at most in any record; records that are alike are looked at once."""
    return records.select(F.schema_of_variant("rec").alias("schema")).distinct().agg(F.max(_nesting(F.col("schema")))).first()[0] or 1


def flatten(records: DataFrame) -> DataFrame:
    """ordinal, path (array of keys), value (VARIANT) of every leaf: what is no object, and an empty object below the
    root. A record without leaves gives one row with an empty path and no value; a null record gives none. Objects are
    opened level by level within one pass, each record to its own depth, whatever others hold at the same path."""
    spark = records.sparkSession
    levels = depth(records)

    def inner(value: Column) -> Column:
        schema = F.schema_of_variant(value)
        return F.when(schema.startswith("OBJECT<") & (schema != "OBJECT<>"), value)

    # What has been opened once and is a leaf isn't looked at again.
    at = spark.sql("SELECT r.ordinal, CASE WHEN e.key IS NULL THEN CAST(array() AS array<string>) ELSE array(e.key) END AS path, e.value, e.key IS NOT NULL AS fresh FROM {r} r, LATERAL variant_explode_outer(r.rec) e", r=records.where("rec IS NOT NULL"))
    for _ in range(levels - 1):
        marked = at.withColumn("inner", F.when(F.col("fresh"), inner(F.col("value"))))
        at = spark.sql("SELECT r.ordinal, CASE WHEN e.key IS NULL THEN r.path ELSE concat(r.path, array(e.key)) END AS path, CASE WHEN e.key IS NULL THEN r.value ELSE e.value END AS value, e.key IS NOT NULL AS fresh FROM {r} r, LATERAL variant_explode_outer(r.inner) e", r=marked)
    return at.drop("fresh")


def leaves_only(flat: DataFrame) -> DataFrame:
    """The leaves of flatten(), without the rows that stand for records that have none."""
    return flat.where(F.size("path") > 0)


def schemas(flat: DataFrame) -> DataFrame:
    """ordinal and paths (sorted): the leaf schema of each record, empty for one without leaves."""
    return flat.groupBy("ordinal").agg(F.sort_array(F.collect_list(F.when(F.size("path") > 0, F.col("path")))).alias("paths"))


def registry(per_record: DataFrame) -> DataFrame:
    """schema_id (by first appearance), paths, n of each distinct schema."""
    seen = per_record.groupBy("paths").agg(F.min("ordinal").alias("_first"), F.count("*").alias("n"))
    return numbered(materialize(seen), "_first", "schema_id").select("schema_id", "paths", "n")


def global_paths(flat: DataFrame) -> DataFrame:
    """path_id and path: the sorted union of all paths."""
    return numbered(materialize(leaves_only(flat).select("path").distinct()), "path", "path_id").select("path_id", "path")


def record_keys(records: DataFrame) -> DataFrame:
    """key_id and key: the names on the records' first level, in order of first appearance and then by name."""
    keys = records.sparkSession.sql("SELECT r.ordinal, e.key FROM {r} r, LATERAL variant_explode(r.rec) e", r=records.where("rec IS NOT NULL"))
    first = keys.groupBy("key").agg(F.min("ordinal").alias("o")).select("key", F.struct("o", "key").alias("at"))
    return first.select((F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("key_id"), "key")


def columns(flat: DataFrame, chunk: int) -> DataFrame:
    """chunk, path, pos (place among the chunk's records that have the path), ordinal, value."""
    cut = leaves_only(flat).withColumn("chunk", F.floor(F.col("ordinal") / chunk).cast("long"))
    return cut.withColumn("pos", (F.row_number().over(Window.partitionBy("chunk", "path").orderBy("ordinal")) - 1).cast("long"))


def rebuild(per_record: DataFrame, cols: DataFrame, chunk: int) -> DataFrame:
    """flatten()'s rows again: each record's schema names its leaves, and the place of the record among those of its
    chunk that have a path finds the value. cols is columns() without the ordinal."""
    open_ = per_record.select(F.floor(F.col("ordinal") / chunk).cast("long").alias("chunk"), "ordinal", F.explode_outer("paths").alias("path"))
    placed = open_.withColumn("pos", (F.row_number().over(Window.partitionBy("chunk", "path").orderBy("ordinal")) - 1).cast("long"))
    found = placed.join(cols, ["chunk", "path", "pos"], "left")
    return found.select("ordinal", F.coalesce("path", F.array().cast("array<string>")).alias("path"), "value")


def nest(flat: DataFrame) -> DataFrame:
    """ordinal and rec: records again from their leaves, from the deepest level up. Rows are dealt by record once; objects
    are built as VARIANT, so values keep their types. A row with an empty path gives the record {}."""
    levels = flat.agg(F.max(F.size("path"))).first()[0] or 0
    at = flat.repartition("ordinal")
    built = lambda members: F.to_variant_object(F.map_from_entries(members))
    member = F.struct(F.element_at("path", -1).alias("key"), "value")
    for d in range(levels, 1, -1):
        deep = F.size("path") == d
        keyed = at.select("ordinal", F.when(deep, F.slice("path", 1, d - 1)).otherwise(F.col("path")).alias("to"), deep.alias("deep"), F.when(deep, member).alias("member"), F.when(~deep, F.col("value")).alias("value"))
        grouped = keyed.groupBy("ordinal", "to", "deep").agg(F.collect_list("member").alias("members"), F.first("value").alias("value"))
        at = grouped.select("ordinal", F.col("to").alias("path"), F.when(F.col("deep"), built(F.col("members"))).otherwise(F.col("value")).alias("value"))
    rows = at.groupBy("ordinal").agg(F.collect_list(F.when(F.size("path") == 1, F.struct(F.get("path", F.lit(0)).alias("key"), "value"))).alias("members"))
    return rows.select("ordinal", built(F.col("members")).alias("rec"))
