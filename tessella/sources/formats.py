"""Formats by name and content, CSV with quoted line feeds, JSON arrays, whole dumps, and writers that keep the order."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import copy_escape, csv_cell
from ..operators.records import record_keys
from .text import BOM, SLICE, copy_rows, parse_json_lines, read_lines

#: Delimiters that are tried, in this order, and the records that are looked at for it.
DELIMITERS = (",", ";", "\t", "|")
SAMPLE = 20
SQL_START = r"(?i)^(--|/\*|SET\s|CREATE\s|COPY\s|INSERT\s|BEGIN;|START TRANSACTION)"
INSERT = r"(?i)^INSERT\s+INTO\s+(\S+)\s*\(([^)]*)\)\s*VALUES\s*\((.*)\);\z"
#: A value of a tuple: quoted texts, brackets (two deep) and other characters.
_TEXT, _PLAIN = "'[^']*+'", "[^'()]++"
TOKEN = rf",((?:{_TEXT}|\((?:{_TEXT}|{_PLAIN}|\((?:{_TEXT}|{_PLAIN})*+\))*+\)|[^',()]++)*+)"
#: What a quoted CSV cell holds. Nothing is given back, so that a doubled quote never counts as an end.
_BODY = '[^"]*+(?:""[^"]*+)*+'


def detect_format(name: Column, head: Column) -> Column:
    """csv, sql, jsonl or json: by the name's ending where that says it, else by how the content begins."""
    ending = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    begins = F.regexp_replace(F.left(F.coalesce(head, F.lit("")), F.lit(8192)), "^﻿?\\s*", "")
    by_name = F.when(ending.isin("csv", "tsv"), "csv").when(ending == "sql", "sql").when(ending.isin("jsonl", "ndjson"), "jsonl").when(ending == "json", "json")
    return F.coalesce(by_name, F.when(~begins.rlike(r"^[{\[]") & begins.rlike(SQL_START), "sql").otherwise("json"))


def parse_json_arrays(texts: DataFrame) -> DataFrame:
    """file, ordinal, rec, ok for each element of texts(file, text), each text a JSON array. An array can't be split
    before it is parsed, so each is read by one task; an element that is no object has a null rec, a text that is no
    array no rows."""
    docs = texts.select("file", F.try_parse_json("text").alias("doc")).where(F.schema_of_variant("doc").startswith("ARRAY"))
    each = texts.sparkSession.sql("SELECT d.file, CAST(e.pos AS BIGINT) AS ordinal, e.value AS rec FROM {d} d, LATERAL variant_explode(d.doc) e", d=docs)
    ok = F.coalesce(F.schema_of_variant("rec").startswith("OBJECT"), F.lit(False))
    return each.select("file", "ordinal", F.when(ok, F.col("rec")).alias("rec"), ok.alias("ok"))


def _cell(delimiter: str) -> str:
    d = re.escape(delimiter)
    return f'(?:"{_BODY}"[^{d}]*+|[^"{d}][^{d}]*+|)'


def _before(frame: DataFrame, keys: list[str], at: str) -> DataFrame:
    """known and parity for each row of frame(const, v, swap), in the order of at: what a two-valued state is before the
    row, if a row that sets it to v came earlier; and whether the rows before flip it an odd number of times."""
    w = Window.partitionBy(*keys).orderBy(at)
    counted = frame.withColumn("_s", F.sum("swap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.when(F.col("const"), F.struct(F.col(at), F.col("_s"), F.col("v")))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = F.col("_s") - F.col("swap")
    return counted.withColumn("_l", last).select(*frame.columns, (s % 2).alias("parity"), ((F.col("_l.v") + s - F.col("_l._s")) % 2).alias("known"))


def csv_records(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """file, ordinal (of the first line), cells of each record of lines(file, ordinal, line).

    A quote opens at the start of a cell only, a doubled one stands for itself, and line feeds in quotes belong to the
    cell. Whether a line begins in quotes follows from what each line does to that state (keep, flip, or set it), which
    is composed within slices of lines and then over slices; no task holds a file. Blank records are left out, a quote
    that never closes holds the rest of the file, and a carriage return at a record's end is dropped."""
    d = re.escape(delimiter)
    opens = rf'^(?:{_cell(delimiter)}{d})*+"{_BODY}\z'
    stays = rf'^{_BODY}(?:"[^{d}]*+{d}(?:{_cell(delimiter)}{d})*+"{_BODY})?+\z'
    marked = lines.select("file", "ordinal", "line", F.floor(F.col("ordinal") / SLICE).alias("slice"), F.col("line").rlike(opens).alias("out"), F.col("line").rlike(stays).alias("ins"))
    const, bit = F.col("out") == F.col("ins"), lambda c: c.cast("long")
    moves = marked.select("file", "ordinal", "line", "slice", const.alias("const"), bit(F.col("out")).alias("v"), bit(F.col("out") & ~F.col("ins")).alias("swap"))
    local = _before(moves, ["file", "slice"], "ordinal")
    state = lambda enter: F.coalesce("known", (enter + F.col("parity")) % 2)
    after = F.when(F.col("const"), F.col("v")).otherwise((F.col("known") + F.col("swap")) % 2)
    begun = lambda enter: F.max(F.when(state(F.lit(enter)) == 0, F.col("ordinal")))
    ends = local.groupBy("file", "slice").agg(F.max_by(F.struct(after.alias("v"), ((F.col("parity") + F.col("swap")) % 2).alias("p")), "ordinal").alias("x"), begun(0).alias("a0"), begun(1).alias("a1"))
    whole = ends.select("file", "slice", "a0", "a1", F.col("x.v").isNotNull().alias("const"), "x.v", F.when(F.col("x.v").isNull(), F.col("x.p")).otherwise(0).alias("swap"))
    earlier = Window.partitionBy("file").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    entered = _before(whole, ["file"], "slice").withColumn("enter", state(F.lit(0)))
    entered = entered.select("file", "slice", "enter", F.max(F.when(F.col("enter") == 0, F.col("a0")).otherwise(F.col("a1"))).over(earlier).alias("carried"))
    placed = local.join(entered, ["file", "slice"])
    own = F.max(F.when(state(F.col("enter")) == 0, F.col("ordinal"))).over(Window.partitionBy("file", "slice").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    grouped = placed.withColumn("first", F.coalesce(own, "carried")).groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("ordinal", "line"))).alias("x"))
    record = grouped.select("file", F.col("first").alias("ordinal"), F.regexp_replace(F.array_join(F.transform("x", lambda x: x.line), "\n"), "\r\\z", "").alias("record"))
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), "record"), F.lit(rf'{d}("{_BODY}"?+[^{d}]*+|[^"{d}][^{d}]*+|)'), 1)
    part = lambda c, k: F.regexp_extract(c, rf'(?s)^"({_BODY})"?+(.*)\z', k)
    value = lambda c: F.when(c.startswith('"'), F.concat(F.replace(part(c, 1), F.lit('""'), F.lit('"')), part(c, 2))).otherwise(c)
    return record.where("record <> ''").select("file", "ordinal", F.transform(found, value).alias("cells"))


def sniff_delimiter(lines: DataFrame) -> DataFrame:
    """file and delimiter: the one by which the first records are cut most evenly (into two cells at least), then into
    most cells, then the first listed; a comma where none cuts. Files of blank lines aren't listed."""
    head = lines.where(F.col("ordinal") < 10 * SAMPLE)
    order = Window.partitionBy("file").orderBy("ordinal")
    tried = []
    for place, d in enumerate(DELIMITERS):
        cut = csv_records(head, d).select("file", "ordinal", F.size("cells").alias("n"))
        seen = cut.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE).withColumn("n0", F.first("n").over(order))
        score = F.avg((F.col("n") == F.col("n0")).cast("double")) * 100 + F.first("n0")
        best = seen.groupBy("file").agg(F.when(F.first("n0") >= 2, score).otherwise(-1.0).alias("score"))
        tried.append(best.select("file", "score", F.lit(-place).alias("place"), F.lit(d).alias("d")))
    return reduce(DataFrame.unionByName, tried).groupBy("file").agg(F.max_by("d", F.struct("score", "place")).alias("delimiter"))


def header(records: DataFrame) -> DataFrame:
    """file, has_header, names: the first record's cells are names unless one is empty or a number, or the file has but
    one record, which always is a header. Names that are repeated get _2, _3 and so on; without a header they are
    column_1, column_2."""
    top = records.groupBy("file").agg(F.min_by("cells", "ordinal").alias("cells"), F.count("*").alias("n"))
    data = F.exists("cells", lambda c: (c == "") | F.trim(c).rlike(r"^[+-]?[0-9]+([.,][0-9]+)?\z"))
    has = (F.col("n") < 2) | ~data
    earlier = lambda c, i: F.size(F.filter(F.slice("cells", F.lit(1), i + 1), lambda x: x == c))
    named = F.transform("cells", lambda c, i: F.when(earlier(c, i) == 1, c).otherwise(F.concat(c, F.lit("_"), earlier(c, i).cast("string"))))
    counted = F.transform("cells", lambda c, i: F.concat(F.lit("column_"), (i + 1).cast("string")))
    return top.select("file", has.alias("has_header"), F.when(has, named).otherwise(counted).alias("names"))


def csv_rows(records: DataFrame) -> DataFrame:
    """file, ordinal, rec (a map by name), extra of each data record: missing cells are empty, surplus ones in extra."""
    heads = header(records)
    first = records.groupBy("file").agg(F.min("ordinal").alias("first"))
    data = records.join(heads.join(first, "file"), "file").where(~F.col("has_header") | (F.col("ordinal") > F.col("first")))
    width, own = F.size("names"), F.size("cells")
    filled = F.concat(F.slice("cells", F.lit(1), width), F.array_repeat(F.lit(""), F.greatest(width - own, F.lit(0))))
    return data.select("file", "ordinal", F.map_from_arrays("names", filled).alias("rec"), F.slice("cells", width + 1, F.greatest(own - width, F.lit(0))).alias("extra"))


def csv_lines(columns: list[str], delimiter: str = ",") -> Column:
    """A row of the columns as a CSV record."""
    return F.concat_ws(delimiter, *[csv_cell(F.col(f"`{c}`").cast("string"), delimiter) for c in columns])


def _insert_line(target: Column, columns: Column, cells: Column, quoted: Column) -> Column:
    shown = F.zip_with(cells, quoted, lambda c, q: F.when(c.isNull(), "NULL").when(q, F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(c))
    return F.concat(F.lit("INSERT INTO "), target, F.lit(" ("), F.array_join(columns, ", "), F.lit(") VALUES ("), F.array_join(shown, ", "), F.lit(");"))


def _copy_line(cells: Column) -> Column:
    return F.array_join(F.transform(cells, copy_escape), "\t")


def dump_parts(lines: DataFrame) -> DataFrame:
    """file, ordinal, kind, target, columns, cells, quoted, line for every line of a dump.

    kind is copy for data of a COPY block, insert for a single-row INSERT, else literal. Values are lifted only where
    writing them again gives the same line; line is null for those, and a literal's text for the rest."""
    data = copy_rows(lines).select("file", "ordinal", "target", "columns", "cells")
    all_ = lines.select("file", "ordinal", "line").join(data, ["file", "ordinal"], "left")
    got = lambda k: F.regexp_extract("line", INSERT, k)
    raw = F.regexp_extract_all(F.concat(F.lit(","), got(3)), F.lit(TOKEN), 1)
    is_text = lambda t: (F.length(t) >= 2) & t.startswith("'") & t.endswith("'")
    value = lambda t: F.when(F.upper(t) == "NULL", F.lit(None)).when(is_text(t), F.replace(F.substr(t, F.lit(2), F.length(t) - 2), F.lit("''"), F.lit("'"))).otherwise(t)
    inserts = (F.col("cells").isNull()) & F.col("line").rlike(INSERT)
    tokens = all_.select("*", F.when(inserts, got(1)).alias("t"), F.when(inserts, F.split(got(2), ", *")).alias("c"), F.when(inserts, F.transform(raw, lambda t: F.trim(t))).alias("tokens"))
    valued = tokens.select("*", F.transform("tokens", value).alias("v"), F.transform("tokens", is_text).alias("q"))
    as_insert = F.coalesce((F.size("v") == F.size("c")) & (_insert_line(F.col("t"), F.col("c"), F.col("v"), F.col("q")) == F.col("line")), F.lit(False))
    as_copy = F.coalesce(_copy_line(F.col("cells")) == F.col("line"), F.lit(False))
    pick = lambda copy, insert: F.when(as_copy, F.col(copy)).when(as_insert, F.col(insert))
    return valued.select(
        "file", "ordinal", F.when(as_copy, "copy").when(as_insert, "insert").otherwise("literal").alias("kind"), pick("target", "t").alias("target"),
        pick("columns", "c").alias("columns"), pick("cells", "v").alias("cells"), F.when(as_insert, F.col("q")).alias("quoted"), F.when(~as_copy & ~as_insert, F.col("line")).alias("line"),
    )


def dump_text(parts: DataFrame) -> DataFrame:
    """file, ordinal, line: the dump that dump_parts took apart."""
    line = F.when(F.col("kind") == "copy", _copy_line(F.col("cells"))).when(F.col("kind") == "insert", _insert_line(*map(F.col, ("target", "columns", "cells", "quoted"))))
    return parts.select("file", "ordinal", F.coalesce(line, "line").alias("line"))


def csv_document(rows: DataFrame, order: str, columns: list[str], names: list[str] | None = None, delimiter: str = ",", eol: str = "\n", bom: bool = False, has_header: bool = True) -> DataFrame:
    """ordinal and line of the rows as a CSV file: the header first (names where they differ from the columns), a byte order
    mark before it, and a carriage return in each line where lines end so."""
    end = F.lit("\r" if eol == "\r\n" else "")
    body = rows.select(F.col(order).cast("long").alias("ordinal"), F.concat(csv_lines(columns, delimiter), end).alias("line"))
    if has_header:
        heads = F.concat_ws(delimiter, *[csv_cell(F.lit(c), delimiter) for c in names or columns])
        body = body.unionByName(rows.agg((F.coalesce(F.min(order), F.lit(0)) - 1).cast("long").alias("ordinal")).select("ordinal", F.concat(heads, end).alias("line")))
    if bom:
        first = body.agg(F.min("ordinal").alias("_first"))
        body = body.join(F.broadcast(first)).select("ordinal", F.when(F.col("ordinal") == F.col("_first"), F.concat(F.lit(BOM), "line")).otherwise(F.col("line")).alias("line"))
    return body


def same_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """file, lines, equal: whether two frames of lines(file, ordinal, line) hold the same lines, byte for byte."""
    both = a.select("file", "ordinal", F.col("line").alias("x"), F.lit(1).alias("a")).join(b.select("file", "ordinal", F.col("line").alias("y"), F.lit(1).alias("b")), ["file", "ordinal"], "full")
    return both.groupBy("file").agg(F.count("*").alias("lines"), F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("x").eqNullSafe(F.col("y"))).alias("equal"))


def write_lines(lines: DataFrame, path: str, parts: int) -> None:
    """Text files of lines(ordinal, line) that give all lines in order when read by file name. Rows are dealt by ranges
    of the order."""
    lines.repartitionByRange(parts, "ordinal").sortWithinPartitions("ordinal").select("line").write.text(path)


def json_lines(records: DataFrame) -> DataFrame:
    """ordinal and line of records(ordinal, rec), keys in order."""
    return records.select("ordinal", F.to_json("rec").alias("line"))


def json_array(records: DataFrame) -> DataFrame:
    """ordinal and line of one JSON array: its brackets on lines of their own, a record on each other line."""
    ends = records.agg(F.coalesce(F.min("ordinal"), F.lit(0)).cast("long").alias("a"), F.coalesce(F.max("ordinal"), F.lit(0)).cast("long").alias("b"))
    own = json_lines(records).join(F.broadcast(ends)).select("ordinal", F.when(F.col("ordinal") < F.col("b"), F.concat("line", F.lit(","))).otherwise(F.col("line")).alias("line"))
    return own.unionByName(ends.select((F.col("a") - 1).alias("ordinal"), F.lit("[").alias("line"))).unionByName(ends.select((F.col("b") + 1).alias("ordinal"), F.lit("]").alias("line")))


def serialize(records: DataFrame, form: str, **dialect) -> DataFrame:
    """ordinal and line of records in one of the formats csv, sql, jsonl, json-array and json-object (the first record). sql
    takes the parts of a dump. CSV takes rows; records' keys make its columns where none are named."""
    if form == "sql":
        return dump_text(records)
    if form == "csv":
        if "rec" in records.columns:
            names = dialect.pop("columns", None) or [r.key for r in record_keys(records).orderBy("key_id").collect()]
            text = lambda k: F.when(F.try_variant_get("rec", f"$[{json.dumps(k)}]", "variant").isNotNull(), F.coalesce(F.try_variant_get("rec", f"$[{json.dumps(k)}]", "string"), F.lit("")))
            records = records.select("ordinal", *[text(k).alias(k) for k in names])
            dialect["columns"] = names
        return csv_document(records, "ordinal", **dialect)
    if form == "jsonl":
        return json_lines(records)
    if form == "json-array":
        return json_array(records)
    if form == "json-object":
        return json_lines(records.orderBy("ordinal").limit(1))
    raise ValueError(f"unknown format {form}")


def read_input(spark: SparkSession, path: str, form: str | None = None) -> tuple[str, DataFrame]:
    """The format and the records (file, ordinal, rec) of a file or folder, the same way for every format; an explicit format
    counts more than names and content. Of sql the parts of the dump are given, of csv a map by name as rec.

    An input without content, CSV without data rows, and JSON that holds anything but objects raise an error that names the
    first bad line. A dump without data is legal. JSON that isn't in lines is parsed a file at a time."""
    lines = read_lines(spark, path)
    filled = lines.where(F.trim("line") != "")
    top = filled.orderBy("file", "ordinal").first()
    if top is None:
        raise ValueError(f"{path}: input is empty")
    if form is None:
        form = spark.range(1).select(detect_format(F.lit(top.file), F.lit(top.line)).alias("f")).first().f
    if form == "sql":
        return form, dump_parts(lines)
    if form == "csv":
        delimiter = sniff_delimiter(lines.where(F.col("file") == top.file)).first().delimiter
        rows = csv_rows(csv_records(lines, delimiter))
        if not rows.head(1):
            raise ValueError(f"{path}: CSV input holds no data rows")
        return form, rows
    parsed = parse_json_lines(lines)
    bad = parsed.where("NOT ok").orderBy("file", "ordinal").first()
    if bad is None:
        return ("jsonl" if form == "jsonl" or parsed.limit(2).count() > 1 else "json-object"), parsed.select("file", "ordinal", "rec")
    if form == "jsonl" or parsed.where(F.col("file") == bad.file).orderBy("ordinal").first().ok:
        raise ValueError(f"{bad.file}: line {bad.ordinal + 1} is not a JSON object")
    texts = lines.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n").alias("text"))
    whole = texts.select("file", F.when(F.btrim(F.col("text"), F.lit(" \t\r\n")).rlike(r"[}\]]\z"), F.try_parse_json("text")).alias("doc"))
    kind = F.schema_of_variant("doc")
    wrong = whole.where(F.col("doc").isNull() | ~(kind.startswith("ARRAY") | kind.startswith("OBJECT"))).first()
    if wrong is not None:
        raise ValueError(f"{wrong.file}: line {bad.ordinal + 1} is not a JSON object, and the file is neither an object nor an array of objects")
    found = parse_json_arrays(texts)
    if found.where("NOT ok").head(1):
        raise ValueError(f"{path}: a top-level JSON array must contain objects")
    objects = whole.where(kind.startswith("OBJECT")).select("file", F.lit(0).cast("long").alias("ordinal"), F.col("doc").alias("rec"))
    return ("json-object" if not found.head(1) else "json-array"), found.select("file", "ordinal", "rec").unionByName(objects)
