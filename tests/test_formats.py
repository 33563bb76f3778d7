import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tessella.sources import formats as X


def lines_of(spark, text, file="f", step=1):
    return spark.createDataFrame([(file, k * step, x) for k, x in enumerate(text.split("\n"))], "file string, ordinal long, line string")


@pytest.mark.parametrize("delimiter", [",", ";", "\t", "|"])
@pytest.mark.parametrize("step", [1, 30_000])
def test_csv_records_match_a_reader(spark, delimiter, step):
    rng = random.Random(step)
    rows = [["".join(rng.choice(f'ab "\n{delimiter}') for _ in range(rng.randrange(6))) for _ in range(4)] for _ in range(60)]
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator="\r\n").writerows(rows)
    got = X.csv_records(lines_of(spark, out.getvalue().removesuffix("\n"), step=step), delimiter).orderBy("ordinal").collect()
    assert [r.cells for r in got] == rows


def test_csv_quotes_in_the_middle_empty_cells_and_long_cells(spark):
    long = '"' + '""' * 100_000 + '\nz"'
    text = 'a"b,c\n,\n"x"y,"",\n\n' + long + ',1\n"never,closed\n5'
    got = [r.cells for r in X.csv_records(lines_of(spark, text)).orderBy("ordinal").collect()]
    assert got == [['a"b', "c"], ["", ""], ["xy", "", ""], ['"' * 100_000 + "\nz", "1"], ["never,closed\n5"]]
    assert X.csv_records(lines_of(spark, "").limit(0)).count() == 0


def test_csv_dialect_header_and_ragged_rows(spark):
    both = lines_of(spark, "id;name;name\n1;a,b;c\n2;d\n3;e;f;g", "s").union(lines_of(spark, "1,2\n3,4", "n")).union(lines_of(spark, "only", "o"))
    assert {r.file: r.delimiter for r in X.sniff_delimiter(both).collect()} == {"s": ";", "n": ",", "o": ","}
    rows = {(r.file, r.ordinal): (r.rec, r.extra) for r in X.csv_rows(X.csv_records(both, ";")).where("file = 's'").collect()}
    assert rows == {("s", 1): ({"id": "1", "name": "a,b", "name_2": "c"}, []), ("s", 2): ({"id": "2", "name": "d", "name_2": ""}, []), ("s", 3): ({"id": "3", "name": "e", "name_2": "f"}, ["g"])}
    heads = {r.file: (r.has_header, r.names) for r in X.header(X.csv_records(both)).collect()}
    assert heads["n"] == (False, ["column_1", "column_2"]) and heads["o"] == (True, ["only"])


def test_formats_by_name_and_content(spark):
    cases = [("a.CSV", "{", "csv"), ("a.tsv", "", "csv"), ("a.sql", "", "sql"), ("a.ndjson", "", "jsonl"), ("a.json", "SET x", "json"), ("a.txt", "﻿ [1]", "json"), ("", "-- x", "sql"), (None, "insert into", "sql"), (None, None, "json"), ("x", "SETTER", "json")]
    df = spark.createDataFrame(cases, "n string, h string, want string")
    assert [r.got for r in df.select(X.detect_format(F.col("n"), F.col("h")).alias("got")).collect()] == [c[2] for c in cases]


def test_json_arrays(spark):
    df = spark.createDataFrame([("a", '[{"k":1},2,{"k":null}]'), ("b", "{}"), ("c", None), ("d", "[]")], "file string, text string")
    got = X.parse_json_arrays(df).select("file", "ordinal", F.to_json("rec").alias("rec"), "ok").orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [("a", 0, '{"k":1}', True), ("a", 1, None, False), ("a", 2, '{"k":null}', True)]


def test_dumps_come_back_line_by_line(spark):
    dump = "\n".join((
        "SET a;", "COPY t (x, y) FROM stdin;", "1\t\\N", "a\\tb\t\\x41", "\\.", "INSERT INTO t (x, y) VALUES (1, NULL);", "INSERT INTO t (x, y) VALUES ('O''Brien', f(1, 'a,b'));",
        "INSERT INTO t (x) VALUES ('a'::text);", "insert into t (x) values (1);", "INSERT INTO t (x, y) VALUES (1);", "INSERT INTO t (x) VALUES (1), (2);", "",
    ))
    lines = lines_of(spark, dump)
    parts = X.dump_parts(lines)
    got = {r.ordinal: (r.kind, r.cells) for r in parts.collect()}
    assert got[2] == ("copy", ["1", None]) and got[5] == ("insert", ["1", None]) and got[6] == ("insert", ["O'Brien", "f(1, 'a,b')"]) and got[7] == ("insert", ["'a'::text"])
    assert [got[k][0] for k in (0, 1, 4, 8, 9, 11)] == ["literal"] * 6
    assert [r.line for r in X.dump_text(parts).orderBy("ordinal").collect()] == dump.split("\n")


def test_lines_are_written_in_order(spark, tmp_path):
    X.write_lines(spark.range(500).select((499 - F.col("id")).alias("ordinal"), F.col("id").cast("string").alias("line")), str(tmp_path / "o"), 4)
    assert "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*"))).split() == [str(499 - k) for k in range(500)]
