import pytest
from pyspark.sql import functions as F

from tessella.operators import encodings as E
from tessella.sources import formats as X
from tessella.sources import text as T
from tessella.streaming import ingest


def test_line_order_and_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join('{"k":%d}\r\n' % k for k in range(500)) + "\n[1]\nno\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        lines = T.read_lines(spark, str(tmp_path / "a.jsonl"))
        got = T.parse_json_lines(lines).orderBy("ordinal").select(F.expr("try_variant_get(rec, '$.k', 'int')").alias("k"), "ok", "ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.k, r.ok, r.ordinal) for r in got] == [(k, True, k) for k in range(500)] + [(None, False, 501), (None, False, 502)]


def test_copy_blocks(spark):
    dump = ["SET a;", "COPY t (x, y) FROM stdin;", "1\t\\N", "a\\tb\\\\n\t", "\\.", "1\t2", "COPY s.u (z) FROM stdin;", "q", "\\."]
    got = T.copy_rows(spark.createDataFrame([("f", k, x) for k, x in enumerate(dump)], "file string, ordinal long, line string")).orderBy("ordinal").collect()
    assert [(r.target, r.cells) for r in got] == [("t", ["1", None]), ("t", ["a\tb\\n", ""]), ("s.u", ["q"])]


@pytest.mark.parametrize("head", ["COPY t (a) FROM STDIN;", "copy t(a) from stdin; ", "COPY ONLY t (a) FROM stdin;"])
def test_copy_heads_in_any_case(spark, head):
    got = T.copy_rows(spark.createDataFrame([("f", 0, head), ("f", 1, "x"), ("f", 2, "\\.")], "file string, ordinal long, line string")).collect()
    assert [(r.target.split()[-1], r.cells) for r in got] == [("t", ["x"])]


def test_stream_gives_the_cells_back_and_compacts(spark, tmp_path):
    """The order column begins anew in each file, and each file is a batch."""
    schema = "id long, t string, f double, a array<int>"
    rows = [[(k, None if k % 3 else f"v{f}{k}", k / 4, [k, f]) for k in range(30)] for f in range(2)]
    for f in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        spark.createDataFrame(rows[f], schema).coalesce(1).write.json(str(tmp_path / f"w{f}"))
        next((tmp_path / f"w{f}").glob("part-*")).rename(tmp_path / "in" / f"{f}.json")
        ingest.start(spark, str(tmp_path / "in"), schema, "id", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    cells = ingest.compacted(spark.read.parquet(str(tmp_path / "out")), 25)
    assert cells.agg(F.max("chunk")).first()[0] == 2
    back = E.wide_frame(cells, spark.createDataFrame([], schema).schema).orderBy("pos").collect()
    assert [(r.id, r.t, r.f, r.a) for r in back] == rows[0] + rows[1]


FILES = {
    "object.json": ('{"a": 1,\n "b": {}}', "json-object", ['{"a":1,"b":{}}']), "array.json": ('\ufeff[{"a":1},\n{"b":null}]', "json-array", ['{"a":1}', '{"b":null}']),
    "one.jsonl": ('{"a":1}\n', "jsonl", ['{"a":1}']), "lines.txt": ('\ufeff{"a":1}\r\n\r\n{"a":[2]}', "jsonl", ['{"a":1}', '{"a":[2]}']), "t.csv": ("\ufeffx;y\r\n1;2\r\n", "csv", [{"x": "1", "y": "2"}]),
}


@pytest.mark.parametrize("name", FILES)
def test_one_reader_for_all_formats(spark, tmp_path, name):
    text, form, want = FILES[name]
    (tmp_path / name).write_bytes(text.encode())
    got, records = X.read_input(spark, str(tmp_path / name))
    rows = records.orderBy("ordinal")
    assert got == form and [r.rec for r in (rows if form == "csv" else rows.select(F.to_json("rec").alias("rec"))).collect()] == want


@pytest.mark.parametrize("name, text, form", [("e.json", " \n", None), ("n.json", "[1,2,3]", None), ("s.jsonl", '{"a":1}\n[2]', None), ("h.csv", "only,a,header", None), ("b.json", '{"a":1}\nno', None), ("c.csv", "[1]", "jsonl")])
def test_bad_inputs_raise(spark, tmp_path, name, text, form):
    (tmp_path / name).write_text(text)
    with pytest.raises(ValueError, match="empty|object|no data rows"):
        X.read_input(spark, str(tmp_path / name), form)


def test_a_folder_is_read_with_all_below_it_and_dumps_may_be_empty(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "2.jsonl").write_text('{"k":2}\n')
    (tmp_path / "a" / "b" / "1.jsonl").write_text('{"k":1}\n{"k":3}')
    (tmp_path / "a" / "note.md").write_text("not read")
    form, records = X.read_input(spark, str(tmp_path / "a"))
    assert form == "jsonl" and records.count() == 3
    assert [r.file.rsplit("/", 1)[1] for r in T.files(T.read_lines(spark, str(tmp_path / "a"))).collect()] == ["2.jsonl", "1.jsonl"]
    (tmp_path / "d.sql").write_text("SET x = 1;\n")
    assert X.read_input(spark, str(tmp_path / "d.sql"))[1].select("kind").collect()[0].kind == "literal"


@pytest.mark.parametrize("eol, bom, trailing", [("\n", False, True), ("\r\n", True, False), ("\r\n", False, True), ("\n", True, False)])
def test_layout_of_files(spark, tmp_path, eol, bom, trailing):
    text = ("\ufeff" if bom else "") + eol.join(["a,é", "1,2", "3,4"]) + (eol if trailing else "")
    (tmp_path / "f.csv").write_bytes(text.encode())
    r = T.layout(T.read_raw(spark, str(tmp_path / "f.csv"))).first()
    assert (r.bom, r.eol, r.trailing_newline) == (bom, eol, trailing)
    lines = X.csv_document(spark.createDataFrame([(0, "1", "2"), (1, "3", "4")], "k long, a string, b string"), "k", ["a", "b"], ["a", "é"], eol=eol, bom=bom)
    raw = T.read_raw(spark, str(tmp_path / "f.csv")).select(F.col("file"), (F.col("ordinal") - 1).alias("ordinal"), "line")
    if not bom:  # the reader takes the mark away
        assert X.same_lines(lines.withColumn("file", F.lit(raw.first().file)), raw).first().equal


def test_serialize_dispatches(spark):
    from tessella.operators import records as R

    records = R.parse(spark.createDataFrame([(0, '{"a":1,"b":"x,y"}'), (1, '{"c":null,"a":"z"}')], "k long, t string"), "k", "t")
    lines = lambda form, **x: [r.line for r in X.serialize(records, form, **x).orderBy("ordinal").collect()]
    assert lines("jsonl") == ['{"a":1,"b":"x,y"}', '{"a":"z","c":null}'] and lines("json-array") == ["[", '{"a":1,"b":"x,y"},', '{"a":"z","c":null}', "]"]
    assert lines("json-object") == ['{"a":1,"b":"x,y"}'] and lines("csv") == ["a,b,c", '1,"x,y",', "z,,"] and lines("csv", columns=["b"], has_header=False) == ['"x,y"', ""]
    with pytest.raises(ValueError):
        X.serialize(records, "xml")
