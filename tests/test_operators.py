import pytest
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import encodings as E
from tessella.operators import records as R
from tessella.operators import sequences as Q


def column(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pos long, value long").selectExpr("pos div 3 AS chunk", "pos", "value")


@pytest.mark.parametrize("values", [[], [5], [1, 2], [3, 3, 3, 4, 4, 9, -7, 0], [2**40, -(2**40), 0]])
def test_deltas_and_runs_give_the_column_back(spark, values):
    c = column(spark, values)
    got = lambda df: [r.value for r in df.orderBy("pos").collect()]
    assert got(Q.undelta(Q.delta(c).drop("value"))) == values
    assert got(Q.undelta2(Q.delta2(c).drop("value"))) == values
    back = Q.unrun(Q.runs(c)).withColumn("pos", F.col("begin") + F.col("k"))
    assert got(back) == values


def test_null_runs_and_codes(spark):
    c = spark.createDataFrame([(0, 0, None), (0, 1, None), (0, 2, "a"), (0, 3, None)], "chunk long, pos long, value string")
    assert [(r.value, r.n) for r in Q.runs(c).orderBy("begin").collect()] == [(None, 2), ("a", 1), (None, 1)]
    d = Q.dictionary(c)
    assert [r.code for r in Q.encode_codes(c, d).orderBy("pos").collect()] == [0, 0, 1, 0]


@pytest.mark.parametrize(
    "text, want",
    [("2024-01-02T03:04:05.123456789Z", 1704164645123456789), ("2024-02-30T00:00:00Z", None), ("2024-01-02T03:04:05", None), ("2024-01-02T03:04:05Z\n", None), ("1960-01-01T00:00:00.5Z", -315619199500000000)],
)
def test_timestamps(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(S.timestamp_ns(F.col("s")).alias("ns")).first().ns == want


LINES = ['{"a":null,"b":{}}', '{"b":{"c":1}}', "{}", '{"a":[1,{"x":2}],"a.b":"t"}', "[1]", "oops", '{"a":{"b":{"c":{"d":1}}}}', '{"a>":{"b":{"c":{"d":1.0}}},"`<":{"k":{}}}']


def flat_lines(spark):
    return R.flatten(R.parse(spark.createDataFrame(list(enumerate(LINES)), "i long, t string"), "i", "t"))


def test_absent_is_not_null_and_mixed_paths_open(spark):
    got = sorted((r.ordinal, tuple(r.path), r.v) for r in flat_lines(spark).select("ordinal", "path", F.to_json("value").alias("v")).collect())
    assert got == [
        (0, ("a",), "null"), (0, ("b",), "{}"), (1, ("b", "c"), "1"), (2, (), None), (3, ("a",), '[1,{"x":2}]'), (3, ("a.b",), '"t"'),
        (6, ("a", "b", "c", "d"), "1"), (7, ("`<", "k"), "{}"), (7, ("a>", "b", "c", "d"), "1"),
    ]


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_records_come_back_from_their_columns(spark, chunk):
    flat = flat_lines(spark)
    back = R.nest(R.rebuild(R.schemas(flat), R.columns(flat, chunk).drop("ordinal"), chunk))
    shown = lambda df: {r.ordinal: (r.t, r.s) for r in df.select("ordinal", F.to_json("rec").alias("t"), F.schema_of_variant("rec").alias("s")).collect()}
    assert shown(back) == shown(R.parse(spark.createDataFrame(list(enumerate(LINES)), "i long, t string"), "i", "t").where("rec IS NOT NULL"))


@pytest.mark.parametrize("kind", ["long", "string", "array"])
def test_rows_are_numbered_in_ranges(spark, monkeypatch, kind):
    from tessella.operators import ordering

    monkeypatch.setattr(ordering, "ALONE", 10)
    monkeypatch.setattr(ordering, "RANGE", 50)
    k = F.col("id") * 977 % 5003
    df = spark.range(3000).select({"long": k, "string": F.md5(k.cast("string")), "array": F.array(F.lit("p"), k.cast("string"))}[kind].alias("k"))
    got = ordering.numbered(df, "k", "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(3000)) and [r.k for r in got] == sorted(r.k for r in df.collect())


def test_sparse_and_text_keys_fill_chunks(spark):
    df = spark.range(1000).select((F.col("id") * 4096).alias("k"), F.format_string("k%05d", "id").alias("t"), "id")
    for key in ("k", "t"):
        assert Q.chunked(df, key, "id").agg(F.max("chunk"), F.max("pos")).first() == (0, 999)
        assert E.long_frame(df, key).select("chunk").distinct().count() == 1


def test_prefixes_of_long_texts(spark):
    pairs = [("", ""), ("a", ""), ("abc", "abd"), ("é" * 5000 + "x", "é" * 5000 + "y"), ("q" * 70_000, "q" * 70_000), ("a" * 4096, "a" * 4097), (None, "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select(S.common_prefix_len(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.n for r in got] == [0, 0, 2, 5000, 70_000, 4096, 0]


def test_no_cell_is_lost(spark):
    from datetime import date, datetime
    from decimal import Decimal

    schema = "k int, f double, d date, t timestamp, n decimal(12,2), a array<double>, b binary, s struct<x:int,y:string>, m map<string,int>, o boolean, e string"
    rows = [(k, None if k % 3 == 0 else k / 3, date(2020, 1, 1 + k), datetime(2020, 1, 1, 0, 0, k, k), Decimal(k) / 4, [k / 7], bytes([k]), (k, "é"), {"q": k}, k % 2 == 0, None) for k in range(20)]
    df = spark.createDataFrame(rows, schema)
    cells = E.long_frame(df, "k")
    assert cells.where("kind <> 'null' AND i IS NULL AND d IS NULL AND s IS NULL").count() == 0
    back = E.wide_frame(cells, df.schema).orderBy("pos").drop("chunk", "pos").collect()
    assert back == df.orderBy("k").collect()
    hurt = cells.withColumn("d", F.when((F.col("pos") == 4) & (F.col("path") == "f"), F.lit(0.5)).otherwise(F.col("d")))
    assert {r.path: r.diffs for r in E.differences(cells, hurt).collect() if r.diffs} == {"f": 1}


def test_packed_sizes(spark):
    values = [0, -33, 128, 255, 256, -129, 2**16, -(2**15) - 1, 2**32, -(2**63)]
    assert [r.n for r in spark.createDataFrame([(v,) for v in values], "v long").select(S.packed_int(F.col("v")).alias("n")).collect()] == [1, 2, 2, 2, 3, 3, 5, 5, 9, 9]
    df = spark.createDataFrame([([1, 300, None], {"ab": 1.5}, (True, "é")), (None, None, None)], "a array<long>, m map<string,double>, s struct<x:boolean,y:string>")
    sizes = df.select(*[S.packed_len(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]).collect()
    assert [tuple(r) for r in sizes] == [(1 + 1 + 3 + 1, 1 + 3 + 9, 1 + 2 + 1 + 2 + 3), (1, 1, 1)]


@pytest.mark.parametrize("text, kind", [("0042", "text"), ("7", "int"), ("-12", "int"), ("-0", "text"), ("1.50", "text"), ("1.5", "float"), ("1e5", "text"), ("+7", "text"), ("9007199254740993", "text"), ("", "text")])
def test_inference_keeps_what_does_not_print_back(spark, text, kind):
    assert spark.createDataFrame([(text,)], "s string").select(S.infer_kind(F.col("s")).alias("k")).first().k == kind


def test_addresses(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("256.1.1.1",), ("01.2.3.4",), ("255.255.255.255",)], "s string")
    assert [r.n for r in df.select(S.ipv4_number(F.col("s")).alias("n")).collect()] == [167772161, None, None, 4294967295]


def costs_of(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), f"k long, v {'long' if isinstance(values[0], int) else 'string'}")
    return {r.enc: r.cost for r in E.candidates(E.statistics(E.long_frame(df, "k"))).where("path = 'v'").collect()}


def test_candidates_for_texts_with_numbers_and_hex(spark):
    latency = costs_of(spark, [f"took 0.{k % 100:02d}s" for k in range(800)])
    assert latency["numtemplate"] == 2 + 807 + 100  # differences, seven of them of two bytes, and codes of one scale
    trace = costs_of(spark, [f"trace/g00000000{k * 2654435761 % 2**32:08x}" for k in range(500)])
    assert trace["prefix_hex"] == 500 * 8 // 2
    assert "hex" not in trace and "numtemplate" not in trace
    for odd in ("a+1", "a01", "a-0", "a-0.0", "b1", "a\x011"):
        assert "numtemplate" not in costs_of(spark, ["a1", "a2", odd])
    assert "prefix_hex" not in costs_of(spark, ["x/0123456789abcdef", "x/f123456789ABCDEF"])
    assert costs_of(spark, ["007", "8"]).keys() >= {"strraw", "front"} and "uintstr" not in costs_of(spark, ["007", "8"])
    assert costs_of(spark, [str(10**15 + k) for k in range(100)])["uintstr"] == 8 + 99
    assert costs_of(spark, ["é" * 100 + x for x in "ab" * 10])["prefix_raw"] == 20 * 2
    # A dictionary that is front coded: of 300 long words with a common beginning, each once and in order.
    words = [f"{'w' * 40}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    assert costs_of(spark, words)["strdict"] < 300 * 10


def test_numbers_at_the_ends_of_64_bits(spark):
    ends = costs_of(spark, [2**63 - 1, -(2**63), 0, -(2**63)])
    assert ends["ints"] == 10 + 10 + 1 + 10 and "intdelta" not in ends and "intdelta2" not in ends
    far = costs_of(spark, ["9999-12-31T00:00:00Z", "0001-01-01T00:00:00Z"])
    assert "timestamp" not in far and "strraw" in far


def test_long_texts_can_be_inspected(spark):
    df = spark.createDataFrame([(k, f"{'long text ' * 20_000}{k}") for k in range(20)], "k long, v string")
    assert E.inspect(df, "k").where("path = 'v'").first().n == 20


def test_varint_sizes_at_their_ends(spark):
    values = [0, 127, 128, 2**14 - 1, 2**14, 2**49, 2**56 - 1, 2**56, 2**63 - 1, -1, None]
    got = spark.createDataFrame([(v,) for v in values], "v long").select(S.uvarint_len(F.col("v")).alias("n")).collect()
    assert [r.n for r in got] == [1, 1, 2, 2, 3, 8, 8, 9, 9, 10, 1]


def test_prefixes_as_columns(spark):
    pairs = [("", ""), ("a", ""), ("abc", "abd"), ("é" * 62 + "x", "é" * 62 + "y"), ("é" * 63 + "x", "é" * 63 + "y"), ("q" * 64, "q" * 63), ("ab" * 20, "ab" * 40), (None, "a"), ("same", "same"), ("x", "y")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = E._with_prefixes(df, "n", "a", "b").withColumn("m", S.common_prefix_len(F.col("a"), F.col("b"))).collect()
    assert [(r.n, r.m) for r in got if r.a is not None] == [(n, n) for n in (0, 0, 2, 62, 63, 63, 40, 4, 0)]


def test_dealt_tasks_grow_with_the_cells(spark, monkeypatch):
    """Few bytes of many equal texts aren't put into one task."""
    monkeypatch.setattr(E, "DEALT", 100)
    df = spark.range(2000).select("id", F.lit("same").alias("v"))
    stats = E.statistics(E.long_frame(df, "id", 50))
    assert stats._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 3
    got = E.choose(E.candidates(stats)).collect()
    assert len(got) == 80 and {r.enc for r in got if r.path == "v"} == {"const"}


def test_constants_of_all_kinds(spark):
    df = spark.createDataFrame([(k, 1.5, [1, 2], None, True, 0.5 * k, [k]) for k in range(9)], "k long, f double, a array<int>, e string, o boolean, g double, h array<int>")
    found = {r.path for r in E.candidates(E.statistics(E.long_frame(df, "k"))).where("enc = 'const'").collect()}
    assert found == {"f", "a", "e", "o"}


def test_texts_that_are_no_objects_give_null_records(spark):
    texts = [' \t{"a":1}', "{}", '\n{"a":', '"{"', "[{}]", " 1", "null", "", None, "{oops}", '{"a":1} ']
    got = R.parse(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "i", "t").select("ordinal", F.to_json("rec").alias("t")).orderBy("ordinal").collect()
    assert [r.t for r in got] == ['{"a":1}', "{}", None, None, None, None, None, None, None, None, '{"a":1}']


@pytest.mark.parametrize("name", ["schema_ids", "schema_counts", "schema_seq_cost", "reconstruct", "nest_records", "roundtrip_diff"])
def test_records_used_twice_are_not_parsed_again(spark, name):
    from tessella.plans.queries import FOUND

    plan = FOUND[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "parse_json" not in plan and "variant_explode" not in plan
