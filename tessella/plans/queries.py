"""The column operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import encodings as E
from ..operators import records as R
from ..operators import sequences as Q
from ..operators.stored import materialize
from ..sources import formats as X
from ..sources import text as T

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _custkeys(spark, d):
    return Q.chunked(table(spark, d, "orders"), "o_orderkey", "o_custkey")


def _types(spark, d):
    return Q.chunked(table(spark, d, "events"), "event_id", "event_type")


def _names(spark, d):
    return Q.chunked(table(spark, d, "customer"), "c_custkey", "c_name")


def _priorities(spark, d):
    return Q.chunked(table(spark, d, "orders"), "o_orderkey", "o_orderpriority")


@query
def zigzag(spark, d):
    v = F.col("o_custkey") - 500
    return table(spark, d, "orders").select("o_orderkey", S.zigzag(v).alias("z"))


@query
def uvarint_len(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.uvarint_len(F.col("o_custkey")).alias("bytes"), S.varint_len(F.col("o_custkey") - 500).alias("signed_bytes"))


@query
def delta(spark, d):
    return Q.delta(_custkeys(spark, d)).select("chunk", "pos", "d")


@query
def delta2(spark, d):
    return Q.delta2(_custkeys(spark, d)).select("chunk", "pos", "dd")


@query
def delta_roundtrip(spark, d):
    return Q.undelta(Q.delta(_custkeys(spark, d)).drop("value")).select("chunk", "pos", "value")


@query
def delta2_roundtrip(spark, d):
    return Q.undelta2(Q.delta2(_custkeys(spark, d)).drop("value")).select("chunk", "pos", "value")


@query
def rle_runs(spark, d):
    return Q.runs(_types(spark, d))


@query
def rle_roundtrip(spark, d):
    return Q.unrun(Q.runs(Q.chunked(table(spark, d, "orders"), "o_orderkey", "o_orderstatus"))).groupBy("chunk", "value").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query
def dict_encode(spark, d):
    c = _priorities(spark, d)
    return Q.encode_codes(c, Q.dictionary(c))


@query
def dict_decode(spark, d):
    c = _priorities(spark, d)
    words = Q.dictionary(c)
    return Q.decode_codes(Q.encode_codes(c, words), words)


@query
def bits_needed(spark, d):
    return Q.chunked(table(spark, d, "part"), "p_partkey", "p_type").groupBy("chunk").agg(S.bits_needed(F.count_distinct("value")).alias("bits"))


@query
def cardinality(spark, d):
    cells = E.long_frame(table(spark, d, "customer"), "c_custkey")
    return cells.groupBy("path", "i", "d", "s").agg(F.count("*").alias("n")).groupBy("path").agg(F.count("*").alias("distinct"), F.max("n").alias("most"))


@query
def front_coding(spark, d):
    return Q.front_coded(_names(spark, d)).select("chunk", "pos", "shared", "suffix")


@query
def common_prefix(spark, d):
    return Q.common_prefix(_names(spark, d))


@query
def csv_render(spark, d):
    cells = [S.csv_cell(F.col(c).cast("string")) for c in ("page_id", "url", "html")]
    return table(spark, d, "pages").select("page_id", F.concat_ws(",", *cells).alias("line"))


def _stamps(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("s"))


@query
def ts_ns(spark, d):
    return _stamps(spark, d).select("event_id", S.timestamp_ns(F.col("s")).alias("ns"))


@query
def ts_predicate(spark, d):
    s = F.when(F.col("event_id") % 3 == 0, F.concat("s", F.lit(" "))).when(F.col("event_id") % 3 == 1, F.replace("s", F.lit("Z"), F.lit("+00:00"))).otherwise(F.col("s"))
    return _stamps(spark, d).select((F.col("event_id") % 3).alias("form"), s.rlike(S.TIMESTAMP).alias("ok")).groupBy("form").agg(F.bool_and("ok").alias("all_ok"), F.count("*").alias("n"))


@query
def num_template(spark, d):
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    text = F.concat(F.lit("cost "), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" USD"))
    part = lambda k: F.regexp_extract("t", S.TEMPLATE, k)
    return table(spark, d, "part").select("p_partkey", text.alias("t")).select("p_partkey", part(1).alias("prefix"), F.replace(part(2), F.lit("."), F.lit("")).cast("long").alias("mantissa"), (F.length(part(2)) - F.locate(".", part(2))).cast("long").alias("scale"), part(3).alias("suffix"))


@query
def hex_pack(spark, d):
    text = F.lower(F.lpad(F.hex("o_orderkey"), 16, "0"))
    back = F.lower(F.hex(F.unhex("t")))
    return table(spark, d, "orders").select("o_orderkey", text.alias("t")).select("o_orderkey", "t", F.octet_length(F.unhex("t")).cast("long").alias("bytes"), (back == F.col("t")).alias("same"))


@query
def ipv4_pack(spark, d):
    k = F.col("o_orderkey")
    text = F.concat_ws(".", F.lit("10"), (F.floor(k / 65536) % 256).cast("string"), (F.floor(k / 256) % 256).cast("string"), (k % 256).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", text.alias("t")).withColumn("number", S.ipv4_number(F.col("t"))).withColumn("back", S.ipv4_text(F.col("number")))


def event_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of several schemas, as JSON texts derived from the events: a path that is a number, an object, an array and
    null by turns, and records without any key."""
    e = F.col("event_id")
    mixed = F.when(e % 4 == 0, e.cast("string")).when(e % 4 == 1, '{"deep":{"er":{"k":1}}}').when(e % 4 == 2, '[1,{"x":2}]').otherwise("null")
    text = F.concat(
        F.lit('{"id":'), e.cast("string"), F.when(e % 13 != 0, F.concat(F.lit(',"user":{"id":'), F.col("user_id").cast("string"), F.lit(',"opt":{}}'))).otherwise(""),
        F.lit(',"type":"'), F.col("event_type"), F.lit('"'), F.when(e % 7 == 0, ',"note":null').otherwise(""), F.lit(',"props":'), F.col("props"), F.lit(',"mix":'), mixed,
        F.when(e % 5 == 0, F.concat(F.lit(',"tags":["a",'), (e % 3).cast("string"), F.lit("]"))).otherwise(""), F.lit("}"),
    )
    # Dealt by record, as a small file is read by few tasks; a record's leaves stay where it is.
    return R.parse(table(spark, d, "events").repartition("event_id").select("event_id", F.when(e % 17 == 16, "{}").otherwise(text).alias("t")), "event_id", "t")


def _flat_twice(spark, d):
    """The leaves, written as they are read more than once."""
    return materialize(_flat(spark, d))


def _flat(spark, d):
    return R.flatten(event_records(spark, d))


def _shown(leaves):
    return R.leaves_only(leaves).select("ordinal", F.array_join("path", "/").alias("path"), F.to_json("value").alias("value"))


@query
def flatten_leaves(spark, d):
    return _shown(_flat(spark, d))


@query
def global_paths(spark, d):
    return R.global_paths(_flat(spark, d)).select("path_id", F.array_join("path", "/").alias("path"))


@query
def record_keys(spark, d):
    return R.record_keys(event_records(spark, d))


def _schema_text():
    return F.array_join(F.transform("paths", lambda p: F.array_join(p, "/")), ",")


@query
def schema_ids(spark, d):
    per = materialize(R.schemas(_flat(spark, d)))
    ids = R.registry(per).drop("n")
    return per.join(ids, "paths").select("ordinal", "schema_id")


@query
def schema_counts(spark, d):
    return R.registry(R.schemas(_flat(spark, d))).select("schema_id", _schema_text().alias("schema"), "n")


@query
def column_positions(spark, d):
    return R.columns(_flat(spark, d), Q.CHUNK).select("chunk", F.array_join("path", "/").alias("path"), "pos", "ordinal")


def _rebuilt(flat):
    return R.rebuild(R.schemas(flat), R.columns(flat, Q.CHUNK).drop("ordinal"), Q.CHUNK)


@query
def reconstruct(spark, d):
    return _shown(_rebuilt(_flat_twice(spark, d)))


@query
def nest_records(spark, d):
    """Whole records again from their columns."""
    return R.nest(_rebuilt(_flat_twice(spark, d))).select("ordinal", F.to_json("rec").alias("canonical"))


@query
def canonical_json(spark, d):
    return event_records(spark, d).select("ordinal", F.to_json("rec").alias("canonical"))


@query
def class_totals(spark, d):
    """Records and bytes of each type of event."""
    both = event_records(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("ordinal"), "event_type"), "ordinal")
    return both.groupBy("event_type").agg(F.count("*").alias("records"), F.sum(F.octet_length(F.to_json("rec"))).cast("long").alias("bytes"))


@query
def roundtrip_diff(spark, d):
    """Leaves that differ after columnising and rebuilding, with every tenth value's last digit dropped on the way."""
    flat = _flat_twice(spark, d)
    leaves = _shown(flat)
    other = _shown(_rebuilt(flat)).withColumn("value", F.when((F.col("ordinal") % 10 == 0) & (F.col("path") == "id"), F.concat("value", F.lit("0"))).otherwise(F.col("value")))
    both = leaves.alias("a").join(other.alias("b"), (F.col("a.ordinal") == F.col("b.ordinal")) & (F.col("a.path") == F.col("b.path")), "full")
    return both.where(~F.col("a.value").eqNullSafe(F.col("b.value"))).select(F.coalesce("a.ordinal", "b.ordinal").alias("ordinal"), F.coalesce("a.path", "b.path").alias("path"))


def _event_cells(spark, d):
    return E.long_frame(table(spark, d, "events"), "event_id")


@query
def column_kinds(spark, d):
    return E.column_kinds(_event_cells(spark, d))


def _costs(spark, d):
    return E.candidates(E.statistics(_event_cells(spark, d)))


@query
def cost_int_candidates(spark, d):
    return _costs(spark, d).where("kind = 'int'").select("chunk", "path", "enc", "cost", "meta")


@query
def cost_string_candidates(spark, d):
    return _costs(spark, d).where("kind = 'str'").select("chunk", "path", "enc", "cost", "meta")


@query
def choose_encoding(spark, d):
    return E.choose(_costs(spark, d))


@query
def enc_counts(spark, d):
    return E.choose(_costs(spark, d)).groupBy("enc").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "enc")


@query
def inspect_columns(spark, d):
    return E.inspect(table(spark, d, "events"), "event_id")


@query
def top_columns(spark, d):
    parts = [E.inspect(table(spark, d, t), k).select(F.lit(t).alias("source"), "path", "bytes") for t, k in (("events", "event_id"), ("customer", "c_custkey"), ("orders", "o_orderkey"))]
    return E.union(parts).orderBy(F.desc("bytes"), "source", "path").limit(50)


@query
def size_report(spark, d):
    sizes = E.inspect(table(spark, d, "events"), "event_id").agg(F.sum("bytes").alias("bytes"))
    raw = event_records(spark, d).agg(F.sum(F.octet_length(F.to_json("rec"))).cast("long").alias("json_bytes"), F.count("*").alias("records"))
    return raw.join(F.broadcast(sizes)).select("records", "json_bytes", "bytes", F.floor(F.col("bytes") * 1000 / F.col("json_bytes")).cast("long").alias("per_mille"))


@query
def human_bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", S.human_bytes(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query
def schema_seq_cost(spark, d):
    """Bytes of each chunk's schema ids, bit-packed and as runs, and the cheaper of the two."""
    return _schema_seq(materialize(R.schemas(_flat(spark, d))))


def _schema_seq(per):
    seq = per.join(R.registry(per).drop("n"), "paths").select(F.floor(F.col("ordinal") / Q.CHUNK).cast("long").alias("chunk"), F.col("ordinal").alias("pos"), F.col("schema_id").alias("value"))
    packed = seq.groupBy("chunk").agg(F.count("*").alias("n"), F.max("value").alias("top")).select("chunk", F.ceil(F.col("n") * S.bits_needed(F.col("top") + 1) / 8).cast("long").alias("bitpack"))
    rle = Q.runs(seq).groupBy("chunk").agg(F.sum(S.uvarint_len(F.col("n")) + S.uvarint_len(S.uvarint_len(F.col("value"))) + S.uvarint_len(F.col("value"))).alias("rle"))
    return packed.join(rle, "chunk").withColumn("enc", F.when(F.col("bitpack") <= F.col("rle"), "bitpack").otherwise("rle"))


@query
def infer_value(spark, d):
    e = F.col("event_id")
    s = F.when(e % 6 == 0, F.concat(F.lit("00"), e.cast("string"))).when(e % 6 == 1, e.cast("string")).when(e % 6 == 2, F.concat(e.cast("string"), F.lit(".5"))).when(e % 6 == 3, F.concat(e.cast("string"), F.lit(".50"))).when(e % 6 == 4, F.concat(F.lit("-"), e.cast("string"))).otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", S.infer_kind(s).alias("kind"), F.to_json(S.infer_value(s)).alias("value"))


@query
def copy_escape(spark, d):
    s = F.when(F.col("page_id") % 9 == 0, F.lit(None)).otherwise(F.concat("url", F.lit("\t\\"), F.col("html")))
    return table(spark, d, "pages").select("page_id", S.copy_escape(s).alias("cell"))


@query
def encode_roundtrip(spark, d):
    """Cells that differ after the events' cells have become rows and cells again."""
    events = table(spark, d, "events")
    cells = materialize(E.long_frame(events, "event_id"))
    rows = materialize(E.wide_frame(cells, events.schema).drop("chunk", "pos"))
    return E.differences(cells, E.long_frame(rows, "event_id"))


@query
def cost_text_classes(spark, d):
    """Costs of columns derived from the orders: a constant, truth values, digits, addresses, hex with and without a prefix,
    codes, and numbers with gaps."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        k.alias("k"), F.lit("same").alias("konst"), (k % 3 == 0).alias("flag"), (k + 1_000_000).cast("string").alias("digits"),
        F.concat_ws(".", F.lit("10"), (F.floor(k / 65536) % 256).cast("string"), (F.floor(k / 256) % 256).cast("string"), (k % 256).cast("string")).alias("ip"),
        F.md5(k.cast("string")).alias("hexid"), F.concat(F.lit("trace/"), F.md5(k.cast("string"))).alias("trace"), F.concat(F.lit("é-"), "o_orderpriority").alias("code"), F.when(k % 7 != 0, k).alias("gaps"), F.col("o_totalprice").alias("price"),
    )
    return E.candidates(E.statistics(E.long_frame(rows, "k"))).select("chunk", "path", "enc", "cost", "meta")


#: Rows of a chunk that are tried against each other.
GRID = (1024, 4096, 16384)


@query
def bench_grid(spark, d):
    """Bytes of the events' columns and of their descriptions, by rows of a chunk."""
    events = table(spark, d, "events")
    runs = [E.choose(E.candidates(E.statistics(E.long_frame(events, "event_id", n)))).select(F.lit(n).cast("long").alias("chunk_rows"), "chunk", "cost", "meta") for n in GRID]
    return E.union(runs).groupBy("chunk_rows").agg(F.count_distinct("chunk").alias("chunks"), F.sum("cost").alias("bytes"), F.sum("meta").alias("meta_bytes"))


@query
def bench_best(spark, d):
    return bench_grid(spark, d).agg(F.min_by("chunk_rows", F.struct(F.col("bytes") + F.col("meta_bytes"), "chunk_rows")).alias("chunk_rows"), F.min(F.col("bytes") + F.col("meta_bytes")).alias("total"))


@query
def analysis_report(spark, d):
    """One row on the events' records: how many, their schemas and fields, bytes as canonical JSON, as columns and as schema
    ids, the encodings chosen, and whether the records came back equal."""
    records = event_records(spark, d)
    flat = materialize(R.flatten(records))
    per, cols = materialize(R.schemas(flat)), R.columns(flat, Q.CHUNK)
    best = E.choose(E.candidates(E.statistics(E.leaf_cells(cols))))
    encs = best.groupBy("enc").agg(F.count("*").alias("c")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "enc", F.col("c").cast("string")))), ",").alias("encodings"))
    columns = best.agg(F.count_distinct("path").alias("fields"), F.sum("cost").alias("column_bytes"), F.sum("meta").alias("meta_bytes"))
    seq = _schema_seq(per).agg(F.sum(F.least("bitpack", "rle")).alias("schema_bytes"))
    json = records.agg(F.count("*").alias("records"), F.sum(F.octet_length(F.to_json("rec"))).cast("long").alias("json_bytes"))
    back = R.nest(R.rebuild(per, cols.drop("ordinal"), Q.CHUNK)).withColumnRenamed("rec", "again")
    same = records.join(back, "ordinal", "full").agg(F.bool_and(F.to_json("rec").eqNullSafe(F.to_json("again")) & F.schema_of_variant("rec").eqNullSafe(F.schema_of_variant("again"))).alias("round_trip"))
    n_schemas = per.select("paths").distinct().agg(F.count("*").alias("schemas"))
    out = json
    for one in (n_schemas, columns, seq, encs, same):
        out = out.join(F.broadcast(one))
    return out.withColumn("per_mille", F.floor((F.col("column_bytes") + F.col("meta_bytes") + F.col("schema_bytes")) * 1000 / F.col("json_bytes")).cast("long"))


@query
def front_roundtrip(spark, d):
    return Q.front_decoded(Q.front_coded(_names(spark, d)).drop("value"))


@query
def ts_roundtrip(spark, d):
    """Times in nanoseconds and as text again, with as many digits as the event's number modulo ten."""
    digits = (F.col("event_id") % 10).cast("int")
    return _stamps(spark, d).select("event_id", S.timestamp_text(S.timestamp_ns(F.col("s")), digits).alias("s"))


@query
def unzigzag(spark, d):
    v = F.col("o_custkey") - 500
    return table(spark, d, "orders").select("o_orderkey", S.unzigzag(S.zigzag(v)).alias("v"))


@query
def file_names(spark, d):
    return table(spark, d, "pages").select("page_id", S.safe_name(F.col("url")).alias("name"), S.stem(F.concat("url", F.lit(" ü.tar.gz"))).alias("stem"))


def dump_lines(spark: SparkSession, d: str) -> DataFrame:
    """A dump of the customers, a COPY block for every hundred, as lines."""
    k = F.col("c_custkey")
    own = table(spark, d, "customer").select(F.floor(k / 100).alias("b"), k.alias("k"), F.concat_ws("\t", k.cast("string"), S.copy_escape(F.concat("c_name", F.lit("\t\\"))), F.when(k % 5 == 0, "\\N").otherwise(F.col("c_mktsegment"))).alias("line"))
    blocks = own.select("b").distinct()
    rows = own.select((F.col("b") * 1000 + 1 + F.col("k") % 100).alias("ordinal"), "line")
    heads = blocks.select((F.col("b") * 1000).alias("ordinal"), F.lit("COPY public.customer (id, name, segment) FROM stdin;").alias("line"))
    ends = blocks.select(F.explode(F.array(*[F.struct((F.col("b") * 1000 + n).alias("ordinal"), F.lit(t).alias("line")) for n, t in ((998, "\\."), (999, "SET x = 1;"))])).alias("x")).select("x.*")
    return E.union([rows, heads, ends]).withColumn("file", F.lit("dump.sql"))


@query
def copy_rows(spark, d):
    got = T.copy_rows(dump_lines(spark, d))
    return got.select("ordinal", "target", F.size("columns").cast("long").alias("width"), F.col("cells")[0].cast("long").alias("id"), F.col("cells")[1].alias("name"), F.col("cells")[2].alias("segment"))


@query
def detect_format(spark, d):
    """What each page would be read as, its name cut from its address, every third without one."""
    name = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat("url", F.lit(".CSV")))
    head = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("-- "), "html")).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", X.detect_format(name, head).alias("format"))


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """The pages as lines of one CSV file, a line feed in quotes after each tag."""
    cells = table(spark, d, "pages").select("page_id", "url", F.replace("html", F.lit("><"), F.lit(">\n<")).alias("html"))
    each = cells.select("page_id", F.posexplode(F.split(X.csv_lines(["page_id", "url", "html"]), "\n")).alias("k", "line"))
    return each.select(F.lit("pages.csv").alias("file"), (F.col("page_id") * 4096 + F.col("k")).alias("ordinal"), "line")


@query
def csv_roundtrip(spark, d):
    cell = lambda k: F.col("cells")[k]
    return X.csv_records(page_lines(spark, d)).select(cell(0).cast("long").alias("page_id"), cell(1).alias("url"), F.length(cell(2)).cast("long").alias("n"), F.md5(cell(2).cast("binary")).alias("html_md5"), F.size("cells").cast("long").alias("width"))


@query
def csv_dialect(spark, d):
    """Delimiter, header and names of a table written with each delimiter."""
    own = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    found = []
    for name, delimiter in (("comma", ","), ("semicolon", ";"), ("tab", "\t"), ("bar", "|")):
        body = own.select(F.lit(name).alias("file"), F.col("s_suppkey").alias("ordinal"), X.csv_lines(own.columns, delimiter).alias("line"))
        head = own.agg(F.min("s_suppkey").alias("k")).select(F.lit(name).alias("file"), (F.col("k") - 1).alias("ordinal"), F.lit(delimiter.join(("s_suppkey", "s_name", "s_name"))).alias("line"))
        lines = body.unionByName(head) if name != "tab" else body
        heads = X.header(X.csv_records(lines, delimiter)).select("file", "has_header", F.array_join("names", " ").alias("names"))
        found.append(X.sniff_delimiter(lines).join(heads, "file"))
    return E.union(found)


@query
def json_array(spark, d):
    """Records of JSON arrays, one of every thousand events."""
    one = table(spark, d, "events").select(F.floor(F.col("event_id") / 1000).alias("b"), F.struct("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("t")).alias("x"))
    texts = one.groupBy(F.col("b").cast("string").alias("file")).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.t), ","), F.lit("]")).alias("text"))
    return X.parse_json_arrays(texts).select("file", "ordinal", F.expr("try_variant_get(rec, '$.id', 'bigint')").alias("id"), F.to_json("rec").alias("rec"))


def insert_lines(spark: SparkSession, d: str) -> DataFrame:
    """Single-row INSERT lines of the suppliers, every seventh with several rows, which stay text."""
    k = F.col("s_suppkey")
    row = F.concat(F.lit("("), k.cast("string"), F.lit(", '"), "s_name", F.lit("''s, ('')', "), F.when(k % 3 == 0, "NULL").otherwise("f(1, 'a,b')"), F.lit(")"))
    line = F.concat(F.lit("INSERT INTO public.supplier (id, name, note) VALUES "), row, F.when(k % 7 == 0, ", (0, '', NULL);").otherwise(";"))
    return table(spark, d, "supplier").select(F.lit("inserts.sql").alias("file"), k.alias("ordinal"), line.alias("line"))


@query
def insert_rows(spark, d):
    cell = lambda k: F.col("cells")[k]
    return X.dump_parts(insert_lines(spark, d)).select("ordinal", "kind", "target", cell(0).alias("id"), cell(1).alias("name"), cell(2).alias("note"), F.col("quoted")[1].alias("name_quoted"), F.col("quoted")[2].alias("note_quoted"))


@query
def dump_roundtrip(spark, d):
    """Lines of each kind in two dumps, and those that differ when they are written again."""
    lines = dump_lines(spark, d).select("file", "ordinal", "line").unionByName(insert_lines(spark, d))
    parts = X.dump_parts(lines)
    again = X.dump_text(parts).withColumnRenamed("line", "again").join(parts.select("file", "ordinal", "kind"), ["file", "ordinal"])
    return lines.join(again, ["file", "ordinal"]).groupBy("file", "kind").agg(F.count("*").alias("n"), F.count(F.when(~F.col("line").eqNullSafe(F.col("again")), 1)).alias("diffs"))


@query
def csv_layout(spark, d):
    """Line ends, byte order mark and last line of the suppliers as CSV files of several dialects, found from their lines."""
    own = table(spark, d, "supplier").select("s_suppkey", "s_name")
    found = []
    for name, eol, bom in (("plain", "\n", False), ("windows", "\r\n", True)):
        lines = X.csv_document(own, "s_suppkey", own.columns, eol=eol, bom=bom)
        size = lines.agg((F.sum(F.octet_length("line")) + F.count("*") - (0 if bom else 1)).alias("size"))
        found.append(T.layout(lines.join(F.broadcast(size)).select(F.lit(name).alias("file"), "ordinal", "line", "size")))
    return E.union(found)


@query
def csv_byte_exact(spark, d):
    """Whether the suppliers' CSV lines, read and written again, are the same lines."""
    own = table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit(' "x", y')).alias("s_name"))
    lines = X.csv_document(own, "s_suppkey", own.columns).select(F.lit("s.csv").alias("file"), "ordinal", "line")
    rows = X.csv_rows(X.csv_records(lines)).select("ordinal", F.col("rec")["s_suppkey"].alias("s_suppkey"), F.col("rec")["s_name"].alias("s_name"))
    again = X.csv_document(rows, "ordinal", ["s_suppkey", "s_name"]).select(F.lit("s.csv").alias("file"), "ordinal", "line")
    return X.same_lines(lines, again)


@query
def json_array_lines(spark, d):
    return X.json_array(event_records(spark, d)).select("ordinal", "line")
