"""Byte costs of candidate encodings for every column of a table, and the choice among them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import scalars as S
from .ordering import numbered
from .sequences import CHUNK
from .stored import materialize

#: Encodings in the order in which ties are settled.
ORDER = ("const", "boolbits", "ints", "intdelta", "intdelta2", "intdict", "intrle", "strraw", "timestamp", "uintstr", "numtemplate", "ipv4", "strdict", "strrle", "hex", "prefix_hex", "prefix_raw", "front", "msgpack")
#: Distinct values up to which a dictionary is considered.
DICTIONARY = 65_536
#: Different scales up to which a template's scales are held as codes.
SCALES = 16
#: Kinds of cells in order.
_ORDERED = ("bool", "float", "int", "null", "other", "str")
_KINDS = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "boolean": "bool", "double": "float", "float": "float", "string": "str"}
_KEY = ["chunk", "path"]
#: Cells that a task sorts, about, where they are dealt by chunk and path.
DEALT = 200_000


def long_frame(df: DataFrame, order: str, chunk: int = CHUNK) -> DataFrame:
    """chunk, path, pos, kind, i (whole numbers), d (floats), s (texts, and all other values as text), packed (bytes in a
    self-describing format): one row for each cell, with nothing lost. Times become RFC 3339 texts, dates and decimals
    their texts, binaries hex, arrays, maps and structs JSON. pos is the row's place in the order (any type without ties),
    and chunks hold equally many rows."""
    cells = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c, kind = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), T.StringType()
        elif isinstance(kind, (T.DateType, T.DecimalType)):
            c, kind = c.cast("string"), T.StringType()
        k = _KINDS.get(kind.simpleString(), "other")
        text = c if k == "str" else F.hex(c) if isinstance(kind, T.BinaryType) else F.to_json(c) if k == "other" else F.lit(None)
        cells.append(F.struct(
            F.lit(f.name).alias("path"), F.when(c.isNull(), "null").otherwise(k).alias("kind"), (c.cast("long") if k in ("int", "bool") else F.lit(None).cast("long")).alias("i"),
            (c.cast("double") if k == "float" else F.lit(None).cast("double")).alias("d"), text.cast("string").alias("s"), S.packed_len(c, kind).alias("packed"),
        ))
    rows = numbered(df, order, "_pos")
    return rows.select(F.floor(F.col("_pos") / chunk).cast("long").alias("chunk"), F.col("_pos").alias("pos"), F.explode(F.array(*cells)).alias("x")).select("chunk", "pos", "x.*")


def wide_frame(cells: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows again from the cells of long_frame(), in columns of the schema's types, beside chunk and pos."""
    def back(f: T.StructField) -> Column:
        kind = f.dataType
        value = F.col("s")
        if isinstance(kind, (T.IntegralType, T.BooleanType)):
            value = F.col("i").cast(kind)
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            value = F.col("d").cast(kind)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            value = F.to_timestamp(F.col("s")).cast(kind)
        elif isinstance(kind, T.BinaryType):
            value = F.unhex("s")
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            value = F.from_json("s", kind)
        elif not isinstance(kind, T.StringType):
            value = F.col("s").cast(kind)
        return F.first(F.when(F.col("path") == f.name, F.struct(value.alias("v"))), ignorenulls=True)["v"].alias(f.name)

    return cells.groupBy("chunk", "pos").agg(*[back(f) for f in schema.fields])


def leaf_cells(cols: DataFrame) -> DataFrame:
    """The cells of records' columns (chunk, path, pos, value): whole numbers, truth values, fractions, texts and nulls by
    their kind; arrays and empty objects as JSON, whose length stands for their packed size."""
    of = F.schema_of_variant("value")
    kind = F.when(of == "BIGINT", "int").when(of == "BOOLEAN", "bool").when(of.startswith("DECIMAL") | (of == "DOUBLE") | (of == "FLOAT"), "float").when(of == "STRING", "str").when(of == "VOID", "null").otherwise("other")
    get = lambda t: F.try_variant_get("value", "$", t)
    rows = cols.select("chunk", F.to_json("path").alias("path"), "pos", kind.alias("kind"), "value").select(
        "chunk", "path", "pos", "kind", F.when(F.col("kind") == "int", get("bigint")).when(F.col("kind") == "bool", get("boolean").cast("long")).alias("i"),
        F.when(F.col("kind") == "float", get("double")).alias("d"), F.when(F.col("kind") == "str", get("string")).when(F.col("kind") == "other", F.to_json("value")).alias("s"),
    )
    size = F.octet_length("s").cast("long")
    packed = F.when(F.col("kind") == "int", S.packed_int(F.col("i"))).when(F.col("kind").isin("bool", "null"), 1).when(F.col("kind") == "float", 9).when(F.col("kind") == "str", S.packed_bytes(size)).otherwise(size)
    return rows.withColumn("packed", packed.cast("long"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """path, n, diffs: cells of each path in either frame, and those that one lacks or holds otherwise."""
    both = a.alias("a").join(b.alias("b"), ["chunk", "path", "pos"], "full")
    same = reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("kind", "i", "d", "s")])
    return both.groupBy("path").agg(F.count("*").alias("n"), F.count(F.when(~same, 1)).alias("diffs"))


def column_kinds(cells: DataFrame) -> DataFrame:
    """path, kinds (comma-joined, in order), n."""
    return cells.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count("*").alias("n"))


#: Ways to hold whole numbers and their names; the cheapest is taken where an encoding holds numbers of its own.
_WAYS = {"": "ints", "_delta": "intdelta", "_delta2": "intdelta2"}


def _steps(name: str, w: Window) -> list[Column]:
    """A number's differences and differences of differences; null beyond 64 bits."""
    x, before, two = F.col(name), F.lag(name).over(w), F.lag(name, 2).over(w)
    d, was = F.try_subtract(x, before), F.try_subtract(before, two)
    return [F.when(before.isNull(), x).otherwise(d).alias(f"{name}_delta"), F.when(before.isNull(), x).when(two.isNull(), d).otherwise(F.try_subtract(d, was)).alias(f"{name}_delta2")]


def _sums(names: tuple[str, ...]) -> list[Column]:
    """Bytes of each way for each number; null where it can't hold all cells."""
    return [F.when(F.count(c) == F.count("*"), F.sum(S.varint_len(F.col(c)))).alias(c) for name in names for c in (name + way for way in _WAYS)]


def _firsts(own: DataFrame, value: str) -> DataFrame:
    """first, true on the first cell of each different value. Asked before all else, so that the frame is sorted by values
    once and by places once."""
    return own.withColumn("first", F.row_number().over(Window.partitionBy(*_KEY, value).orderBy("pos")) == 1)


def _with_prefixes(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """df with name, common_prefix_len() of two columns, null where one is. For texts below 64 characters the halving is written
    out as columns, which are compiled, while functions of arrays aren't."""
    long_, n = F.least(F.length(a), F.length(b)), F.col("_same")
    df = df.withColumns({"_short": F.when(F.col(a) != F.col(b), F.when(long_ < 64, long_)), "_same": F.lit(0)})
    for step in (32, 16, 8, 4, 2, 1):
        more = (n + step <= F.col("_short")) & (F.substr(a, n + 1, F.lit(step)) == F.substr(b, n + 1, F.lit(step)))
        df = df.withColumn("_same", F.when(more, n + step).otherwise(n))
    return df.withColumn(name, F.when(F.col("_short").isNotNull(), n.cast("long")).otherwise(S.common_prefix_len(F.col(a), F.col(b)))).drop("_short", "_same")


def _runs(steps: DataFrame, w: Window) -> DataFrame:
    """run_n, the length of a run, on its last cell."""
    steps = steps.withColumns({"_at": F.row_number().over(w).cast("long"), "_next": F.coalesce(F.lead("same").over(w), F.lit(False))})
    begin = F.last(F.when(~F.col("same"), F.col("_at")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("run_n", F.when(~F.col("_next"), F.col("_at") - begin + 1))


def _dealt(cells: DataFrame, tasks: int) -> DataFrame:
    """In the way that the windows need, before anything is computed. The number is given, as tasks that are joined by the
    bytes of their shuffle (which texts alike hardly take) would grow with the table."""
    return cells.repartition(tasks, *_KEY)


def _of_ints(cells: DataFrame, tasks: int) -> DataFrame:
    w = Window.partitionBy(*_KEY).orderBy("pos")
    i, run_n = F.col("i"), F.col("run_n")
    own = _dealt(cells.where(F.col("kind").isin("int", "bool")).select(*_KEY, "pos", "i"), tasks)
    steps = _firsts(own, "i").select("*", F.coalesce(i == F.lag("i").over(w), F.lit(False)).alias("same"), *_steps("i", w))
    return _runs(steps, w).groupBy(*_KEY).agg(
        *_sums(("i",)), F.sum(F.when(run_n.isNotNull(), S.uvarint_len(run_n) + S.uvarint_len(S.varint_len(i)) + S.varint_len(i))).alias("intrle"), F.count("run_n").alias("int_runs"),
        F.count(F.when(F.col("first"), 1)).alias("ints_distinct"), F.sum(F.when(F.col("first"), S.varint_len(i))).alias("dict_ints"),
    )


def _of_texts(cells: DataFrame, tasks: int) -> DataFrame:
    w = Window.partitionBy(*_KEY).orderBy("pos")
    s, run_n, first = F.col("s"), F.col("run_n"), F.col("first")
    own = _firsts(_dealt(cells.where("kind = 'str'").select(*_KEY, "pos", "s"), tasks), "s").withColumn("size", F.octet_length("s").cast("long"))
    own = own.select(
        "*", F.when((F.length(s) <= S.DIGITS) & s.rlike(S.UNSIGNED), s.cast("long")).alias("u"), F.when(F.length(s).between(20, 30) & s.endswith("Z"), S.timestamp_ns(s)).alias("ns"),
        S.template_parts(s).alias("t"), F.coalesce((F.length(s) <= 15) & s.rlike(S.IPV4), F.lit(False)).alias("ip"), F.lag("s").over(w).alias("before"),
    ).withColumn("m", F.col("t.mantissa"))
    steps = own.select("*", F.coalesce(s == F.col("before"), F.lit(False)).alias("same"), *[x for name in ("u", "ns", "m") for x in _steps(name, w)])
    steps = _with_prefixes(_runs(steps, w), "lcp", "before", "s").withColumn("lcp", F.coalesce("lcp", F.lit(0).cast("long")))
    known = F.last(F.when(first, s), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # Where the word before in the dictionary is the text before, what they have in common is known.
    steps = steps.withColumn("known", known).withColumn("dict_lcp", F.when(first & (F.col("known") == F.col("before")), F.col("lcp")).when(first, F.coalesce(S.common_prefix_len(F.col("known"), s), F.lit(0))))
    steps = steps.withColumns({f"{lcp}_rest": F.col("size") - F.octet_length(F.left("s", F.col(lcp).cast("int"))) for lcp in ("lcp", "dict_lcp")})
    front = lambda lcp: S.uvarint_len(F.col(lcp)) + S.uvarint_len(F.col(f"{lcp}_rest")) + F.col(f"{lcp}_rest")
    tail = lambda digits: F.min(F.length(s) - F.length(F.rtrim(s, F.lit(digits))))
    return steps.groupBy(*_KEY).agg(
        *_sums(("ns", "u", "m")),
        F.min("t.prefix").alias("p0"), F.max("t.prefix").alias("p1"), F.min("t.suffix").alias("e0"), F.max("t.suffix").alias("e1"), F.sum("t.chars").alias("digits"),
        F.size(F.collect_set("t.scale")).alias("scales"), F.sum(S.uvarint_len(F.col("t.scale"))).alias("scale_bytes"), F.size(F.collect_set(F.when(F.col("ns").isNotNull(), F.length(s)))).alias("precisions"),
        tail("0123456789abcdef").alias("low_hex"), tail("0123456789ABCDEF").alias("high_hex"), F.bool_and("ip").alias("all_ip"),
        F.sum(S.text_len(s)).alias("strraw"), F.sum(F.when(run_n.isNotNull(), S.uvarint_len(run_n) + S.text_len(s))).alias("strrle"), F.count("run_n").alias("text_runs"), F.sum(front("lcp")).alias("front"),
        F.count(F.when(first, 1)).alias("texts_distinct"), F.sum(F.when(first, S.text_len(s))).alias("dict_raw"), F.sum(F.when(first, front("dict_lcp"))).alias("dict_front"),
        F.min("s").alias("low"), F.max("s").alias("high"), F.min(F.length(s)).alias("shortest"), F.max(F.length(s)).alias("longest"),
        F.collect_list("size").alias("sizes"), F.collect_list(F.when(first, F.col("size"))).alias("dict_sizes"),
    )


def statistics(cells: DataFrame) -> DataFrame:
    """One row for each chunk and path, with all sums that costs need. Whole numbers and texts are dealt by chunk and path
    once each, into as many tasks as their number asks for; lists are of a chunk's cells at most. The cells are written
    first, as they are read three times."""
    cells = materialize(cells)
    tasks = max(cells.sparkSession.sparkContext.defaultParallelism, cells.count() // DEALT + 1)
    # Kinds as numbers in their order, and no least text here: these sums are hashed, so no task sorts its part of the file.
    kinds = F.array(*[F.lit(k) for k in _ORDERED])
    code, ends = F.array_position(kinds, F.col("kind")).cast("int"), [f(c).alias(f"{c}_{name}") for c in ("i", "d") for name, f in (("low", F.min), ("high", F.max))]
    one = cells.groupBy(*_KEY).agg(F.count("*").alias("n"), F.min(code).alias("_k0"), F.max(code).alias("_k1"), F.sum("packed").alias("packed"), F.max("packed").alias("most_packed"), *ends)
    one = one.withColumns({"kind": F.get(kinds, F.col("_k0") - 1), "pure": F.col("_k0") == F.col("_k1")})
    others = _dealt(cells.where("kind = 'other'").select(*_KEY, "s"), tasks).groupBy(*_KEY).agg((F.min("s") == F.max("s")).alias("same_other"))
    found = one.join(_of_ints(cells, tasks), _KEY, "left").join(_of_texts(cells, tasks), _KEY, "left").join(others, _KEY, "left")
    same_text = F.when(F.col("kind") == "str", F.col("low").eqNullSafe(F.col("high"))).when(F.col("kind") == "other", F.col("same_other")).otherwise(True)
    equal = F.col("i_low").eqNullSafe(F.col("i_high")) & F.col("d_low").eqNullSafe(F.col("d_high")) & same_text
    return found.withColumn("equal", equal).drop("_k0", "_k1", "i_low", "i_high", "d_low", "d_high", "same_other")


def _mode(name: str, order: tuple[str, ...] = ("", "_delta", "_delta2")) -> Column:
    """total, place, bytes, label (bytes of the way's name) of the cheapest way for a number, its name's bytes included;
    null where none holds all cells."""
    ways = [f"CASE WHEN {name}{way} IS NOT NULL THEN named_struct('total', {name}{way} + {len(_WAYS[way])}, 'place', {k}, 'bytes', {name}{way}, 'label', {len(_WAYS[way])}) END" for k, way in enumerate(order)]
    return F.expr(f"array_min(array({', '.join(ways)}))")


def _key(name: str, value: str | int) -> str:
    """Bytes of a member of an encoding's description: its name, and its value of so many bytes."""
    return f"({1 + len(name)} + {value})"


def _even(length: str) -> str:
    """Texts of one even length whose last so many characters are all hex digits of one case."""
    return f"(shortest = longest AND {length} % 2 = 0 AND {length} >= 8 AND greatest(low_hex, high_hex) >= {length})"


def candidates(stats: DataFrame) -> DataFrame:
    """chunk, path, kind, n, enc, cost (bytes of the column), meta (bytes of its description), place for every encoding that
    can hold the column. The sums are SQL text, which is planned in a fraction of the time of as many Column calls."""
    c = F.col
    prefix = S.common_prefix_len(c("low"), c("high"))
    stats = stats.select("*", prefix.alias("pre"), _mode("ns", ("_delta", "_delta2", "")).alias("ns_way"), _mode("u").alias("u_way"), _mode("m").alias("m_way"))
    stats = stats.select("*", F.expr("CAST(octet_length(left(low, CAST(pre AS INT))) AS BIGINT)").alias("pre_bytes"), F.expr("longest - pre").alias("rest"))
    cut = lambda sizes: F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + S.uvarint_len(x - c("pre_bytes")) + x - c("pre_bytes"))
    size = lambda name: F.octet_length(name).cast("long")
    stats = stats.select(
        "*", cut("sizes").alias("cut_all"), cut("dict_sizes").alias("cut_dict"), S.packed_many(c("n")).alias("many"), S.packed_many(c("scales")).alias("many_scales"),
        *[S.packed_int(c(k)).alias(f"{k}_packed") for k in ("n", "texts_distinct", "ints_distinct", "int_runs", "text_runs", "longest", "rest")],
        *[S.packed_bytes(b).alias(f"{k}_packed") for k, b in (("pre", c("pre_bytes")), ("p0", size("p0")), ("e0", size("e0")))],
        *[S.bits_needed(c(k)).alias(f"{k}_bits") for k in ("texts_distinct", "ints_distinct", "precisions", "scales")],
        *[(S.uvarint_len(b) + b).alias(f"{k}_held") for k, b in (("ints", c("dict_ints")), ("ns", c("ns_way.bytes")), ("m", c("m_way.bytes")))],
    )
    codes = lambda k: f"CAST(ceil(n * {k}_bits / 8) AS BIGINT)"
    prefixed, hexed = _key("prefix", "pre_packed"), lambda length: f"({_key('hexchars', length + '_packed')} + {_key('hcase', 6)})"
    # How the dictionary of texts itself is held.
    inner = {
        "raw": ("true", "dict_raw", "0"), "prefix": ("pre > 0", "cut_dict", prefixed), "front": ("true", "dict_front", "0"), "hex": (_even("longest"), "texts_distinct * longest / 2", hexed("longest")),
        "prefix_hex": (f"pre > 0 AND {_even('rest')}", "texts_distinct * rest / 2", f"{prefixed} + {hexed('rest')}"),
    }
    ways = []
    for k, (e, (ok, b, m)) in enumerate(inner.items()):
        described = f"1 + {_key('denc', 1 + len(e))} + {_key('n', 'texts_distinct_packed')} + {m}"
        ways.append(f"CASE WHEN {ok} THEN named_struct('total', CAST({b} AS BIGINT) + {described}, 'place', {k}, 'bytes', CAST({b} AS BIGINT), 'meta', {described}) END")
    stats = stats.select("*", F.expr(f"CASE WHEN texts_distinct IS NOT NULL THEN array_min(array({', '.join(ways)})) END").alias("dict"))
    stats = stats.select("*", (S.uvarint_len(c("dict.bytes")) + c("dict.bytes")).alias("dict_held"))
    is_int, is_str = "pure AND kind = 'int'", "pure AND kind = 'str'"
    counted = lambda k: f"{_key('dcount', k + '_packed')} + {_key('bits', 1)}"
    mode = lambda name, way: _key(name, f"1 + {way}.label")
    coded = f"scales <= {SCALES}"
    costs = {
        "const": ("pure AND equal", "0", _key("value", "most_packed")), "boolbits": ("pure AND kind = 'bool'", "ceil(n / 8)", "0"),
        "ints": (is_int, "i", "0"), "intdelta": (is_int, "i_delta", "0"), "intdelta2": (is_int, "i_delta2", "0"),
        "intdict": (f"{is_int} AND ints_distinct <= {DICTIONARY}", f"ints_held + {codes('ints_distinct')}", counted("ints_distinct")), "intrle": (is_int, "intrle", _key("runs", "int_runs_packed")),
        "strraw": (is_str, "strraw", "0"),
        "timestamp": (is_str, f"ns_held + {codes('precisions')}", f"{mode('tmode', 'ns_way')} + {_key('pdict', '1 + precisions')} + {_key('pbits', 1)}"), "uintstr": (is_str, "u_way.bytes", mode("umode", "u_way")),
        "numtemplate": (f"{is_str} AND p0 = p1 AND e0 = e1 AND 5 * digits >= 6 * n", f"m_held + CASE WHEN {coded} THEN {codes('scales')} ELSE scale_bytes END",
            f"{_key('prefix', 'p0_packed')} + {_key('suffix', 'e0_packed')} + {mode('menc', 'm_way')} + CASE WHEN {coded} THEN {_key('sdict', 'many_scales + scales')} + {_key('sbits', 1)} ELSE {_key('svarint', 1)} END"),
        "ipv4": (f"{is_str} AND all_ip", "4 * n", "0"), "strdict": (f"{is_str} AND texts_distinct <= {DICTIONARY}", f"dict_held + {codes('texts_distinct')}", f"{counted('texts_distinct')} + {_key('dmeta', 'dict.meta')}"),
        "strrle": (is_str, "strrle", _key("runs", "text_runs_packed")), "hex": (f"{is_str} AND {_even('longest')}", "n * longest / 2", hexed("longest")),
        "prefix_hex": (f"{is_str} AND pre > 0 AND {_even('rest')}", "n * rest / 2", f"{prefixed} + {hexed('rest')}"), "prefix_raw": (f"{is_str} AND pre > 0", "cut_all", prefixed),
        "front": (is_str, "front", "0"), "msgpack": ("NOT pure OR kind IN ('float', 'other')", "many + packed", "0"),
    }
    each = [
        f"named_struct('enc', '{e}', 'cost', CASE WHEN {ok} THEN CAST({b} AS BIGINT) END, 'meta', CAST(1 + {_key('enc', 1 + len(e))} + {_key('n', 'n_packed')} + {m} AS BIGINT), 'place', {ORDER.index(e)})"
        for e, (ok, b, m) in costs.items()
    ]
    return stats.select(*_KEY, "kind", "n", F.expr(f"explode(array({', '.join(each)}))").alias("x")).select(*_KEY, "kind", "n", "x.*").where("cost IS NOT NULL")


def choose(found: DataFrame) -> DataFrame:
    """chunk, path, n, enc, cost, meta: the candidate with fewest bytes, description included, the first of equals."""
    best = found.groupBy(*_KEY).agg(F.min_by(F.struct("enc", "cost", "meta", "n"), F.struct(F.col("cost") + F.col("meta"), "place")).alias("b"))
    return best.select(*_KEY, "b.n", "b.enc", "b.cost", "b.meta")


def inspect(df: DataFrame, order: str, chunk: int = CHUNK) -> DataFrame:
    """path, encs (those chosen in any chunk), n, bytes of every column."""
    return columns_of(choose(candidates(statistics(long_frame(df, order, chunk)))))


def columns_of(best: DataFrame) -> DataFrame:
    return best.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("enc")), ",").alias("encs"), F.sum("n").alias("n"), F.sum("cost").alias("bytes"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
