"""DuckDB SQL for the rows of the column queries."""

from __future__ import annotations

_UVL = lambda x: f"greatest(1, ceil(length(bin(({x})::BIGINT)) / 7.0))::BIGINT"
_ZZ = lambda x: f"(CASE WHEN ({x}) >= 0 THEN 2 * ({x}) ELSE -2 * ({x}) - 1 END)"
_VL = lambda x: _UVL(_ZZ(x))
_BITS = lambda n: f"greatest(1, length(bin(({n} - 1)::BIGINT)))::BIGINT"
_BYTES = lambda s: f"octet_length(encode({s}))"
_LCP = lambda a, b: f"coalesce(list_min(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, i, 1) <> substr({b}, i, 1))) - 1, least(length({a}), length({b})))"
_TS = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?Z$"
_IP = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
_HEX = r"^([0-9a-f]+|[0-9A-F]+)$"
_UINT = r"^(0|[1-9][0-9]*)$"
_TEMPLATE, _EXACT, _MINUS0 = r"^([^\n]*?)([+-]?[0-9]+(?:\.[0-9]+)?)([^0-9]*)$", r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?$", r"^-[0.]*$"


def _chunked(table: str, key: str, value: str) -> str:
    return f"c AS (SELECT pos_ // 4096 AS chunk, pos_ AS pos, value FROM (SELECT row_number() OVER (ORDER BY {key}) - 1 AS pos_, {value} AS value FROM {table}))"


_CUST, _TYPES = _chunked("orders", "o_orderkey", "o_custkey"), _chunked("events", "event_id", "event_type")
_PRIO, _NAMES = _chunked("orders", "o_orderkey", "o_orderpriority"), _chunked("customer", "c_custkey", "c_name")
_W = "OVER (PARTITION BY chunk ORDER BY pos)"
_RUNS = f"""
m AS (SELECT *, CASE WHEN lag(pos) {_W} IS NULL OR value IS DISTINCT FROM lag(value) {_W} THEN 1 ELSE 0 END AS ch FROM c),
g AS (SELECT *, sum(ch) OVER (PARTITION BY chunk ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM m),
runs AS (SELECT chunk, min(pos) AS "begin", any_value(value) AS value, count(*) AS n FROM g GROUP BY chunk, run)"""
_DICT = "d AS (SELECT chunk, value, row_number() OVER (PARTITION BY chunk ORDER BY min(pos)) - 1 AS code FROM c GROUP BY chunk, value)"
_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"

_MIX = "CASE event_id % 4 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN '{\"deep\":{\"er\":{\"k\":1}}}' WHEN 2 THEN '[1,{\"x\":2}]' ELSE 'null' END"
_E = "(SELECT * FROM events WHERE event_id % 17 <> 16)"
_LEAVES = f"""leaves AS (
  SELECT event_id AS ordinal, 'id' AS path, event_id::VARCHAR AS value FROM {_E}
  UNION ALL SELECT event_id, 'user/id', user_id::VARCHAR FROM {_E} WHERE event_id % 13 <> 0
  UNION ALL SELECT event_id, 'user/opt', '{{}}' FROM {_E} WHERE event_id % 13 <> 0
  UNION ALL SELECT event_id, 'type', '"' || event_type || '"' FROM {_E}
  UNION ALL SELECT event_id, 'note', 'null' FROM {_E} WHERE event_id % 7 = 0
  UNION ALL SELECT event_id, 'props/k', props->>'k' FROM {_E}
  UNION ALL SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 'mix/deep/er/k' ELSE 'mix' END, CASE WHEN event_id % 4 = 1 THEN '1' ELSE {_MIX} END FROM {_E}
  UNION ALL SELECT event_id, 'tags', '["a",' || (event_id % 3) || ']' FROM {_E} WHERE event_id % 5 = 0)"""
_SCHEMAS = f"""{_LEAVES},
per AS (SELECT event_id AS ordinal, coalesce("schema", '') AS "schema" FROM events LEFT JOIN (SELECT ordinal, string_agg(path, ',' ORDER BY path) AS "schema" FROM leaves GROUP BY ordinal) ON ordinal = event_id),
reg AS (SELECT row_number() OVER (ORDER BY min(ordinal)) - 1 AS schema_id, "schema", count(*) AS n FROM per GROUP BY "schema")"""
_CANON = f"""CASE WHEN event_id % 17 = 16 THEN '{{}}' ELSE '{{"id":' || event_id || ',"mix":' || {_MIX} || CASE WHEN event_id % 7 = 0 THEN ',"note":null' ELSE '' END || ',"props":{{"k":' || (props->>'k') || '}}'
  || CASE WHEN event_id % 5 = 0 THEN ',"tags":["a",' || (event_id % 3) || ']' ELSE '' END || ',"type":"' || event_type || '"'
  || CASE WHEN event_id % 13 <> 0 THEN ',"user":{{"id":' || user_id || ',"opt":{{}}}}' ELSE '' END || '}}' END"""
_POS = f"{_LEAVES}, placed AS (SELECT ordinal // 4096 AS chunk, path, row_number() OVER (PARTITION BY ordinal // 4096, path ORDER BY ordinal) - 1 AS pos, ordinal, value FROM leaves)"
_SEQ = """c AS (SELECT ordinal // 4096 AS chunk, ordinal AS pos, schema_id AS value FROM per JOIN reg USING ("schema"))"""


_PI = lambda x: f"(CASE WHEN {x} BETWEEN -32 AND 127 THEN 1 WHEN {x} BETWEEN -128 AND 255 THEN 2 WHEN {x} BETWEEN -32768 AND 65535 THEN 3 WHEN {x} BETWEEN -2147483648 AND 4294967295 THEN 5 ELSE 9 END)"
_PB = lambda x: f"(CASE WHEN {x} < 32 THEN 1 WHEN {x} < 256 THEN 2 WHEN {x} < 65536 THEN 3 ELSE 5 END + {x})"
_PM = lambda x: f"(CASE WHEN {x} < 16 THEN 1 WHEN {x} < 65536 THEN 3 ELSE 5 END)"


def _cells(table: str, key: str, cols: dict[str, str], chunk: int = 4096, name: str = "cells") -> str:
    """cols: path to kind (int, bool, str, float, or stamp)."""
    rows = []
    for c, k in cols.items():
        s = f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'" if k == "stamp" else c if k == "str" else "NULL"
        kind = "str" if k == "stamp" else k
        packed = {"int": _PI(c), "bool": "1", "float": "9"}.get(k) or _PB(_BYTES(f"({s})::VARCHAR"))
        rows.append(
            f"SELECT pos_ // {chunk} AS chunk, pos_ AS pos, '{c}' AS path, CASE WHEN {c} IS NULL THEN 'null' ELSE '{kind}' END AS kind, {c if k in ('int', 'bool') else 'NULL'}::BIGINT AS i, "
            f"{c if k == 'float' else 'NULL'}::DOUBLE AS d, ({s})::VARCHAR AS s, CASE WHEN {c} IS NULL THEN 1 ELSE {packed} END AS packed FROM (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS pos_ FROM {table})"
        )
    return f"{name} AS (" + " UNION ALL ".join(rows) + ")"


def _member(name: str, value: str) -> str:
    return f"{1 + len(name)} + {value}"


def _stats(cells: str) -> str:
    w = "OVER (PARTITION BY chunk, path ORDER BY pos)"
    ns = f"CASE WHEN regexp_matches(s, '{_TS}') THEN epoch_ns(try_cast(replace(s, 'Z', '') AS TIMESTAMP)) END"
    ip = f"regexp_matches(s, '{_IP}')"
    part = lambda k: f"regexp_extract(s, '{_TEMPLATE}', {k})"
    exact = f"regexp_matches(num, '{_EXACT}') AND NOT regexp_matches(num, '{_MINUS0}') AND length(replace(num, '.', '')) <= 18"
    uint = f"CASE WHEN regexp_matches(s, '{_UINT}') AND length(s) <= 18 THEN try_cast(s AS BIGINT) END"
    steps = ", ".join(f"CASE WHEN lag({x}) {w} IS NULL THEN {x} ELSE {x} - lag({x}) {w} END AS {x}_delta, CASE WHEN lag({x}) {w} IS NULL THEN {x} WHEN lag({x}, 2) {w} IS NULL THEN {x} - lag({x}) {w} ELSE {x} - 2 * lag({x}) {w} + lag({x}, 2) {w} END AS {x}_delta2" for x in ("i", "ns", "u", "m"))
    sums = ", ".join(f"CASE WHEN count({c}) = count(*) THEN sum({_VL(c)}) END AS {c}" for x in ("i", "ns", "u", "m") for c in (x, f"{x}_delta", f"{x}_delta2"))
    names = {"": "ints", "_delta": "intdelta", "_delta2": "intdelta2"}
    way = lambda x, order: "list_min(list_filter([" + ", ".join(f"{{'total': {x}{o} + {len(names[o])}, 'place': {k}, 'bytes': {x}{o}, 'label': {len(names[o])}}}" for k, o in enumerate(order)) + "], lambda e: e.total IS NOT NULL))"
    held = lambda b: f"{_UVL(b)} + {b}"
    codes = lambda k: f"ceil(n * {_BITS(k)} / 8.0)::BIGINT"
    cut = lambda sizes: f"list_sum(list_transform({sizes}, lambda x: {_UVL('(x - pre_bytes)')} + x - pre_bytes))::BIGINT"
    even = lambda length: f"short = long AND ({length}) % 2 = 0 AND ({length}) >= 8"
    prefixed = _member("prefix", _PB("pre_bytes"))
    hexed = lambda length: _member("hexchars", _PI(length)) + " + " + _member("hcase", "6")
    denc = lambda e, more="0": f"1 + {_member('denc', str(1 + len(e)))} + {_member('n', _PI('td'))} + {more}"
    inner = [("raw", "true", "dict_raw", "0"), ("prefix", "pre > 0", cut("dict_sizes"), prefixed), ("front", "true", "dict_front", "0"), ("hex", f"{even('long')} AND tail >= long", "td * long // 2", hexed("long")), ("prefix_hex", f"pre > 0 AND {even('long - pre')} AND tail >= long - pre", "td * (long - pre) // 2", prefixed + " + " + hexed("(long - pre)"))]
    ways = ", ".join(f"{{'total': CASE WHEN {ok} THEN {b} + {denc(e, m)} END, 'place': {k}, 'bytes': ({b})::BIGINT, 'meta': ({denc(e, m)})::BIGINT}}" for k, (e, ok, b, m) in enumerate(inner))
    counted = lambda k: _member("dcount", _PI(k)) + " + " + _member("bits", "1")
    mode = lambda name, x: _member(name, f"1 + {x}.label")
    small = "<= 65536"
    cands = [
        ("const", "pure AND equal", "0", _member("value", "most_packed")), ("boolbits", "pure AND kind = 'bool'", "ceil(n / 8.0)::BIGINT", "0"), ("ints", "pure AND kind = 'int'", "i", "0"), ("intdelta", "pure AND kind = 'int'", "i_delta", "0"), ("intdelta2", "pure AND kind = 'int'", "i_delta2", "0"),
        ("intdict", f"pure AND kind = 'int' AND vd {small}", f"{held('dict_ints')} + {codes('vd')}", counted("vd")), ("intrle", "pure AND kind = 'int'", "intrle", _member("runs", _PI("runs"))),
        ("strraw", "pure AND kind = 'str'", "strraw", "0"), ("timestamp", "pure AND kind = 'str'", f"{held('ns_way.bytes')} + {codes('precisions')}", f"{mode('tmode', 'ns_way')} + {_member('pdict', '1 + precisions')} + {_member('pbits', '1')}"),
        ("uintstr", "pure AND kind = 'str'", "u_way.bytes", mode("umode", "u_way")),
        ("numtemplate", "pure AND kind = 'str' AND one_form AND 5 * digits >= 6 * n", f"{held('m_way.bytes')} + CASE WHEN scales <= 16 THEN {codes('scales')} ELSE scale_bytes END", f"{_member('prefix', _PB(_BYTES('t_pre')))} + {_member('suffix', _PB(_BYTES('t_suf')))} + {mode('menc', 'm_way')} + CASE WHEN scales <= 16 THEN {_member('sdict', _PM('scales') + ' + scales')} + {_member('sbits', '1')} ELSE {_member('svarint', '1')} END"),
        ("ipv4", "pure AND kind = 'str' AND all_ip", "4 * n", "0"), ("strdict", f"pure AND kind = 'str' AND td {small}", f"{held('dict.bytes')} + {codes('td')}", counted("td") + " + " + _member("dmeta", "dict.meta")), ("strrle", "pure AND kind = 'str'", "strrle", _member("runs", _PI("runs"))),
        ("hex", f"pure AND kind = 'str' AND {even('long')} AND tail >= long", "n * long // 2", hexed("long")), ("prefix_hex", f"pure AND kind = 'str' AND pre > 0 AND {even('long - pre')} AND tail >= long - pre", "n * (long - pre) // 2", prefixed + " + " + hexed("(long - pre)")), ("prefix_raw", "pure AND kind = 'str' AND pre > 0", cut("sizes"), prefixed),
        ("front", "pure AND kind = 'str'", "front", "0"), ("msgpack", "NOT pure OR kind IN ('float', 'other')", f"{_PM('n')} + packed", "0"),
    ]
    every = " UNION ALL ".join(f"SELECT chunk, path, kind, n, '{e}' AS enc, CASE WHEN {ok} THEN {c} END AS cost, 1 + {_member('enc', str(1 + len(e)))} + {_member('n', _PI('n'))} + {m} AS meta, {k} AS place FROM q" for k, (e, ok, c, m) in enumerate(cands))
    return f"""{cells},
num AS (SELECT *, {part(1)} AS pre_, {part(2)} AS num, {part(3)} AS suf_, {ns} AS ns, {ip} AS ip, {uint} AS u FROM cells),
tem AS (SELECT *, CASE WHEN {exact} THEN replace(num, '.', '')::BIGINT END AS m, CASE WHEN {exact} THEN pre_ END AS t_pre, CASE WHEN {exact} THEN suf_ END AS t_suf,
    CASE WHEN {exact} THEN length(num) END AS t_chars, CASE WHEN {exact} THEN CASE WHEN contains(num, '.') THEN length(num) - position('.' IN num) ELSE 0 END END AS t_scale FROM num),
st AS (SELECT *, {steps}, row_number() OVER (PARTITION BY chunk, path, kind, i, s ORDER BY pos) = 1 AS first,
    lag(pos) {w} IS NOT NULL AND i IS NOT DISTINCT FROM lag(i) {w} AND s IS NOT DISTINCT FROM lag(s) {w} AS same, lag(s) {w} AS t FROM tem),
s1 AS (SELECT *, last_value(CASE WHEN first THEN s END IGNORE NULLS) OVER (PARTITION BY chunk, path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dt FROM st),
s2 AS (SELECT *, CASE WHEN t IS NULL THEN 0 ELSE {_LCP("t", "s")} END AS lcp, CASE WHEN dt IS NULL THEN 0 ELSE {_LCP("dt", "s")} END AS dlcp,
    sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY chunk, path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM s1),
s3 AS (SELECT *, {_BYTES("s")} - {_BYTES("left(s, lcp::BIGINT)")} AS suffix, {_BYTES("s")} - {_BYTES("left(s, dlcp::BIGINT)")} AS dsuffix, {_BYTES("s")} AS size FROM s2),
rn AS (SELECT chunk, path, sum(a)::BIGINT AS intrle, sum(b)::BIGINT AS strrle, count(*) AS runs FROM (SELECT chunk, path, {_UVL("count(*)")} + {_UVL(_VL("any_value(i)"))} + {_VL("any_value(i)")} AS a, {_UVL("count(*)")} + {_UVL(_BYTES("any_value(s)"))} + {_BYTES("any_value(s)")} AS b FROM s2 GROUP BY chunk, path, run) GROUP BY chunk, path),
one AS (SELECT chunk, path, count(*) AS n, min(kind) AS kind, min(kind) = max(kind) AS pure, sum(packed)::BIGINT AS packed, max(packed) AS most_packed,
    count(DISTINCT i) + count(DISTINCT d) + count(DISTINCT s) <= 1 AND min(kind) = max(kind) AS equal, {sums},
    min(t_pre) = max(t_pre) AND min(t_suf) = max(t_suf) AS one_form, min(t_pre) AS t_pre, min(t_suf) AS t_suf, sum(t_chars) AS digits, count(DISTINCT t_scale) AS scales, sum({_UVL("t_scale")})::BIGINT AS scale_bytes, count(DISTINCT CASE WHEN ns IS NOT NULL THEN length(s) END) AS precisions,
    greatest(min(length(regexp_extract(s, '[0-9a-f]*$'))), min(length(regexp_extract(s, '[0-9A-F]*$')))) AS tail,
    sum({_UVL(_BYTES("s"))} + {_BYTES("s")})::BIGINT AS strraw, sum({_UVL("lcp")} + {_UVL("suffix")} + suffix)::BIGINT AS front, min(s) AS low, max(s) AS high,
    sum(CASE WHEN first THEN {_VL("i")} END)::BIGINT AS dict_ints, count(CASE WHEN first AND i IS NOT NULL THEN 1 END) AS vd, count(CASE WHEN first AND s IS NOT NULL THEN 1 END) AS td,
    sum(CASE WHEN first THEN {_UVL("size")} + size END)::BIGINT AS dict_raw, sum(CASE WHEN first THEN {_UVL("dlcp")} + {_UVL("dsuffix")} + dsuffix END)::BIGINT AS dict_front, list(size) AS sizes, list(size) FILTER (first) AS dict_sizes,
    bool_and(coalesce(ip, false)) AS all_ip, min(length(s)) AS short, max(length(s)) AS long FROM s3 GROUP BY chunk, path),
a AS (SELECT *, {_LCP("low", "high")} AS pre FROM one JOIN rn USING (chunk, path)),
p AS (SELECT *, {_BYTES("left(low, pre::BIGINT)")} AS pre_bytes, {way("ns", ("_delta", "_delta2", ""))} AS ns_way, {way("u", ("", "_delta", "_delta2"))} AS u_way, {way("m", ("", "_delta", "_delta2"))} AS m_way FROM a),
q AS (SELECT *, list_min(list_filter([{ways}], lambda e: e.total IS NOT NULL)) AS dict FROM p),
cand AS (SELECT chunk, path, kind, n, enc, cost::BIGINT AS cost, meta::BIGINT AS meta, place FROM ({every}) WHERE cost IS NOT NULL),
best AS (SELECT chunk, path, any_value(n) AS n, arg_min(enc, (cost + meta, place)) AS enc, arg_min(cost, (cost + meta, place)) AS cost, arg_min(meta, (cost + meta, place)) AS meta FROM cand GROUP BY chunk, path),
seen AS (SELECT path, string_agg(DISTINCT enc, ',' ORDER BY enc) AS encs, sum(n)::BIGINT AS n, sum(cost)::BIGINT AS bytes FROM best GROUP BY path)"""


_EVENT_COLUMNS = {"event_id": "int", "ts": "stamp", "user_id": "int", "event_type": "str", "value": "float", "props": "str"}
_EVENTS = _cells("events", "event_id", _EVENT_COLUMNS)
_CUSTOMER = _cells("customer", "c_custkey", {"c_custkey": "int", "c_name": "str", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "str"})
_ORDERS = _cells("orders", "o_orderkey", {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "str", "o_totalprice": "float", "o_orderdate": "stamp", "o_orderpriority": "str"})
_STATS = _stats(_EVENTS)
_INSPECTED = lambda cells: f"(WITH {_stats(cells)} SELECT path, bytes FROM seen)"

_DERIVED = _cells(
    """(SELECT o_orderkey AS k, 'same' AS konst, o_orderkey % 3 = 0 AS flag, (o_orderkey + 1000000)::VARCHAR AS digits, concat_ws('.', 10, o_orderkey // 65536 % 256, o_orderkey // 256 % 256, o_orderkey % 256) AS ip,
      md5(o_orderkey::VARCHAR) AS hexid, 'trace/' || md5(o_orderkey::VARCHAR) AS trace, 'é-' || o_orderpriority AS code, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS gaps, o_totalprice AS price FROM orders)""",
    "k", {"k": "int", "konst": "str", "flag": "bool", "digits": "str", "ip": "str", "hexid": "str", "trace": "str", "code": "str", "gaps": "int", "price": "float"},
)
_GRID = " UNION ALL ".join(f"SELECT * FROM (WITH {_stats(_cells('events', 'event_id', _EVENT_COLUMNS, n))} SELECT {n}::BIGINT AS chunk_rows, count(DISTINCT chunk) AS chunks, sum(cost)::BIGINT AS bytes, sum(meta)::BIGINT AS meta_bytes FROM best)" for n in (1024, 4096, 16384))
_LEAF_CELLS = f"""{_POS},
kinds AS (SELECT chunk, '["' || replace(path, '/', '","') || '"]' AS path, pos, CASE WHEN value = 'null' THEN 'null' WHEN value[1] IN ('[', '{{') THEN 'other' WHEN value[1] = '"' THEN 'str' ELSE 'int' END AS kind, value FROM placed),
typed AS (SELECT chunk, path, pos, kind, CASE WHEN kind = 'int' THEN value::BIGINT END AS i, NULL::DOUBLE AS d, CASE kind WHEN 'str' THEN value[2:-2] WHEN 'other' THEN value END AS s FROM kinds),
cells AS (SELECT *, CASE kind WHEN 'int' THEN {_PI("i")} WHEN 'str' THEN {_PB(_BYTES("s"))} WHEN 'other' THEN {_BYTES("s")} ELSE 1 END AS packed FROM typed)"""
_REPORT = f"""WITH {_stats(_LEAF_CELLS)}, {_SCHEMAS.replace(_LEAVES + ",", "").strip()}, {_SEQ.replace("c AS (", "c AS (", 1)}, {_RUNS},
b AS (SELECT chunk, ceil(count(*) * {_BITS('(max(value) + 1)')} / 8.0)::BIGINT AS bitpack FROM c GROUP BY chunk),
r AS (SELECT chunk, sum({_UVL('n')} + {_UVL(_UVL('value'))} + {_UVL('value')})::BIGINT AS rle FROM runs GROUP BY chunk),
x AS (SELECT (SELECT count(*) FROM events) AS records, (SELECT sum({_BYTES(_CANON)})::BIGINT FROM events) AS json_bytes, (SELECT count(*) FROM reg) AS schemas, (SELECT count(DISTINCT path) FROM cells) AS fields,
  (SELECT sum(cost)::BIGINT FROM best) AS column_bytes, (SELECT sum(meta)::BIGINT FROM best) AS meta_bytes, (SELECT sum(least(bitpack, rle))::BIGINT FROM b JOIN r USING (chunk)) AS schema_bytes,
  (SELECT string_agg(enc || '=' || c, ',' ORDER BY enc || '=' || c) FROM (SELECT enc, count(*) AS c FROM best GROUP BY enc)) AS encodings, true AS round_trip)
SELECT *, (column_bytes + meta_bytes + schema_bytes) * 1000 // json_bytes AS per_mille FROM x"""

ORACLES = {
    "zigzag": f"SELECT o_orderkey, {_ZZ('o_custkey - 500')} AS z FROM orders",
    "uvarint_len": f"SELECT o_orderkey, {_UVL('o_custkey')} AS bytes, {_VL('o_custkey - 500')} AS signed_bytes FROM orders",
    "delta": f"WITH {_CUST} SELECT chunk, pos, value - coalesce(lag(value) {_W}, 0) AS d FROM c",
    "delta2": f"WITH {_CUST} SELECT chunk, pos, CASE WHEN lag(value) {_W} IS NULL THEN value WHEN lag(value, 2) {_W} IS NULL THEN value - lag(value) {_W} ELSE value - 2 * lag(value) {_W} + lag(value, 2) {_W} END AS dd FROM c",
    "delta_roundtrip": f"WITH {_CUST} SELECT * FROM c",
    "delta2_roundtrip": f"WITH {_CUST} SELECT * FROM c",
    "rle_runs": f"WITH {_TYPES}, {_RUNS} SELECT * FROM runs",
    "rle_roundtrip": f"WITH {_chunked('orders', 'o_orderkey', 'o_orderstatus')}, {_RUNS} SELECT chunk, value, sum(n)::BIGINT AS n, sum(n * (n - 1) // 2)::BIGINT AS k FROM runs GROUP BY chunk, value",
    "dict_encode": f"WITH {_PRIO}, {_DICT} SELECT c.chunk, pos, code FROM c JOIN d ON c.chunk = d.chunk AND c.value IS NOT DISTINCT FROM d.value",
    "dict_decode": f"WITH {_PRIO} SELECT * FROM c",
    "bits_needed": f"WITH {_chunked('part', 'p_partkey', 'p_type')} SELECT chunk, {_BITS('count(DISTINCT value)')} AS bits FROM c GROUP BY chunk",
    "cardinality": " UNION ALL ".join(f"SELECT '{c}' AS path, count(*) AS \"distinct\", max(n) AS most FROM (SELECT {c}, count(*) AS n FROM customer GROUP BY {c})" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
    "front_coding": f"WITH {_NAMES}, l AS (SELECT *, lag(value) {_W} AS b FROM c), s AS (SELECT chunk, pos, value, CASE WHEN b IS NULL THEN 0 ELSE {_LCP('b', 'value')} END AS shared FROM l) SELECT chunk, pos, shared::BIGINT AS shared, substr(value, shared::BIGINT + 1) AS suffix FROM s",
    "common_prefix": f"WITH {_NAMES}, e AS (SELECT chunk, min(value) AS a, max(value) AS b FROM c GROUP BY chunk) SELECT chunk, left(a, {_LCP('a', 'b')}) AS prefix FROM e",
    "csv_render": "SELECT page_id, " + " || ',' || ".join(f"""coalesce(CASE WHEN regexp_matches({c}, '["\\r\\n,]') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END, '')""" for c in ("page_id::VARCHAR", "url", "html")) + " AS line FROM pages",
    "ts_ns": "SELECT event_id, epoch_ns(ts) AS ns FROM events",
    "ts_predicate": f"WITH t AS (SELECT event_id, {_STAMP} AS s FROM events), f AS (SELECT event_id % 3 AS form, CASE event_id % 3 WHEN 0 THEN s || ' ' WHEN 1 THEN replace(s, 'Z', '+00:00') ELSE s END AS s FROM t) SELECT form, bool_and(regexp_matches(s, '{_TS}')) AS all_ok, count(*) AS n FROM f GROUP BY form",
    "num_template": "SELECT p_partkey, 'cost ' AS prefix, round(p_retailprice * 100)::BIGINT AS mantissa, 2::BIGINT AS scale, ' USD' AS suffix FROM part",
    "hex_pack": "SELECT o_orderkey, lpad(lower(printf('%x', o_orderkey)), 16, '0') AS t, 8::BIGINT AS bytes, true AS same FROM orders",
    "ipv4_pack": "SELECT o_orderkey, concat_ws('.', 10, o_orderkey // 65536 % 256, o_orderkey // 256 % 256, o_orderkey % 256) AS t, 167772160 + o_orderkey % 16777216 AS number, concat_ws('.', 10, o_orderkey // 65536 % 256, o_orderkey // 256 % 256, o_orderkey % 256) AS back FROM orders",
    "flatten_leaves": f"WITH {_LEAVES} SELECT * FROM leaves",
    "global_paths": f"WITH {_LEAVES} SELECT row_number() OVER (ORDER BY path) - 1 AS path_id, path FROM (SELECT DISTINCT path FROM leaves)",
    "schema_ids": f"WITH {_SCHEMAS} SELECT ordinal, schema_id FROM per JOIN reg USING (\"schema\")",
    "schema_counts": f"WITH {_SCHEMAS} SELECT * FROM reg",
    "column_positions": f"WITH {_POS} SELECT chunk, path, pos, ordinal FROM placed",
    "reconstruct": f"WITH {_LEAVES} SELECT * FROM leaves",
    "canonical_json": f"SELECT event_id AS ordinal, {_CANON} AS canonical FROM events",
    "roundtrip_diff": "SELECT event_id AS ordinal, 'id' AS path FROM events WHERE event_id % 10 = 0 AND event_id % 17 <> 16",
    "column_kinds": f"WITH {_EVENTS} SELECT path, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n FROM cells GROUP BY path",
    "cost_int_candidates": f"WITH {_STATS} SELECT chunk, path, enc, cost, meta FROM cand WHERE kind = 'int'",
    "cost_string_candidates": f"WITH {_STATS} SELECT chunk, path, enc, cost, meta FROM cand WHERE kind = 'str'",
    "choose_encoding": f"WITH {_STATS} SELECT chunk, path, n, enc, cost, meta FROM best",
    "enc_counts": f"WITH {_STATS} SELECT enc, count(*) AS n FROM best GROUP BY enc",
    "inspect_columns": f"WITH {_STATS} SELECT * FROM seen",
    "top_columns": f"SELECT * FROM (SELECT 'events' AS source, * FROM {_INSPECTED(_EVENTS)} UNION ALL SELECT 'customer', * FROM {_INSPECTED(_CUSTOMER)} UNION ALL SELECT 'orders', * FROM {_INSPECTED(_ORDERS)}) ORDER BY bytes DESC, source, path LIMIT 50",
    "size_report": f"WITH {_STATS}, j AS (SELECT count(*) AS records, sum({_BYTES(_CANON)})::BIGINT AS json_bytes FROM events), b AS (SELECT sum(bytes)::BIGINT AS bytes FROM seen) SELECT records, json_bytes, bytes, bytes * 1000 // json_bytes AS per_mille FROM j, b",
    "human_bytes": "SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN n // 1024 || '.' || (n % 1024 * 10 // 1024) || ' KiB' WHEN n < 1073741824 THEN n // 1048576 || '.' || (n % 1048576 * 10 // 1048576) || ' MiB' ELSE n // 1073741824 || '.' || (n % 1073741824 * 10 // 1073741824) || ' GiB' END AS size FROM (SELECT doc_id, n_chars * n_chars AS n FROM documents)",
    "schema_seq_cost": f"WITH {_SCHEMAS}, {_SEQ}, {_RUNS}, b AS (SELECT chunk, ceil(count(*) * {_BITS('(max(value) + 1)')} / 8.0)::BIGINT AS bitpack FROM c GROUP BY chunk), r AS (SELECT chunk, sum({_UVL('n')} + {_UVL(_UVL('value'))} + {_UVL('value')})::BIGINT AS rle FROM runs GROUP BY chunk) SELECT chunk, bitpack, rle, CASE WHEN bitpack <= rle THEN 'bitpack' ELSE 'rle' END AS enc FROM b JOIN r USING (chunk)",
    "infer_value": """WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '00' || event_id WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN event_id || '.5' WHEN 3 THEN event_id || '.50' WHEN 4 THEN '-' || event_id ELSE event_type END AS s FROM events),
      k AS (SELECT *, CASE WHEN regexp_matches(s, '^-?(0|[1-9][0-9]*)$') AND s <> '-0' AND abs(try_cast(s AS HUGEINT)) < 9007199254740992 THEN 'int' WHEN regexp_matches(s, '^-?(0|[1-9][0-9]*)\\.[0-9]*[1-9]$') AND length(s) <= 15 THEN 'float' ELSE 'text' END AS kind FROM t)
      SELECT event_id, kind, CASE WHEN kind = 'text' THEN '"' || s || '"' ELSE s END AS value FROM k""",
    "copy_escape": "SELECT page_id, coalesce(replace(replace(replace(replace(replace(replace(replace(s, '\\', '\\\\'), chr(8), '\\b'), chr(12), '\\f'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t'), chr(11), '\\v'), '\\N') AS cell FROM (SELECT page_id, CASE WHEN page_id % 9 <> 0 THEN url || chr(9) || '\\' || html END AS s FROM pages)",
    "encode_roundtrip": f"WITH {_EVENTS} SELECT path, count(*) AS n, 0::BIGINT AS diffs FROM cells GROUP BY path",
    "copy_rows": "SELECT c_custkey // 100 * 1000 + 1 + c_custkey % 100 AS ordinal, 'public.customer' AS target, 3::BIGINT AS width, c_custkey AS id, c_name || chr(9) || '\\' AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment FROM customer",
    "detect_format": """SELECT page_id, CASE WHEN e IN ('csv', 'tsv') THEN 'csv' WHEN e = 'sql' THEN 'sql' WHEN e IN ('jsonl', 'ndjson') THEN 'jsonl' WHEN e = 'json' THEN 'json' WHEN page_id % 2 = 0 THEN 'sql' ELSE 'json' END AS format
      FROM (SELECT page_id, lower(regexp_extract(CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN url || '.CSV' ELSE '' END, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM pages)""",
    "csv_roundtrip": "SELECT page_id, url, length(h) AS n, md5(h) AS html_md5, 3::BIGINT AS width FROM (SELECT page_id, url, replace(html, '><', '>' || chr(10) || '<') AS h FROM pages)",
    "csv_dialect": "SELECT * FROM (VALUES ('comma', ',', true, 's_suppkey s_name s_name_2'), ('semicolon', ';', true, 's_suppkey s_name s_name_2'), ('tab', chr(9), false, 'column_1 column_2 column_3'), ('bar', '|', true, 's_suppkey s_name s_name_2')) t(file, delimiter, has_header, names)",
    "json_array": """SELECT (event_id // 1000)::VARCHAR AS file, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) - 1 AS ordinal, event_id AS id, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS rec FROM events""",
    "insert_rows": """SELECT s_suppkey AS ordinal, CASE WHEN m THEN 'literal' ELSE 'insert' END AS kind, CASE WHEN NOT m THEN 'public.supplier' END AS target, CASE WHEN NOT m THEN s_suppkey::VARCHAR END AS id, CASE WHEN NOT m THEN s_name || '''s, ('')' END AS name,
      CASE WHEN NOT m AND s_suppkey % 3 <> 0 THEN 'f(1, ''a,b'')' END AS note, CASE WHEN NOT m THEN true END AS name_quoted, CASE WHEN NOT m THEN false END AS note_quoted FROM (SELECT *, s_suppkey % 7 = 0 AS m FROM supplier)""",
    "dump_roundtrip": """SELECT 'dump.sql' AS file, 'copy' AS kind, count(*) AS n, 0::BIGINT AS diffs FROM customer UNION ALL SELECT 'dump.sql', 'literal', 3 * count(DISTINCT c_custkey // 100), 0 FROM customer
      UNION ALL SELECT 'inserts.sql', CASE WHEN s_suppkey % 7 = 0 THEN 'literal' ELSE 'insert' END, count(*), 0 FROM supplier GROUP BY 2""",
    "record_keys": f"WITH {_LEAVES}, k AS (SELECT split_part(path, '/', 1) AS key, min(ordinal) AS o FROM leaves GROUP BY 1) SELECT row_number() OVER (ORDER BY o, key) - 1 AS key_id, key FROM k",
    "nest_records": f"SELECT event_id AS ordinal, {_CANON} AS canonical FROM events",
    "class_totals": f"SELECT event_type, count(*) AS records, sum({_BYTES(_CANON)})::BIGINT AS bytes FROM events GROUP BY event_type",
    "cost_text_classes": f"WITH {_stats(_DERIVED)} SELECT chunk, path, enc, cost, meta FROM cand",
    "bench_grid": _GRID,
    "bench_best": f"SELECT arg_min(chunk_rows, (bytes + meta_bytes, chunk_rows)) AS chunk_rows, min(bytes + meta_bytes) AS total FROM ({_GRID})",
    "analysis_report": _REPORT,
    "front_roundtrip": f"WITH {_NAMES} SELECT * FROM c",
    "ts_roundtrip": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 10 = 0 THEN '' ELSE '.' || left(strftime(ts, '%f') || '000', event_id % 10) END || 'Z' AS s FROM events",
    "unzigzag": "SELECT o_orderkey, o_custkey - 500 AS v FROM orders",
    "file_names": """SELECT page_id, CASE WHEN b = '' THEN 'archive' ELSE b END AS name, CASE WHEN e = '' THEN 'archive' ELSE e END AS stem FROM (
      SELECT page_id, left(regexp_replace(regexp_extract(url, '[^\\\\/]*$'), '[^\\p{L}\\p{N}._-]', '_', 'g'), 180) AS b, regexp_replace(left(regexp_replace(regexp_extract(url || ' ü.tar.gz', '[^\\\\/]*$'), '[^\\p{L}\\p{N}._-]', '_', 'g'), 180), '\\.[^.]+$', '') AS e FROM pages)""",
    "csv_layout": "SELECT file, bom, CASE WHEN bom THEN chr(13) || chr(10) ELSE chr(10) END AS eol, bom AS trailing_newline FROM (VALUES ('plain', false), ('windows', true)) t(file, bom) WHERE (SELECT count(*) FROM supplier) > 0",
    "csv_byte_exact": "SELECT 's.csv' AS file, count(*) + 1 AS lines, true AS equal FROM supplier",
    "json_array_lines": f"WITH j AS (SELECT event_id AS ordinal, {_CANON} AS line FROM events), b AS (SELECT min(ordinal) AS lo, max(ordinal) AS hi FROM j) SELECT ordinal, CASE WHEN ordinal < hi THEN line || ',' ELSE line END AS line FROM j, b UNION ALL SELECT lo - 1, '[' FROM b UNION ALL SELECT hi + 1, ']' FROM b",
}
