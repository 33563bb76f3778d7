"""Scalar expressions, all of them evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns of whole texts; a line feed at the end is no match.
TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?Z\z"
UNSIGNED = r"^(0|[1-9][0-9]*)\z"
HEX = r"^([0-9a-f]+|[0-9A-F]+)\z"
IPV4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\z"
#: What stands before a text's last number, the number, and what follows it.
TEMPLATE = r"^([^\n]*?)([+-]?[0-9]++(?:\.[0-9]++)?+)([^0-9]*+)\z"
#: Numbers that their digits and scale give back: no plus sign, no zeros in front, no negative zero; 18 digits at most.
EXACT = r"^(?!-[0.]*\z)-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?\z"
DIGITS = 18


def zigzag(v: Column) -> Column:
    """Signed numbers as unsigned ones: 0, -1, 1, -2 become 0, 1, 2, 3."""
    v = v.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def uvarint_len(v: Column) -> Column:
    """Bytes of an unsigned number (64 bits, also where the sign bit is set) in groups of seven bits; 1 for null."""
    v = v.cast("long")
    size = F.when(v < 0, 10)
    for n in range(1, 9):
        size = size.when(v < F.lit(2 ** (7 * n)), n)
    return size.when(v.isNull(), 1).otherwise(9).cast("long")


def varint_len(v: Column) -> Column:
    return uvarint_len(zigzag(v))


def bits_needed(n: Column) -> Column:
    """Bits that tell n values apart, one at least."""
    return F.greatest(F.lit(1), F.length(F.bin(n - 1))).cast("long")


def text_len(s: Column) -> Column:
    """Bytes of a length-prefixed UTF-8 text."""
    return uvarint_len(F.octet_length(s).cast("long")) + F.octet_length(s)


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("long")))


def packed_int(v: Column) -> Column:
    """Bytes of a whole number in a self-describing binary format (1, 2, 3, 5 or 9 with its tag)."""
    fits = lambda low, high: v.between(F.lit(low), F.lit(high))
    return F.when(fits(-32, 127), 1).when(fits(-128, 255), 2).when(fits(-(2**15), 2**16 - 1), 3).when(fits(-(2**31), 2**32 - 1), 5).otherwise(9).cast("long")


def packed_bytes(n: Column) -> Column:
    """The same of a text of n bytes."""
    return (F.when(n < 32, 1).when(n < 256, 2).when(n < 65536, 3).otherwise(5) + n).cast("long")


def packed_many(n: Column) -> Column:
    """The same of the head of a list or object with n members."""
    return F.when(n < 16, 1).when(n < 65536, 3).otherwise(5).cast("long")


def packed_len(c: Column, kind: T.DataType) -> Column:
    """The same of a value of any type; texts stand for times, dates and decimals."""
    if isinstance(kind, T.ArrayType):
        known = packed_many(F.size(c)) + F.aggregate(F.transform(c, lambda x: packed_len(x, kind.elementType)), F.lit(0).cast("long"), lambda a, x: a + x)
    elif isinstance(kind, T.MapType):
        each = F.transform(F.map_entries(c), lambda e: packed_len(e["key"], kind.keyType) + packed_len(e["value"], kind.valueType))
        known = packed_many(F.size(c)) + F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)
    elif isinstance(kind, T.StructType):
        known = packed_many(F.lit(len(kind.fields)))
        for f in kind.fields:
            known = known + packed_bytes(F.lit(len(f.name.encode()))) + packed_len(c[f.name], f.dataType)
    elif isinstance(kind, T.BooleanType):
        known = F.lit(1).cast("long")
    elif isinstance(kind, T.IntegralType):
        known = packed_int(c.cast("long"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        known = F.lit(9).cast("long")
    elif isinstance(kind, T.BinaryType):
        known = F.octet_length(c) + F.when(F.octet_length(c) < 256, 2).when(F.octet_length(c) < 65536, 3).otherwise(5)
    else:
        known = packed_bytes(F.octet_length(c.cast("string")).cast("long"))
    return F.when(c.isNull(), F.lit(1).cast("long")).otherwise(known)


def common_prefix_len(a: Column, b: Column) -> Column:
    """Code points that both texts begin with: bit by bit from the highest, by whether the next stretch is equal."""
    short = F.least(F.length(a), F.length(b))
    powers = F.transform(F.sequence(F.floor(F.log2(F.greatest(short, F.lit(1)))).cast("int"), F.lit(0)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    same = lambda n, step: (n + step <= short) & (F.substr(a, n + 1, step) == F.substr(b, n + 1, step))
    return F.when(a == b, F.length(a)).otherwise(F.aggregate(powers, F.lit(0), lambda n, step: F.when(same(n, step), n + step).otherwise(n))).cast("long")


def timestamp_ns(s: Column) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 text in UTC; null where the text is none, names no day that exists, or lies
    beyond 64 bits."""
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat(F.left(s, F.lit(19)), F.lit("Z"))))
    fraction = F.rpad(F.regexp_extract(s, r"\.([0-9]+)Z$", 1), 9, "0").cast("long")
    return F.when(s.rlike(TIMESTAMP), F.try_add(F.try_multiply(seconds, F.lit(1_000_000_000)), F.coalesce(fraction, F.lit(0))))


def timestamp_text(ns: Column, digits: Column) -> Column:
    """An RFC 3339 text in UTC again, with so many digits of the second's fraction."""
    rest = F.pmod(ns, F.lit(1_000_000_000))
    seconds = F.round((ns - rest) / 1_000_000_000).cast("long")
    fraction = F.when(digits > 0, F.concat(F.lit("."), F.left(F.lpad(rest.cast("string"), 9, "0"), digits))).otherwise(F.lit(""))
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def template_parts(s: Column) -> Column:
    """prefix, mantissa, scale, suffix and chars (of the number) of a text that EXACT allows; else null."""
    cut = F.split(F.regexp_replace(s, F.lit(TEMPLATE), F.lit("$1\u0001$2\u0001$3")), "\u0001")
    part = lambda k: F.get(cut, F.lit(k - 1))
    number, point = part(2), F.locate(".", part(2))
    digits = F.replace(number, F.lit("."), F.lit(""))
    scale = F.when(point > 0, F.length(number) - point).otherwise(0).cast("long")
    fits = (F.size(cut) == 3) & number.rlike(EXACT) & (F.length(digits) <= DIGITS)
    return F.when(fits, F.struct(part(1).alias("prefix"), digits.cast("long").alias("mantissa"), scale.alias("scale"), part(3).alias("suffix"), F.length(number).cast("long").alias("chars")))


def ipv4_number(s: Column) -> Column:
    """A dotted quad as a 32-bit number; null for other texts."""
    part = lambda i: F.split(s, r"\.")[i].cast("long")
    return F.when(s.rlike(IPV4), part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


def ipv4_text(n: Column) -> Column:
    byte = lambda k: F.shiftright(n, k).bitwiseAND(F.lit(255).cast("long")).cast("string")
    return F.concat_ws(".", byte(24), byte(16), byte(8), byte(0))


def infer_kind(s: Column) -> Column:
    """int or float where the text prints back as it stands, else text."""
    whole = s.rlike(r"^-?(0|[1-9][0-9]*)\z") & (s != "-0") & (F.length(s) <= 17) & (F.abs(s.try_cast("long")) <= 2**53 - 1)
    decimal = s.rlike(r"^-?(0|[1-9][0-9]*)\.[0-9]*[1-9]\z") & (F.length(s) <= 15)
    return F.when(whole, "int").when(decimal, "float").otherwise("text")


def infer_value(s: Column) -> Column:
    """The text as VARIANT: a number where infer_kind() says so, else the text itself."""
    return F.when(infer_kind(s) != "text", F.try_parse_json(s)).otherwise(s.cast("variant"))


def safe_name(path: Column) -> Column:
    """A path's last part, characters other than letters, digits, dot, line and hyphen replaced; "archive" for none."""
    base = F.left(F.regexp_replace(F.regexp_extract(F.coalesce(path, F.lit("")), r"[^\\/]*$", 0), r"[^\p{L}\p{N}._-]", "_"), F.lit(180))
    return F.when(base == "", "archive").otherwise(base)


def stem(path: Column) -> Column:
    """safe_name() without the ending."""
    name = F.regexp_replace(safe_name(path), r"\.[^.]+$", "")
    return F.when(name == "", "archive").otherwise(name)


def copy_escape(s: Column) -> Column:
    """A value as PostgreSQL's COPY writes it; null is \\N."""
    out = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for raw, name in (("\b", "b"), ("\f", "f"), ("\n", "n"), ("\r", "r"), ("\t", "t"), ("\x0b", "v")):
        out = F.replace(out, F.lit(raw), F.lit("\\" + name))
    return F.coalesce(out, F.lit("\\N"))


def csv_cell(s: Column, delimiter: str = ",") -> Column:
    """A CSV cell, quoted only where it must be; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(s.rlike(f'["\\r\\n{delimiter}]'), quoted).otherwise(s), F.lit(""))


def human_bytes(n: Column) -> Column:
    """Bytes as B, KiB, MiB or GiB with one decimal."""
    scaled = lambda p, unit: F.concat(F.format_string("%d.%d", F.floor(n / p), F.floor(n % p * 10 / p)), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, scaled(1024, "KiB")).when(n < 1024**3, scaled(1024**2, "MiB")).otherwise(scaled(1024**3, "GiB"))
