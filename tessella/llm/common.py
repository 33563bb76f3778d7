"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stored import materialize, release, scratch_dir  # noqa: F401

#: A run of the white space that separates words, as a Java and a Python pattern.
SPACES = r"[\x20\x09-\x0D]+"
#: The same characters, for trim().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys of a table that are broadcast at most by join_uneven().
BROADCAST_KEYS = 50_000


def join_uneven(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with table(key, weight, more), whose keys are unique, where a key may hold very many of
    the rows. Keys whose weight is one in BROADCAST_KEYS of all or more, of which there can't be more than that, are sent to
    all tasks; the rows of the other keys are shuffled, and none of these is large. A null key matches nothing."""
    total, n = table.agg(F.coalesce(F.sum(weight), F.lit(0)), F.count("*")).first()
    if n <= BROADCAST_KEYS:
        return rows.join(F.broadcast(table.drop(weight)), key, how)
    is_large = F.col(weight) * BROADCAST_KEYS >= total
    large, small = table.where(is_large).drop(weight), table.where(~is_large).drop(weight)
    rest = rows.where(F.col(key).isNotNull()).join(F.broadcast(large.select(key)), key, "left_anti")
    found = rows.join(F.broadcast(large), key).unionByName(rest.join(small, key, how))
    return found.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row, also where body uses it inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def row_keys(doc_id: Column, text: Column) -> list[Column]:
    """_k1 and _k2, 128 bits that name a row by its id and text, without nulls; rows that repeat both share them."""
    return [F.xxhash64(F.lit(1), doc_id, text).alias("_k1"), F.xxhash64(F.lit(2), text, doc_id).alias("_k2")]


def packed(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that names of ours can't clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
