"""WARC revisits: a "not modified" record takes its payload from the latest earlier full response of the same URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Headers of a stored response that a 304 response may bring up to date.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that name a visit and not a page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: Responses that are taken, up to which their keys (16 bytes each) are broadcast; more of them are joined by a shuffle.
BROADCAST_TAKEN = 500_000
#: Two columns that name a response by 128 bits of all it holds.
KEY = ["key_a", "key_b"]


def canonical_url(url: Column) -> Column:
    """Host in lower case without "www." and default port, path without last slash and index page, query parameters in
    order without those that track visits; no scheme, no fragment."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/index\.html?$", ""), r"/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit("")))


def latest_before(records: DataFrame) -> DataFrame:
    """row, and response (KEY, record_id, etag, last_modified) of each revisit in records(row, KEY, record_id, canon, ts,
    revisit, etag, last_modified) that has an earlier response.

    Records are dealt by ranges of (URL, time), which hold equally many rows however they lie in time. Within a range a
    window finds a revisit's response; what a range begins with is the last response of the URL in the ranges before,
    found over one row for each range and URL."""
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    response = F.when(~F.col("revisit"), F.struct("ts", "record_id", *KEY, "etag", "last_modified"))
    ranged = materialize(records.repartitionByRange(n, "canon", "ts", F.col("revisit").desc(), "record_id", "row").withColumn("slice", F.spark_partition_id()))
    lasts = ranged.groupBy("canon", "slice").agg(F.max(response).alias("r"))
    carried = lasts.select("canon", "slice", F.last("r", ignorenulls=True).over(Window.partitionBy("canon").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    order = Window.partitionBy("canon", "slice").orderBy("ts", F.col("revisit").desc(), "record_id", *KEY).rowsBetween(Window.unboundedPreceding, 0)
    within = ranged.withColumn("r", F.last(response, ignorenulls=True).over(order)).where("revisit").select("row", "canon", "slice", "r")
    found = within.join(carried, ["canon", "slice"], "left").select("row", F.coalesce("r", "before").alias("response"))
    return found.where("response IS NOT NULL")


def _headers(headers: Column) -> Column:
    """The headers by name in lower case, as HTTP compares names; of names that only differ in case the last in the order
    of their spelling counts."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    lower = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(lower, lambda e, i: ~F.exists(F.slice(lower, i + 2, F.size(lower)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def resolve(records: DataFrame) -> DataFrame:
    """One row for each revisit row of records(record_id, url, ts, revisit, headers, payload): record_id, canonical_url,
    outcome, response_id, headers (names in lower case), payload.

    outcome is "resolved" where entity tags, or else modification dates, of both records are there and equal;
    "mismatch" where they differ; "unchecked" where there is none to compare; "no_response" where no response of the
    URL is earlier (of equal times none is; of responses at one time the largest id counts). Resolved and unchecked
    revisits get the response's payload and headers, with permitted headers replaced by the revisit's. Header names have
    no case. A null URL or time has no earlier response; null headers are none. Repeated revisit rows give a row each,
    and a repeated response counts once; of different responses that share id and time one counts. An empty table gives
    an empty result; other columns are left out. Payloads, however long, are shuffled once, and only to the revisits that
    take them; where very many take one response, Spark splits the join's skewed side."""
    revisit = F.coalesce("revisit", F.lit(False))
    # Names a response by all it holds, so that repeated rows share the key; payloads are read for it and not moved.
    held = ("record_id", "url", "ts", F.to_json(F.array_sort(F.map_entries("headers"))), "payload")
    keys = [F.when(~revisit, F.xxhash64(F.lit(k), *held)).alias(c) for k, c in enumerate(KEY)]
    keyed = records.select("record_id", "url", "ts", revisit.alias("revisit"), F.when(F.col("headers").isNotNull(), _headers(F.col("headers"))).alias("headers"), "payload", *keys)
    get = lambda name: F.element_at("headers", F.lit(name))
    small = materialize(keyed.select(
        F.monotonically_increasing_id().alias("row"), *KEY, "record_id", canonical_url(F.col("url")).alias("canon"), "ts", "revisit",
        get("etag").alias("etag"), get("last-modified").alias("last_modified"), F.when(F.col("revisit"), F.col("headers")).alias("own"),
    ))
    # URLs go by their hashes here, which are shorter.
    found = latest_before(small.drop("own").where("canon IS NOT NULL AND ts IS NOT NULL").withColumn("canon", F.struct(F.xxhash64(F.lit(1), "canon").alias("a"), F.xxhash64(F.lit(2), "canon").alias("b"))))
    both = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a) == F.col(b))
    same = F.coalesce(both("etag", "response.etag"), both("last_modified", "response.last_modified"))
    outcome = F.when(F.col("response").isNull(), "no_response").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    judged = materialize(small.where("revisit").join(found, "row", "left").select("record_id", F.col("canon").alias("canonical_url"), outcome.alias("outcome"), F.col("response.record_id").alias("response_id"), *[F.col(f"response.{c}").alias(c) for c in KEY], "own"))
    takes = judged.where(F.col("outcome").isin("resolved", "unchecked"))
    # Payloads that no revisit takes stay where they are, as long as the keys of the others may be sent to all tasks.
    taken = materialize(takes.select(*KEY).distinct())
    taken = F.broadcast(taken) if taken.count() <= BROADCAST_TAKEN else taken
    full = keyed.where(~F.col("revisit")).select(*KEY, F.col("headers").alias("stored"), "payload").join(taken, KEY, "left_semi").dropDuplicates(KEY)
    none = F.create_map().cast("map<string,string>")
    new = F.map_filter(F.coalesce("own", none), lambda k, _: k.isin(*PERMITTED))
    old = F.map_filter(F.coalesce("stored", none), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    merged = takes.join(full, KEY).select("record_id", "canonical_url", "outcome", "response_id", F.map_concat(old, new).alias("headers"), "payload")
    left = judged.where(~F.col("outcome").isin("resolved", "unchecked")).select("record_id", "canonical_url", "outcome", "response_id", F.col("own").alias("headers"), F.lit(None).cast(records.schema["payload"].dataType).alias("payload"))
    return merged.unionByName(left)


def crawl_of(pages: DataFrame) -> DataFrame:
    """A crawl log derived from pages(page_id, url, html): each page as a full response at time 10 * page_id, and for
    every second page a later visit, by another spelling of its URL, that the server answered with "not modified". One
    visit in ten has another entity tag, and one in fourteen comes before the page's response. Header names are spelt in
    several ways, and one page in six and one visit in eight stands twice in the log."""
    tag, p = F.md5("html"), F.col("page_id")
    spelt = lambda upper, lower: F.when(p % 3 == 0, upper).otherwise(lower)
    responses = pages.select(
        (2 * p).alias("record_id"), "url", (10 * p).alias("ts"), F.lit(False).alias("revisit"),
        F.create_map(spelt("ETag", "etag"), tag, spelt("Date", "date"), (10 * p).cast("string"), F.lit("Content-Length"), F.octet_length("html").cast("string")).alias("headers"), F.col("html").alias("payload"),
    )
    visits = pages.where(p % 2 == 0).select(
        (2 * p + 1).alias("record_id"), F.concat(F.regexp_replace("url", r"#.*$", ""), F.when(F.col("url").contains("?"), F.lit("&utm_source=again#top")).otherwise(F.lit("?utm_source=again#top"))).alias("url"),
        (10 * p + F.when(p % 14 == 0, -5).otherwise(5003)).alias("ts"), F.lit(True).alias("revisit"),
        F.create_map(spelt("Etag", "ETAG"), F.when(p % 10 == 0, F.md5(F.concat("html", F.lit("x")))).otherwise(tag), F.lit("date"), (10 * p + 5003).cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("content-length"), F.lit("0")).alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    times = lambda df, twice: df.select("*", F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_again")).drop("_again")
    return times(responses, F.col("record_id") % 12 == 0).unionByName(times(visits, F.col("record_id") % 16 == 1))
