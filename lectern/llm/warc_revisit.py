"""WARC: resolving not-modified revisit records to full responses.

A revisit record says that a URL's content had not changed; it carries validators and headers, but no body. Each is
joined as of its time to the latest earlier full response of the same canonical URL; the validators are checked, and the
response's headers are updated by the revisit's as far as a not-modified answer may. Bodies are not moved: the result
names the record that holds the body.

A URL captured very often is split by time: within a slice of time a running last value finds the response; where a slice
has none before a revisit, the last response of the slices before is looked up, one row a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers of a 304 answer that must not replace stored ones, and query parameters that name no content.
NOT_MERGED = ["content-length", "content-encoding", "content-type", "content-range", "transfer-encoding", "connection"]
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref"]
SLICE = 4096


def canonical_url(url: Column) -> Column:
    """Scheme and host without www. in lower case, path without a trailing slash, sorted query without tracking, no fragment.

    http counts as https, default ports are dropped. Null or a string without :// stays as it is, null as empty.
    """
    text = F.coalesce(url, F.lit(""))
    at = lambda g: F.regexp_extract(text, r"(?s)^([^:/?#]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?\z", g)
    host = F.regexp_replace(F.regexp_replace(F.lower(at(2)), r":(80|443)\z", ""), r"^www\.", "")
    path = F.regexp_replace(at(3), r"/+\z", "")
    keep = F.filter(F.split(at(4), "&"), lambda q: (q != "") & ~F.lower(F.substring_index(q, "=", 1)).isin(TRACKING))
    query = F.array_join(F.array_sort(keep), "&")
    scheme = F.when(F.lower(at(1)).isin("http", "https"), F.lit("https")).otherwise(F.lower(at(1)))
    built = F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(at(1) == "", text).otherwise(built)


def merged_headers(stored: Column, newer: Column) -> Column:
    """The stored headers, updated by those of the revisit that a not-modified answer may change. Names in lower case."""
    allowed = F.map_filter(newer, lambda k, v: ~k.isin(NOT_MERGED))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def resolve_revisits(records: DataFrame, slice_size: int = SLICE) -> DataFrame:
    """One row per revisit record: record_id, url_key, refers_to, status, headers.

    records: record_id, url, ts (long), kind ('response' or 'revisit'), headers (map of lower-case names). The response
    joined is the latest before the revisit's time, of equal times the one of largest record_id; a response at the very
    time of the revisit is not earlier. status: resolved, validator-mismatch (both have an etag, or neither pair of etags
    exists and both have a last-modified, and they differ), or no-earlier-response. headers are merged where resolved,
    else the revisit's own. Null headers count as empty; rows of null time or another kind are left out; a null url is
    the key ''. Repeated rows give repeated results. An empty table gives no rows.
    """
    empty = F.create_map().cast("map<string,string>")
    rows = records.where("ts is not null and kind in ('response', 'revisit')").select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), (F.col("kind") == "response").alias("full"), F.coalesce("headers", empty).alias("headers")
    ).withColumn("slice", F.floor(F.col("ts") / slice_size))
    seen = F.when(F.col("full"), F.struct("ts", "record_id", "headers"))
    # a revisit comes before a response of its own time, which is not earlier
    before = Window.partitionBy("url_key", "slice").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("found", F.last(seen, ignorenulls=True).over(before)).where(~F.col("full"))
    last = rows.where("full").groupBy("url_key", "slice").agg(F.max_by(F.struct("ts", "record_id", "headers"), F.struct("ts", "record_id")).alias("last"))
    needed = near.where("found is null").select("url_key", "slice").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType))
    slices = last.unionByName(needed).groupBy("url_key", "slice").agg(F.first("last", ignorenulls=True).alias("last"))
    earlier = slices.withColumn("carried", F.last("last", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).select("url_key", "slice", "carried")
    joined = near.join(earlier, ["url_key", "slice"], "left").withColumn("found", F.coalesce("found", "carried"))
    theirs, ours = F.col("found.headers"), F.col("headers")
    differ = lambda k: F.element_at(theirs, k) != F.element_at(ours, k)
    mismatch = F.coalesce(differ("etag"), differ("last-modified"), F.lit(False))
    status = F.when(F.col("found").isNull(), "no-earlier-response").when(mismatch, "validator-mismatch").otherwise("resolved")
    return joined.withColumn("status", status).select(
        "record_id", "url_key", F.when(F.col("status") == "resolved", F.col("found.record_id")).alias("refers_to"), "status",
        F.when(F.col("status") == "resolved", merged_headers(theirs, ours)).otherwise(ours).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """WARC-like records drawn from every page, for the registered query.

    Page p stands for two captures of what its URL begins with: scheme, host and the first part of the path, which many
    pages share. The first is at time t = 7919 p mod 50021, a full response, but for every third page a revisit; so URLs
    have gaps, ties, and revisits before any response. The second is a revisit at t + (p mod 17) - 4, its URL spelled with
    a tracking parameter and a fragment. Content changes every 9000 ticks: an etag (not for every fifth page) and a
    last-modified (for every other page) name the content of a capture's own time. A page without a URL has the key ''.
    """
    p, html = F.col("page_id").cast("long"), F.coalesce("html", F.lit(""))
    base = F.regexp_extract("url", r"^([^:/?#]+://[^/?#]*(?:/[^/?#]*)?)", 1)
    base = F.when(base != "", base)
    t = p * 7919 % 50021

    def headers(ts: Column, size: Column) -> Column:
        version = F.floor(ts / 9000).cast("string")
        all_ = F.create_map(
            F.lit("etag"), F.when(p % 5 != 0, F.concat(F.lit("v"), version)), F.lit("last-modified"), F.when(p % 2 == 0, F.concat(F.lit("day "), version)),
            F.lit("content-length"), size.cast("string"), F.lit("date"), ts.cast("string"),
        )
        return F.map_filter(all_, lambda k, v: v.isNotNull())

    kind = F.when(p % 3 == 0, "revisit").otherwise("response")
    first = pages.select((p * 2).alias("record_id"), F.coalesce(base, "url").alias("url"), t.alias("ts"), kind.alias("kind"), headers(t, F.octet_length(html)).alias("headers"))
    later = t + p % 17 - 4
    spelled = F.coalesce(F.concat(base, F.lit("/?utm_source=x#again")), "url")
    again = pages.select((p * 2 + 1).alias("record_id"), spelled.alias("url"), later.alias("ts"), F.lit("revisit").alias("kind"), headers(later, F.lit(0)).alias("headers"))
    return first.unionByName(again)


def revisit_report(pages: DataFrame) -> DataFrame:
    """record_id, url_key, refers_to, status, headers as text, for every revisit drawn from `pages`.

    A null url is a key of its own, the empty one; of a null html the size is 0; a very long one is only measured. Repeated
    pages give repeated revisits; an empty table gives none.
    """
    told = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return resolve_revisits(captures(pages)).select("record_id", "url_key", "refers_to", "status", told.alias("headers"))
