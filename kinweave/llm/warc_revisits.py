"""Resolution of not-modified revisit records of web archives.

A revisit says that a page was as before. It is resolved by an as-of join on the canonical URL to the
latest earlier full response. Its validators (entity tag, last-modified date, payload digest) must not
contradict those of that response; then the payload is that of the response, and its headers are those of
the response with the ones a not-modified answer may update taken from the revisit.

The as-of join sorts within stretches of ``STRETCH`` seconds of a URL, and hands the last response of each
stretch on to later ones by a second, much smaller window over one row per stretch. A URL with a third of
all captures is thus dealt over as many tasks as it has stretches. Payloads are not moved, only their
digests and the identifier of the record that holds them.

Defined cases: a revisit without earlier response is ``unresolved``, one whose validators contradict is
``mismatch``, one that states none is ``resolved``; a revisit without URL or time is ``unresolved``; a
response of the same second counts as earlier if its identifier is smaller; null headers are empty;
repeated records are each resolved; other record types are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 30 * 24 * 3600
#: Fixed value: headers that a not-modified answer may update.
UPDATED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary", "via", "warning")


def canonical_url(url: Column) -> Column:
    """Key under which captures of one page meet: no scheme, ``www.``, default port, fragment or trailing slash; sorted query."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?i:https?://)?(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)$", ""), r"^www\d?\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^(?i:https?://)?[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    sorted_query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    return F.when(F.length(host) > 0, F.concat(host, path, F.when(F.length(sorted_query) > 0, F.concat(F.lit("?"), sorted_query)).otherwise("")))


def headers_of(block: Column) -> Column:
    """Header block of ``name: value`` lines as a map with lower-case names; the last of equal names counts."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"),
                                                  F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["name"] == p["name"]))
    return F.map_from_entries(last)


def merged_headers(response: Column, revisit: Column) -> Column:
    """Headers of the response, with those a not-modified answer may update taken from the revisit."""
    taken = F.map_filter(revisit, lambda k, v: k.isin(*UPDATED))
    kept = F.map_filter(response, lambda k, v: ~F.array_contains(F.map_keys(taken), k))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, taken))))


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, url_key, status, response_id, headers, payload_digest) of every revisit.

    ``records``: record_id, type (``response`` or ``revisit``), url, seconds, headers (map of lower-case
    names), payload_digest.
    """
    empty = F.create_map().cast("map<string,string>")
    all_ = records.where(F.col("type").isin("response", "revisit")).select(
        "record_id", "type", canonical_url(F.col("url")).alias("url_key"), F.col("seconds").cast("long").alias("seconds"),
        F.coalesce("headers", empty).alias("headers"), "payload_digest")
    usable = F.col("url_key").isNotNull() & F.col("seconds").isNotNull()
    dealt = all_.where(usable).withColumn("stretch", F.floor(F.col("seconds") / STRETCH))
    response = F.when(F.col("type") == "response", F.struct("seconds", "record_id", "headers", "payload_digest"))
    inner = Window.partitionBy("url_key", "stretch").orderBy("seconds", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.last(response, ignorenulls=True).over(inner)).where(F.col("type") == "revisit")
    # Last response of every stretch, then of all stretches before.
    last = dealt.where(F.col("type") == "response").groupBy("url_key", "stretch").agg(
        F.max_by(F.struct("record_id", "headers", "payload_digest"), F.struct("seconds", "record_id")).alias("last"))
    stretches = last.unionByName(dealt.where(F.col("type") == "revisit").select("url_key", "stretch").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType)))
    stretches = stretches.groupBy("url_key", "stretch").agg(F.max_by("last", F.col("last").isNotNull()).alias("last"))
    before = Window.partitionBy("url_key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    far = stretches.withColumn("far", F.last("last", ignorenulls=True).over(before)).select("url_key", "stretch", "far")
    found = F.when(F.col("near").isNotNull(), F.struct(F.col("near.record_id"), F.col("near.headers"), F.col("near.payload_digest"))).otherwise(F.col("far"))
    joined = near.join(far, ["url_key", "stretch"], "left").withColumn("found", found)
    theirs, own = F.col("found.headers"), F.col("headers")
    differ = lambda a, b: F.coalesce(a != b, F.lit(False))
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    contradicts = (differ(weak(F.try_element_at(own, F.lit("etag"))), weak(F.try_element_at(theirs, F.lit("etag"))))
                   | differ(F.try_element_at(own, F.lit("last-modified")), F.try_element_at(theirs, F.lit("last-modified")))
                   | differ(F.col("payload_digest"), F.col("found.payload_digest")))
    status = F.when(F.col("found").isNull(), "unresolved").when(contradicts, "mismatch").otherwise("resolved")
    good = F.col("status") == "resolved"
    out = joined.withColumn("status", status).select(
        "record_id", "url_key", "status", F.when(good, F.col("found.record_id")).alias("response_id"),
        F.when(good, merged_headers(theirs, own)).alias("headers"), F.when(good, F.col("found.payload_digest")).alias("payload_digest"))
    lost = all_.where((F.col("type") == "revisit") & ~usable).select(
        "record_id", "url_key", F.lit("unresolved").alias("status"), F.lit(None).cast(out.schema["response_id"].dataType).alias("response_id"),
        F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("payload_digest"))
    return out.unionByName(lost)


def captures_of(pages: DataFrame) -> DataFrame:
    """Archive records spelled out of pages: each page is captured in full, and an hour later found not modified.

    The second capture comes under another spelling of the URL; every fifth has another entity tag.
    """
    digest = F.concat(F.lit("sha256:"), F.sha2(F.coalesce("html", F.lit("")), 256))
    tag = F.substring(digest, 8, 16)
    at = F.col("page_id") * 600
    # Bytes leave the row here; everything later works on digests.
    seen = pages.select("page_id", "url", digest.alias("payload_digest"), tag.alias("tag"), at.alias("seconds"))
    full = seen.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("type"), "url", "seconds",
        headers_of(F.concat(F.lit("Content-Type: text/html\r\nServer: a\r\nETag: "), F.col("tag"), F.lit("\r\nDate: "), F.col("seconds").cast("string"))).alias("headers"), "payload_digest")
    later = F.when(F.col("page_id") % 5 == 0, F.reverse("tag")).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    again = seen.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("type"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"),
        (F.col("seconds") + 3600).alias("seconds"),
        headers_of(F.concat(F.lit("ETag: "), later, F.lit("\r\nServer: b\r\nDate: "), (F.col("seconds") + 3600).cast("string"))).alias("headers"), F.lit(None).cast("string").alias("payload_digest"))
    return full.unionByName(again)


def revisit_report(pages: DataFrame) -> DataFrame:
    """One row per revisit of the captures of ``pages``."""
    headers = F.array_join(F.transform(F.map_entries("headers"), lambda x: F.concat_ws(": ", x["key"], x["value"])), "\n")
    return resolve(captures_of(pages)).select("record_id", "url_key", "status", "response_id", headers.alias("headers"), "payload_digest")
