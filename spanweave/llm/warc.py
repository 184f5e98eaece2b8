"""WARC captures: not-modified revisits resolved to the latest earlier full response of the same canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize

#: Seconds of a time bucket; a URL's captures are ordered within a bucket, buckets are chained by one row each.
BUCKET_SECONDS = 3600

# Query parameters that name a visit, not a resource.
TRACKING = ("fbclid", "gclid", "ref", "sessionid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")

# Header fields that a not-modified answer may update in the stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")


def canonical_url(url: Column, tracking: tuple[str, ...] = TRACKING) -> Column:
    """Host in lower case without www, default ports and scheme; no fragment; path without trailing slashes; parameters
    sorted, without those of `tracking`. Null, and text that is no absolute URL, give null.
    """
    bare = F.regexp_replace(url, r"#.*$", "")
    shape = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?]*)([^?]*)\??(.*)$"
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, shape, 1)), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, shape, 2), r"/+$", "")
    keep = F.array_sort(F.filter(F.split(F.regexp_extract(bare, shape, 3), "&"), lambda p: (p != "") & ~F.lower(F.regexp_replace(p, "=.*$", "")).isin(*tracking)))
    query = F.array_join(keep, "&")
    return F.when(bare.rlike(shape), F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))))


def latest_earlier(records: DataFrame, key: str, time: str, record: str, is_target: Column, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """records with `ref`: of the rows with the same key that come before by (time, record), the record of the last target.

    An as-of join in two steps, so that no key meets in one task: within (key, time bucket) a window looks back; what a
    bucket knows of earlier ones is the last target of each earlier bucket, one row per key and bucket. Null keys and times
    have no ref and are no target.
    """
    target = F.when(is_target & F.col(key).isNotNull() & F.col(time).isNotNull(), F.struct(F.col(time).alias("t"), F.col(record).alias("r")))
    rows = records.withColumn("_bucket", F.floor(F.unix_timestamp(time) / bucket_seconds)).withColumn("_target", target)
    buckets = rows.where("_target is not null").groupBy(key, "_bucket").agg(F.max("_target").alias("_last"))
    marks = buckets.unionByName(rows.where((F.col("_target").isNull()) & F.col(key).isNotNull() & F.col("_bucket").isNotNull()).select(key, "_bucket").distinct().withColumn("_last", F.lit(None).cast(buckets.schema["_last"].dataType)))
    marks = marks.groupBy(key, "_bucket").agg(F.max("_last").alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = marks.select(key, "_bucket", before.alias("_carried"))
    inside = F.last("_target", ignorenulls=True).over(Window.partitionBy(key, "_bucket").orderBy(time, record).rowsBetween(Window.unboundedPreceding, -1))
    found = rows.withColumn("_inside", F.when(F.col(key).isNotNull() & F.col("_bucket").isNotNull(), inside)).join(carried, [key, "_bucket"], "left")
    return found.withColumn("ref", F.coalesce("_inside", "_carried")["r"]).drop("_bucket", "_target", "_inside", "_carried")


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that then are equal, the value of the last one as the names were."""
    entries = F.array_sort(F.map_entries(headers))
    merged = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])))
    return F.when(F.exists(F.map_keys(headers), lambda k: k != F.lower(k)), merged).otherwise(headers)


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """(record_id, canonical_url, status, ref_id, headers map, body): one row per record.

    records: record_id (of any type that has an order, such as a URN), warc_type, url, date timestamp, http_status, headers
    map<string,string> (names of any case; they come out in lower case), body.
    A full response (warc_type response, status 200) is `response` and keeps its own headers and body. A not-modified revisit
    (warc_type revisit, status 304) refers to the latest earlier full response of its canonical URL and is
    `resolved` if its ETag equals that response's (weakly: W/ aside), or, without one, its Last-Modified does;
    `unverified` if it has neither; `mismatch` if they differ; `orphan` if there is no earlier response. Resolved and unverified
    ones get that response's body, and its headers with the permitted fields of the revisit over them. All else is `other`.

    Equal dates are ordered by record_id; repeated records give repeated rows, each target counting once (record ids name
    captures, so the first of a repeated id's bodies by header text is used). Null URLs and dates have no earlier response;
    null headers count as none. Empty table, empty result. Only ids take part in the as-of step; of the bodies, those that are
    referred to are joined by id afterwards, a join that AQE can split where many revisits have one response.
    """
    kind = records.schema["record_id"].dataType
    none = F.create_map().cast("map<string,string>")
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "date", "warc_type", "http_status", lower_names(F.coalesce("headers", none)).alias("headers"), "body")
    full = F.coalesce((F.col("warc_type") == "response") & (F.col("http_status") == 200), F.lit(False))
    unchanged = F.coalesce((F.col("warc_type") == "revisit") & (F.col("http_status") == 304), F.lit(False))

    whole = rows.where(full).select("record_id", "canonical_url", F.lit("response").alias("status"), F.lit(None).cast(kind).alias("ref_id"), "headers", "body")
    other = rows.where(~full & ~unchanged).select("record_id", "canonical_url", F.lit("other").alias("status"), F.lit(None).cast(kind).alias("ref_id"), "headers", "body")
    slim = rows.where(full | unchanged).select("record_id", "canonical_url", "date", F.when(unchanged, F.col("headers")).alias("own"), unchanged.alias("revisit"))
    asked = latest_earlier(slim, "canonical_url", "date", "record_id", ~F.col("revisit"), bucket_seconds).where("revisit").select("record_id", "canonical_url", "own", "ref")
    asked = materialize(asked, "revisits")
    named = rows.where(full).join(asked.select(F.col("ref").alias("_ref")).distinct(), F.col("record_id") == F.col("_ref"), "left_semi")
    stored = named.groupBy(F.col("record_id").alias("ref")).agg(F.min_by(F.struct("headers", "body"), F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"], F.lit(""))))), "\n")).alias("full"))
    joined = asked.join(stored, "ref", "left")

    strong = lambda c: F.regexp_replace(c, "^W/", "")
    etag, modified = F.col("own")["etag"], F.col("own")["last-modified"]
    same = F.when(etag.isNotNull(), F.coalesce(strong(etag) == strong(F.col("full.headers")["etag"]), F.lit(False))).when(modified.isNotNull(), F.coalesce(modified == F.col("full.headers")["last-modified"], F.lit(False)))
    status = F.when(F.col("ref").isNull(), "orphan").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    over = F.map_filter("own", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(F.col("full.headers"), lambda k, v: ~F.array_contains(F.map_keys(over), k)), over)
    taken = F.col("status").isin("resolved", "unverified")
    answered = joined.withColumn("status", status).select("record_id", "canonical_url", "status", F.col("ref").alias("ref_id"), F.when(taken, merged).otherwise(F.col("own")).alias("headers"), F.when(taken, F.col("full.body")).alias("body"))
    return whole.unionByName(answered).unionByName(other)


def page_captures(pages: DataFrame) -> DataFrame:
    """The capture history that pages stand for: each page is a full response, and pages of even id are asked for again a
    week later and answered not modified, through an address with a tracking parameter and the other scheme.

    The validators of the second capture depend on page_id / 2 mod 4: an equal weak ETag, a Last-Modified alone, none, a stale ETag.
    """
    start = F.lit(1_700_000_000).cast("long")
    at = start + F.col("page_id") * 60
    etag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16), F.lit('"'))
    modified = F.concat(F.lit("t"), start - F.col("page_id") * 3600)
    first = pages.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("warc_type"), "url", F.timestamp_seconds(at).alias("date"), F.lit(200).alias("http_status"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("date"), F.concat(F.lit("t"), at), F.lit("etag"), etag, F.lit("last-modified"), modified).alias("headers"),
        F.col("html").alias("body"),
    )
    turn = F.floor(F.col("page_id") / 2) % 4
    later = at + 7 * 86400
    plain = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), F.concat(F.lit("t"), later), F.lit("expires"), F.concat(F.lit("t"), later + 60))
    validators = F.when(turn == 0, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), etag))).when(turn == 1, F.create_map(F.lit("last-modified"), modified)).when(turn == 3, F.create_map(F.lit("etag"), F.lit('"stale"'))).otherwise(F.create_map().cast("map<string,string>"))
    bare = F.regexp_replace("url", "#.*$", "")
    other = F.when(bare.startswith("https:"), F.regexp_replace(bare, "^https:", "http:")).otherwise(F.regexp_replace(bare, "^http:", "https:"))
    again = pages.where(F.col("page_id") % 2 == 0).select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("warc_type"), F.concat(other, F.when(bare.contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit("utm_source=again")).alias("url"),
        F.timestamp_seconds(later).alias("date"), F.lit(304).alias("http_status"), F.map_concat(plain, validators).alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    return first.unionByName(again)
