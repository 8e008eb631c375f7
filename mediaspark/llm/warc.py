"""Revisit records of web archives: an as-of join to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaspark.llm.common import written

#: Query parameters that say where a visitor came from, not what is asked for.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=.*)?$"
#: Header fields that a 304 answer must not change in a stored response (fixed values).
KEPT_FIELDS = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Host, path and query by which captures of a page meet: without scheme, ``www.``, default port, user, fragment,
    closing slash and tracking parameters; the host in lower case, the parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place = F.regexp_extract(bare, r"^[^/?]*", 0)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(place, r"^.*@", "")), r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    asked = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise(F.lit("")))


def fields(headers: Column) -> Column:
    """Header fields under lower-case names; of names that differ by case, the last entry counts."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.coalesce(F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])), F.create_map().cast("map<string,string>"))


def merged(stored: Column, news: Column) -> Column:
    """A stored response's fields, updated by those that a 304 answer may change."""
    named = F.transform(F.split(F.lower(F.coalesce(F.element_at(news, "connection"), F.lit(""))), ","), lambda x: F.trim(x))
    may = F.map_filter(news, lambda k, _: ~k.isin(*KEPT_FIELDS) & ~F.array_contains(named, k))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(may, k)), may)


def _tag(f: Column) -> Column:
    return F.regexp_replace(F.element_at(f, "etag"), r"^W/", "")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Every revisit of ``captures`` with canonical_url, refers_to, resolution, merged (headers) and payload_digest.

    ``captures`` has record_id, url, at (a whole number that grows with time), kind ('response' or 'revisit'),
    status, headers (map) and digest.  A full response has kind 'response' and status 200.  A revisit meets the
    latest full response of its canonical URL at a smaller ``at``, of several at one time that with the largest
    record_id.  The first validator that the revisit carries decides: ETag (weakly compared), Last-Modified, its
    digest.  resolution is 'resolved' if it agrees, 'changed' if it doesn't or the response lacks it, 'unverified'
    if the revisit has none, 'no_response' without an earlier response.  A resolved revisit gets the response's
    digest and headers, updated by its own fields but those that KEPT_FIELDS or its Connection field name; for
    the others merged and payload_digest are null, and refers_to still names the response that was met.

    Rows are dealt by ranges of (URL, time), so a URL with a third of all captures is spread over tasks in order
    of time; within a range a window carries the last response on, and a range starts with the last response of
    the ranges before it, one row per URL and range.  Payloads don't travel.  A null URL or time meets nothing;
    null headers are empty; repeated rows are resolved alike.  An empty table gives an empty result.  Columns
    with the result's names are replaced, other columns are kept.
    """
    fresh = ("canonical_url", "refers_to", "resolution", "merged", "payload_digest")
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("at").isNotNull()
    revisit = F.col("kind") == "revisit"
    row = F.struct(*[F.col(f"`{c}`") for c in captures.columns if c.lower() not in fresh])
    seen = F.struct(F.col("at").cast("bigint").alias("at"), F.col("record_id"), fields(F.col("headers")).alias("fields"), F.col("digest"))
    rows = captures.where(full | revisit).select(
        canonical_url(F.col("url")).alias("page"), F.col("at").cast("bigint").alias("time"), F.when(revisit, row).alias("row"),
        F.when(full, seen).alias("full"), F.when(full, F.struct(F.col("at").cast("bigint").alias("at"), F.col("record_id"))).alias("rank"),
    )
    # Equal (page, time) are never parted, so what earlier ranges hold is earlier.
    rows = written(rows.repartitionByRange("page", "time").withColumn("range", F.spark_partition_id()), "captures")
    earlier = Window.partitionBy("range", "page").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    ranges = rows.where("full is not null").groupBy("page", "range").agg(F.max_by("full", "rank").alias("last"), F.max("rank").alias("top"))
    # Carried to every range that holds the page, also those without a response of their own.
    held = rows.groupBy("page", "range").agg(F.count("*").alias("of")).join(ranges, ["page", "range"], "left")
    before = Window.partitionBy("page").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select("page", "range", F.max_by("last", "top").over(before).alias("carried"))
    met = rows.withColumn("near", F.max_by("full", "rank").over(earlier)).where("row is not null")
    met = met.join(carried.where("carried is not null"), ["page", "range"], "left")
    met = met.withColumn("met", F.when(F.col("page").isNotNull() & F.col("time").isNotNull(), F.coalesce("near", "carried")))
    met = met.withColumn("own", fields(F.col("row.headers")))
    old = F.col("met.fields")
    agrees = (
        F.when(_tag(F.col("own")).isNotNull(), _tag(F.col("own")).eqNullSafe(_tag(old)))
        .when(F.element_at("own", "last-modified").isNotNull(), F.element_at("own", "last-modified").eqNullSafe(F.element_at(old, "last-modified")))
        .when(F.col("row.digest").isNotNull(), F.col("row.digest").eqNullSafe(F.col("met.digest")))
    )
    resolution = F.when(F.col("met").isNull(), "no_response").when(agrees, "resolved").when(agrees.isNull(), "unverified").otherwise("changed")
    met = met.withColumn("resolution", resolution)
    done = F.col("resolution") == "resolved"
    return met.select(
        "row.*", F.col("page").alias("canonical_url"), F.col("met.record_id").alias("refers_to"), "resolution",
        F.when(done, merged(old, F.col("own"))).alias("merged"), F.when(done, F.col("met.digest")).alias("payload_digest"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Capture records of crawled pages: each page as a response, and two later requests for its URL.

    One asks with the page's ETag (every fifth with an outdated one), one with its date or, at every seventh page,
    with nothing; every eleventh page answers 404, and every third first request comes before the page itself.
    """
    at = F.col("page_id") * 10
    digest = F.md5("html")
    date = F.concat(F.lit("day "), at.cast("string"))
    response = F.create_map(
        F.lit("ETag"), F.concat(F.lit('"'), digest, F.lit('"')), F.lit("Last-Modified"), date, F.lit("Content-Type"), F.lit("text/html"),
        F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"),
    )
    tag = F.when(F.col("page_id") % 5 == 0, F.lit('"outdated"')).otherwise(F.concat(F.lit('W/"'), digest, F.lit('"')))
    first = F.create_map(F.lit("etag"), tag, F.lit("Cache-Control"), F.lit("max-age=3600"), F.lit("Content-Length"), F.lit("0"), F.lit("X-Hop"), F.lit("1"), F.lit("Connection"), F.lit("close, X-Hop"))
    second = F.when(F.col("page_id") % 7 == 0, F.create_map(F.lit("Age"), F.lit("5"))).otherwise(F.create_map(F.lit("Last-Modified"), date, F.lit("Age"), F.lit("5")))
    early = F.when(F.col("page_id") % 3 == 0, at - 5).otherwise(at + 3)
    record = lambda n, time, kind, status, headers, body: F.struct(
        (F.col("page_id") * 3 + n).alias("record_id"), "url", time.alias("at"), F.lit(kind).alias("kind"), status.cast("int").alias("status"), headers.alias("headers"), body.alias("digest")
    )
    none = F.lit(None).cast("string")
    rows = F.array(
        record(0, at, "response", F.when(F.col("page_id") % 11 == 0, 404).otherwise(200), response, digest),
        record(1, early, "revisit", F.lit(304), first, none),
        record(2, at + 7, "revisit", F.lit(304), second, none),
    )
    return pages.select(F.explode(rows).alias("r")).select("r.*")
