"""WARC not-modified revisits: an as-of join to the latest earlier full response."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import table

#: Headers of a 304 answer that replace those of the stored response.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
#: Seconds of capture time that one window task takes of one URL.
SLICE = 7 * 86400
NOT_MODIFIED = "server-not-modified"

RECORD = "record_id long, url string, ts long, kind string, profile string, etag string, last_modified string, digest string, headers map<string,string>"


def canonical(url: Column) -> Column:
    """Host and path of a URL by which captures are held to be of one resource.

    Scheme, ``www.``, port 80 or 443, user data, fragment, tracking parameters
    (utm_*, ref) and a slash or ``index.html`` at the end don't count; the host is lowered.
    """
    bare = F.regexp_replace(F.trim(url), "(?i)^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^.*@", ""), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/(index[.]html?)?$", "")
    query = F.regexp_replace(F.concat(F.lit("&"), F.regexp_extract(bare, "[?](.*)$", 1)), "&(utm_[a-z]+|ref)=[^&]*", "")
    query = F.regexp_replace(query, "^&+|&+$", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame, permitted: list[str] = PERMITTED, slice_seconds: int = SLICE) -> DataFrame:
    """Every revisit of ``records`` with the response it repeats.

    record_id, url_key, ts, status, original_id, original_ts, digest, headers.
    The original is the latest full response (kind ``response``) of the same
    canonical URL with a smaller ts; of several at that ts the one with the
    largest record_id.  status is ``resolved``; ``changed`` if both sides have
    an entity tag (weak comparison) and these differ, or, without a pair of
    tags, both have a modification date and these differ; ``unvalidated`` if
    there is no pair of either; ``missing`` without an original; ``other`` for
    a revisit of another profile, which is not joined.  Only a resolved row has digest and headers:
    those of the original, with the revisit's values for ``permitted`` names
    (lower case; header names are compared without case).

    A null url or ts makes a revisit ``missing`` and a response no original.
    Repeated rows stay.  A URL with very many captures is cut into slices of
    ``slice_seconds`` and has one row a second there; what a slice hands on to
    the next is one response, so no window is longer than a slice has seconds,
    however many captures a second has.
    """
    names = ["record_id", "url", "ts", "kind", "profile", "etag", "last_modified", "digest", "headers"]
    r = records.select(*(records[n] for n in names)).withColumn("url_key", canonical(F.col("url")))
    r = r.withColumn("asks", F.col("kind") == "revisit").withColumn("fits", F.col("asks") & F.col("profile").eqNullSafe(NOT_MODIFIED))
    joined = r.where("((fits OR kind = 'response') AND url_key IS NOT NULL AND ts IS NOT NULL)")
    joined = joined.withColumn("slice", F.floor(F.col("ts") / slice_seconds))
    lower = F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    joined = joined.withColumn("headers", lower)
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"))
    # one row for each second of a URL that has captures: no window holds more than the seconds of a slice
    last = F.max(F.when(F.col("kind") == "response", F.struct("ts", "record_id")))
    points = joined.groupBy("url_key", "slice", "ts").agg(last.alias("own"))
    in_slice = W.partitionBy("url_key", "slice").orderBy("ts").rowsBetween(W.unboundedPreceding, -1)
    carried = W.partitionBy("url_key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = points.groupBy("url_key", "slice").agg(F.max("own").alias("end"))
    slices = slices.withColumn("carry", F.max("end").over(carried)).select("url_key", "slice", "carry")
    points = points.withColumn("before", F.max("own").over(in_slice)).join(slices, ["url_key", "slice"])
    points = points.select("url_key", "ts", F.coalesce("before", "carry").alias("pick"))
    asks = joined.where("fits").join(points, ["url_key", "ts"])
    originals = joined.where("kind = 'response'").select("url_key", F.struct("ts", "record_id").alias("pick"), full.alias("o"))
    # rows that repeat an identical response count once
    originals = originals.groupBy("url_key", "pick").agg(F.max_by("o", F.struct(F.coalesce("o.digest", F.lit("")), F.coalesce("o.etag", F.lit("")), F.coalesce("o.last_modified", F.lit("")))).alias("o"))
    got = asks.join(originals, ["url_key", "pick"], "left")
    tags = F.col("etag").isNotNull() & F.col("o.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("o.last_modified").isNotNull()
    status = (
        F.when(F.col("o").isNull(), "missing")
        .when(tags, F.when(_weak(F.col("etag")) == _weak(F.col("o.etag")), "resolved").otherwise("changed"))
        .when(dates, F.when(F.col("last_modified") == F.col("o.last_modified"), "resolved").otherwise("changed"))
        .otherwise("unvalidated")
    )
    got = got.withColumn("status", status)
    ok = F.col("status") == "resolved"
    allowed = F.map_filter("headers", lambda k, _: k.isin(permitted))
    merged = F.map_concat(F.map_filter("o.headers", lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)
    got = got.select(
        "record_id", "url_key", "ts", "status", F.col("o.record_id").alias("original_id"), F.col("o.ts").alias("original_ts"),
        F.when(ok, F.col("o.digest")).alias("digest"), F.when(ok, merged).alias("headers"),
    )
    empty = [F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")]
    rest = r.where("asks AND NOT (fits AND url_key IS NOT NULL AND ts IS NOT NULL)").select(
        "record_id", "url_key", "ts", F.when(F.col("fits"), "missing").otherwise("other").alias("status"), *empty
    )
    return reduce(DataFrame.unionAll, [got, rest])


def records_of(pages: DataFrame) -> DataFrame:
    """Capture records of a crawl that fetched every page and asked for it again.

    Page p is fetched at p minutes with its hash as entity tag; 30 days later
    it is asked for again and answered 304, by a tag (every third page), by a
    date (every third + 1) or by both.  Every seventh page has changed meanwhile.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"))
    at = F.col("page_id") * 60
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    date = F.concat(F.lit("day-"), (F.col("page_id") % 28).cast("string"))
    changed = F.col("page_id") % 7 == 0
    seen = p.select(
        (F.col("page_id") * 2).alias("record_id"), "url", at.alias("ts"), F.lit("response").alias("kind"), F.lit(None).cast("string").alias("profile"), tag.alias("etag"), date.alias("last_modified"), "digest",
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Date"), at.cast("string"), F.lit("Server"), F.lit("one")).alias("headers"),
    )
    again_tag = F.when(F.col("page_id") % 3 != 1, F.when(changed, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag)))
    again_date = F.when(F.col("page_id") % 3 != 0, F.when(changed, F.lit("day-99")).otherwise(date))
    later = at + 30 * 86400
    asked = p.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("kind"), F.lit(NOT_MODIFIED).alias("profile"), again_tag.alias("etag"), again_date.alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("Date"), later.cast("string"), F.lit("Server"), F.lit("two"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
    )
    return seen.unionAll(asked)


def op6_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(records_of(table(spark, sf_dir, "pages")))
    header = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ";")
    return out.select("record_id", "url_key", "ts", "status", "original_id", "original_ts", "digest", header.alias("headers"))


_SQL = r"""
WITH p AS (SELECT page_id, url, sha256(coalesce(html, '')) AS digest FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS bare FROM p),
k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^.*@', ''), '^www[.]', ''), ':(80|443)$', '')
        || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/(index[.]html?)?$', '') AS stem,
        regexp_replace(regexp_replace('&' || regexp_extract(bare, '[?](.*)$', 1), '&(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&+|&+$', '', 'g') AS query FROM c),
n AS (SELECT page_id, digest, stem || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key,
        '"' || substr(digest, 1, 16) || '"' AS tag, 'day-' || CAST(page_id % 28 AS VARCHAR) AS day FROM k),
a AS (SELECT page_id, url_key, page_id * 60 + 2592000 AS ts,
        CASE WHEN page_id % 3 <> 1 THEN CASE WHEN page_id % 7 = 0 THEN '"other"' ELSE tag END END AS tag,
        CASE WHEN page_id % 3 <> 0 THEN CASE WHEN page_id % 7 = 0 THEN 'day-99' ELSE day END END AS day FROM n),
j AS (SELECT a.*, o.page_id AS o_page, o.digest AS o_digest, o.tag AS o_tag, o.day AS o_day
      FROM a LEFT JOIN n AS o ON o.url_key = a.url_key AND o.page_id = (SELECT max(x.page_id) FROM n AS x WHERE x.url_key = a.url_key AND x.page_id * 60 < a.ts)),
s AS (SELECT *, CASE WHEN o_page IS NULL THEN 'missing' WHEN tag IS NOT NULL THEN CASE WHEN tag = o_tag THEN 'resolved' ELSE 'changed' END
        WHEN day = o_day THEN 'resolved' ELSE 'changed' END AS status FROM j)
SELECT page_id * 2 + 1 AS record_id, url_key, ts, status, o_page * 2 AS original_id, o_page * 60 AS original_ts,
  CASE WHEN status = 'resolved' THEN o_digest END AS digest,
  CASE WHEN status = 'resolved' THEN 'cache-control:max-age=60;content-type:text/html;date:' || CAST(ts AS VARCHAR) || ';etag:' || o_tag || ';server:one' END AS headers
FROM s
"""
ORACLE_SQL = {"op6_warc_revisit": _SQL}
