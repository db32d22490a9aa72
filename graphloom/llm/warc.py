"""WARC not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

A revisit record says that a server answered "not modified"; it carries validators and a few headers, no body. It
is resolved to the latest earlier full response of its canonical URL, if the validators agree; the response's headers are
then updated with those that such an answer may change.

The as-of join has two levels: within a bucket of time of a URL, rows are ordered and the last response is carried
forward; across buckets, each bucket hands on its last response. So a URL that holds a third of all records
is ordered by buckets in many tasks. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Header fields that a 304 answer updates, and query parameters that do not name a resource.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "sessionid", "phpsessid", "jsessionid")
_URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """The resource a URL names: scheme, user, "www.", default port, fragment, tracking parameters and a trailing slash go;
    the host is lower-cased, parameters are sorted. Text that is no URL stays, trimmed; null stays null."""
    part = lambda k: F.regexp_extract(url, _URL, k)
    host = F.regexp_replace(F.lower(F.regexp_replace(part(2), r"^.*@", "")), r"(:80|:443|:)$", "")
    host = F.regexp_replace(host, r"^www[0-9]?\.", "")
    path = F.regexp_replace(part(3), r"/+$", "")
    names = "|".join(TRACKING)
    wanted = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^({names})(=|$)"))
    query = F.array_join(F.array_sort(wanted), "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(url.rlike(_URL), whole).otherwise(F.trim(url))


def merge_headers(base: Column, update: Column, permitted: tuple[str, ...] = PERMITTED) -> Column:
    """``base`` with the permitted fields of ``update``: names are lower-cased, of names that differ in case the first in order counts."""
    entries = lambda m: F.transform(F.array_sort(F.coalesce(F.map_entries(m), F.array().cast("array<struct<key: string, value: string>>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    allowed = F.filter(entries(update), lambda e: e["key"].isin(*permitted))
    all_of = F.concat(allowed, entries(base))
    names = F.array_sort(F.array_distinct(F.transform(all_of, lambda e: e["key"])))
    return F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("key"), F.filter(all_of, lambda e: e["key"] == k)[0]["value"].alias("value"))))


def resolve(records: DataFrame, bucket_seconds: int = 86_400, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """Resolve records(record_id of any type that has an order, url, ts timestamp, kind, etag, last_modified, headers map<string, string>), kind being
    "response" or "revisit".

    Gives for each revisit (record_id, canonical, ts, status, response_id, age_seconds, headers). The response is the one with
    the largest (ts, record_id) below the revisit's. status: "resolved", "mismatch" (a validator that both have
    differs; strong comparison of etags, W/ aside), "unvalidated" (no validator in common), "orphan" (no response).
    headers: merged where resolved or unvalidated, else the revisit's own. Null urls and times resolve to nothing
    (orphan); an id that is repeated is as many records, each resolved alike; other columns are not read; an empty
    table gives an empty result.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "ts", "kind", "etag", "last_modified", "headers")
    rows = rows.where(F.col("kind").isin("response", "revisit"))
    kind = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in ("ts", "record_id", "etag", "last_modified", "headers")])
    known = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    lost = rows.where(~known & (F.col("kind") == "revisit")).withColumn("r", F.lit(None).cast(kind))
    rows = rows.where(known).withColumn("bucket", F.floor(F.unix_micros("ts") / F.lit(bucket_seconds * 1_000_000)))
    rows = rows.withColumn("own", F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "headers")))
    key = ["canonical", "bucket"]
    ends = rows.groupBy(*key).agg(F.max_by("own", F.when(F.col("kind") == "response", F.struct("ts", "record_id"))).alias("end"))
    across = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*key, F.last("end", ignorenulls=True).over(across).alias("before"))
    # of records of the same time and id, revisits stand first: a response beside them is not earlier
    within = Window.partitionBy(*key).orderBy("ts", "record_id", F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    asof = rows.withColumn("here", F.last("own", ignorenulls=True).over(within)).where("kind = 'revisit'")
    asof = asof.join(before, key).withColumn("r", F.coalesce("here", "before")).select(*lost.columns)
    both = asof.unionByName(lost)
    strong = lambda c: F.regexp_replace(c, r"^W/", "")
    has = lambda name: F.col(name).isNotNull() & F.col(f"r.{name}").isNotNull()
    differ = (has("etag") & (strong(F.col("etag")) != strong(F.col("r.etag")))) | (has("last_modified") & (F.col("last_modified") != F.col("r.last_modified")))
    status = F.when(F.col("r").isNull(), "orphan").when(differ, "mismatch").when(has("etag") | has("last_modified"), "resolved").otherwise("unvalidated")
    merged = merge_headers(F.col("r.headers"), F.col("headers"), permitted)
    both = both.withColumn("status", status)
    usable = F.col("status").isin("resolved", "unvalidated")
    age = (F.unix_micros("ts") - F.unix_micros("r.ts")) / F.lit(1e6)
    return both.select("record_id", "canonical", "ts", "status", F.when(usable, F.col("r.record_id")).alias("response_id"), F.when(usable, age).alias("age_seconds"), F.when(usable, merged).otherwise(F.col("headers")).alias("headers"))


def records_of(pages: DataFrame) -> DataFrame:
    """A crawl log over pages(page_id, url, html): page k is fetched in minute k and answered in full, unless k mod 3 is 2
    and the server says "not modified". Half an hour later each page is asked again by another spelling of its URL,
    and not modified; the validators of every seventh have changed."""
    k, url = F.col("page_id"), F.col("url")
    tag, day = F.md5(F.col("html")), F.date_format(F.timestamp_seconds(k * 60), "yyyy-MM-dd HH:mm:ss")
    header = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    first = F.struct(
        (k * 2).alias("record_id"), url.alias("url"), F.timestamp_seconds(k * 60).alias("ts"), F.when(k % 3 == 2, "revisit").otherwise("response").alias("kind"),
        F.when(k % 5 < 4, tag).alias("etag"), F.when(k % 2 == 0, day).alias("last_modified"),
        header("Date", day, "Content-Type", "text/html", "Content-Length", F.length("html").cast("string"), "ETag", F.coalesce(tag, F.lit(""))).alias("headers"),
    )
    other = F.concat(F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^https?", "HTTPS"), F.lit("#again"))
    second = F.struct(
        (k * 2 + 1).alias("record_id"), other.alias("url"), F.timestamp_seconds(k * 60 + 1800).alias("ts"), F.lit("revisit").alias("kind"),
        F.when(k % 5 < 4, F.when(k % 7 == 0, F.concat(F.lit("new"), tag)).otherwise(F.concat(F.lit("W/"), tag))).alias("etag"), F.when(k % 2 == 0, day).alias("last_modified"),
        header("date", F.concat(F.lit("later "), day), "content-length", "0", "Cache-Control", "max-age=60").alias("headers"),
    )
    return pages.select(F.explode(F.array(first, second)).alias("r")).select("r.*")
