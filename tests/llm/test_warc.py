import datetime as dt
import random

from pyspark.sql import functions as F

from compare import check, connect
from graphloom.llm import queries, warc

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "record_id long, url string, ts timestamp, kind string, etag string, last_modified string, headers map<string, string>"


def test_query(spark, sf):
    check(queries.op5_warc(spark, sf), connect(sf), queries.ORACLE_SQL["op5_warc"])


def test_canonical_url(spark):
    same = ["http://www.Example.com:80/a/?b=2&a=1&utm_source=x#f", "https://user@example.com/a?a=1&b=2", "HTTP://EXAMPLE.COM/a?a=1&b=2&ref=z", " https://example.com:443/a?&a=1&b=2"]
    others = ["no url ", None, "", "http://example.com", "http://example.com/a?refer=1"]
    df = spark.createDataFrame([(u,) for u in same + others], "u string").select("u", warc.canonical_url(F.col("u")).alias("c")).collect()
    assert {r["c"] for r in df[:4]} == {"example.com/a?a=1&b=2"}
    assert [r["c"] for r in df[4:]] == ["no url", None, "", "example.com", "example.com/a?refer=1"]


def brute(rows):
    out = []
    for i, url, ts, kind, etag, changed, _ in rows:
        if kind != "revisit":
            continue
        old = [r for r in rows if r[3] == "response" and url is not None and r[1] == url and ts is not None and r[2] is not None and (r[2], r[0]) < (ts, i)]
        if not old:
            out.append((i, "orphan", None))
            continue
        r = max(old, key=lambda r: (r[2], r[0]))
        strip = lambda e: e.removeprefix("W/")
        both = [(a, b) for a, b in ((etag and strip(etag), r[4] and strip(r[4])), (changed, r[5])) if a is not None and b is not None]
        status = "mismatch" if any(a != b for a, b in both) else "resolved" if both else "unvalidated"
        out.append((i, status, r[0] if status != "mismatch" else None))
    return sorted(out)


def test_as_of_join_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        url = rng.choice(["hot.example/a"] * 3 + ["b.example/x", "c.example/y", None])
        ts = rng.choice([None, *[T0 + dt.timedelta(seconds=s) for s in range(0, 300, 10)]])
        rows.append((i, url, ts, rng.choice(["response", "revisit", "revisit", "request"]), rng.choice([None, "1", "W/1", "2"]), rng.choice([None, "m", "n"]), {"Date": str(i)}))
    df = spark.createDataFrame(rows, SCHEMA)
    for bucket in (7, 100, 86_400):
        got = sorted((r["record_id"], r["status"], r["response_id"]) for r in warc.resolve(df, bucket).collect())
        assert got == brute(rows)


def test_headers_and_odd_rows(spark):
    stored = {"Content-Type": "text/html", "ETag": "1", "etag": "again", "Date": "old", "X": None}
    fresh = {"date": "new", "Content-Length": "0", "Cache-Control": "max-age=1"}
    rows = [(1, "u", T0, "response", "1", None, stored), (2, "u", T0 + dt.timedelta(hours=1), "revisit", "1", None, fresh), (3, "u", T0, "revisit", None, None, None), (4, "u", T0 + dt.timedelta(hours=2), "revisit", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("bucket", F.lit("clash")).withColumn("canonical", F.lit("clash"))
    got = {r["record_id"]: r for r in warc.resolve(df).collect()}
    assert got[2]["headers"] == {"content-type": "text/html", "etag": "1", "date": "new", "cache-control": "max-age=1", "x": None}
    assert (got[2]["status"], got[2]["response_id"], got[2]["age_seconds"]) == ("resolved", 1, 3600.0)
    assert got[3]["status"] == "unvalidated" and got[3]["response_id"] == 1 and got[4]["status"] == "unvalidated" and got[4]["headers"]["date"] == "old"
    assert warc.resolve(df.limit(0)).count() == 0


def test_text_record_ids(spark):
    rows = [("urn:b", "u", T0, "response", "1", None, {}), ("urn:a", "u", T0, "revisit", "1", None, {}), ("urn:c", "u", T0, "revisit", "1", None, {}), ("urn:d", None, None, "revisit", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA.replace("record_id long", "record_id string"))
    got = {r["record_id"]: (r["status"], r["response_id"]) for r in warc.resolve(df).collect()}
    assert got == {"urn:a": ("orphan", None), "urn:c": ("resolved", "urn:b"), "urn:d": ("orphan", None)}
