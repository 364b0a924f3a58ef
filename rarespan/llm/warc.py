"""WARC: not-modified revisits, resolved to the latest earlier full response of their canonical URL.

Records are (record_id, url, ts long, kind 'response' or 'revisit', status, etag, last_modified, digest,
headers map). A revisit's answer is the response with the largest (ts, record_id) among those of its
canonical URL with an earlier ts, and status 200. Validators are checked in the order ETag (weak
comparison), Last-Modified, payload digest: the first that the revisit carries decides. Of the revisit's
headers only those that a 304 may update replace the response's.

The as-of join is two-level, so that a URL with a third of all captures is no single task: captures fall
into spans of time, a (URL, span) is ordered on its own, and what a span inherits is the last response of
the spans before, one row per (URL, span). Bodies never move: a capture carries digests and headers only.

Defined results: a revisit without a url, without an earlier response or without a ts has no answer
('no_response'); one whose validator differs is 'mismatch' and keeps its answer's id, without headers; one
without validators is 'unverified' and merged; equal ts: a response is not earlier than a revisit of its
own ts; repeated rows are resolved alike; header names are lower-cased and the last of equal names counts;
an empty table gives an empty result. Columns besides those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a 304 may update (fixed values, RFC 9110 section 15.4.5 and RFC 9111 section 3.2).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that name no resource of their own (fixed values).
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"
#: Ports that a scheme implies (fixed values).
DEFAULT_PORTS = {"http": 80, "https": 443}
SPAN = 86_400


def canonical(url: Column) -> Column:
    """Host lower-cased without scheme, user, www. and the scheme's own port; path without last slash; sorted query without tracking."""
    part = lambda n: F.regexp_extract(url, r"(?s)^([^:/?#]+)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?", n)
    host, scheme = F.regexp_replace(F.regexp_replace(F.lower(part(2)), r"^www\d*\.", ""), ":$", ""), F.lower(part(1))
    for own, port in DEFAULT_PORTS.items():
        host = F.when(scheme == own, F.regexp_replace(host, f":{port}$", "")).otherwise(host)
    query = F.array_join(F.array_sort(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(part(1) != "", F.concat(host, F.regexp_replace(part(3), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def clean(headers: Column) -> Column:
    """A map with lower-cased names; the last of equal ones counts."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda x: x["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(F.transform(F.array(entries), last)[0]), F.create_map().cast("map<string,string>"))


def merged(response: Column, revisit: Column) -> Column:
    new = F.map_filter(revisit, lambda k, v: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(response, lambda k, v: ~F.map_contains_key(new, k)), new)


def resolve(records: DataFrame, span: int = SPAN) -> DataFrame:
    """(record_id, canonical_url, ts, refers_to, outcome, headers), one row per revisit."""
    rows = records.select("record_id", canonical(F.col("url")).alias("canonical_url"), "ts", "kind", "status", "etag", "last_modified", "digest", clean(F.col("headers")).alias("headers"))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    whole = F.struct("ts", "record_id", "etag", "last_modified", "digest", F.map_entries("headers").alias("entries"))
    usable = rows.where(F.col("canonical_url").isNotNull() & F.col("ts").isNotNull() & (full | (F.col("kind") == "revisit")))
    usable = usable.withColumns({"full": F.when(full, whole), "span": F.floor(F.col("ts") / span)})

    spans = usable.groupBy("canonical_url", "span").agg(F.max("full").alias("full"))
    before = W.partitionBy("canonical_url").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    inherited = spans.select("canonical_url", "span", F.last("full", ignorenulls=True).over(before).alias("inherited"))
    inside = W.partitionBy("canonical_url", "span").orderBy("ts", F.col("full").isNotNull(), "record_id").rowsBetween(W.unboundedPreceding, -1)
    found = usable.withColumn("answer", F.last("full", ignorenulls=True).over(inside)).where(F.col("kind") == "revisit").drop("full", "status", "kind")
    found = found.join(inherited, ["canonical_url", "span"], "left").withColumn("answer", F.coalesce("answer", "inherited"))

    weak = lambda c: F.regexp_replace(c, "^W/", "")
    same = F.when(F.col("etag").isNotNull(), weak(F.col("etag")) == weak(F.col("answer.etag")))
    same = same.when(F.col("last_modified").isNotNull(), F.col("last_modified") == F.col("answer.last_modified"))
    same = same.when(F.col("digest").isNotNull(), F.col("digest") == F.col("answer.digest"))
    checked = F.coalesce("etag", "last_modified", "digest").isNotNull()
    outcome = F.when(F.col("answer").isNull(), "no_response").when(~checked, "unverified").when(F.coalesce(same, F.lit(False)), "resolved").otherwise("mismatch")
    found = found.withColumn("outcome", outcome)
    kept = F.when(F.col("outcome").isin("resolved", "unverified"), merged(F.map_from_entries("answer.entries"), F.col("headers")))
    found = found.select("record_id", "canonical_url", "ts", F.col("answer.record_id").alias("refers_to"), "outcome", kept.alias("headers"))
    lost = rows.where((F.col("kind") == "revisit") & (F.col("canonical_url").isNull() | F.col("ts").isNull()))
    return found.unionByName(lost.select("record_id", "canonical_url", "ts", F.lit(None).cast(records.schema["record_id"].dataType).alias("refers_to"), F.lit("no_response").alias("outcome"), F.lit(None).cast("map<string,string>").alias("headers")))


def captures(pages: DataFrame) -> DataFrame:
    """A capture log of pages: each page's full response, and a revisit of it.

    Every fourth revisit comes before its own response, every fifth carries another ETag, and its URL
    differs in what the canonical form drops.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16), F.lit('"'))
    at, own = F.col("page_id") * 10, F.pmod("page_id", F.lit(4)) != 3
    length = F.length(F.coalesce("html", F.lit(""))).cast("string")
    base = pages.select("page_id", "url", tag.alias("tag"), at.alias("at"), F.when(own, at + 5).otherwise(at - 5).alias("again"), length.alias("length"), F.when(F.pmod("page_id", F.lit(5)) == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), "tag")).alias("validator"))
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")

    def record(offset, url, ts, kind, status, etag, *headers):
        return F.struct((F.col("page_id") * 2 + offset).alias("record_id"), url.alias("url"), F.col(ts).alias("ts"), F.lit(kind).alias("kind"), F.lit(status).alias("status"), F.col(etag).alias("etag"), none.alias("last_modified"), none.alias("digest"), F.create_map(*headers).alias("headers"))

    response = record(0, F.col("url"), "at", "response", 200, "tag", F.lit("ETag"), F.col("tag"), F.lit("Date"), text("at"), F.lit("Content-Length"), F.col("length"), F.lit("Cache-Control"), F.lit("max-age=60"))
    revisit = record(1, F.concat("url", F.lit("#again")), "again", "revisit", 304, "validator", F.lit("ETag"), F.col("validator"), F.lit("Date"), text("again"), F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=120"), F.lit("Set-Cookie"), F.lit("a=b"))
    return base.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")


def header_text(headers: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, page_id * 10 AS at, length(coalesce(html, '')) AS n,
    CASE WHEN page_id % 4 <> 3 THEN page_id * 10 + 5 ELSE page_id * 10 - 5 END AS again,
    CASE WHEN starts_with(lower(url), 'http://') AND ends_with(authority, ':80') THEN left(authority, length(authority) - 3) WHEN starts_with(lower(url), 'https://') AND ends_with(authority, ':443') THEN left(authority, length(authority) - 4) ELSE rtrim(authority, ':') END AS host,
    regexp_replace(regexp_extract(url, '(?s)^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1) AS query
  FROM (SELECT *, regexp_replace(lower(regexp_extract(url, '(?s)^[^:/?#]+://(?:[^/?#@]*@)?([^/?#]*)', 1)), '^www[0-9]*\.', '') AS authority FROM pages WHERE url IS NOT NULL)),
c AS (
  SELECT *, host || path || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))), '&'), ''), '') AS canonical_url,
    CASE WHEN page_id % 5 = 0 THEN '"other"' ELSE 'W/' || tag END AS validator FROM p),
j AS (
  SELECT v.page_id * 2 + 1 AS record_id, v.canonical_url, v.again AS ts, r.page_id * 2 AS refers_to, r.page_id IS NULL AS none,
    regexp_replace(v.validator, '^W/', '') = r.tag AS same, r.n, v.validator
  FROM c v ASOF LEFT JOIN c r ON v.canonical_url = r.canonical_url AND v.again > r.at)
SELECT record_id, canonical_url, ts, refers_to, CASE WHEN none THEN 'no_response' WHEN same THEN 'resolved' ELSE 'mismatch' END AS outcome,
  CASE WHEN same THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || n || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || validator END AS headers
FROM j
"""
