"""Resolution of not-modified revisit records to the responses that they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored

#: Query parameters that do not change the page, and headers that a not-modified answer may not update. Fixed values.
TRACKING = r"^(utm_[a-z_]+|ref|fbclid|gclid|msclkid|mc_[a-z]+)$"
FORBIDDEN = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade"]


def canonical_url(url: Column) -> Column:
    """Scheme, user, default port, fragment, tracking parameters and trailing slashes dropped, host in lower case, parameters
    sorted; null for a null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.rlike(F.lower(F.split(p, "=")[0]), F.lit(TRACKING))))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def resolve_revisits(records: DataFrame, block_rows: int = 100_000) -> DataFrame:
    """For each not-modified revisit record (warc_type 'revisit', status 304): record_id, url, ts, outcome, refers_to,
    headers, payload.

    ``records`` has record_id (string), warc_type, status, target_uri, ts (long), headers (map, lower-case names) and
    payload. The referent is the latest full response (warc_type 'response', status 200) of the same canonical URL with an
    earlier ts; at equal ts the largest record_id. outcome is 'resolved' if the revisit's validators fit: its etag
    equals the referent's (weakly, so W/ is ignored), or, without an etag, its last-modified does; 'mismatch' if they
    differ, 'unverifiable' if the revisit has none or the referent lacks it, 'missing' without a referent. Only a resolved
    revisit gets headers (the referent's, updated by the revisit's permitted ones) and payload. Records with a null URL, ts or
    record_id never are referents; such revisits are 'missing'. Of responses that share a record_id the one of the largest
    ts counts, then of the largest hash of its content; revisits that share one are resolved each by its own headers, and
    a revisit that repeats gives as many rows. Columns of other names are ignored; an empty table gives an empty result.

    The as-of join runs over distinct (URL, ts), dealt into blocks by ranges of both; a block's last response is carried into
    the URL's later blocks in a second, small step. No task gathers all captures of a hot URL or of one ts.
    """
    tie = F.xxhash64(F.array_sort(F.map_entries("headers")), "target_uri", "payload")
    keys = records.select(
        "record_id", "warc_type", "status", canonical_url(F.col("target_uri")).alias("url"), F.col("ts").cast("long").alias("ts"),
        F.regexp_replace(F.col("headers")["etag"], "^W/", "").alias("etag"), F.col("headers")["last-modified"].alias("modified"), tie.alias("tie"), "target_uri",
    )
    whole = F.col("record_id").isNotNull() & F.col("target_uri").isNotNull() & F.col("ts").isNotNull()
    full = F.coalesce((F.col("warc_type") == "response") & (F.col("status") == 200) & whole, F.lit(False))
    ask = F.coalesce((F.col("warc_type") == "revisit") & (F.col("status") == 304), F.lit(False))
    keys = stored(keys.select("*", full.alias("full"), ask.alias("ask")).where("full or ask"), "captures")
    one = keys.where("full").groupBy("record_id").agg(F.max(F.struct("ts", "tie", "url", "etag", "modified")).alias("r")).select("record_id", "r.*")
    latest = one.groupBy("url", "ts").agg(F.max(F.struct("record_id", "etag", "modified")).alias("source"))
    asks = keys.where("ask and url is not null and ts is not null").select("url", "ts").distinct()
    events = latest.withColumn("asked", F.lit(False)).unionByName(asks.withColumns({"source": F.lit(None).cast(latest.schema["source"].dataType), "asked": F.lit(True)}))
    events = stored(events.groupBy("url", "ts").agg(F.max("source").alias("source"), F.max("asked").alias("asked")), "events")
    blocks = max(1, -(-events.count() // block_rows))
    events = stored(events.repartitionByRange(blocks, "url", "ts").withColumn("block", F.spark_partition_id()), "blocks")
    lasts = events.groupBy("url", "block").agg(F.max(F.when(F.col("source").isNotNull(), F.struct("ts", "source"))).alias("last"))
    carried = lasts.withColumn("carry", F.last("last", ignorenulls=True).over(W.partitionBy("url").orderBy("block").rowsBetween(W.unboundedPreceding, -1))["source"])
    within = F.last("source", ignorenulls=True).over(W.partitionBy("url", "block").orderBy("ts").rowsBetween(W.unboundedPreceding, -1))
    answers = events.withColumn("near", within).where("asked").join(carried.select("url", "block", "carry"), ["url", "block"])
    answers = stored(answers.select("url", "ts", F.coalesce("near", "carry").alias("near")), "answers")
    known = F.col("near").isNotNull()
    fit = F.when(F.col("etag").isNotNull(), F.col("etag") == F.col("near.etag")).otherwise(F.col("modified") == F.col("near.modified"))
    outcome = F.when(~known, "missing").when(fit.isNull(), "unverifiable").when(fit, "resolved").otherwise("mismatch")
    asked = keys.where("ask").join(answers, ["url", "ts"], "left")
    asked = stored(asked.select("record_id", "url", "ts", "tie", outcome.alias("outcome"), F.when(known, F.col("near.record_id")).alias("refers_to")), "asked")
    permitted = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: ~F.lower(k).isin(FORBIDDEN))
    own = records.where(ask).select(F.col("record_id").alias("__id"), F.col("ts").cast("long").alias("__ts"), tie.alias("__tie"), permitted.alias("__new")).dropDuplicates(["__id", "__ts", "__tie"])
    bodies = records.where(full).groupBy(F.col("record_id").alias("refers_to")).agg(F.max_by(F.struct(F.col("headers").alias("__old"), "payload"), F.struct(F.col("ts").cast("long"), tie)).alias("r")).select("refers_to", "r.*")
    done = asked.where("outcome = 'resolved'").join(bodies, "refers_to")
    done = done.join(own, F.col("record_id").eqNullSafe(F.col("__id")) & (F.col("ts") == F.col("__ts")) & (F.col("tie") == F.col("__tie")))
    old = F.map_filter(F.coalesce("__old", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(F.col("__new")), k))
    done = done.select("record_id", "url", "ts", "outcome", "refers_to", F.map_concat(old, F.col("__new")).alias("headers"), "payload")
    rest = asked.where("outcome <> 'resolved'").select("record_id", "url", "ts", "outcome", "refers_to", F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast(dict(records.dtypes)["payload"]).alias("payload"))
    return done.unionByName(rest)


def captures(pages: DataFrame) -> DataFrame:
    """A capture log over a table of pages (page_id, url, html): each page's response, for a third of the pages a
    later response with another etag, and for each page a not-modified revisit, some of them with a stale etag, with
    last-modified alone, or without validators."""
    p, quote = F.col("page_id"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    etag = quote(F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16))
    text, modified = lambda c: c.cast("string"), F.concat(F.lit("m"), (p % 7).cast("string"))
    size = text(F.octet_length(F.coalesce("html", F.lit(""))))
    full = lambda e: F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), size, F.lit("etag"), e, F.lit("last-modified"), modified)
    sent = F.create_map(F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.lit("0"), F.lit("etag"), F.when(p % 4 != 3, F.when(p % 5 == 0, '"stale"').otherwise(etag)), F.lit("last-modified"), F.when(p % 8 != 7, modified))
    row = lambda prefix, kind, status, ts, headers, body: pages.select(F.concat(F.lit(prefix), text(p)).alias("record_id"), F.lit(kind).alias("warc_type"), F.lit(status).alias("status"), F.col("url").alias("target_uri"), ts.alias("ts"), headers.alias("headers"), body.alias("payload"))
    first = row("r", "response", 200, p * 10, full(etag), F.col("html"))
    second = row("s", "response", 200, p * 10 + 3, full(quote(F.lit("new"))), F.col("html")).where("cast(substring(record_id, 2) as long) % 3 = 0")
    again = row("v", "revisit", 304, p * 10 + 1 + p % 5, F.map_filter(sent, lambda k, v: v.isNotNull()), F.lit(None).cast("string"))
    return first.unionByName(second).unionByName(again)


ORACLE = f"""
WITH u AS (SELECT page_id AS p, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS bare FROM pages),
q AS (SELECT *, regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), ':(80|443)$', '') || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS head,
  list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(string_split(x, '=')[1]), '{TRACKING}'))) AS args FROM u),
c AS (SELECT p, html, head || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS url, '"' || md5(coalesce(html, ''))[1:16] || '"' AS etag, 'm' || (p % 7) AS modified FROM q),
r AS (SELECT 'r' || p AS rid, url, p * 10 AS ts, etag, modified, html FROM c UNION ALL SELECT 's' || p, url, p * 10 + 3, '"new"', modified, html FROM c WHERE p % 3 = 0),
v AS (SELECT 'v' || p AS record_id, url, p * 10 + 1 + p % 5 AS ts, CASE WHEN p % 4 <> 3 THEN CASE WHEN p % 5 = 0 THEN '"stale"' ELSE etag END END AS etag, CASE WHEN p % 8 <> 7 THEN modified END AS modified FROM c),
a AS (SELECT v.*, rid, r.etag AS e0, r.modified AS m0, html FROM v ASOF LEFT JOIN r ON v.url = r.url AND v.ts > r.ts),
o AS (SELECT *, CASE WHEN rid IS NULL THEN 'missing' WHEN coalesce(etag, modified) IS NULL THEN 'unverifiable' WHEN CASE WHEN etag IS NOT NULL THEN etag = e0 ELSE modified = m0 END THEN 'resolved' ELSE 'mismatch' END AS outcome FROM a)
SELECT record_id, url, ts, outcome, rid AS refers_to,
  CASE WHEN outcome = 'resolved' THEN 'cache-control=max-age=60;content-length=' || octet_length(encode(coalesce(html, ''))) || ';content-type=text/html;etag=' || coalesce(etag, e0) || ';last-modified=' || coalesce(modified, m0) END AS headers,
  CASE WHEN outcome = 'resolved' THEN sha256(html) END AS payload_sha256
FROM o
"""


def digest(resolved: DataFrame) -> DataFrame:
    """Resolved rows with headers as one string, in key order; their payload must be its hash already."""
    keys = F.array_sort(F.map_keys("headers"))
    line = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), F.col("headers")[k])), ";")
    return resolved.select("record_id", "url", "ts", "outcome", "refers_to", line.alias("headers"), F.col("payload").alias("payload_sha256"))
