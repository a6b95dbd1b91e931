"""Feed readers: RSS, Atom and JSON Feed bodies in a text column to headline rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import article_text, html_text
from ..functions.urls import AGGREGATORS, host, is_public_url, is_web

#: Shortest snippet that counts, longest that is kept, and the first second of 2000. Fixed values.
LEAST, MOST, FIRST = 40, 1200, 946_684_800
ITEM = "title string, link string, pubDate string, date string, published string, description string, content string, summary string, encoded string, source struct<_VALUE: string, _url: string>"
ENTRY = "title string, link array<struct<_href: string, _rel: string, _VALUE: string>>, published string, updated string, content string, summary string"


def parse_date(raw: Column, now: int) -> Column:
    """Unix seconds of an RFC 2822 or ISO 8601 date; null if it can't be read, lies before 2000 or over a day ahead."""
    bare = F.regexp_replace(F.trim(raw), "^[A-Za-z]{3}, *", "")
    forms = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z"]
    ts = F.coalesce(F.try_to_timestamp(raw), *[F.try_to_timestamp(bare, F.lit(f)) for f in forms])
    s = F.unix_seconds(ts)
    return F.when((s >= FIRST) & (s <= now + 86_400), s)


def pick_snippet(*fields: Column) -> Column:
    """The first field whose cleaned text is long enough."""
    clean = [html_text(F.coalesce(c, F.lit("")), MOST) for c in fields]
    return F.coalesce(*[F.when(F.length(c) >= LEAST, c) for c in clean])


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def read_rss(rows: DataFrame, body: str, now: int, cap: int = 20) -> DataFrame:
    """Headlines of RSS bodies, ``cap`` at most a body: title, url, published_at, snippet, item_source, item_source_url, pos. Items
    without title or link are left out; a body that is no RSS has none. An item's own source name and web address are
    kept beside it; the address stands in for a link that only leads through an aggregator."""
    parsed = F.from_xml(body, f"channel struct<item: array<struct<{ITEM}>>>")
    rows = rows.withColumn("__feed", parsed).select(*rows.columns, F.posexplode(F.slice(F.col("__feed.channel.item"), 1, cap)).alias("pos", "i"))
    i = F.col("i")
    date = F.coalesce(parse_date(i["pubDate"], now), parse_date(i["date"], now), parse_date(i["published"], now))
    link, address = _filled(i["link"]), _filled(i["source"]["_url"])
    address = F.when(is_web(address), address)
    url = F.when(address.isNotNull() & host(link).isin(AGGREGATORS), address).otherwise(link)
    out = rows.select(*[c for c in rows.columns if c not in ("i",)], _filled(i["title"]).alias("title"), url.alias("url"), date.alias("published_at"), pick_snippet(i["encoded"], i["content"], i["description"], i["summary"]).alias("snippet"), _filled(i["source"]["_VALUE"]).alias("item_source"), address.alias("item_source_url"))
    return out.where("title is not null and url is not null")


def read_atom(rows: DataFrame, body: str, now: int, cap: int = 20) -> DataFrame:
    """Headlines of Atom bodies; an entry's link is the first with an address (alternate before others)."""
    parsed = F.from_xml(body, f"entry array<struct<{ENTRY}>>")
    rows = rows.withColumn("__feed", parsed).select(*rows.columns, F.posexplode(F.slice(F.col("__feed.entry"), 1, cap)).alias("pos", "i"))
    i = F.col("i")
    hrefs = lambda cond: F.try_element_at(F.filter(F.transform(F.filter(i["link"], cond), lambda x: F.coalesce(_filled(x["_href"]), _filled(x["_VALUE"]))), lambda h: h.isNotNull()), F.lit(1))
    url = F.coalesce(hrefs(lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), hrefs(lambda x: F.lit(True)))
    date = F.coalesce(parse_date(i["published"], now), parse_date(i["updated"], now))
    out = rows.select(*[c for c in rows.columns if c not in ("i",)], _filled(i["title"]).alias("title"), url.alias("url"), date.alias("published_at"), pick_snippet(i["content"], i["summary"]).alias("snippet"))
    return out.where("title is not null and url is not null")


def read_json_feed(rows: DataFrame, body: str, now: int) -> DataFrame:
    """Headlines of JSON Feed bodies; the url falls back to external_url; snippets are measured before cleaning."""
    kind = "items array<struct<title: string, url: string, external_url: string, date_published: string, content_text: string, content_html: string, summary: string>>"
    rows = rows.withColumn("__feed", F.from_json(body, kind)).select(*rows.columns, F.posexplode("__feed.items").alias("pos", "i"))
    i = F.col("i")
    raw = F.coalesce(*[F.when(F.length(F.trim(i[c])) >= LEAST, F.trim(i[c])) for c in ("content_text", "content_html", "summary")])
    out = rows.select(*[c for c in rows.columns if c not in ("i",)], _filled(i["title"]).alias("title"), F.coalesce(_filled(i["url"]), _filled(i["external_url"])).alias("url"), parse_date(i["date_published"], now).alias("published_at"), html_text(raw, MOST).alias("snippet"))
    return out.where("title is not null and url is not null")


def fetched(spark, path: str, most: int = 1 << 20) -> DataFrame:
    """Bodies of a landing folder: path, body (cut at ``most`` bytes), and reason for those that are too long."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.decode(F.substring("content", 1, most), "UTF-8").alias("body"), F.when(F.col("length") > most, "body").alias("reason"))


def fetch_results(responses: DataFrame, cap: int = 20, most: int = 1 << 20) -> DataFrame:
    """Why a fetch (url, kind rss, atom or json, status, body) has no headlines, and whether it was sent and succeeded: reason, fetched,
    success, n. Reasons, the first that applies: ssrf (no public https address, not sent), network (no status), http (no 2xx), body
    (none, or over ``most`` characters), parse (no XML or JSON), extract (not the shape of its kind). n counts the
    items looked at, ``cap`` at most."""
    body, kind = F.col("body"), F.col("kind")
    json = F.try_parse_json(body)
    xml = F.rlike(body, F.lit("(?s)^\\s*(<\\?xml.*?\\?>)?\\s*(<!--.*?-->\\s*|<!DOCTYPE[^>]*>\\s*)*<[A-Za-z][^>]*>.*</[A-Za-z][^>]*>\\s*$"))
    items = F.when(kind == "json", F.size(F.from_json(body, "items array<string>")["items"])).when(kind == "atom", F.size(F.from_xml(body, "entry array<struct<title: string>>")["entry"])).otherwise(F.size(F.from_xml(body, "channel struct<item: array<struct<title: string>>>")["channel"]["item"]))
    root = F.when(kind == "json", F.schema_of_variant(json).startswith("OBJECT")).when(kind == "atom", F.rlike(body, F.lit("<([a-z]+:)?feed[\\s>]"))).otherwise(F.rlike(body, F.lit("<channel[\\s>]")))
    good = F.when(kind == "json", json.isNotNull()).otherwise(xml)
    status = F.col("status")
    reason = (
        F.when(~is_public_url(F.coalesce("url", F.lit(""))), "ssrf").when(status.isNull(), "network").when((status < 200) | (status > 299), "http")
        .when(body.isNull() | (F.length(body) > most), "body").when(~F.coalesce(good, F.lit(False)), "parse").when(~F.coalesce(root, F.lit(False)), "extract")
    )
    out = responses.withColumn("reason", reason)
    n = F.when(F.col("reason").isNull(), F.least(F.greatest(F.coalesce(items, F.lit(0)), F.lit(0)), F.lit(cap))).otherwise(0)
    return out.withColumns({"fetched": ~F.col("reason").eqNullSafe("ssrf"), "success": F.col("reason").isNull(), "n": n.cast("long")})


def article_bodies(pages: DataFrame, most: int = 1_500_000, least: int = 100) -> DataFrame:
    """``pages`` (url, status, content_type, html) with the article's text: of public addresses that answered 2xx with HTML, plain text, XML or no
    type, cut after ``most`` bytes; null where the gate is shut or the text is shorter than ``least``."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    typed = (kind == "") | F.contains(kind, F.lit("html")) | F.contains(kind, F.lit("text/plain")) | F.contains(kind, F.lit("application/xml"))
    cut = F.when(F.octet_length("html") > most, F.decode(F.substring(F.encode("html", "UTF-8"), 1, most), "UTF-8")).otherwise(F.col("html"))
    text = article_text(cut)
    open_ = is_public_url(F.coalesce("url", F.lit(""))) & F.col("status").between(200, 299) & typed
    return pages.withColumn("text", F.when(F.coalesce(open_, F.lit(False)) & (F.length(text) >= least), text))
